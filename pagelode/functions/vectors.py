"""Vector expressions over arrays. Codes are widened to BIGINT before any product (ANSI arithmetic is on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the codecs.
TERNARY_EDGE = 42
TERNARY_LEVEL = 127
TERNARY_AT, PQ_AT = 100, 2000


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda inside the body uses it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fit(vector: Column, dims: int) -> Column:
    """Padded with zeros or cut to ``dims`` entries."""
    padded = F.concat(F.transform(vector, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dims))
    return F.slice(padded, 1, dims)


def quantize_params(vector: Column, dims: int) -> Column:
    """struct(min, range) of the affine code; a flat vector has range 1."""

    def params(v: Column) -> Column:
        low, span = F.array_min(v), F.array_max(v) - F.array_min(v)
        return F.struct(low.alias("min"), F.when(F.abs(span) < 1e-10, F.lit(1.0)).otherwise(span).alias("range"))

    return let(fit(vector, dims), params)


def quantize(vector: Column, params: Column, dims: int) -> Column:
    """Codes -128..127, rounded half up: floor(x + 0.5)."""
    return let(params, lambda p: F.transform(
        fit(vector, dims),
        lambda x: F.floor((x - p["min"]) / p["range"] * F.lit(255.0) - F.lit(128.0) + F.lit(0.5)).cast("tinyint"),
    ))


def dot_int(a: Column, b: Column) -> Column:
    """Exact integer dot product over the entries that both have."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("bigint") * y.cast("bigint"))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x)


def norm_int(a: Column) -> Column:
    return F.sqrt(dot_int(a, a).cast("double"))


def cosine_int(a: Column, b: Column, norm_a: Column | None = None) -> Column:
    """Cosine of codes; 0 where a norm is 0. Exact sums before one square root each and one division; a known norm is not computed again."""
    norm = (norm_int(a) if norm_a is None else norm_a) * norm_int(b)
    return let(norm, lambda n: dot_int(a, b).cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def dot_float(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)).cast("double") * F.coalesce(y, F.lit(0.0)).cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot_float(a, a))


def cosine_float(query: Column, vector: Column) -> Column:
    """Cosine of floats; 0 where the vector's norm is below 1e-10."""
    norm = l2_norm(vector)
    return F.when(norm < 1e-10, F.lit(0.0)).otherwise(dot_float(query, vector) / (l2_norm(query) * norm))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(l2_norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def is_nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def ternary(codes: Column) -> Column:
    """The lossy projection that packing and unpacking amounts to: -127, 0 or 127."""
    return F.transform(
        codes,
        lambda q: F.when(q < -TERNARY_EDGE, F.lit(-TERNARY_LEVEL)).when(q > TERNARY_EDGE, F.lit(TERNARY_LEVEL))
        .otherwise(F.lit(0)).cast("tinyint"),
    )


def ternary_pack(codes: Column) -> Column:
    """Two bits a value, four values a byte, the first in the lowest bits; as BINARY."""
    trits = F.transform(
        codes, lambda q: F.when(q < -TERNARY_EDGE, F.lit(0)).when(q > TERNARY_EDGE, F.lit(2)).otherwise(F.lit(1))
    )
    at = lambda i: F.coalesce(F.get(trits, i), F.lit(0))
    count = F.ceil(F.size(codes) / 4).cast("int")
    hexes = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.lpad(F.hex(at(k * 4) + at(k * 4 + 1) * 4 + at(k * 4 + 2) * 16 + at(k * 4 + 3) * 64), 2, "0"),
    )
    return F.unhex(F.array_join(hexes, ""))


def ternary_unpack(packed: Column, dims: Column | int) -> Column:
    """Codes back from packed bytes; the bit pairs 1 and 3 both give 0."""
    dims = dims if isinstance(dims, Column) else F.lit(dims)
    text = F.hex(packed)

    def value(i: Column) -> Column:
        byte = F.conv(F.substring(text, F.floor(i / 4).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
        pair = F.floor(byte / F.pow(F.lit(4.0), F.pmod(i, F.lit(4)))).cast("int") % 4
        return F.when(pair == 0, F.lit(-TERNARY_LEVEL)).when(pair == 2, F.lit(TERNARY_LEVEL)).otherwise(F.lit(0)).cast("tinyint")

    return F.when(dims > 0, F.transform(F.sequence(F.lit(0), dims - 1), value)).otherwise(F.array().cast("array<tinyint>"))


def compression_for(count: Column) -> Column:
    """Which codec a run of that many chunks uses; ``pq`` is a label for the ternary payload."""
    return F.when(count >= PQ_AT, F.lit("pq")).when(count >= TERNARY_AT, F.lit("ternary")).otherwise(F.lit("none"))
