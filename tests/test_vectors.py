import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.functions import vectors as vx


def codes_of(spark, rows, dims):
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    p = vx.quantize_params(F.col("v"), dims)
    return [tuple(r["c"]) for r in df.select(vx.quantize(F.col("v"), p, dims).alias("c")).collect()]


def reference(v, dims):
    v = (list(v) + [0.0] * dims)[:dims]
    low, span = min(v), max(v) - min(v)
    span = 1.0 if abs(span) < 1e-10 else span
    return tuple(int(np.floor((x - low) / span * 255 - 128 + 0.5)) for x in v)


def test_quantize_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=n).tolist() for n in (8, 8, 5, 11)] + [[0.0] * 8, [3.0] * 8, [0, 1, 0.5, 0.1, 0, 0, 0, 1.0]]
    rows = [[float(x) for x in r] for r in rows]
    got = codes_of(spark, rows, 8)
    assert got == [reference(r, 8) for r in rows]
    assert all(-128 <= c <= 127 for r in got for c in r)
    assert got[4] == (-128,) * 8


def test_ternary_values_and_pack(spark):
    v = [90, -61, 7, -128, 44, -9, 0, 126]
    df = spark.createDataFrame([(v,), ([42, -42, 43, -43, 5, 6, 7, 8, 127],), ([],)], "v array<tinyint>")
    rows = df.select(
        vx.ternary(F.col("v")).alias("t"), vx.ternary_unpack(vx.ternary_pack(F.col("v")), F.size("v")).alias("u"), F.length(vx.ternary_pack(F.col("v"))).alias("n")
    ).collect()
    assert rows[0]["t"] == [127, -127, 0, -127, 127, 0, 0, 127]
    assert rows[1]["t"] == [0, 0, 127, -127, 0, 0, 0, 0, 127]
    assert [r["u"] for r in rows] == [r["t"] for r in rows]
    assert [r["n"] for r in rows] == [2, 3, 0]


def test_cosine(spark):
    df = spark.createDataFrame([([127, -128, 3], [127, -128, 3]), ([0, 0, 0], [1, 2, 3]), ([1, 0, 0], [0, 1, 0])], "a array<tinyint>, b array<tinyint>")
    got = [r[0] for r in df.select(vx.cosine_int(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0])


@pytest.mark.parametrize("n, kind", [(0, "none"), (99, "none"), (100, "ternary"), (1999, "ternary"), (2000, "pq"), (7_654_321, "pq")])
def test_compression_policy(spark, n, kind):
    from pagelode.sources.store import compression_type

    assert compression_type(n) == kind
    assert spark.range(1).select(vx.compression_for(F.lit(n))).first()[0] == kind


def test_normalize_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vx.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
