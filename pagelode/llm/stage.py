"""Cutting lineage in the shared checkpoint folder, and joins whose cost is alike at every size."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.session import cut_lineage as cut

#: Rows of a narrow side (one row an index, source or setting) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Bits of a key filter: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26
#: Most keys that are looked up apart as hot.
HOT_KEYS = 10_000


def small_side(df: DataFrame) -> DataFrame:
    """A narrow table with a row an index, source or setting, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Has shuffle files and broadcasts removed that no table in use needs; else they stay until the driver happens to collect its garbage.

    Tables that Python has let go are made known to the JVM by a thread that looks once a second.
    """
    gc.collect()
    until = time.monotonic() + 1.5
    while getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None) and time.monotonic() < until:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


def key_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true of every key in the table, and seldom of others.

    The table is a Bloom filter of ``FILTER_BITS`` bits, three a key. The more keys there
    are, the more others pass: 1 % at six million, a third at 25 million, all in the end.
    So a step that works on what passes costs ever more towards all rows, and its result
    must not depend on what passes too much. The driver and every task hold 8 MB.
    """
    h = F.xxhash64(F.col(key), F.lit(41))
    mask = FILTER_BITS - 1
    first, second, third = (F.shiftrightunsigned(h, n).bitwiseAND(F.lit(mask)) for n in (0, 26, 38))
    places = F.array(first, second, first.bitwiseXOR(third))
    at = keys.where(F.col(key).isNotNull()).select(F.explode(places).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")).alias("bits"))
    got = words.toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        own = sent.value
        x = hashes.to_numpy().view(np.uint64)
        first, second, third = (x >> np.uint64(n) & np.uint64(mask) for n in (0, 26, 38))
        out = np.ones(len(x), dtype=bool)
        for place in (first, second, first ^ third):
            out &= (own[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    return lambda column: held(F.xxhash64(column, F.lit(41)))


def first_delivery(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per key: the columns of its earliest delivery.

    Null keys are left out; a null time counts as the latest; ties go to the smallest
    row hash, so the result is the same on every run. The keys that were delivered more
    than once are found by their keys alone. Rows that their filter lets through are
    shuffled and aggregated, all others pass as they are. A key that was delivered very
    often is aggregated before the shuffle.
    """
    rows = df.where(F.col(key).isNotNull())
    again = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    suspect = key_filter(again, key)(F.col(key))
    return rows.where(~suspect).select(key, *columns).unionByName(earliest(rows.where(suspect), key, at, columns))


def earliest(rows: DataFrame, key: str, at: str | None, columns: list[str]) -> DataFrame:
    """One row per key, as ``first_delivery`` chooses it, by aggregation of all rows."""
    row = F.struct(*[F.col(c) for c in columns])
    time = [F.col(at).isNull(), F.col(at)] if at else []
    order = F.struct(*time, *[F.xxhash64(F.col(c)) for c in columns])
    return rows.groupBy(key).agg(F.min_by(row, order).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def look_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, salt: str, how: str = "left") -> DataFrame:
    """Rows joined with a table that has one row per ``key``, though many rows share one of the ``hot`` keys.

    ``hot`` (the key alone) has at most some ``HOT_KEYS`` rows by its construction. Their rows
    of the table are broadcast; the rows that found theirs there go through the other join
    under a key made of ``salt``, so they gather nowhere, and what they meet there is not taken.
    """
    values = [c for c in table.columns if c != key]
    some = table.join(F.broadcast(hot), key, "left_semi").select(key, F.struct(*values).alias("_hot"))
    known = rows.join(F.broadcast(some), key, "left")
    kind = rows.schema[key].dataType
    spread = F.pmod(F.xxhash64(salt), F.lit(1 << 20)).cast("string")
    spread = F.concat(F.lit("\0"), spread) if kind.simpleString() == "string" else F.xxhash64(spread).cast(kind)
    keyed = known.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    joined = keyed.join(table.select(F.col(key).alias("_at"), F.struct(*values).alias("_cold")), "_at", "left")
    if how == "inner":
        joined = joined.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def rows_as_binary(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(matrix)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.view(np.uint8).ravel() if rows.size else b"")])


def binary_as_rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of equal length, none of them null, as the rows of a matrix; ``width`` is that of an empty one."""
    if not len(column):
        return np.zeros((0, width), dtype=kind)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat.view(kind).reshape(len(column), -1)
