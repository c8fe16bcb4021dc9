import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import stage


def test_key_filter_misses_no_key(spark):
    keys = spark.range(0, 30_000, 3).select(F.col("id").alias("k"))
    seems = stage.key_filter(keys, "k")
    got = spark.range(30_000).select("id", seems(F.col("id")).alias("in"))
    assert got.where("id % 3 = 0 AND NOT in").count() == 0
    assert got.where("id % 3 <> 0 AND in").count() < 20
    none = stage.key_filter(keys.limit(0), "k")
    assert spark.range(100).where(none(F.col("id"))).count() == 0
    words = spark.createDataFrame([("a",), (None,), ("",)], "k string")
    assert words.where(stage.key_filter(words, "k")(F.col("k")) & F.col("k").isNotNull()).count() == 2


@pytest.mark.parametrize("bits", [1 << 26, 1 << 7])
def test_first_delivery_of_any_number_of_repeats(spark, monkeypatch, bits):
    """A filter that lets nearly all rows through costs time, not rows."""
    monkeypatch.setattr(stage, "FILTER_BITS", bits)
    rows = spark.range(2_000).selectExpr("id % 1500 AS k", "CASE WHEN id < 1500 THEN 'old' ELSE 'new' END AS v", "id AS at", "'x' AS _n")
    rows = rows.unionByName(spark.createDataFrame([(None, "old", 1, "x"), (3, "none", None, "x"), (1499, "old", 1499, "y")], "k long, v string, at long, _n string"))
    got = stage.first_delivery(rows, "k", "at", ["v"])
    assert got.columns == ["k", "v"] and got.count() == 1500
    assert {r["v"] for r in got.select("v").distinct().collect()} == {"old"}
    assert stage.first_delivery(rows.limit(0), "k", "at", ["v"]).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_look_up_hot_keys(spark, kind):
    """A third of all rows share one key; its value is the same, and the rows do not meet in one partition."""
    rows = spark.range(3_000).selectExpr(f"CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS {kind}) AS k", "id")
    table = spark.range(0, 3_000, 2).selectExpr(f"CAST(id AS {kind}) AS k", "id * 10 AS v").unionByName(spark.createDataFrame([("7", 70)], "k string, v long").selectExpr(f"CAST(k AS {kind}) AS k", "v"))
    hot = rows.groupBy("k").count().where("count >= 900").select("k")
    for how, want in (("left", 3_000), ("inner", None)):
        got = stage.look_up(rows, table, "k", hot, "id", how)
        found = got.where("v IS NOT NULL")
        assert got.columns == ["k", "id", "v"] and found.where("v <> CAST(k AS long) * 10").count() == 0
        assert found.count() == rows.join(table, "k").count() and got.count() == (want or found.count())
    assert found.where("CAST(k AS long) = 7").count() >= 1_000


def test_small_side_is_checked(spark, monkeypatch):
    df = spark.range(10)
    hint = lambda d: "BROADCAST" in d._jdf.queryExecution().logical().toString().upper() or "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(stage.small_side(df))
    monkeypatch.setattr(stage, "BROADCAST_ROWS", 5)
    assert not hint(stage.small_side(df))
    assert np.uint64(stage.FILTER_BITS - 1) == stage.FILTER_BITS - 1


def test_binary_rows_round_trip():
    import pyarrow as pa

    rows = np.arange(24, dtype=np.uint16).reshape(6, 4)
    column = stage.rows_as_binary(rows)
    assert column.to_pylist() == [r.tobytes() for r in rows]
    assert (stage.binary_as_rows(column, np.uint16, 4) == rows).all()
    assert (stage.binary_as_rows(column.slice(2, 3), np.uint16, 4) == rows[2:5]).all()
    assert (stage.binary_as_rows(column.take(pa.array([5, 0])), np.uint16, 4) == rows[[5, 0]]).all()
    assert stage.binary_as_rows(stage.rows_as_binary(rows[:0]), np.uint16, 4).shape == (0, 4)
