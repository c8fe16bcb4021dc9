import pytest
from pyspark.sql import functions as F

from pagelode.llm import bpe, mixing, queries

TARGETS = [("big", 0.5, 1), ("small", 0.3, 3), ("none", 0.1, 5), ("zero", 0.0, 1), (None, 0.1, 1), ("nulls", 0.05, None)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, "big", "one two three four five six seven eight") for i in range(60)] + [(100 + i, "small", "nine ten") for i in range(10)]
    docs += [(200, None, "unlisted text here"), (201, "nulls", None), (202, "nulls", ""), (203, "other", "left out")]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(tables):
    docs, targets = tables
    copies, shares = mixing.mix(docs, targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert set(rows) == {"big", "small", "none", "zero", "nulls"}
    assert [s for s, r in sorted(rows.items()) if not r["reachable"]] == ["none", "nulls", "small"]
    got = copies.collect()
    assert all(r["copies"] >= 1 for r in got) and {r["source"] for r in got} == {"big", "small"}
    assert rows["small"]["most_copies"] == 3 and sum(r["copies"] for r in got if r["source"] == "small") == 30
    assert rows["big"]["most_copies"] == 1
    total = sum(bpe.count_tokens(docs, ("doc_id",)).agg({"tokens": "sum"}).first())
    assert rows["big"]["share_of_target_size"] == pytest.approx(0.5, abs=8 / total)
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1.0)
    assert mixing.mix(docs, targets)[0].orderBy("doc_id").collect() == copies.orderBy("doc_id").collect()


def test_systematic_sampling_crosses_every_integer_once(spark, monkeypatch):
    """Over several slices the copies differ from the expected number by less than one."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    docs = spark.range(200).selectExpr("id AS doc_id", "'s' AS source", "'one two' AS text")
    for share, want in ((0.37, 74), (1.0, 200), (1.7, 340)):
        copies, _ = mixing.mix(docs, spark.createDataFrame([("s", share, 3)], "source string, target_share double, max_repeats int"))
        n = [r["copies"] for r in copies.collect()]
        assert abs(sum(n) - want) <= 1 and max(n) <= -(-want // 200)


def test_empty(tables):
    docs, targets = tables
    copies, shares = mixing.mix(docs.limit(0), targets)
    assert copies.count() == 0 and {r["actual_share"] for r in shares.collect()} == {0.0}
    assert mixing.mix(docs, targets.limit(0))[1].count() == 0


def test_out_of_reach_is_told_by_the_sample(spark, tables, tmp_path, monkeypatch):
    """Rows come from the copies that were sampled: the same as the shares' arithmetic, and others if no document comes out."""
    docs, targets = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    total = bpe.count_tokens(docs, ("doc_id",)).agg({"tokens": "sum"}).first()[0]
    small = bpe.count_tokens(docs.where("source = 'small'"), ("doc_id",)).agg({"tokens": "sum"}).first()[0]
    other = [("other", 1.0, 0), ("big", 0.5, 1), ("small", 3 * small / total, 3), ("zero", None, 1), ("nulls", 0.05, None), ("none", 0.1, 5)]
    for i, rows in enumerate((targets, spark.createDataFrame(other, targets.schema))):
        rows.write.parquet(f"{tmp_path}/mix_targets.parquet", mode="overwrite")
        got = sorted(r["source"] for r in queries.p8_found(spark, str(tmp_path)).collect())
        sizes = bpe.count_tokens(docs, ("source",)).groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
        assert got == sorted(r["source"] for r in mixing.plan_shares(sizes, rows).where("not reachable").collect())
        assert got == (["none", "nulls", "small"], ["none", "nulls", "other"])[i]
    targets.write.parquet(f"{tmp_path}/mix_targets.parquet", mode="overwrite")
    monkeypatch.setattr(mixing, "emitted", lambda rate, position, offset: F.lit(0))
    assert sorted(r["source"] for r in queries.p8_found(spark, str(tmp_path)).collect()) == ["none", "nulls"]
