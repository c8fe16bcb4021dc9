import math

import pytest
from pyspark.sql import functions as F

from pagelode.operators import search as s
from pagelode.queries import QUERIES

DOCS = [(0, "Alpha beta alpha", "e"), (1, "alphabet soup", "e"), (2, "gamma", "e"), (3, None, "e"), (4, "", "e"), (5, "BETA beta beta beta", "e")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, extra string")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(0, [10, 0, 5]), (1, [9, 1, 5]), (5, [-10, 3, 0]), (2, None)], "doc_id long, vector array<tinyint>")


def kw(text, terms):
    t = (text or "").lower()
    return sum(t.count(x) / (t.count(x) + 1.5) for x in terms)


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))


def brute(query, vectors, k):
    terms = query.lower().split()
    hits = [(kw(t, terms), i) for i, t, _ in DOCS if kw(t, terms) > 0]
    hits.sort(key=lambda h: (-h[0], h[1]))
    seed = vectors.get(hits[0][1]) if hits else None
    out = []
    for w, i in hits:
        ok = len(hits) > 1 and seed and any(seed) and vectors.get(i)
        out.append((i, w, 0.6 * w / (w + 1) + 0.4 * cos(seed, vectors[i]) if ok else w))
    return sorted(out, key=lambda r: (-r[2], -r[1], r[0]))[:k]


@pytest.mark.parametrize("query", ["alpha", "beta", "alpha beta", "a", "beta beta", "gamma", "missing", " ", "et"])
def test_single_and_batch_agree_with_brute_force(spark, docs, vectors, query):
    vecs = {0: [10, 0, 5], 1: [9, 1, 5], 5: [-10, 3, 0]}
    want = brute(query, vecs, 3)
    single = [(r["doc_id"], r["kw"], r["score"]) for r in s.hybrid_search(docs, vectors, query, 3).collect()]
    batch = s.hybrid_search_batch(docs, vectors, spark.createDataFrame([(7, query)], "query_id long, query string"), 3).orderBy("rank").collect()
    for got in (single, [(r["doc_id"], r["kw"], r["score"]) for r in batch]):
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1:] for g in got] == [pytest.approx(w[1:]) for w in want]


def test_keyword_batch_ties_and_blocks(spark, docs, monkeypatch):
    asked = spark.createDataFrame([(1, "beta alpha beta soup"), (2, "gamma"), (3, "  "), (4, None), (5, "a")], "query_id long, query string")
    want = {}
    for q, text in ((1, "beta alpha beta soup"), (2, "gamma"), (5, "a")):
        hits = sorted((-kw(t, text.split()), i) for i, t, _ in DOCS if kw(t, text.split()) > 0)[:2]
        want |= {(q, i): (pytest.approx(-w), r + 1) for r, (w, i) in enumerate(hits)}
    for block in (4096, 1):
        monkeypatch.setattr(s, "QUERY_BLOCK", block)
        rows = s.keyword_topk_batch(docs, asked, 2).collect()
        assert {(r["query_id"], r["doc_id"]): (r["kw"], r["rank"]) for r in rows} == want


def test_batch_keys_of_any_type(spark):
    rows = spark.createDataFrame([("b", "red red", [1, 2]), ("a", "red red", [2, 1]), (None, "red", [1, 1]), ("c", "Red", None)], "doc_id string, text string, vector array<tinyint>")
    asked = spark.createDataFrame([("q", "red")], "query_id string, query string")
    got = s.keyword_topk_batch(rows, asked, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["a", "b"]
    both = s.hybrid_search_batch(rows, rows, asked, 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in both] == ["a", "b", "c"]  # the seed itself, its neighbour, the one without a vector


def test_no_rows_per_query_and_text(spark, docs, vectors):
    """What is shuffled are the best of each task, not all hits."""
    asked = spark.range(50).selectExpr("id AS query_id", "'a' AS query")
    many = spark.range(4000).selectExpr("id AS doc_id", "concat('a word ', id) AS text").repartition(2)
    found = s.keyword_topk_batch(many, asked, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.count() == 150


def test_single_hit_keeps_raw_score(docs, vectors):
    assert [r["score"] for r in s.hybrid_search(docs, vectors, "gamma gamma gamma", 5).collect()] == [pytest.approx(1.2)]


def test_zero_seed_vector_is_not_used(spark, docs):
    zero = spark.createDataFrame([(0, [0, 0]), (1, [1, 2])], "doc_id long, vector array<tinyint>")
    rows = s.hybrid_search(docs, zero, "alpha", 5).collect()
    assert all(r["score"] == r["kw"] for r in rows)


def test_bad_k(docs, vectors):
    with pytest.raises(ValueError):
        s.hybrid_search(docs, vectors, "a", -1)
    assert s.keyword_topk(docs, "alpha", 0).count() == 0


def test_vector_topk(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = s.vector_topk(v, [1.0, 0.0], 3).collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in rows] == [(0, 1.0), (4, 1.0), (1, round(1 / math.sqrt(2), 6))]
    assert s.vector_topk(v, [0.0, 0.0], 3).count() == 0
    asked = v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    got = s.vector_topk_batch(v, asked, 2, vector="embedding").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 0]


def test_empty_tables(spark, docs, vectors):
    none = docs.limit(0)
    asked = spark.createDataFrame([(1, "alpha"), (2, None), (3, "")], "query_id long, query string")
    assert s.hybrid_search_batch(none, vectors, asked).count() == 0
    assert {r["query_id"] for r in s.hybrid_search_batch(docs, vectors.limit(0), asked).collect()} == {1}


def test_batch_over_documents_without_vectors(spark, tmp_path):
    docs = [(50, "alpha beta gamma", "en", "a"), (1, "alpha beta", "en", "a"), (2, "alpha", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(50, [0.1, 0.9], 1), (1, [0.2, 0.7], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["doc_id"] for r in QUERIES["hybrid_batch_all"](spark, str(tmp_path)).collect()} == {50, 1, 2}
    assert {r["doc_id"] for r in QUERIES["hybrid_search_batch"](spark, str(tmp_path)).collect()} == {50, 1}
