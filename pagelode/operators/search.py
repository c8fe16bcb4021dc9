"""Keyword scoring, pseudo-relevance re-ranking and top-k, for one query or a table of queries.

The query text itself is never embedded: the vector of the best keyword hit is
the query vector, and only keyword hits are re-ranked.

A table of queries is a stated set against all rows. It is taken in blocks of bounded
size, which every task holds; a task scores its Arrow batches against the block as one
matrix and keeps the k best of each query, so what is shuffled is at most tasks x queries
x k rows, and no row stands for a (query, text) pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.functions.text import WORD_RE, keyword_score, query_terms
from pagelode.functions.vectors import cosine_float, cosine_int, is_nonzero, l2_norm, norm_int
from pagelode.session import cut_lineage

#: Queries, and bytes of their words or vectors, in one block: what the driver collects and every task holds.
QUERY_BLOCK, BLOCK_BYTES = 4_096, 16 << 20
#: Cells of a matrix that a task works on at once.
CELLS = 4_000_000
#: Distinct words of which a worker remembers the terms.
REMEMBERED = 500_000


def _check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def parse_query(query: str) -> list[str]:
    """Lower-case whitespace words, in order, repeats kept."""
    return WORD_RE.findall(query.lower())


def keyword_hits(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kw) of the texts that hold any term; an empty query or null text gives no row."""
    scored = docs.select(F.col(key).alias(key), keyword_score(F.col(text), parse_query(query)).alias("kw"))
    return scored.where(F.col("kw") > 0)


def keyword_topk(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best keyword hits, ties to the smaller key."""
    _check_k(k)
    return keyword_hits(docs, query, key, text).orderBy(F.desc("kw"), F.asc(key)).limit(k)


class TermMatrix:
    """Counts the terms of a block of queries in texts, and adds up each query's score.

    A term has no whitespace, so each occurrence lies inside one whitespace word and a
    text's count is the sum over its words. The terms in a word are found when the word is
    first met, by the term's first characters, and remembered.
    """

    def __init__(self, queries: list[list[str]]) -> None:
        terms = list(dict.fromkeys(t for q in queries for t in q if t))
        number = {t: i for i, t in enumerate(terms)}
        self.size = len(terms)
        self.slots: list[tuple[np.ndarray, np.ndarray]] = []  # per place in a query: the queries that have one, and their term
        for at in range(max(map(len, queries), default=0)):
            rows = [i for i, q in enumerate(queries) if len(q) > at]
            self.slots.append((np.array(rows), np.array([number[queries[i][at]] for i in rows])))
        self.queries = len(queries)
        self.heads: dict[str, list[tuple[str, int]]] = {}
        for t, i in number.items():
            self.heads.setdefault(t[:3], []).append((t, i))
        self.known: dict[str, list[tuple[int, int]]] = {}

    def _terms_in(self, word: str) -> list[tuple[int, int]]:
        """(term, non-overlapping occurrences) of the terms that a word holds."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            heads = {word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)} & self.heads.keys()
            got = self.known[word] = [(i, n) for h in heads for t, i in self.heads[h] if (n := word.count(t))]
        return got

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(texts, queries) keyword scores of lower-case texts; the terms of a query are added up in its order."""
        rows: list[int] = []
        terms: list[int] = []
        counts: list[int] = []
        for row, text in enumerate(texts):
            if not text:
                continue
            words: dict[str, int] = {}
            for w in WORD_RE.findall(text):
                words[w] = words.get(w, 0) + 1
            for w, tf in words.items():
                for term, each in self._terms_in(w):
                    rows.append(row), terms.append(term), counts.append(tf * each)
        at = np.array(rows, dtype=np.int64) * max(self.size, 1) + np.array(terms, dtype=np.int64)
        found = np.bincount(at, weights=np.array(counts, dtype=np.float64), minlength=len(texts) * self.size).reshape(len(texts), self.size)
        saturated = found / (found + 1.5)
        out = np.zeros((len(texts), self.queries))
        for queries, term in self.slots:
            out[:, queries] += saturated[:, term]
        return out


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Lists of numbers without nulls as rows, shorter ones padded with zeros."""
    if len(pc.unique(pc.list_value_length(column))) <= 1:
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists))), dtype=dtype)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == n else np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


class Best:
    """The k best texts of every query so far, by rising key among equals."""

    def __init__(self, queries: int, k: int, columns: int) -> None:
        self.k = k
        self.rows: list[tuple] = [None] * queries  # per query: keys, then the columns to rank by
        self.columns = columns

    def add(self, keys: np.ndarray, query: int, *values: np.ndarray) -> None:
        old = self.rows[query]
        if old is not None:
            keys = np.concatenate([old[0], keys])
            values = tuple(np.concatenate([o, v]) for o, v in zip(old[1:], values))
        order = np.argsort(keys, kind="stable")
        for v in reversed(values):
            order = order[np.argsort(-v[order], kind="stable")]
        order = order[: self.k]
        self.rows[query] = (keys[order], *(v[order] for v in values))

    def floor(self, query: int) -> float:
        """The first value that a further row must reach to matter."""
        own = self.rows[query]
        return own[1][-1] if own is not None and len(own[0]) == self.k else -np.inf


def _blocks(queries: DataFrame, size: Callable) -> Iterator[pa.Table]:
    """The queries in blocks of at most about ``QUERY_BLOCK`` rows and ``BLOCK_BYTES`` bytes, one at a time on the driver."""
    n, most = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(-(-n // QUERY_BLOCK), -(-most // BLOCK_BYTES))
    for i in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)) == i).toArrow()


def _key_array(keys: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(keys.tolist() if keys.dtype == object else keys, kind)


def _types(queries: DataFrame, docs: DataFrame, key: str) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {docs.schema[key].dataType.simpleString()}"


def _scored_blocks(batch: pa.RecordBatch, terms: TermMatrix) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, keys, keyword scores) of a batch (key, text, ...) in parts of bounded size."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    step = max(1, CELLS // max(terms.size, terms.queries, 1))
    for at in range(0, len(keys), step):
        yield at, keys[at : at + step], terms.scores(batch.column(1).slice(at, step).to_pylist())


def _asked(queries: DataFrame, query: str) -> DataFrame:
    return queries.select("query_id", query_terms(F.col(query)).alias("terms")).where(F.col("query_id").isNotNull() & (F.size("terms") > 0))


def _emit(best: Best, ids: pa.Array, kind: pa.DataType, extra: list[str]) -> Iterator[pa.RecordBatch]:
    held = [(i, r) for i, r in enumerate(best.rows) if r is not None and len(r[0])]
    if held:
        which = pa.array(np.repeat([i for i, _ in held], [len(r[0]) for _, r in held]))
        columns = [np.concatenate([r[c] for _, r in held]) for c in range(best.columns + 1)]
        yield pa.RecordBatch.from_arrays([ids.take(which), _key_array(columns[0], kind), *map(pa.array, columns[1:])], names=["query_id", "key", *extra])


def keyword_topk_batch(
    docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query: str = "query"
) -> DataFrame:
    """(query_id, key, kw, rank): the k best keyword hits of every query (query_id, ``query``), ties to the smaller key.

    Null and blank queries, null keys and texts without a term give no row. Query ids must be unique.
    """
    _check_k(k)
    asked = _asked(queries, query)
    types = _types(queries, docs, key)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    parts = []
    for block in _blocks(asked, F.size("terms") * 16) if k else ():
        sent = docs.sparkSession.sparkContext.broadcast((block.column("query_id").combine_chunks(), block.column("terms").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, words = sent.value
            terms, best, kind = TermMatrix(words), Best(len(words), k, 1), pa.int64()
            for batch in batches:
                kind = batch.schema.field(0).type
                for _, keys, kw in _scored_blocks(batch, terms):
                    for q in np.nonzero((kw > 0).any(0))[0]:
                        at = np.nonzero((kw[:, q] > 0) & (kw[:, q] >= best.floor(q)))[0]
                        if len(at):
                            best.add(keys[at], q, kw[at, q])
            yield from _emit(best, ids, kind, ["kw"])

        parts.append(rows.mapInArrow(run, f"{types}, kw double"))
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], f"{types}, kw double")
    w = Window.partitionBy("query_id").orderBy(F.desc("kw"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def rerank(hits: DataFrame, vectors: DataFrame, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(key, kw, score) of one query's hits: 0.6 kw/(kw+1) + 0.4 cosine with the best hit's vector.

    A single hit, and all hits if the best one has no vector or a zero one, keep the raw kw,
    as do hits without a vector of their own.
    """
    vecs = vectors.select(F.col(key).alias(key), F.col(vector).alias("_v"))
    best = hits.agg(F.min_by(key, F.struct(-F.col("kw"), F.col(key))).alias("_seed"), F.count("*").alias("_n"))
    seed = best.join(vecs.withColumnRenamed(key, "_seed"), "_seed", "left").select("_n", F.col("_v").alias("_sv"), norm_int(F.col("_v")).alias("_norm"))
    joined = hits.join(vecs, key, "left").join(F.broadcast(seed))  # one row
    usable = (F.col("_n") > 1) & F.col("_sv").isNotNull() & F.coalesce(is_nonzero(F.col("_sv")), F.lit(False))
    mixed = F.lit(0.6) * (F.col("kw") / (F.col("kw") + F.lit(1.0))) + F.lit(0.4) * cosine_int(F.col("_sv"), F.col("_v"), F.col("_norm"))
    return joined.select(key, "kw", F.when(usable & F.col("_v").isNotNull(), mixed).otherwise(F.col("kw")).alias("score"))


def _cosines(codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(rows, seeds) cosines of integer codes, exact up to one square root each and one division; 0 where a norm is 0."""
    codes, seeds = _same_width(codes, seeds)
    norm = np.sqrt((codes * codes).sum(1))[:, None] * np.sqrt((seeds * seeds).sum(1))[None]
    return (codes @ seeds.T) / np.where(norm == 0, 1.0, norm)


def hybrid_search_batch(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10,
    key: str = "doc_id", text: str = "text", vector: str = "vector",
) -> DataFrame:
    """(query_id, key, kw, score, rank) of the k best texts of every query: keyword hits re-ranked as by ``rerank``.

    Two passes over the texts for a block of queries: the first finds each query's best hit and
    the number of its hits, one row a task and query; the second scores the texts, joined with
    their vectors, against the block and keeps the k best. Keys must be unique.
    """
    _check_k(k)
    spark = docs.sparkSession
    asked = _asked(queries, "query")
    types = _types(queries, docs, key)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    vecs = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<int>").alias("vector"))
    both = rows.join(vecs, "key", "left")
    parts = []
    for block in _blocks(asked, F.size("terms") * 16) if k else ():
        sent = spark.sparkContext.broadcast((block.column("query_id").combine_chunks(), block.column("terms").to_pylist()))

        def first(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, words = sent.value
            terms, best, kind = TermMatrix(words), Best(len(words), 1, 1), pa.int64()
            hits = np.zeros(len(words), dtype=np.int64)
            for batch in batches:
                kind = batch.schema.field(0).type
                for _, keys, kw in _scored_blocks(batch, terms):
                    hits += (kw > 0).sum(0)
                    for q in np.nonzero((kw > 0).any(0))[0]:
                        at = np.nonzero((kw[:, q] > 0) & (kw[:, q] >= best.floor(q)))[0]
                        if len(at):
                            best.add(keys[at], q, kw[at, q])
            for out in _emit(best, ids, kind, ["kw"]):
                n = pa.array(hits[[r is not None for r in best.rows]])
                yield pa.RecordBatch.from_arrays([*out.columns, n], names=[*out.schema.names, "n"])

        seen = rows.mapInArrow(first, f"{types}, kw double, n bigint").groupBy("query_id").agg(
            F.min_by("key", F.struct(-F.col("kw"), F.col("key"))).alias("key"), F.sum("n").alias("n")
        )
        seeds = seen.where("n > 1").join(vecs, "key").where(F.col("vector").isNotNull() & is_nonzero(F.col("vector")))
        table = seeds.select("query_id", "vector").toArrow()  # one row a query of the block
        seed_of = dict(zip(table.column("query_id").to_pylist(), table.column("vector").to_pylist()))
        place = [i for i, q in enumerate(block.column("query_id").to_pylist()) if q in seed_of]
        codes = matrix(pa.array([seed_of[block.column("query_id")[i].as_py()] for i in place], pa.list_(pa.int64()))) if place else None
        seeded = spark.sparkContext.broadcast((np.array(place, dtype=np.int64), codes))

        def second(batches: Iterator[pa.RecordBatch], sent=sent, seeded=seeded) -> Iterator[pa.RecordBatch]:
            ids, words = sent.value
            place, codes = seeded.value
            terms, best, kind = TermMatrix(words), Best(len(words), k, 2), pa.int64()
            for batch in batches:
                kind = batch.schema.field(0).type
                for at, keys, kw in _scored_blocks(batch, terms):
                    score = kw.copy()
                    own = batch.column(2).slice(at, len(keys))
                    have = np.nonzero(own.is_valid().to_numpy(zero_copy_only=False))[0]
                    if len(have) and len(place):
                        cosine = _cosines(matrix(own.take(pa.array(have))), codes)
                        w = kw[np.ix_(have, place)]
                        score[np.ix_(have, place)] = 0.6 * (w / (w + 1.0)) + 0.4 * cosine
                    for q in np.nonzero((kw > 0).any(0))[0]:
                        at_q = np.nonzero((kw[:, q] > 0) & (score[:, q] >= best.floor(q)))[0]
                        if len(at_q):
                            best.add(keys[at_q], q, score[at_q, q], kw[at_q, q])
            yield from _emit(best, ids, kind, ["score", "kw"])

        parts.append(both.select("key", "text", "vector").mapInArrow(second, f"{types}, score double, kw double"))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{types}, score double, kw double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("kw"), F.asc("key"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("key").alias(key), "kw", "score", "rank")


def hybrid_search(
    docs: DataFrame, vectors: DataFrame, query: str, k: int = 10,
    key: str = "doc_id", text: str = "text", vector: str = "vector",
) -> DataFrame:
    """(key, kw, score) of the k best texts of one query: one scan of the texts, whose hits (key, kw) are kept, and vectors only for hits."""
    _check_k(k)
    scored = rerank(cut_lineage(keyword_hits(docs, query, key, text)), vectors, key, vector)
    return scored.orderBy(F.desc("score"), F.desc("kw"), F.asc(key)).limit(k)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): cosine with one query vector; a query norm below 1e-10 gives no row, null vectors are left out."""
    _check_k(k)
    q = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias(key), cosine_float(q, F.col(vector)).alias("score"))
    return found.where(l2_norm(q) >= 1e-10).orderBy(F.desc("score"), F.asc(key)).limit(k)


def vector_topk_batch(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "vector", digits: int | None = None
) -> DataFrame:
    """(query_id, key, score, rank): the k vectors of highest cosine for every query (query_id, qvec), ties to the smaller key.

    With ``digits`` scores are rounded before they are ranked, for floats whose sums depend
    on their order; integer codes are exact without. Null vectors and null queries give no row;
    a zero norm gives cosine 0.
    """
    _check_k(k)
    spark = vectors.sparkSession
    asked = queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).where(F.col("query_id").isNotNull() & F.col("qvec").isNotNull())
    types = _types(queries, vectors, key)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    parts = []
    for block in _blocks(asked, F.size("qvec") * 8) if k else ():
        sent = spark.sparkContext.broadcast((block.column("query_id").combine_chunks(), matrix(block.column("qvec").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, asked_codes = sent.value
            best, kind = Best(len(ids), k, 1), pa.int64()
            step = max(1, CELLS // max(1, len(ids)))
            for batch in batches:
                kind = batch.schema.field(0).type
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    score = _cosines(matrix(part.column(1)), asked_codes)
                    if digits is not None:
                        score = np.round(score, digits)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    for q in range(len(ids)):
                        at_q = np.nonzero(score[:, q] >= best.floor(q))[0]
                        if len(at_q):
                            best.add(keys[at_q], q, score[at_q, q])
            yield from _emit(best, ids, kind, ["score"])

        parts.append(rows.mapInArrow(run, f"{types}, score double"))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{types}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("key", key)
