"""The pN_ queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import bpe, distinctive, markup, mixing, near_duplicates, neighbours, splitting, truncation
from pagelode.llm.stage import cut, first_delivery
from pagelode.session import ensure_checkpoint_dir
from pagelode.sources.fs import SharedFolder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, text): each chunk once, by its first delivery."""
    return first_delivery(table(spark, sf, "chunks"), "chunk_id", "ingested_at", ["text"])


# ---- problem 1

TERMS_SQL = """t AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
w AS (SELECT chunk_id, i, lower(w) AS term FROM (SELECT chunk_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT chunk_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS ws FROM t))),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


@query(f"""WITH {TERMS_SQL} SELECT chunk_id, term FROM tf JOIN df USING (term)
WHERE tf >= 3 AND df BETWEEN 2 AND 12 AND length(term) >= 5 AND term[1] BETWEEN 'a' AND 'z'""")
def p1_found(spark, sf):
    scored = distinctive.distinctive_terms(chunk_texts(spark, sf), "chunk_id", least=3, between=(2, 12))
    return scored.where(F.col("term").rlike("^[a-z]") & (F.length("term") >= 5)).select("chunk_id", "term")


@query(f"""WITH {TERMS_SQL}, n AS (SELECT count(*) AS n, avg(length(text)) AS mean FROM t),
e AS (SELECT DISTINCT a.chunk_id, a.term, b.term AS other FROM w a JOIN w b ON a.chunk_id = b.chunk_id AND abs(a.i - b.i) <= 3 AND a.term <> b.term),
d AS (SELECT chunk_id, term, count(*) AS degree FROM e GROUP BY 1, 2)
SELECT chunk_id, term, tf, coalesce(degree, 0) AS degree, df,
  round(coalesce(degree, 0) / (1 - 0.003::DOUBLE + 0.003::DOUBLE * length(text) / mean) * ln((n + 1) / df), 6) AS score
FROM tf JOIN df USING (term) JOIN t USING (chunk_id) LEFT JOIN d USING (chunk_id, term), n""")
def p1_scores(spark, sf):
    scored = distinctive.distinctive_terms(chunk_texts(spark, sf), "chunk_id")
    return scored.withColumn("score", F.round("score", 6))


# ---- problem 7


@query()
def p7_ids(spark, sf):
    return bpe.encode_corpus(table(spark, sf, "documents"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark, sf):
    """Encoded and decoded again: every text as it was, null as ''."""
    return bpe.decode_corpus(bpe.encode_corpus(table(spark, sf, "documents")))


# ---- problem 8


@query()
def p8_found(spark, sf):
    shares = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]
    return mixing.out_of_reach(shares)


@query()
def p8_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


@query()
def p8_shares(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


@query("""SELECT t.source, count(doc_id) AS docs, true AS within_cap, true AS as_expected
FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) t LEFT JOIN documents d USING (source) GROUP BY 1""")
def p8_checked(spark, sf):
    """Of every target its documents, whether none is used more often than allowed, and whether its copies are as many as its rate says, up to one."""
    copies, shares = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    got = copies.groupBy("source").agg(F.sum("copies").alias("_copies"))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("target_share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    known = shares.join(got, "source", "left")
    return known.select(
        "source", "docs", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"),
        (F.abs(F.coalesce("_copies", F.lit(0)) - rate * F.col("docs")) < 1 + 1e-6).alias("as_expected"),
    )


# ---- problem 2


def _duplicates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicate_classes(table(spark, sf, "chunks"), "chunk_id", at="ingested_at", shingle=3, similarity=0.5, least_words=20)


PAIRS_SQL = """t AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM t),
s AS (SELECT DISTINCT chunk_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle FROM w WHERE len(w) >= 20),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.chunk_id < y.chunk_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM b JOIN n na ON na.chunk_id = a JOIN n nb ON nb.chunk_id = b WHERE shared >= 0.5 * (na.n + nb.n - shared))"""


@query(f"WITH {PAIRS_SQL} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pairs")
def p2_found(spark, sf):
    pairs = near_duplicates.expand_pairs(*_duplicates(spark, sf))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, ends AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT u, u AS v FROM ends UNION SELECT r.u, e.v FROM reached r JOIN ends e ON e.u = r.v)
SELECT n.chunk_id, coalesce(g, n.chunk_id) AS group_id, coalesce(links, 0)::BIGINT AS links
FROM n LEFT JOIN (SELECT u AS chunk_id, min(v) AS g FROM reached GROUP BY 1) USING (chunk_id) LEFT JOIN (SELECT u AS chunk_id, count(*) AS links FROM ends GROUP BY 1) USING (chunk_id)""")
def p2_groups(spark, sf):
    """One row per chunk of 20 words or more: its group and its number of near-duplicates."""
    groups = near_duplicates.near_duplicate_groups(*_duplicates(spark, sf))
    return groups.select(F.col("key").alias("chunk_id"), F.col("group").alias("group_id"), "links")


# ---- problem 3


NEAREST_SQL = """u AS (SELECT v.chunk_id, v.index_id, arg_min(vector, embedded_at) AS x FROM vectors v JOIN search_indexes i ON v.index_id = i.index_id
  AND len(vector) = dimensions AND list_min(vector) <> list_max(vector) WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
d AS (SELECT *, list_dot_product(x::DOUBLE[], x::DOUBLE[]) AS n FROM u),
c AS (SELECT a.index_id, a.chunk_id, b.chunk_id AS neighbour, list_dot_product(a.x::DOUBLE[], b.x::DOUBLE[]) / sqrt(a.n * b.n) AS cosine
  FROM d a JOIN d b ON a.index_id = b.index_id AND a.chunk_id <> b.chunk_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_id, chunk_id ORDER BY cosine DESC, neighbour) AS r FROM c) WHERE r <= 5)"""


@query(f"WITH {NEAREST_SQL} SELECT DISTINCT least(chunk_id, neighbour) AS chunk_id_a, greatest(chunk_id, neighbour) AS chunk_id_b FROM near")
def p3_found(spark, sf):
    near = neighbours.nearest(table(spark, sf, "vectors"), table(spark, sf, "search_indexes"))
    return neighbours.neighbour_pairs(near)


@query(f"WITH {NEAREST_SQL} SELECT index_id, chunk_id, neighbour, cosine FROM near")
def p3_neighbours(spark, sf):
    """(index_id, chunk_id, neighbour, cosine) of the five most similar vectors of every usable vector."""
    return neighbours.nearest(table(spark, sf, "vectors"), table(spark, sf, "search_indexes"))


# ---- problem 6


@query()
def p6_found(spark, sf):
    return markup.markup_kinds(chunk_texts(spark, sf), "chunk_id")


@query()
def p6_clean(spark, sf):
    """(chunk_id, text) of every chunk without its markup."""
    return markup.clean_markup(chunk_texts(spark, sf), "chunk_id")


# ---- problem 4


def _sized(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    return splitting.with_settings(table(spark, sf, "chunks"), table(spark, sf, "search_configs"), columns)


@query(r"""WITH d AS (SELECT chunksize FROM search_configs WHERE index_id IS NULL ORDER BY saved_at DESC LIMIT 1),
f AS (SELECT index_id, coalesce(arg_max(chunksize, saved_at), (SELECT chunksize FROM d)) AS size FROM
  (SELECT index_id, saved_at, coalesce(chunksize, (SELECT chunksize FROM d)) AS chunksize FROM search_configs WHERE index_id IS NOT NULL) GROUP BY 1)
SELECT DISTINCT chunk_id FROM chunks LEFT JOIN f USING (index_id) WHERE len(list_filter(regexp_split_to_array(text,
  '[\t\n\x0b\x0c\r\x1c-\x1f \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')) > coalesce(size, (SELECT chunksize FROM d))""")
def p4_found(spark, sf):
    return splitting.oversized(_sized(spark, sf, ["chunk_id", "text"]), "chunk_id").select("chunk_id")


def _pieces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = splitting.long_enough(_sized(spark, sf, ["chunk_id", "ingested_at", "heading", "text", "range"]))
    kept = first_delivery(rows, "chunk_id", "ingested_at", ["heading", "text", "range", "_size", "_overlap"])
    return kept, splitting.split_records(kept, "chunk_id")


@query()
def p4_pieces(spark, sf):
    """(chunk_id, piece, heading, text, range, words) of every oversized chunk."""
    return _pieces(spark, sf)[1]


UNICODE_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIZES_SQL = """d AS (SELECT chunksize, chunkoverlap FROM search_configs WHERE index_id IS NULL ORDER BY saved_at DESC LIMIT 1),
f AS (SELECT index_id, arg_max(coalesce(chunksize, (SELECT chunksize FROM d)), saved_at) AS size, arg_max(coalesce(chunkoverlap, (SELECT chunkoverlap FROM d)), saved_at) AS lap
  FROM search_configs WHERE index_id IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {SIZES_SQL}, t AS (SELECT chunk_id, any_value(text) AS text, any_value(index_id) AS index_id FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
w AS (SELECT chunk_id, list_filter(regexp_split_to_array(text, '{UNICODE_WS}+'), lambda x: x <> '') AS w, coalesce(size, (SELECT chunksize FROM d)) AS size FROM t LEFT JOIN f USING (index_id))
SELECT chunk_id, len(w)::BIGINT AS words, md5(array_to_string(w, ' ')) AS content, true AS fits, true AS ranged FROM w WHERE len(w) > size""")
def p4_coverage(spark, sf):
    """Of every oversized chunk its pieces' words without those shared with the piece before, whether all fit, and whether ranges are their own."""
    kept, pieces = _pieces(spark, sf)
    joined = pieces.join(kept.select("chunk_id", F.col("text").alias("whole"), F.col("range").alias("span"), "_size", "_overlap"), "chunk_id")
    cut_out = F.when(F.col("range").isNull(), F.col("span").isNull()).otherwise(
        F.expr("substring(whole, CAST(range.start - span.start + 1 AS INT), CAST(range.end - range.start AS INT))") == F.col("text")
    )
    rows = joined.select("chunk_id", "piece", "text", "words", "_size", "_overlap", cut_out.alias("own"))

    def unshared(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        words: list[str] = []
        for text, size, overlap in zip(frame["text"], frame["_size"], frame["_overlap"]):
            words += text.split()[min(overlap, len(words), size - 1) :]
        content = hashlib.md5(" ".join(words).encode()).hexdigest()
        return pd.DataFrame([(frame["chunk_id"].iloc[0], len(words), content, bool((frame["words"] <= frame["_size"]).all()), bool(frame["own"].all()))])

    return rows.groupBy("chunk_id").applyInPandas(unshared, "chunk_id bigint, words bigint, content string, fits boolean, ranged boolean")


@query(f"SELECT sum(len(list_filter(regexp_split_to_array(text, '{UNICODE_WS}+'), lambda x: x <> '')))::BIGINT AS words, 0::BIGINT AS over FROM documents")
def p4_files(spark, sf):
    """All documents' texts as some large files, cut by byte ranges: their words without the shared ones, and pieces over the limit."""
    base = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    table(spark, sf, "documents").where("text IS NOT NULL").select("text").coalesce(4).write.option("lineSep", "\n\n").text(base)
    pieces = splitting.split_files(spark, base, 256, 32)
    per_file = pieces.groupBy("path").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.count_if(F.col("words") > 256).alias("over"))
    done = cut(per_file.agg(F.sum(F.col("words") - 32 * (F.col("n") - 1)).alias("words"), F.coalesce(F.sum("over"), F.lit(0)).alias("over")))
    SharedFolder(spark, base).delete("")
    return done


# ---- problem 9


@query()
def p9_found(spark, sf):
    return truncation.judge_ends(table(spark, sf, "documents")).where("cut").select("doc_id")


@query()
def p9_sources(spark, sf):
    """(source, docs, cut, share, at_limit): how often each source's documents are cut."""
    docs = table(spark, sf, "documents")
    return truncation.source_report(docs, truncation.judge_ends(docs))
