"""The query catalogue of the core operators, with the SQL that must give the same rows.

Paths, titles and a previous manifest are derived from ``documents`` by fixed rules,
in both forms alike; nothing is sampled, and every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.config import DEFAULT_EXCLUDE, DEFAULT_INCLUDE
from pagelode.functions import text as tx
from pagelode.functions import vectors as vx
from pagelode.operators import chunking, incremental, ledger, nav, search
from pagelode.operators.ordinal import numbered, with_ordinal
from pagelode.sources.store import size_stats

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


# Pieces of SQL that several queries share.
WS_SQL = r"[\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_SQL}+'), lambda w: w <> '')"


def count_sql(text: str, term: str) -> str:
    return f"(length({text}) - length(replace({text}, {term}, ''))) // length({term})"


def saturate_sql(c: str) -> str:
    return f"(({c})::DOUBLE / (({c})::DOUBLE + 1.5))"


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def cos_sql(a: str, b: str) -> str:
    norm = f"(sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)}))"
    return f"({dot_sql(a, b)} / CASE WHEN {norm} = 0 THEN 1.0 ELSE {norm} END)"


LOW = "lower(coalesce(text, ''))"
ASKED = "legacy index file"
TERMS = ASKED.split()
KW_SQL = " + ".join(["0.0"] + [saturate_sql(count_sql(LOW, f"'{t}'")) for t in TERMS])
QUANT_SQL = """q AS (SELECT vec_id, label,
    list_min(embedding::DOUBLE[]) AS lo,
    CASE WHEN abs(list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[])) < 1e-10 THEN 1.0
         ELSE list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[]) END AS span, embedding::DOUBLE[] AS e
  FROM embeddings), codes AS (
  SELECT vec_id, label, lo, span, list_transform(e, lambda x: floor((x - lo) / span * 255.0 - 128.0 + 0.5)::TINYINT) AS codes FROM q)"""
TERNARY_SQL = "list_transform(codes, lambda c: CASE WHEN c < -42 THEN -127 WHEN c > 42 THEN 127 ELSE 0 END::TINYINT)"
PATH_SQL = """(coalesce(nullif(lang, ''), 'xx') || '/' || coalesce(source, 'none') || '/doc-' || doc_id ||
  CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.html' ELSE '.json' END)"""


def doc_paths(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".txt", ".html", ".json")]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(
        F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("xx")), F.lit("/"), F.coalesce("source", F.lit("none")),
        F.lit("/doc-"), F.col("doc_id").cast("string"), ext,
    )
    return table(spark, sf, "documents").select("doc_id", path.alias("path"))


def coded(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    params = vx.quantize_params(F.col("embedding"), 64)
    return e.select("vec_id", "label", params.alias("p"), vx.quantize(F.col("embedding"), params, 64).alias("codes"))


def hybrid_corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents that have a vector, and the vectors, keyed alike."""
    vectors = coded(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("codes").alias("vector"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(vectors.select("doc_id"), "doc_id", "left_semi")
    return docs, vectors


def title_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): the first three words of every document whose id is divisible by 50."""
    docs = table(spark, sf, "documents").where("doc_id % 50 = 0")
    return docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tx.tokens(F.col("text")), 1, 3), " ").alias("query"))


TITLES_SQL = f"""title_queries AS (SELECT doc_id AS query_id, list_slice({words_sql('lower(text)')}, 1, 3) AS terms
  FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL)"""
HITS_SQL = f"""hits AS (SELECT query_id, doc_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(terms,
    lambda t: {saturate_sql(count_sql('low', 't'))})), lambda a, x: a + x) AS kw
  FROM title_queries, (SELECT doc_id, {LOW} AS low FROM CORPUS) WHERE len(terms) > 0)"""


# ---- keyword search


@query(f"SELECT doc_id, {KW_SQL} AS kw FROM documents WHERE {KW_SQL} > 0")
def keyword_score(spark, sf):
    return search.keyword_hits(table(spark, sf, "documents"), ASKED)


@query(f"SELECT doc_id, {KW_SQL} AS kw FROM documents WHERE {KW_SQL} > 0 ORDER BY kw DESC, doc_id LIMIT 10")
def keyword_topk(spark, sf):
    return search.keyword_topk(table(spark, sf, "documents"), ASKED, 10)


@query(f"""WITH {TITLES_SQL}, {HITS_SQL.replace('CORPUS', 'documents')}
SELECT query_id, doc_id, kw, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, doc_id)::INT AS rank
  FROM hits WHERE kw > 0) WHERE rank <= 10""")
def keyword_batch_topk(spark, sf):
    hits = search.keyword_topk_batch(table(spark, sf, "documents"), title_queries(spark, sf), 10)
    return hits.select("query_id", "doc_id", "kw", "rank")


@query(f"SELECT doc_id, {words_sql('lower(text)')} AS terms FROM documents WHERE text IS NOT NULL")
def query_terms(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", tx.query_terms(F.col("text")).alias("terms"))


# ---- chunking


def chunk_sql(size: int, overlap: int, source: str = "documents", key: str = "doc_id") -> str:
    """The line fold as a recursive query: one step a line and document."""
    u16 = "(length(line) + len(regexp_extract_all(line, '[\\x{10000}-\\x{10FFFF}]')) + 1)"
    keep = f"list_slice(W, greatest(len(W) - {overlap} + 1, 1), len(W))" if overlap else "W"
    return f"""WITH RECURSIVE ln AS (SELECT id, i, line, {u16} AS n, regexp_matches(line, '^#{{1,6}}{WS_SQL}') AS head,
    {words_sql('line')} AS words
  FROM (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
    FROM (SELECT {key} AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {source}))),
fold AS (SELECT id, 0 AS i, NULL::VARCHAR AS heading, []::VARCHAR[] AS w, 0::BIGINT AS start, 0::BIGINT AS pos,
    NULL::STRUCT(heading VARCHAR, text VARCHAR, "start" BIGINT, "end" BIGINT) AS piece
  FROM (SELECT DISTINCT {key} AS id FROM {source})
  UNION ALL
  SELECT id, i,
    CASE WHEN head THEN regexp_replace(regexp_replace(line, '^#+{WS_SQL}*', ''), '^{WS_SQL}+|{WS_SQL}+$', '', 'g') ELSE heading END,
    CASE WHEN cut THEN {keep.replace('W', 'w2')} ELSE w2 END,
    CASE WHEN cut THEN pos ELSE start END, pos + n,
    CASE WHEN cut THEN {{'heading': heading, 'text': array_to_string(w2, ' '), 'start': start, 'end': CASE WHEN head THEN pos ELSE pos + n END}} END
  FROM (SELECT f.id, l.i, l.line, l.n, l.head, f.heading, f.start, f.pos, CASE WHEN l.head THEN f.w ELSE f.w || l.words END AS w2,
      len(CASE WHEN l.head THEN f.w ELSE f.w || l.words END) > 0 AND (l.head OR len(f.w || l.words) >= {size}) AS cut
    FROM fold f JOIN ln l ON l.id = f.id AND l.i = f.i + 1)),
last AS (SELECT id, max(i) AS i FROM fold GROUP BY id),
pieces AS (SELECT id, i, 0 AS late, piece FROM fold WHERE piece IS NOT NULL
  UNION ALL SELECT f.id, f.i, 1, {{'heading': heading, 'text': array_to_string(w, ' '), 'start': start, 'end': pos}}
  FROM fold f JOIN last l ON f.id = l.id AND f.i = l.i WHERE len(w) > 0),
chunked AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, late) - 1 AS pos, piece.heading AS heading,
  piece."text" AS text, piece."start" AS range_start, piece."end" AS range_end FROM pieces)"""


def chunk_rows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id") -> DataFrame:
    rows = chunking.chunk_documents(docs, "text", size, overlap, keep=(key,))
    return rows.select(
        F.col(key).alias("id"), "pos", "heading", "text", F.col("range.start").alias("range_start"), F.col("range.end").alias("range_end")
    )


FIELDS = "id, pos, heading, text, range_start, range_end"


@query(f"{chunk_sql(256, 32)} SELECT {FIELDS} FROM chunked")
def chunk_size_flush(spark, sf):
    return chunk_rows(table(spark, sf, "documents"), 256, 32)


@query(f"{chunk_sql(24, 6)} SELECT {FIELDS} FROM chunked")
def chunk_markdown_headings(spark, sf):
    return chunk_rows(table(spark, sf, "documents"), 24, 6)


@query(f"{chunk_sql(64, 0)} SELECT {FIELDS} FROM chunked")
def chunk_overlap_zero(spark, sf):
    return chunk_rows(table(spark, sf, "documents"), 64, 0)


@query(f"""WITH w AS (SELECT doc_id, text, {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS pos, regexp_replace(text, '^{WS_SQL}+|{WS_SQL}+$', '', 'g') AS text FROM w WHERE len(w) BETWEEN 1 AND 100
UNION ALL SELECT doc_id, i AS pos, array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ') AS text
FROM (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 80)) AS i FROM w WHERE len(w) > 100)""")
def chunk_fixed_window(spark, sf):
    return chunking.fixed_windows(table(spark, sf, "documents"), "doc_id", size=100, overlap=20)


@query(f"""{chunk_sql(256, 32)}, scored AS (SELECT id, pos, {KW_SQL.replace('text', 'text')} AS kw FROM chunked)
SELECT id, pos, kw FROM scored WHERE kw > 0 ORDER BY kw DESC, id, pos LIMIT 10""")
def chunk_keyword_topk(spark, sf):
    rows = chunk_rows(table(spark, sf, "documents"), 256, 32)
    scored = rows.select("id", "pos", tx.keyword_score(F.col("text"), search.parse_query(ASKED)).alias("kw")).where("kw > 0")
    return scored.orderBy(F.desc("kw"), "id", "pos").limit(10)


@query(f"""{chunk_sql(256, 32)}, numbered AS (SELECT id, pos, row_number() OVER (ORDER BY id, pos) - 1 AS chunk_id FROM chunked)
SELECT (chunk_id // 256)::INT AS batch_id, count(*) AS chunks, count(DISTINCT id) AS files, min(chunk_id) AS first_chunk FROM numbered GROUP BY 1""")
def chunk_batches(spark, sf):
    rows = chunking.chunk_in_order(table(spark, sf, "documents"), "doc_id")
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("files"), F.min("chunk_id").alias("first_chunk")
    )


@query("SELECT doc_id, length(text)::BIGINT AS chars, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS place FROM documents")
def global_ordinal(spark, sf):
    """All documents with their texts, numbered by source and id."""
    rows = table(spark, sf, "documents").select("source", "doc_id", "text")
    return with_ordinal(rows, ("source", "doc_id"), "place").select("doc_id", F.length("text").cast("long").alias("chars"), "place")


BREAKS_SQL = r"\n\r\x{2028}\x{2029}"
MARK_SQL = f"#{{1,6}}{WS_SQL}+[^{BREAKS_SQL}]"


@query(f"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '(^|[{BREAKS_SQL}])({MARK_SQL})', '\\1' || chr(57344) || chr(57345) || '\\2', 'g'), chr(57344) || chr(57345)) AS p
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, CASE WHEN len(p) > 1 AND p[1] = '' THEN p[2:] ELSE p END AS p FROM s),
r AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM t),
h AS (SELECT *, regexp_matches(s, '^{MARK_SQL}') AS has, '^#{{1,6}}{WS_SQL}+[^{BREAKS_SQL}]*' AS line FROM r)
SELECT * FROM (SELECT doc_id, pos,
  CASE WHEN has THEN regexp_replace(regexp_replace(regexp_extract(s, line), '^#+{WS_SQL}+', ''), '^{WS_SQL}+|{WS_SQL}+$', '', 'g') END AS heading,
  regexp_replace(CASE WHEN has THEN regexp_replace(s, line, '') ELSE s END, '^{WS_SQL}+|{WS_SQL}+$', '', 'g') AS text FROM h) WHERE text <> ''""")
def chunk_sections(spark, sf):
    return chunking.sections(table(spark, sf, "documents"), "doc_id")


@query("""SELECT file, count(*) AS rows, count(DISTINCT chunk_id) AS chunks, count(DISTINCT batch_id) AS batches,
  max(batch_id) + 1 AS next_batch, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY file""")
def file_stats(spark, sf):
    return table(spark, sf, "chunks").groupBy("file").agg(
        F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("batch_id").alias("batches"),
        (F.max("batch_id") + 1).alias("next_batch"), F.sum(F.length("text")).alias("chars"),
    )


@query("""WITH c AS (SELECT DISTINCT chunk_id, file, batch_id FROM chunks), f AS (SELECT file, min(batch_id) AS batch_id FROM c GROUP BY file),
n AS (SELECT batch_id, count(*) AS files FROM f GROUP BY 1), e AS (SELECT batch_id, count(*) AS rows FROM c GROUP BY 1)
SELECT e.batch_id, sum(rows) OVER (ORDER BY e.batch_id)::BIGINT AS total_chunks, sum(coalesce(files, 0)) OVER (ORDER BY e.batch_id)::BIGINT AS indexed_files
FROM e LEFT JOIN n USING (batch_id)""")
def index_counters(spark, sf):
    return incremental.running_counters(table(spark, sf, "chunks").select("chunk_id", "file", "batch_id").distinct())


SIZES_SQL = """SELECT count(*) AS chunks, (sum(length(j) + len(regexp_extract_all(j, '[\\x{10000}-\\x{10FFFF}]')) - CASE WHEN file IS NULL THEN 12 ELSE 0 END
    - CASE WHEN heading IS NULL THEN 15 ELSE 0 END - CASE WHEN text IS NULL THEN 12 ELSE 0 END - CASE WHEN range IS NULL THEN 13 ELSE 0 END)
  + count(*) - 1 + 2) / 1024 AS meta_kb, count(*) * 384 / 1024 AS vector_kb
FROM (SELECT *, to_json({'file': file, 'heading': heading, 'text': text, 'range': CASE WHEN range IS NOT NULL THEN [range."start", range."end"] END})::VARCHAR AS j FROM chunks)"""


@query(SIZES_SQL)
def index_size_stats(spark, sf):
    return size_stats(table(spark, sf, "chunks"), 384)


# ---- vectors


@query(f"WITH {QUANT_SQL} SELECT vec_id, lo AS min, span AS range FROM q")
def quantize_params(spark, sf):
    return coded(spark, sf).select("vec_id", "p.min", "p.range")


@query(f"WITH {QUANT_SQL} SELECT vec_id, codes FROM codes")
def quantize_int8(spark, sf):
    return coded(spark, sf).select("vec_id", "codes")


@query(f"WITH {QUANT_SQL} SELECT vec_id, {TERNARY_SQL} AS codes FROM codes")
def ternary_roundtrip(spark, sf):
    rows = coded(spark, sf).select("vec_id", vx.ternary_pack(F.col("codes")).alias("packed"))
    return rows.select("vec_id", vx.ternary_unpack(F.col("packed"), 64).alias("codes"))


@query(f"""WITH {QUANT_SQL}, t AS (SELECT vec_id, list_transform(codes, lambda c: CASE WHEN c < -42 THEN 0 WHEN c > 42 THEN 2 ELSE 1 END) AS t FROM codes)
SELECT vec_id, array_to_string(list_transform(generate_series(0, len(t) // 4 - 1),
  lambda k: printf('%02X', t[k * 4 + 1] + t[k * 4 + 2] * 4 + t[k * 4 + 3] * 16 + t[k * 4 + 4] * 64)), '') AS packed FROM t""")
def ternary_packed_hex(spark, sf):
    return coded(spark, sf).select("vec_id", F.hex(vx.ternary_pack(F.col("codes"))).alias("packed"))


@query("""SELECT index_id, count(*) AS rows, CASE WHEN count(*) >= 2000 THEN 'pq' WHEN count(*) >= 100 THEN 'ternary' ELSE 'none' END AS compression
FROM vectors GROUP BY index_id""")
def compression_policy(spark, sf):
    n = table(spark, sf, "vectors").groupBy("index_id").agg(F.count("*").alias("rows"))
    return n.withColumn("compression", vx.compression_for(F.col("rows")))


@query("""SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], s.embedding::DOUBLE[])
  / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(s.embedding::DOUBLE[], s.embedding::DOUBLE[]))) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) s) ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk_float(spark, sf):
    e = table(spark, sf, "embeddings")
    seed = e.where("vec_id = 0").select(F.col("embedding").alias("_seed"))  # one row
    scored = e.join(F.broadcast(seed)).select("vec_id", F.round(vx.cosine_float(F.col("_seed"), F.col("embedding")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


def _seeded(spark: SparkSession, sf: str, codes) -> DataFrame:
    rows = coded(spark, sf).select("vec_id", codes(F.col("codes")).alias("vector"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("qvec"))
    return search.vector_topk_batch(rows, asked, 10).select("query_id", "vec_id", "score", "rank")


def seeded_sql(codes: str) -> str:
    return f"""WITH {QUANT_SQL}, v AS (SELECT vec_id, {codes} AS v FROM codes)
SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM (SELECT s.vec_id AS query_id, v.vec_id, {cos_sql('s.v', 'v.v')} AS score FROM v, v s WHERE s.vec_id % 50 = 0)) WHERE rank <= 10"""


@query(seeded_sql("codes"))
def cosine_topk_int8(spark, sf):
    return _seeded(spark, sf, lambda c: c)


@query(seeded_sql(TERNARY_SQL))
def cosine_topk_ternary(spark, sf):
    return _seeded(spark, sf, vx.ternary)


FLOAT_PAIRS = """(SELECT s.vec_id AS query_id, v.vec_id, round(list_dot_product(s.embedding::DOUBLE[], v.embedding::DOUBLE[])
    / (sqrt(list_dot_product(s.embedding::DOUBLE[], s.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings v, embeddings s WHERE s.vec_id % 50 = 0)"""


def _float_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return search.vector_topk_batch(e, asked, 10, vector="embedding", digits=6)


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM {FLOAT_PAIRS}) WHERE rank <= 10""")
def cosine_all_pairs_topk(spark, sf):
    return _float_topk(spark, sf).select("query_id", "vec_id", "score", "rank")


@query(f"""WITH {QUANT_SQL},
f AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {FLOAT_PAIRS}) WHERE rank <= 10),
c AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
  (SELECT s.vec_id AS query_id, v.vec_id, {cos_sql('s.codes', 'v.codes')} AS score FROM codes v, codes s WHERE s.vec_id % 50 = 0)) WHERE rank <= 10)
SELECT f.query_id, count(c.vec_id) / 10.0::DOUBLE AS recall FROM f LEFT JOIN c USING (query_id, vec_id) GROUP BY 1""")
def quantization_recall(spark, sf):
    exact = _float_topk(spark, sf).select("query_id", "vec_id")
    got = _seeded(spark, sf, lambda c: c).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(got, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("hit") / 10.0).alias("recall"))


@query("""SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / n, 6)) AS unit
FROM (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def l2_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(vx.l2_normalize(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("SELECT doc_id, substring(text, 1, 1000) AS text FROM documents")
def truncate_for_embedding(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncate_for_embedding(F.col("text")).alias("text"))


# ---- hybrid search


def hybrid_sql(codes: str, k: int, corpus: str = "(SELECT doc_id, text FROM documents SEMI JOIN embeddings ON doc_id = vec_id)") -> str:
    return f"""WITH {QUANT_SQL}, v AS (SELECT vec_id AS doc_id, {codes} AS v FROM codes), {TITLES_SQL}, {HITS_SQL.replace('CORPUS', corpus)},
h AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, first_value(doc_id) OVER (PARTITION BY query_id ORDER BY kw DESC, doc_id) AS seed FROM hits WHERE kw > 0),
s AS (SELECT query_id, h.doc_id, kw, CASE WHEN n > 1 AND sv.v IS NOT NULL AND list_max(list_transform(sv.v, lambda x: abs(x::INT))) > 0 AND v.v IS NOT NULL
  THEN 0.6 * (kw / (kw + 1.0)) + 0.4 * {cos_sql('sv.v', 'v.v')} ELSE kw END AS score
  FROM h LEFT JOIN v ON v.doc_id = h.doc_id LEFT JOIN v sv ON sv.doc_id = h.seed)
SELECT query_id, doc_id, kw, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kw DESC, doc_id)::INT AS rank FROM s) WHERE rank <= {k}"""


def _hybrid(spark: SparkSession, sf: str, codes=lambda c: c, k: int = 10) -> DataFrame:
    docs, vectors = hybrid_corpus(spark, sf)
    vectors = vectors.select("doc_id", codes(F.col("vector")).alias("vector"))
    return search.hybrid_search_batch(docs, vectors, title_queries(spark, sf), k).select("query_id", "doc_id", "kw", "score", "rank")


@query(hybrid_sql("codes", 10))
def hybrid_search_batch(spark, sf):
    return _hybrid(spark, sf)


@query(hybrid_sql(TERNARY_SQL, 10))
def hybrid_ternary(spark, sf):
    return _hybrid(spark, sf, vx.ternary)


@query(hybrid_sql("codes", 10, "documents"))
def hybrid_batch_all(spark, sf):
    """All documents, most of them without a vector: their hits keep the raw keyword score."""
    _, vectors = hybrid_corpus(spark, sf)
    hits = search.hybrid_search_batch(table(spark, sf, "documents"), vectors, title_queries(spark, sf), 10)
    return hits.select("query_id", "doc_id", "kw", "score", "rank")


def one_query_sql(terms: list[str], corpus: str, k: int) -> str:
    kw = " + ".join(["0.0"] + [saturate_sql(count_sql(LOW, f"'{t}'")) for t in terms])
    return f"""WITH {QUANT_SQL}, v AS (SELECT vec_id AS doc_id, codes AS v FROM codes),
h AS (SELECT *, count(*) OVER () AS n, first_value(doc_id) OVER (ORDER BY kw DESC, doc_id) AS seed FROM (SELECT doc_id, {kw} AS kw FROM {corpus}) WHERE kw > 0),
s AS (SELECT h.doc_id, kw, CASE WHEN n > 1 AND sv.v IS NOT NULL AND v.v IS NOT NULL THEN 0.6 * (kw / (kw + 1.0)) + 0.4 * {cos_sql('sv.v', 'v.v')} ELSE kw END AS score
  FROM h LEFT JOIN v ON v.doc_id = h.doc_id LEFT JOIN v sv ON sv.doc_id = h.seed)
SELECT doc_id, kw, score FROM s ORDER BY score DESC, kw DESC, doc_id LIMIT {k}"""


WITH_VECTOR = "(SELECT doc_id, text FROM documents SEMI JOIN embeddings ON doc_id = vec_id)"


@query(one_query_sql(TERMS, WITH_VECTOR, 10))
def hybrid_search(spark, sf):
    docs, vectors = hybrid_corpus(spark, sf)
    return search.hybrid_search(docs, vectors, ASKED, 10)


@query(one_query_sql(["nobody", "restore"], "documents", 25))
def hybrid_no_vectors(spark, sf):
    """All documents, most of them without a vector: the seed's vector is often missing, and raw scores stay."""
    _, vectors = hybrid_corpus(spark, sf)
    return search.hybrid_search(table(spark, sf, "documents"), vectors, "nobody restore", 25)


@query(one_query_sql(["-0."], "(SELECT doc_id, path AS text FROM documents)", 10))
def hybrid_single_hit(spark, sf):
    """One hit keeps its raw keyword score."""
    _, vectors = hybrid_corpus(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", F.col("path").alias("text"))
    return search.hybrid_search(docs, vectors, "-0.", 10)


@query(f"""SELECT doc_id, substring(regexp_replace(regexp_replace(text, '{WS_SQL}+', ' ', 'g'), '^ +| +$', '', 'g'), 1, 100)
  || CASE WHEN length(text) > 100 THEN '…' ELSE '' END AS snippet, floor(kw * 100 + 0.5)::INT AS pct,
  CASE WHEN floor(kw * 100 + 0.5) > 60 THEN 'green' WHEN floor(kw * 100 + 0.5) > 30 THEN 'yellow' ELSE 'dim' END AS band
FROM (SELECT doc_id, text, {KW_SQL} AS kw FROM documents) WHERE kw > 0""")
def result_snippets(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.join(search.keyword_hits(docs, ASKED), "doc_id")
    return rows.select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.score_percent(F.col("kw")).alias("pct"), tx.score_band(F.col("kw")).alias("band"))


# ---- files, titles, navigation


@query(f"""SELECT path FROM source_files WHERE ({' OR '.join(f"regexp_matches(path, '{tx.glob_regex(p)}')" for p in DEFAULT_INCLUDE)})
  AND NOT ({' OR '.join(f"regexp_matches(path, '{tx.glob_regex(p)}')" for p in (*DEFAULT_EXCLUDE, '**/v3/**', '*/faq/*'))})""")
def glob_include_exclude(spark, sf):
    exclude = [*DEFAULT_EXCLUDE, "**/v3/**", "*/faq/*"]
    return table(spark, sf, "source_files").where(tx.glob_filter(F.col("path"), list(DEFAULT_INCLUDE), exclude)).select("path")


TITLE_SQL = """array_to_string(list_transform(regexp_extract_all(regexp_replace(SLUG, '[-_]', ' ', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
  lambda p: CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE p END), '')"""


def title_sql(slug: str) -> str:
    return TITLE_SQL.replace("SLUG", slug)


LAST_SQL = r"regexp_replace(string_split(path, '/')[-1], '\.[A-Za-z0-9_]+$', '')"


@query(f"SELECT DISTINCT path, {title_sql(LAST_SQL)} AS title FROM source_files WHERE path IS NOT NULL")
def slug_titles(spark, sf):
    return table(spark, sf, "source_files").where("path IS NOT NULL").select("path", tx.file_title(F.lit(""), F.col("path")).alias("title")).distinct()


NAV_SQL = f"""f AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM source_files WHERE path IS NOT NULL),
d AS (SELECT DISTINCT list_slice(p, 1, n) AS p FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS n FROM f WHERE len(p) > 1))
SELECT path, CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], '/') END AS parent_path, {title_sql(LAST_SQL)} AS title, false AS is_dir, (len(p) - 1)::INT AS depth FROM f
UNION ALL SELECT array_to_string(p, '/'), CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], '/') END, {title_sql('p[-1]')}, true, (len(p) - 1)::INT FROM d"""


@query(f"WITH {NAV_SQL}")
def nav_tree(spark, sf):
    return nav.nav_nodes(table(spark, sf, "source_files").select("path", F.lit("").alias("title")))


@query(f"WITH nodes AS (WITH {NAV_SQL}) SELECT path, row_number() OVER (ORDER BY path COLLATE en, path) - 1 AS place FROM nodes")
def nav_sorted(spark, sf):
    """The navigation's nodes in locale order of their paths."""
    nodes = nav.nav_nodes(table(spark, sf, "source_files").select("path", F.lit("").alias("title")))
    return numbered(nav.nav_order(nodes), "place").select("path", "place")


@query("SELECT file, coalesce(arg_min(heading, chunk_id) FILTER (heading IS NOT NULL), '') AS heading FROM chunks GROUP BY file")
def first_heading(spark, sf):
    return nav.first_headings(table(spark, sf, "chunks"))


# ---- incremental maintenance

PREVIOUS_SQL = f"""cur AS (SELECT {PATH_SQL} AS path, doc_id * 1000.5 AS mtime, coalesce(n_chars, 0) AS size FROM documents),
prev AS (SELECT {PATH_SQL} AS path, doc_id * 1000.5 AS mtime, coalesce(n_chars, 0) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, [(doc_id // 256)::INT] AS batches
  FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'gone/' || path, 1.5, 10, NULL::INT[] FROM (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL))"""


def _manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(doc_paths(spark, sf), "doc_id")
    mtime = (F.col("doc_id") * F.lit(1000.5)).alias("mtime")
    current = docs.select("path", mtime, F.coalesce("n_chars", F.lit(0)).alias("size"))
    kept = docs.where("doc_id % 5 <> 0").select(
        "path", mtime, (F.coalesce("n_chars", F.lit(0)) + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("size"),
        F.array(F.floor(F.col("doc_id") / 256).cast("int")).alias("batches"),
    )
    gone = table(spark, sf, "source_files").where("path IS NOT NULL").select("path").distinct().select(
        F.concat(F.lit("gone/"), "path").alias("path"), F.lit(1.5).alias("mtime"), F.lit(10).cast("long").alias("size"),
        F.lit(None).cast("array<int>").alias("batches"),
    )
    return current, kept.unionByName(gone)


@query(f"""WITH {PREVIOUS_SQL} SELECT path, CASE WHEN prev.path IS NULL THEN 'new' ELSE 'modified' END AS reason
FROM cur LEFT JOIN prev USING (path) WHERE prev.path IS NULL OR prev.mtime <> cur.mtime OR prev.size <> cur.size""")
def changed_files(spark, sf):
    return incremental.changed_files(*_manifests(spark, sf))


@query(f"WITH {PREVIOUS_SQL} SELECT path FROM cur JOIN prev USING (path) WHERE prev.mtime = cur.mtime AND prev.size = cur.size")
def unchanged_files(spark, sf):
    return incremental.unchanged_files(*_manifests(spark, sf))


@query(f"WITH {PREVIOUS_SQL} SELECT path FROM prev ANTI JOIN cur USING (path)")
def deleted_files(spark, sf):
    return incremental.deleted_files(*_manifests(spark, sf))


@query(f"""WITH {PREVIOUS_SQL} SELECT path, coalesce(cur.mtime, prev.mtime) AS mtime, coalesce(cur.size, prev.size) AS size, coalesce(batches, []::INT[]) AS batches
FROM cur FULL JOIN prev USING (path)""")
def manifest_upsert(spark, sf):
    current, previous = _manifests(spark, sf)
    return incremental.upsert_manifest(previous, current, drop_deleted=False)


@query(f"""WITH l AS (SELECT CASE doc_id % 6 WHEN 0 THEN ' M ' WHEN 1 THEN '?? ' WHEN 2 THEN ' D ' WHEN 3 THEN 'D  ' WHEN 4 THEN 'A  ' ELSE 'MM ' END || {PATH_SQL} AS line FROM documents)
SELECT DISTINCT trim(substring(line, 4)) AS path FROM l WHERE NOT (line LIKE ' D%' OR line LIKE 'D %')""")
def git_status_parse(spark, sf):
    marks = F.element_at(F.array(*[F.lit(x) for x in (" M ", "?? ", " D ", "D  ", "A  ", "MM ")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return incremental.parse_git_status(doc_paths(spark, sf).select(F.concat(marks, "path").alias("line")))


@query(f"""WITH {PREVIOUS_SQL}, g AS (SELECT {PATH_SQL} AS path FROM documents WHERE doc_id % 9 = 0 UNION SELECT 'outside/' || path FROM source_files)
SELECT path FROM cur SEMI JOIN g USING (path)""")
def detect_changes(spark, sf):
    current, previous = _manifests(spark, sf)
    named = doc_paths(spark, sf).where("doc_id % 9 = 0").select("path").unionByName(
        table(spark, sf, "source_files").select(F.concat(F.lit("outside/"), "path").alias("path"))
    )
    return incremental.detect_changes(current, previous, named)


# ---- problem 5: the work ledger

LEDGER_SQL = """listing AS (SELECT path, mtime, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY listed_at DESC, mtime DESC, size DESC) AS r
  FROM source_files WHERE mtime IS NOT NULL AND size IS NOT NULL AND path IS NOT NULL) WHERE r = 1),
rec AS (SELECT f.* , status FROM file_records f JOIN index_runs USING (run_id)),
last AS (SELECT path, run_id, mtime, size, batches FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, recorded_at DESC, mtime DESC, size DESC) AS r FROM rec WHERE status = 'complete') WHERE r = 1),
opened AS (SELECT path, max(run_id) AS open_token FROM rec WHERE status <> 'complete' GROUP BY 1),
lost AS (SELECT DISTINCT path FROM (SELECT path, unnest(batches) AS batch_id FROM last) ANTI JOIN (SELECT batch_id FROM index_batches WHERE stored_at IS NOT NULL) USING (batch_id)),
plan AS (SELECT l.path, l.mtime, l.size, CASE WHEN r.path IS NULL THEN CASE WHEN open_token IS NOT NULL THEN 'expired' ELSE 'new' END
    WHEN r.mtime IS DISTINCT FROM l.mtime OR r.size IS DISTINCT FROM l.size THEN 'changed'
    WHEN r.batches IS NULL OR lost.path IS NOT NULL THEN 'unstored' END AS reason,
  r.run_id::BIGINT AS token, greatest(coalesce(r.run_id, 0), coalesce(open_token, 0))::BIGINT + 1 AS next_token
  FROM listing l LEFT JOIN last r USING (path) LEFT JOIN opened USING (path) LEFT JOIN lost USING (path))"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.plan_run(*[table(spark, sf, t) for t in ("source_files", "file_records", "index_runs", "index_batches")])


@query(f"WITH {LEDGER_SQL} SELECT path FROM plan WHERE reason IS NOT NULL")
def p5_found(spark, sf):
    return _plan(spark, sf).where("state = 'pending'").select("path")


@query(f"WITH {LEDGER_SQL} SELECT path, mtime, size, CASE WHEN reason IS NULL THEN 'done' ELSE 'pending' END AS state, reason, token, next_token FROM plan")
def p5_ledger(spark, sf):
    return _plan(spark, sf)


FENCING_SQL = """r AS (SELECT DISTINCT path, run_id::BIGINT AS token, status, max(epoch_us(recorded_at)) OVER (PARTITION BY path, run_id) / 1e6 AS since
  FROM file_records JOIN index_runs USING (run_id) WHERE path IS NOT NULL),
n AS (SELECT *, max(token) OVER (PARTITION BY path) AS newest, (SELECT max(epoch_us(recorded_at)) / 1e6 FROM file_records) AS now FROM r)"""


def _leases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leases, asked commits, now): every run's work on a path as a lease of a day, and a commit of each run that ended."""
    records = table(spark, sf, "file_records").where("path IS NOT NULL").join(table(spark, sf, "index_runs").select("run_id", "status"), "run_id")
    at = F.unix_micros("recorded_at") / 1e6
    work = records.groupBy(F.col("path").alias("item"), F.col("run_id").cast("long").alias("token"), "status").agg(F.max(at).alias("at"))
    leases = work.select("item", F.lit("any").alias("version"), F.lit("leased").alias("kind"), "token", F.lit("run").alias("worker"), "at", (F.col("at") + 86400.0).alias("until"))
    asked = work.where("status = 'complete'").select("item", F.lit("any").alias("version"), "token", "at")
    now = table(spark, sf, "file_records").agg((F.max(F.unix_micros("recorded_at")) / 1e6).alias("_now"))
    return leases, asked, now


@query(f"WITH {FENCING_SQL} SELECT path, token, token = newest AS accepted FROM n WHERE status = 'complete'")
def p5_fencing(spark, sf):
    """Which runs' commits the ledger takes if all come at the end: those under the newest token of their path."""
    leases, asked, _ = _leases(spark, sf)
    return ledger.judge_commits(asked.drop("at"), leases, now=None).select(F.col("item").alias("path"), "token", "accepted")


@query(f"""WITH {FENCING_SQL} SELECT DISTINCT path, CASE WHEN status = 'complete' THEN 'done' WHEN since + 86400 > now THEN 'leased' ELSE 'pending' END AS state, newest AS token
FROM n WHERE token = newest""")
def p5_leases(spark, sf):
    """Every recorded path's state once the accepted commits are in: done, leased while its lease of a day runs, or pending after."""
    leases, asked, now = _leases(spark, sf)
    done = ledger.judge_commits(asked.drop("at"), leases, now=None).where("accepted").select(
        "item", "version", F.lit("done").alias("kind"), "token", F.lit("run").alias("worker"), F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("until")
    )
    end = now.first()["_now"] or 0.0  # one row
    states = ledger.fold_states(leases.select("item", "version").distinct(), leases.unionByName(done), end)
    return states.select(F.col("item").alias("path"), "state", "token")


# ---- streaming


@query(f"{chunk_sql(256, 32)} SELECT {FIELDS}, true AS coded FROM chunked")
def stream_progressive_index(spark, sf):
    """Documents read as a stream and indexed in micro-batches; the stored chunks, and whether each has a vector."""
    import os
    import uuid

    from pagelode.plans.embed import HashingEmbedder
    from pagelode.session import cut_lineage, ensure_checkpoint_dir
    from pagelode.sources.fs import SharedFolder
    from pagelode.sources.store import IndexStore
    from pagelode.streaming.progressive import progressive_index

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf}/documents.parquet"
    schema = spark.read.parquet(source).schema
    pattern = source if os.path.isdir(source) else f"{sf}/documents.parque[t]"
    store = IndexStore(spark, f"{base}/index")
    progressive_index(spark, pattern, schema, store, f"{base}/state", embedder=HashingEmbedder(64)).awaitTermination()
    place = (F.row_number().over(Window.partitionBy("file").orderBy("chunk_id")) - 1).cast("long")
    coded = store.vectors().select("chunk_id", F.col("vector").isNotNull().alias("coded"))
    rows = cut_lineage(store.chunks().withColumn("pos", place).join(coded, "chunk_id", "left").select(
        F.col("file").cast("long").alias("id"), "pos", "heading", "text", F.col("range.start").alias("range_start"), F.col("range.end").alias("range_end"),
        F.coalesce("coded", F.lit(False)).alias("coded"),
    ))
    SharedFolder(spark, base).delete("")
    return rows
