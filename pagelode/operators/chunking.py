"""Chunkers: the heading-aware fold (default), fixed windows and section splitting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.functions.text import WORD_RE, WS, WS_CHARS, WS_EACH, tokens, trim_ws
from pagelode.operators.ordinal import numbered, with_ordinal
from pagelode.schemas import PIECES

HEADING = re.compile(f"#{{1,6}}[{WS_CHARS}]")
HEADING_MARK = re.compile(f"^#+[{WS_CHARS}]*")


def utf16(text: str) -> int:
    """Length in UTF-16 units, which is what ranges count."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def fold_lines(text: str | None, size: int, overlap: int) -> list[tuple[str | None, str, int, int]]:
    """One text's chunks as (heading, text, start, end).

    Lines are read in order. A heading closes the running chunk and is itself no
    part of any text; any other line adds its words, and a chunk closes after the
    line that fills it. The last ``overlap`` words are carried on, across headings
    too; an overlap of 0 carries all words. Null, empty and blank texts give nothing.
    """
    out: list[tuple[str | None, str, int, int]] = []
    heading: str | None = None
    words: list[str] = []
    start = at = 0
    for line in (text or "").split("\n"):
        after = at + utf16(line) + 1
        title = HEADING.match(line) is not None
        if not title:
            words += WORD_RE.findall(line)
        if words and (title or len(words) >= size):
            out.append((heading, " ".join(words), start, at if title else after))
            words = words[-overlap:] if overlap else words
            start = at
        if title:
            heading = HEADING_MARK.sub("", line).strip(WS_EACH)
        at = after
    if words:
        out.append((heading, " ".join(words), start, at))
    return out


def chunk_column(text: Column, size: int = 256, overlap: int = 32) -> Column:
    """Array of chunks of one text, folded in Arrow batches."""

    @F.pandas_udf(PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda t: [dict(zip(("heading", "text", "start", "end"), c)) for c in fold_lines(t, size, overlap)]
            )

    return run(text)


def chunk_documents(
    docs: DataFrame, text: str = "text", size: int = 256, overlap: int = 32, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per chunk: the ``keep`` columns, pos, heading, text, range.

    Only ``keep`` and the text are read, so extra columns with clashing names do no harm.
    """
    if overlap > 0 and overlap >= size:
        raise ValueError("overlap must be smaller than size")
    cut = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], chunk_column(F.col(text), size, overlap).alias("_c"))
    rows = cut.select(*[f"_k{i}" for i in range(len(keep))], F.posexplode("_c").alias("pos", "_p"))
    return rows.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)],
        F.col("pos").cast("long"),
        F.col("_p.heading").alias("heading"),
        F.col("_p.text").alias("text"),
        F.struct(F.col("_p.start").alias("start"), F.col("_p.end").alias("end")).alias("range"),
    )


def number_chunks(chunks: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``chunk_id`` 0, 1, 2 ... in that order, and ``batch_id`` of 256 chunks each."""
    return with_ordinal(chunks, order, "chunk_id").withColumn("batch_id", F.floor(F.col("chunk_id") / 256).cast("int"))


def chunk_in_order(docs: DataFrame, key: str, text: str = "text", size: int = 256, overlap: int = 32) -> DataFrame:
    """(chunk_id, batch_id, key, pos, heading, text, range): all chunks, numbered by key and position.

    The documents are put in order before they are cut, so the chunker runs once and its
    rows need no shuffle of their own.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col(key).alias(key), F.col(text).alias("_text")).repartitionByRange(n, key).sortWithinPartitions(key)
    rows = numbered(chunk_documents(placed, "_text", size, overlap, keep=(key,)), "chunk_id")
    return rows.withColumn("batch_id", F.floor(F.col("chunk_id") / 256).cast("int"))


def fixed_windows(docs: DataFrame, key: str, text: str = "text", size: int = 256, overlap: int = 32) -> DataFrame:
    """Hard windows of ``size`` words stepping ``size - overlap``; short texts stay whole and are trimmed.

    Blank and null texts give no row. Built from array expressions alone.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    split = docs.select(F.col(key).alias(key), F.col(text).alias("_t"), tokens(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.when(F.size("_w") <= size, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap))
    )
    rows = split.select(key, "_t", "_w", F.posexplode(starts).alias("pos", "_at"))
    whole = F.size("_w") <= size
    return rows.select(
        key,
        F.col("pos").cast("long").alias("pos"),
        F.when(whole, trim_ws(F.col("_t"))).otherwise(F.array_join(F.slice("_w", F.col("_at") + 1, size), " ")).alias("text"),
    )


#: What ends a line for ``sections``.
LINE_BREAKS = "\n\r\u2028\u2029"


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The stretches between Markdown headings: (key, pos, heading, text), blank stretches dropped. Null texts give no row."""
    mark = "#{1,6}" + WS + f"+[^{LINE_BREAKS}]"
    start = f"(?<![^{LINE_BREAKS}])(?={mark})"
    rows = docs.select(F.col(key).alias(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), start)).alias("pos", "_s"))
    has = F.col("_s").rlike(f"^{mark}")
    line = f"^#{{1,6}}{WS}+[^{LINE_BREAKS}]*"
    body = F.when(has, F.regexp_replace("_s", line, "")).otherwise(F.col("_s"))
    return rows.select(
        key,
        F.col("pos").cast("long").alias("pos"),
        F.when(has, trim_ws(F.regexp_replace(F.regexp_extract("_s", line, 0), "^#+" + WS + "+", ""))).alias("heading"),
        trim_ws(body).alias("text"),
    ).where(F.col("text") != "")


def register_chunk_text(spark) -> None:
    """Make ``chunk_text(text, size, overlap)`` callable in SQL as a table function."""

    @F.udtf(returnType="pos bigint, heading string, text string, start bigint, end bigint")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            for i, (heading, body, start, end) in enumerate(fold_lines(text, size, overlap)):
                yield i, heading, body, start, end

    spark.udtf.register("chunk_text", ChunkText)
