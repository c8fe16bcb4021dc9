"""Splitting oversized items at natural boundaries (problem 4).

Texts are worked on by ranges of fixed size, so a giant file is never loaded whole.

1. Every range counts the words that start in it and finds its entry: the first natural
   boundary (blank line, line end, sentence end, else any word start) from its nominal
   start on, looking one character back. A range without one has no entry.
2. The ranges' boundary tables are stitched: prefix sums of the word counts give the
   position of every entry, and an entry's segment ends at the next range that has one.
3. Every segment is cut into pieces by offset, on its own: it reads its stretch and, to
   the left, the words it shares with the piece before.

``split_records`` does this to the texts of a table (short texts are one range and one
segment), ``split_files`` to byte ranges of files, each stage spread over all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.llm.stage import cut, small_side

WORD = re.compile(r"\S+")
START = re.compile(r"(?<!\S)\S")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*(?=\S)")
LINE_END = re.compile(r"\n\s*(?=\S)")
SENTENCE_END = re.compile(r"[.!?…。！？][)\]\"'”’»]*\s+(?=\S)")
ENDS_SENTENCE = re.compile(r"[.!?…。！？][)\]\"'”’»]*$")
ENDS_CLAUSE = re.compile(r"[,;:、，；：—–][)\]\"'”’»]*$")
#: Characters of a table text, and bytes of a file, in one range; how far an entry is looked for at a strong boundary.
RANGE_CHARS, RANGE_BYTES, HALO = 65_536, 1 << 20, 4_096


def entry_in(text: str, halo: int = HALO) -> int | None:
    """Offset of the first natural boundary in a range's text, the start of a word; None without one.

    ``text`` starts one character before the range, so a word that starts the range is seen as such.
    """
    near = text[: halo + 1]
    for pattern in (BLANK_LINE, LINE_END, SENTENCE_END):
        m = pattern.search(near)
        if m is not None and m.end() >= 1 and m.end() < len(text):
            return m.end()
    m = START.search(text, 1)
    return None if m is None else m.start()


def boundary_table(text: str, size: int = RANGE_CHARS) -> list[tuple[int, int, int]]:
    """(entry, words before the entry, words before the range's end) of the ranges of a text that have an entry."""
    table: list[tuple[int, int, int]] = []
    before = 0
    for at in range(0, max(len(text), 1), size):
        part = text[max(at - 1, 0) : at + size]
        lead = 1 if at else 0
        here = entry_in(part) if at else (m.start() if (m := START.search(part)) else None)
        starts = [m.start() for m in START.finditer(part, lead)]
        if here is not None:
            table.append((at - lead + here, before + sum(s < here for s in starts), before + len(starts)))
        before += len(starts)
        if here is None and table:
            table[-1] = (*table[-1][:2], before)
    return table


def _strength(text: str, left: re.Match[str], right: re.Match[str]) -> int:
    """How natural a cut between two words is."""
    gap = text[left.end() : right.start()]
    lines = gap.count("\n") or gap.count("\r")
    if lines > 1:
        return 4
    if lines == 1:
        return 3
    word = left.group()
    return 2 if ENDS_SENTENCE.search(word) else 1 if ENDS_CLAUSE.search(word) else 0


def cut_segment(text: str, start: int, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of the pieces of a segment, as offsets into ``text``.

    The segment is text[start:]; what is before it is only used as overlap. A piece has
    at most ``size`` words with the overlap counted, and ends at the strongest boundary of
    the second half of what it may hold, the last of equals.
    """
    words = list(WORD.finditer(text))
    first = next((i for i, w in enumerate(words) if w.start() >= start), len(words))
    out = []
    at = first
    while at < len(words):
        shared = min(overlap, at, size - 1)
        room = size - shared
        if len(words) - at <= room:
            end = len(words)
        else:
            low = at + max(room // 2, 1, min(overlap + 1 - shared, room))
            end = max(range(low, at + room + 1), key=lambda e: (_strength(text, words[e - 1], words[e]), e))
        out.append((words[at - shared].start(), words[end - 1].end(), end - at + shared))
        at = end
    return out


def _left_of(text: str, at: int, words: int) -> int:
    """Offset from which ``words`` words lie before ``at``."""
    step = max(64, words * 12)
    while True:
        low = max(0, at - step)
        if low == 0 or len(START.findall(text, low, at)) > words:
            return low
        step *= 2


def split_text(text: str | None, size: int, overlap: int, range_size: int = RANGE_CHARS) -> tuple[int, list[tuple[int, int, int]]]:
    """(words, pieces as (start, end, words)) of one text; no pieces if it has at most ``size`` words."""
    if not text:
        return 0, []
    table = boundary_table(text, range_size)
    total = table[-1][2] if table else 0
    if total <= size:
        return total, []
    pieces = []
    for i, (entry, _, _) in enumerate(table):
        stop = table[i + 1][0] if i + 1 < len(table) else len(text)
        low = _left_of(text, entry, overlap) if entry else 0
        pieces += [(low + a, low + b, n) for a, b, n in cut_segment(text[low:stop], entry - low, size, overlap)]
    return total, pieces


def settings_in_force(configs: DataFrame, default_size: int = 256, default_overlap: int = 32) -> tuple[DataFrame, tuple[int, int]]:
    """((index_id, size, overlap) per index, the defaults): of several rows of an index the latest saved_at holds.

    A null setting means the default, which the latest row without an index holds. A size
    below 1 counts as 1; an overlap outside 0 .. size - 1 is moved to the nearer bound.
    """
    latest = configs.groupBy("index_id").agg(
        F.max_by(F.struct("chunksize", "chunkoverlap"), F.struct("saved_at", "chunksize", "chunkoverlap")).alias("_c")
    ).select("index_id", "_c.*")
    row = latest.where(F.col("index_id").isNull()).first()
    size = row["chunksize"] if row and row["chunksize"] is not None else default_size
    overlap = row["chunkoverlap"] if row and row["chunkoverlap"] is not None else default_overlap
    own = latest.where(F.col("index_id").isNotNull()).select(
        "index_id", F.greatest(F.coalesce("chunksize", F.lit(size)), F.lit(1)).alias("_size"), F.coalesce("chunkoverlap", F.lit(overlap)).alias("_overlap")
    )
    return own, (max(1, size), overlap)


def with_settings(chunks: DataFrame, configs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with ``_size`` and ``_overlap`` of each row's index."""
    own, (size, overlap) = settings_in_force(configs)
    joined = chunks.select("index_id", *columns).join(small_side(cut(own)), "index_id", "left")  # one row an index
    size_col = F.coalesce("_size", F.lit(size))
    lap = F.greatest(F.least(F.coalesce("_overlap", F.lit(overlap)), size_col - 1), F.lit(0))
    return joined.select(*columns, size_col.cast("int").alias("_size"), lap.cast("int").alias("_overlap"))


def long_enough(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose texts have enough characters to hold more than ``_size`` words; others cannot."""
    return rows.where(F.length(text) > 2 * F.col("_size"))


def oversized(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, words, pieces) of the rows (key, text, _size, _overlap) that ``split_text`` cuts; repeated keys count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [split_text(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            at = [i for i, (_, pieces) in enumerate(cuts) if pieces]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([cuts[i][0] for i in at], pa.int64()), pa.array([len(cuts[i][1]) for i in at], pa.int64())],
                names=["key", "words", "pieces"],
            )

    kind = rows.schema[key].dataType.simpleString()
    long = long_enough(rows.where(F.col(key).isNotNull()), text)
    found = long.select(F.col(key).alias("key"), F.col(text).alias("text"), "_size", "_overlap").mapInArrow(run, f"key {kind}, words bigint, pieces bigint")
    return found.groupBy("key").agg(F.max("words").alias("words"), F.max("pieces").alias("pieces")).withColumnRenamed("key", key)


def split_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, piece, heading, text, range, words) of oversized rows (key, heading, text, range, _size, _overlap).

    Keys must be unique. A piece's range starts at the text's own start plus its offset in
    characters; a null range stays null, as does a heading. Texts within the limit, null
    and blank ones give no row. Words are what any Unicode whitespace separates; a single
    word is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, heading, text, start, size, lap = (batch.column(i) for i in range(6))
            rows_at, number, texts, low, high, count = [], [], [], [], [], []
            starts = start.to_pylist()
            for i, (t, n, o) in enumerate(zip(text.to_pylist(), size.to_pylist(), lap.to_pylist())):
                for j, (a, b, c) in enumerate(split_text(t, n, o)[1]):
                    rows_at.append(i), number.append(j), texts.append(t[a:b]), count.append(c)
                    low.append(None if starts[i] is None else starts[i] + a)
                    high.append(None if starts[i] is None else starts[i] + b)
            at = pa.array(rows_at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(at), pa.array(number, pa.int32()), heading.take(at), pa.array(texts, pa.string()),
                    pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(count, pa.int32()),
                ],
                names=["key", "piece", "heading", "text", "low", "high", "words"],
            )

    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("key"), "heading", "text", F.col("range.start").alias("start"), "_size", "_overlap")
    out = given.mapInArrow(run, f"key {kind}, piece int, heading string, text string, low bigint, high bigint, words int")
    ranges = F.when(F.col("low").isNotNull(), F.struct(F.col("low").alias("start"), F.col("high").alias("end")))
    return out.select(F.col("key").alias(key), "piece", "heading", "text", ranges.alias("range"), "words")


# ---- files


def _reader(path: str):
    """(read(offset, length), size) of a file by any URI that pyarrow can open."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    if path.startswith("file:") and not name:
        raise FileNotFoundError(path)
    f = system.open_input_file(name)
    return f.read_at, f.size()


def _stretch(read, start: int, end: int) -> tuple[str, int]:
    """(text, its first byte) of a byte range; a character cut at either side is left to where it starts."""
    start = max(0, start)
    raw = read(end - start + 3, start)
    skip = 0
    while start and skip < min(3, len(raw)) and raw[skip] & 0xC0 == 0x80:
        skip += 1
    stop = end - start
    while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        stop += 1
    return raw[skip:stop].decode("utf-8", "replace"), start + skip


def _bytes_at(text: str) -> np.ndarray:
    """Byte offset of every character of a text, and its end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def split_files(
    spark: SparkSession, folder: str, size: int = 256, overlap: int = 32, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(path, piece, start, end, words, text) of the files of a folder, offsets in bytes; files within the limit are one piece.

    Only the listing is read as a table; contents are read by byte ranges in the tasks.
    Empty and blank files give no row. Files are expected in UTF-8; broken sequences read
    as replacement characters.
    """
    overlap = max(0, min(overlap, size - 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    nominal = files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("at")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, length, at in frame[["path", "length", "at"]].itertuples(index=False):
                read, _ = _reader(path)
                stop = min(at + range_bytes, length)
                back = at
                while back > 0:  # the whole character before the range
                    back -= 1
                    if read(1, back)[0] & 0xC0 != 0x80:
                        break
                text, base = _stretch(read, back, stop)
                lead = 1 if at else 0
                m = START.search(text)
                entry = entry_in(text) if at else (m.start() if m else None)
                starts = sum(1 for _ in START.finditer(text, lead))
                # A character that began before the nominal start belongs to the range before.
                rows.append((path, length, at, None if entry is None else base + int(_bytes_at(text[:entry])[-1]), starts))
            yield pd.DataFrame(rows, columns=["path", "length", "at", "entry", "words"])

    table = cut(nominal.repartition(tasks, "path", "at").mapInPandas(bounds, "path string, length bigint, at bigint, entry bigint, words bigint"))
    order = Window.partitionBy("path").orderBy("at")  # one row a range
    total = Window.partitionBy("path")
    stitched = table.withColumn("total", F.sum("words").over(total)).where(F.col("entry").isNotNull()).withColumn(
        "stop", F.coalesce(F.lead("entry").over(order), F.col("length"))
    ).withColumn("segment", F.row_number().over(order) - 1)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "segment", "local", "start", "end", "words", "text"]
        for frame in frames:
            rows = []
            for path, entry, stop, segment, total in frame[["path", "entry", "stop", "segment", "total"]].itertuples(index=False):
                read, length = _reader(path)
                back = max(64, overlap * 16)
                while True:  # enough words to the left
                    low = max(0, entry - back)
                    text, base = _stretch(read, low, stop)
                    offsets = _bytes_at(text)
                    at = int(np.searchsorted(offsets, entry - base))
                    if low == 0 or len(START.findall(text, 0, at)) > overlap:
                        break
                    back *= 2
                limit = size if total > size else max(total, 1)
                for i, (a, b, n) in enumerate(cut_segment(text, at, limit, overlap)):
                    rows.append((path, segment, i, base + int(offsets[a]), base + int(offsets[b]), n, text[a:b]))
                    if len(rows) >= 5_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    cut_up = stitched.repartition(tasks, "path", "segment").mapInPandas(
        pieces, "path string, segment bigint, local bigint, start bigint, end bigint, words int, text string"
    )
    cut_up = cut(cut_up)
    counts = cut_up.groupBy("path", "segment").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("path").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("path", "segment", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    return cut_up.join(before, ["path", "segment"]).select(
        "path", (F.col("_before") + F.col("local")).alias("piece"), "start", "end", "words", "text"
    )
