"""How characteristic each word is of its record: graph-of-words weighting (problem 1).

Within a record every word is linked with the different words in a window around it.
The number of its distinct neighbours stands in for its frequency, so a word repeated
in one phrase weighs less than one used in many contexts. The weight is divided by a
mild length norm and multiplied by the word's rarity over all records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.stage import HOT_KEYS, cut, look_up

RUN = re.compile(r"[^\W_]+")
#: A term is hot from so many records at least.
HOT_RECORDS = 10_000
#: No words, since they begin with a blank: the number of records, of texts that are not null, and of their characters.
RECORDS, TEXTS, CHARS = " records", " texts", " characters"
#: Characters of text that are worked on at once.
BLOCK_CHARS = 4_000_000


def words_of(text: str | None) -> list[str]:
    """Maximal runs of Unicode letters and digits, in lower case, in order."""
    if not text:
        return []
    if "İ" in text:  # its lower case holds a mark that would split the run
        return [w.lower() for w in RUN.findall(text)]
    return RUN.findall(text.lower())


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[str]], list[int]]]:
    """The batch's keys, words and text lengths in blocks of bounded size."""
    texts = batch.column(1).to_pylist()
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK_CHARS or i == len(texts) - 1:
            yield batch.column(0).slice(at, i + 1 - at), [words_of(t) for t in texts[at : i + 1]], [len(t or "") for t in texts[at : i + 1]]
            at, size = i + 1, 0


def _flat(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record of each word, code of each word, the distinct words)."""
    record = np.repeat(np.arange(len(words)), [len(w) for w in words])
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    return record, codes.astype(np.int64), distinct


def record_graph(words: list[list[str]], window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, code, frequency, degree, distinct words) of the words that occur ``least`` times in a record.

    The degree counts the different words within ``window`` - 1 places on either side.
    """
    record, codes, distinct = _flat(words)
    size = max(len(distinct), 1)
    nodes, node, count = np.unique(record * size + codes, return_inverse=True, return_counts=True)
    wanted = count >= least
    ends = []
    for gap in range(1, window):
        a, b = node[:-gap], node[gap:]
        ok = (record[:-gap] == record[gap:]) & (a != b) & (wanted[a] | wanted[b])
        a, b = a[ok], b[ok]
        ends.append(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
    edges = np.unique(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
    degree = np.bincount(edges // max(len(nodes), 1), minlength=len(nodes)) + np.bincount(edges % max(len(nodes), 1), minlength=len(nodes))
    kept = nodes[wanted]
    return kept // size, kept % size, count[wanted], degree[wanted], distinct


def record_frequencies(records: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df): in how many records each word occurs, and the sums under ``RECORDS``, ``TEXTS`` and ``CHARS``.

    Counts are summed up per batch before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.num_rows - batch.column(1).null_count
            chars = pc.sum(pc.utf8_length(batch.column(1))).as_py() or 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([RECORDS, TEXTS, CHARS], pa.string()), pa.array([batch.num_rows, texts, chars], pa.int64())], names=["term", "n"]
            )
            for _, words, _ in _blocks(batch):
                record, codes, distinct = _flat(words)
                once = np.unique(record * max(len(distinct), 1) + codes) % max(len(distinct), 1)
                n = np.bincount(once, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.string()), pa.array(n, pa.int64())], names=["term", "n"])

    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def term_graphs(records: DataFrame, key: str, text: str, window: int, least: int) -> DataFrame:
    """(key, term, tf, degree, length of the text) of every word that occurs ``least`` times in its record."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words, lengths in _blocks(batch):
                record, code, tf, degree, distinct = record_graph(words, window, least)
                length = np.array(lengths, dtype=np.int64)
                terms = pa.array(distinct, pa.string()).take(pa.array(code))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(record)), terms, pa.array(tf, pa.int64()), pa.array(degree, pa.int64()), pa.array(length[record])],
                    names=["key", "term", "tf", "degree", "length"],
                )

    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, term string, tf bigint, degree bigint, length bigint")


def distinctive_terms(
    records: DataFrame, key: str, text: str = "text", window: int = 4, slope: float = 0.003, least: int = 1,
    between: tuple[int, int] | None = None,
) -> DataFrame:
    """(key, term, tf, degree, df, score) for every word of every record; keys must be unique.

    score = degree / (1 - slope + slope * length / mean length) * ln((records + 1) / df),
    lengths in characters, the mean over all texts. A word alone in its record has degree
    0 and score 0. ``least`` leaves out words that are rarer within their record, ``between``
    words whose df lies outside; df and the other figures cover all words of all records
    all the same. Null, empty and wordless texts give no row, and count as records.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    df = cut(record_frequencies(records, key, text))
    graphs = term_graphs(records, key, text, window, least)
    special = F.col("term").isin(RECORDS, TEXTS, CHARS)
    sums = {r["term"]: r["df"] for r in df.where(special).collect()}  # three rows
    n, mean = sums.get(RECORDS, 0), sums.get(CHARS, 0) / max(sums.get(TEXTS, 0), 1)
    norm = 1 - slope + slope * F.col("length") / F.lit(float(mean or 1.0))
    score = F.col("degree") / norm * F.log((F.lit(float(n)) + 1) / F.col("df"))
    known = _with_frequency(graphs, df.where(~special), between)
    return known.select(F.col("key").alias(key), "term", "tf", "degree", "df", score.alias("score"))


def _with_frequency(graphs: DataFrame, df: DataFrame, between: tuple[int, int] | None) -> DataFrame:
    """The graphs with each term's df. Terms of very many records do not gather in one task.

    A term is hot if it makes up one in ``HOT_KEYS`` of all (record, term) pairs, so at most
    ``HOT_KEYS`` are. Where they are not wanted, their rows are dropped before the shuffle.
    """
    pairs = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]  # one row
    hot = df.where(F.col("df") >= max(HOT_RECORDS, -(-pairs // HOT_KEYS))).select("term", "df")
    if between is None:
        return look_up(graphs, df, "term", hot.select("term"), "key")
    wanted = df.where(F.col("df").between(*between))
    cold = graphs.join(F.broadcast(hot.where(~F.col("df").between(*between)).select("term")), "term", "left_anti")
    return look_up(cold, wanted, "term", hot.select("term"), "key", "inner")
