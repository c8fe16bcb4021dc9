import re

import pytest
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators.search import parse_query


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, words", [
    ("a b", ["a", "b"]), ("a﻿b c", ["a", "b", "c"]), ("", []), (" \t\r\n", []), (None, None), ("x\u001cy", ["x\u001cy"]),
])
def test_tokens(spark, text, words):
    assert one(spark, text, tx.tokens) == words


def test_query_terms_keep_order_and_repeats(spark):
    assert one(spark, "B a  B", tx.query_terms) == ["b", "a", "b"]
    assert parse_query("B a  B") == ["b", "a", "b"]
    assert parse_query(" ") == []


@pytest.mark.parametrize("text, term, n", [("aaaa", "aa", 2), ("a.b.a", ".", 2), ("abc", "x", 0), ("", "a", 0), ("abc", "", 0)])
def test_term_count(spark, text, term, n):
    assert one(spark, text, lambda c: tx.term_count(c, F.lit(term))) == n


@pytest.mark.parametrize("path, pattern, match", [
    ("a.md", "**/*.md", True), ("x/y/a.md", "**/*.md", True), ("a.mdx", "**/*.md", False), ("x/a.md", "*.md", False),
    ("x/node_modules/y/z.md", "**/node_modules/**", True), ("node_modules", "**/node_modules/**", False), ("a+b(c).md", "a+b(c).md", True),
    ("ab.md", "ax?b.md", True), ("A.MD", "**/*.md", False),
])
def test_glob(spark, path, pattern, match):
    assert bool(re.search(tx.glob_regex(pattern), path)) is match
    assert one(spark, path, lambda c: tx.glob_filter(c, [pattern], [])) is match
    assert one(spark, path, lambda c: tx.glob_filter(c, [pattern], [pattern])) is False


@pytest.mark.parametrize("path, title", [
    ("guide/getting-started.md", "Getting Started"), ("a/my_API-notes.v2.txt", "My API Notes.V2"), ("README", "README"), ("x/über-cool.md", "üBer Cool"),
])
def test_titles(spark, path, title):
    assert one(spark, path, lambda c: tx.file_title(F.lit(None).cast("string"), c)) == title
    assert one(spark, path, lambda c: tx.file_title(F.lit("Given"), c)) == "Given"


def test_snippet_and_band(spark):
    assert one(spark, "  a \n b  ", tx.snippet) == "a b"
    long = "word " * 40
    assert one(spark, long, tx.snippet).endswith("…") and len(one(spark, long, tx.snippet)) == 101
    rows = spark.createDataFrame([(0.605,), (0.31,), (0.3,), (1.7,)], "s double").select(tx.score_percent(F.col("s")), tx.score_band(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(61, "green"), (31, "yellow"), (30, "dim"), (170, "green")]


def test_trimming_takes_the_whitespace_class_and_nothing_else(spark):
    from pagelode.functions.text import WS_EACH, trim_ws
    from pagelode.operators.chunking import fold_lines

    assert len(WS_EACH) == 25 and "-" not in WS_EACH and "\u2005" in WS_EACH and "\ufeff" in WS_EACH
    df = spark.createDataFrame([("\u2005 - a -\ufeff",), ("-\u3000",), ("\n",), (None,), ("a" + " " * 100_000 + "b ",)], "t string")
    assert [r[0] for r in df.select(trim_ws(F.col("t"))).collect()] == ["- a -", "-", "", None, "a" + " " * 100_000 + "b"]
    assert fold_lines("# - top -\u2005\nx", 5, 0)[0][0] == "- top -"
