import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelode.operators import chunking as ch


def test_headings_flush_and_carry_overlap():
    text = "# One\na b c\n## Two\n## Three\nd"
    got = ch.fold_lines(text, 100, 2)
    assert got == [("One", "a b c", 0, 12), ("Two", "b c", 12, 19), ("Three", "b c d", 19, len(text) + 1)]


def test_size_flush_leaves_overlap_only_tail():
    assert ch.fold_lines("a b c d", 4, 2) == [(None, "a b c d", 0, 8), (None, "c d", 0, 8)]


def test_zero_overlap_keeps_all_words():
    got = ch.fold_lines("a b\nc d\ne", 2, 0)
    assert [g[1] for g in got] == ["a b", "a b c d", "a b c d e", "a b c d e"]


@pytest.mark.parametrize("text", [None, "", " \n\t", "# only a heading"])
def test_nothing_to_chunk(text):
    assert ch.fold_lines(text, 10, 2) == []


def test_heading_rules_and_utf16():
    assert ch.fold_lines("#NoSpace x", 9, 1)[0][0] is None
    assert ch.fold_lines("####### seven", 9, 1) == [(None, "####### seven", 0, 14)]
    assert ch.fold_lines("#  T \na", 9, 1)[0][0] == "T"
    assert ch.fold_lines("\U0001F600\na", 9, 1)[0][3] == 5


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab# \n ", max_size=80), st.integers(2, 6), st.integers(1, 1))
def test_every_word_is_in_some_chunk(text, size, overlap):
    pieces = ch.fold_lines(text, size, overlap)
    words = [w for line in text.split("\n") if not ch.HEADING.match(line) for w in ch.WORD_RE.findall(line)]
    assert set(words) == {w for p in pieces for w in p[1].split(" ")}
    assert all(0 <= p[2] <= p[3] <= len(text) + 1 for p in pieces)


def test_frame_forms(spark):
    docs = spark.createDataFrame([(1, "# H\na b c d e", "x"), (2, None, "y"), (3, "", "z")], "id long, text string, pos string")
    rows = ch.chunk_documents(docs, "text", 3, 1, keep=("id",)).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["heading"], r["text"]) for r in rows] == [(1, 0, "H", "a b c d e"), (1, 1, "H", "e")]
    assert ch.chunk_documents(docs.limit(0), "text", keep=("id",)).count() == 0
    with pytest.raises(ValueError):
        ch.chunk_documents(docs, "text", 3, 3)


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, " a b c d e f g "), (2, " a b "), (3, " "), (4, None)], "id long, text string")
    rows = ch.fixed_windows(docs, "id", size=4, overlap=1).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["text"]) for r in rows] == [(1, 0, "a b c d"), (1, 1, "d e f g"), (1, 2, "g"), (2, 0, "a b")]
    with pytest.raises(ValueError):
        ch.fixed_windows(docs, "id", size=4, overlap=4)


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nbody a\n\n## B\n\nbody b"), (2, "# only")], "id long, text string")
    rows = ch.sections(docs, "id").orderBy("id", "pos").collect()
    assert [(r["heading"], r["text"]) for r in rows] == [(None, "intro"), ("A", "body a"), ("B", "body b")]


def test_ordinal_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = ch.with_ordinal(df, ("k",), "n").collect()
    assert all(r["k"] == r["n"] for r in rows) and len(rows) == 1000


def test_table_function(spark):
    ch.register_chunk_text(spark)
    spark.createDataFrame([(1, "# A\nx y z")], "id long, text string").createOrReplaceTempView("d")
    rows = spark.sql("SELECT id, c.* FROM d, LATERAL chunk_text(text, 2, 1) c ORDER BY pos").collect()
    assert [(r["heading"], r["text"]) for r in rows] == [("A", "x y z"), ("A", "z")]
