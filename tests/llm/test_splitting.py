import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelode.llm import splitting as sp


def check(text, size, overlap, pieces):
    """Pieces are slices within the limit that cover all words, each sharing words with the one before."""
    words = [(m.start(), m.end()) for m in sp.WORD.finditer(text)]
    place = {a: i for i, (a, _) in enumerate(words)}
    close = {b: i + 1 for i, (_, b) in enumerate(words)}
    covered = 0
    for a, b, n in pieces:
        first, last = place[a], close[b]
        assert last - first == n <= size
        assert first <= covered < last
        assert covered - first == min(overlap, covered, size - 1)
        covered = last
    assert covered == len(words)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. ,\n é\U0001F600", max_size=400), st.integers(1, 9), st.integers(0, 8), st.integers(5, 60))
def test_pieces_of_any_text(text, size, overlap, range_size):
    overlap = min(overlap, size - 1)
    n, pieces = sp.split_text(text, size, overlap, range_size)
    assert n == len(sp.WORD.findall(text))
    if n <= size:
        assert pieces == []
    else:
        check(text, size, overlap, pieces)


def test_cuts_where_the_text_pauses():
    text = "one two three four. five six\n\nseven eight nine ten eleven twelve"
    _, pieces = sp.split_text(text, 8, 0)
    assert text[pieces[0][0] : pieces[0][1]].endswith("five six")
    _, pieces = sp.split_text("a b c d. e f g", 5, 1)
    assert [p[2] for p in pieces] == [4, 4]


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), (" \n", 0), ("a b c　d", 4), ("x" * 500_000, 1)])
def test_small_texts(text, n):
    assert sp.split_text(text, 5, 2) == (n, [])


def test_one_endless_word_among_ranges():
    text = "a b " + "x" * 5000 + " c d e"
    n, pieces = sp.split_text(text, 3, 1, 100)
    assert n == 6
    check(text, 3, 1, pieces)


def test_records(spark):
    chunks = [
        (1, 1, "H", "w " * 30, (100, 161), 2), (1, 1, "H", "w " * 30, (100, 161), 5), (2, 1, None, "w " * 10, (0, 5), 1), (3, 2, "", "v " * 6, None, 1), (4, 9, "D", "u " * 13, (0, 1), 1),
        (5, None, "N", "t " * 13, (7, 9), 1), (6, 1, None, None, None, 1), (None, 1, None, "w " * 30, None, 1), (7, 3, None, "s " * 40, (0, 0), 1),
    ]
    configs = [(1, 20, 5, 1), (1, 10, 2, 2), (2, 4, None, 1), (None, 12, 3, 1), (None, 99, 9, 0), (3, 5, 50, 1)]
    c = spark.createDataFrame(chunks, "chunk_id long, index_id int, heading string, text string, range struct<start:long,end:long>, ingested_at long")
    s = spark.createDataFrame(configs, "index_id int, chunksize int, chunkoverlap int, saved_at long")
    rows = sp.with_settings(c, s, ["chunk_id", "heading", "text", "range"])
    long = {r["chunk_id"]: (r["words"], r["pieces"]) for r in sp.oversized(rows, "chunk_id").collect()}
    assert {k: n for k, (n, _) in long.items()} == {1: 30, 3: 6, 4: 13, 5: 13, 7: 40}
    pieces = sp.split_records(rows.where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"]), "chunk_id").orderBy("chunk_id", "piece").collect()
    by = {}
    for p in pieces:
        by.setdefault(p["chunk_id"], []).append(p)
    assert set(by) == {1, 3, 4, 5, 7}
    assert {k: len(p) for k, p in by.items()} == {k: n for k, (_, n) in long.items()}
    texts = {r[0]: r[3] for r in chunks}
    for k, size, lap in ((1, 10, 2), (3, 4, 3), (4, 12, 3), (5, 12, 3), (7, 5, 4)):
        assert [p["piece"] for p in by[k]] == list(range(len(by[k])))
        base = {1: 100, 3: 0, 4: 0, 5: 7, 7: 0}[k]
        check(texts[k], size, lap, [(p["range"]["start"] - base, p["range"]["end"] - base, p["words"]) if p["range"] else _locate(texts[k], p, by[k], lap) for p in by[k]])
    assert by[1][0]["heading"] == "H" and by[3][0]["range"] is None
    assert sp.split_records(rows.limit(0), "chunk_id").count() == 0


def _locate(text, piece, pieces, lap):
    at = sum(p["words"] for p in pieces[: piece["piece"]]) - lap * piece["piece"]
    words = [(m.start(), m.end()) for m in sp.WORD.finditer(text)]
    return words[at][0], words[at + piece["words"] - 1][1], piece["words"]


def test_giant_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(5)
    sentence = lambda: " ".join(rng.choice(["schön", "日本語", "plain", "ok", "naïve\U0001F600"]) for _ in range(rng.randint(3, 14))) + rng.choice([". ", ".\n", ".\n\n", ", "])
    files = {"a.txt": "".join(sentence() for _ in range(600)), "b.txt": "short one", "c.txt": "", "d.txt": " \n ", "e.txt": "日" * 3000 + " x y z" * 30}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = sp.split_files(spark, str(tmp_path), size=40, overlap=6, range_bytes=1000).orderBy("path", "piece").collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert set(by) == {"a.txt", "b.txt", "e.txt"}
    for name, pieces in by.items():
        raw = files[name].encode()
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert all(raw[p["start"] : p["end"]].decode() == p["text"] for p in pieces)
        check(files[name], 40, 6, [(len(raw[: p["start"]].decode()), len(raw[: p["end"]].decode()), p["words"]) for p in pieces])
