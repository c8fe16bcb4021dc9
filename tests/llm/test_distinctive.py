import math
import random

import pytest

from pagelode.llm import distinctive as d

ROWS = [
    (1, "Alpha beta alpha gamma; ALPHA", "x"), (2, "beta beta beta", "x"), (3, "", "x"), (4, None, "x"), (5, "snake_case İstanbul ١٢٣ naïve", "x"), (6, "alpha " * 5000, "x"),
    (7, "solo", "x"), (8, " \n\t", "x"), (9, "alpha beta gamma delta alpha", "x"),
]


def brute(rows, window):
    words = {k: d.words_of(t) for k, t, _ in rows}
    n, mean = len(rows), sum(len(t) for _, t, _ in rows if t is not None) / sum(t is not None for _, t, _ in rows)
    df = {}
    for ws in words.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = {}
    for k, t, _ in rows:
        ws = words[k]
        for w in set(ws):
            near = {ws[j] for i, x in enumerate(ws) if x == w for j in range(max(0, i - window + 1), min(len(ws), i + window))} - {w}
            out[k, w] = (ws.count(w), len(near), df[w], len(near) / (0.997 + 0.003 * len(t) / mean) * math.log((n + 1) / df[w]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, term string")


@pytest.mark.parametrize("window", [2, 4])
def test_brute_force(spark, window):
    rng = random.Random(4)
    rows = ROWS + [(100 + i, " ".join(rng.choices("red green blue tall wide".split(), k=rng.randint(0, 40))), "x") for i in range(40)]
    got = {(r["id"], r["term"]): (r["tf"], r["degree"], r["df"], r["score"]) for r in d.distinctive_terms(frame(spark, rows), "id", window=window).collect()}
    want = brute(rows, window)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_least_only_leaves_rows_out(spark):
    full = {(r["id"], r["term"]): tuple(r) for r in d.distinctive_terms(frame(spark, ROWS), "id").collect()}
    some = {(r["id"], r["term"]): tuple(r) for r in d.distinctive_terms(frame(spark, ROWS), "id", least=3).collect()}
    assert some == {k: v for k, v in full.items() if v[2] >= 3} and (1, "alpha") in some


def test_hot_terms_give_the_same(spark, monkeypatch):
    rows = ROWS + [(100 + i, f"alpha common word{i % 7} common", "x") for i in range(60)]
    view = lambda: sorted(map(tuple, d.distinctive_terms(frame(spark, rows), "id").collect()))
    plain = view()
    monkeypatch.setattr(d, "HOT_RECORDS", 5)
    assert view() == plain


def test_words():
    assert d.words_of("A_b-1c'D") == ["a", "b", "1c", "d"]
    assert d.words_of("İX") == ["i̇x"]
    assert d.words_of(None) == [] == d.words_of("")


def test_empty(spark):
    assert d.distinctive_terms(frame(spark, ROWS).limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        d.distinctive_terms(frame(spark, ROWS), "id", window=1)
