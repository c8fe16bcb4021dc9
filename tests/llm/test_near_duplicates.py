import random

import pytest

from pagelode.llm import near_duplicates as nd
from pagelode.llm.distinctive import words_of


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randint(25, 120))
        for edits in (0, 0, 2, 5, 12):
            ws = list(base)
            for _ in range(edits):
                i = rng.randrange(len(ws))
                ws[i : i + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            rows.append((n, (" " if edits else ", ").join(ws)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "too short"), (n + 3, "a b c " * 30000), (n + 4, "A b c " * 30000)]


def brute(rows, size, similarity, least):
    sets = {}
    for k, t in rows:
        ws = words_of(t)
        if len(ws) >= max(least, size):
            sets[k] = set(zip(*[ws[i:] for i in range(size)]))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}, set(keys)


@pytest.mark.parametrize("size, similarity, least", [(3, 0.5, 20), (5, 0.8, 0)])
def test_pairs_and_groups_against_brute_force(spark, size, similarity, least):
    rows = corpus()
    want, keys = brute(rows, size, similarity, least)
    df = spark.createDataFrame([(k, t, k % 3) for k, t in rows] + [(k, t, 9) for k, t in rows[:30]], "id long, text string, rep long")
    df = df.selectExpr("id", "text", "rep", "timestamp_seconds(rep) AS at")
    members, links = nd.near_duplicate_classes(df, "id", at="at", shingle=size, similarity=similarity, least_words=least)
    pairs = [(r["a"], r["b"]) for r in nd.expand_pairs(members, links).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want
    assert len(set(pairs)) >= 0.98 * len(want)
    groups = {r["key"]: (r["group"], r["links"]) for r in nd.near_duplicate_groups(members, links).collect()}
    assert set(groups) == keys
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {k: g for k, (g, _) in groups.items()} == {k: root(k) for k in keys}
    assert {k: n for k, (_, n) in groups.items()} == {k: sum(k in p for p in pairs) for k in keys}


def test_long_chain_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["group"] for r in nd.connected_groups(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_long_buckets_are_compared_in_tiles(spark, monkeypatch):
    """All texts share a passage, so buckets are long; pairs are the same as with short buckets."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(60):
        own = [f"t{rng.randrange(10**6)}" for _ in range(30)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:-2] + ["x", "y"]))]
    want, _ = brute(rows, 3, 0.5, 20)
    df = spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(nd, "BUCKET_ROWS", 7)
    monkeypatch.setattr(nd, "SLICE", 2)
    members, links = nd.near_duplicate_classes(df, "id", shingle=3, similarity=0.5, least_words=20)
    got = [(r["a"], r["b"]) for r in nd.expand_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want) and len(want) >= 60


def test_sliced_classes(spark, monkeypatch):
    monkeypatch.setattr(nd, "SLICE", 3)
    members = spark.createDataFrame([(i, 0, 10) for i in range(10)] + [(20 + i, 20, 4) for i in range(4)] + [(30, 30, 1)], "key long, rep long, size long")
    links = spark.createDataFrame([(0, 20, 0.9), (0, 30, 0.8)], "a long, b long, similarity double")
    got = sorted((r["a"], r["b"]) for r in nd.expand_pairs(members, links).collect())
    ten, four = range(10), range(20, 24)
    want = [(a, b) for x in (ten, four) for a in x for b in x if a < b] + [(a, b) for a in ten for b in (*four, 30)]
    assert got == sorted(want)


def test_hot_group_of_copies(spark):
    """A third of all rows are one text: its members share one representative, and nothing is paired among them."""
    text = " ".join(f"k{i}" for i in range(40))
    rows = [(i, text) for i in range(200)] + [(1000 + i, " ".join(f"{i}x{j}" for j in range(40))) for i in range(400)]
    members, links = nd.near_duplicate_classes(spark.createDataFrame(rows, "id long, text string"), "id")
    assert links.count() == 0
    assert members.where("rep = 0").count() == 200


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    members, links = nd.near_duplicate_classes(df, "id")
    assert members.count() == 0 == links.count()
    assert nd.near_duplicate_groups(members, links).count() == 0
