import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import neighbours as nb

SCHEMA = "chunk_id long, index_id int, vector array<tinyint>, embedded_at timestamp, cell int"


def clustered(n, dims, seed, index, first=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 8), dims)) * 40
    v = np.clip(np.rint(centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, dims)) * 12), -128, 127).astype(int)
    return [(first + i, index, x.tolist(), None, 0) for i, x in enumerate(v)]


def brute(rows, dims, k):
    pairs = set()
    for index, d in dims.items():
        own = {r[0]: r[2] for r in rows if r[0] is not None and r[1] == index and r[2] is not None and len(r[2]) == d and len(set(r[2])) > 1}
        keys = np.array(sorted(own))
        if len(keys) < 2:
            continue
        x = np.array([own[i] for i in keys], dtype=float)
        norm = (x * x).sum(1)
        cos = (x @ x.T) / np.sqrt(norm[:, None] * norm[None])
        np.fill_diagonal(cos, -9)
        for i, row in enumerate(np.argsort(-cos, axis=1, kind="stable")[:, : min(k, len(keys) - 1)]):
            pairs |= {(min(keys[i], keys[j]), max(keys[i], keys[j])) for j in row}
    return {(int(a), int(b)) for a, b in pairs}


def found(spark, rows, dims, k=5):
    v = spark.createDataFrame(rows, SCHEMA)
    i = spark.createDataFrame(list(dims.items()), "index_id int, dimensions int")
    return [tuple(r) for r in nb.neighbour_pairs(nb.nearest(v, i, k)).collect()]


def test_recall_against_brute_force(spark):
    dims = {1: 32, 2: 16}
    rows = clustered(2500, 32, 1, 1) + clustered(700, 16, 2, 2, 10_000)
    want, got = brute(rows, dims, 5), found(spark, rows, dims)
    assert len(got) == len(set(got))
    assert len(want & set(got)) >= 0.95 * len(want)


def test_dirty_rows_copies_and_ties(spark):
    dims = {1: 4, 3: 2}
    rows = [(i, 1, [5, -3, 2, 1], None, 0) for i in range(50)] + [(100 + i, 1, [1, 2, 3, i], None, 0) for i in range(6)]
    rows += [(200, 1, None, None, 0), (201, 1, [1, 2], None, 0), (202, 1, [7, 7, 7, 7], None, 0), (203, 9, [1, 2, 3, 4], None, 0), (None, 1, [1, 2, 3, 9], None, 0)]
    rows += [(300, 3, [1, 2], None, 0), (301, 3, [2, 1], None, 0)]
    got = set(found(spark, rows + rows[:3] + rows[50:52], dims))
    assert got == brute(rows, dims, 5)


def test_large_cell_is_divided(spark, monkeypatch):
    rows = clustered(3000, 24, 7, 1)
    x = np.array([r[2] for r in rows], dtype=np.int8)
    monkeypatch.setattr(nb, "SPLIT_ROWS", 500)
    got = set()
    for q, n, _ in nb._divide(np.arange(3000), x, 5):
        got |= {(int(min(a, b)), int(max(a, b))) for a, b in zip(q, n)}
    want = brute(rows, {1: 24}, 5)
    assert len(got & want) >= 0.95 * len(want)


def spread(n, dims, seed, share):
    """Vectors whose neighbours are as little alike as ``share`` of a common direction and chance make them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 10), dims))
    v = share * centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, dims))
    return np.clip(np.rint(v * 30), -128, 127).astype(np.int8)


@pytest.mark.parametrize("dims, share", [(64, 0.0), (64, 0.8), (48, 1.1), (64, 1.25)])
def test_neighbours_that_are_little_alike(dims, share):
    x = spread(1500, dims, 4, share)
    want = brute([(i, 1, r.tolist(), None, 0) for i, r in enumerate(x)], {1: dims}, 5)
    q, n, _ = nb.neighbours_in_cell(np.arange(len(x)), x, 5)
    got = {(int(min(a, b)), int(max(a, b))) for a, b in zip(q, n)}
    assert len(got & want) >= 0.99 * len(want)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_little_alike_across_cells(spark, share):
    rows = [(i, 1, r.tolist(), None, 0) for i, r in enumerate(spread(4000, 64, 9, share))]
    want, got = brute(rows, {1: 64}, 5), found(spark, rows, {1: 64})
    assert len(got) == len(set(got))
    assert len(want & set(got)) >= 0.98 * len(want)


def test_cells_with_fewer_than_k_others(spark, monkeypatch):
    rows = clustered(300, 16, 3, 1)
    dims = {1: 16}
    monkeypatch.setattr(nb, "CELL_ROWS", 1)
    alone = lambda unit, count, **_: (unit, np.zeros(len(unit), dtype=np.int32))  # noqa: E731: every vector is a centre, and its two cells hold few others
    monkeypatch.setattr(nb, "fit_levels", alone)
    got = set(found(spark, rows, dims))
    assert got == brute(rows, dims, 5)


def test_collisions_are_counted_in_windows():
    rng = np.random.default_rng(2)
    values = rng.normal(size=(777, nb.LINES)).astype(np.float32)
    arrays = nb.SortedLines(values)
    who = np.array([0, 5, 776])
    rank = values.argsort(0).argsort(0)
    for half, least in ((0.5, 31), (0.2, 5), (3.0, 64), (0.5, 1)):
        inside = np.abs(values[who][:, None] - values[None]) <= half
        got = arrays.collided(who, half, least)
        assert (got | ~(inside.sum(2) >= least)).all()  # a window is never narrower than it says
        wide = 2 * 777 // nb.EDGES + 2  # and reaches to the next edges at most
        low = np.array([[(values[:, l] < values[q, l] - half).sum() for l in range(nb.LINES)] for q in who]) - wide
        high = np.array([[(values[:, l] <= values[q, l] + half).sum() for l in range(nb.LINES)] for q in who]) + wide
        most = ((rank[None] >= low[:, None]) & (rank[None] < high[:, None])).sum(2)
        assert (~got | (most >= least)).all()


def test_two_levels_of_centres(spark, monkeypatch):
    monkeypatch.setattr(nb, "TWO_LEVELS", 8)
    monkeypatch.setattr(nb, "CELL_ROWS", 60)
    dims = {1: 32, 2: 16}
    rows = clustered(2500, 32, 1, 1) + clustered(40, 16, 2, 2, 10_000)
    want, got = brute(rows, dims, 5), found(spark, rows, dims)
    assert len(got) == len(set(got)) and len(want & set(got)) >= 0.95 * len(want)


def test_hot_copies_and_versions(spark):
    """A third of all rows are one vector; other keys come twice with different vectors."""
    from datetime import datetime

    base = clustered(600, 8, 4, 1)
    hot = [(5000 + i, 1, base[0][2], None, 0) for i in range(300)]
    twins = [(700 + i, 1, base[i + 1][2], None, 0) for i in range(20)]
    late = [(r[0], 1, base[(i + 9) % 600][2], datetime(2030, 1, 1), 0) for i, r in enumerate(base[:30])]
    early = [(*r[:3], datetime(2020, 1, 1), 0) for r in base[:30]]
    rows = early + base[30:] + hot + twins
    got = found(spark, rows + late + hot[:5], {1: 8})
    assert len(got) == len(set(got)) and set(got) == brute(rows, {1: 8}, 5)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1, 2, 3, 4], None, 0)]])
def test_empty_and_single(spark, rows):
    assert found(spark, rows, {1: 4}) == []


def test_table_is_not_read_again_for_every_pass(spark, monkeypatch):
    """Without clusters nearly all vectors are compared on; more passes of them read no more rows and find the same."""
    rows = [(i, 1, r.tolist(), None, 0) for i, r in enumerate(spread(2000, 32, 9, 0.0))]
    read, got = [], []
    for size in (1 << 25, 1 << 12):
        monkeypatch.setattr(nb, "PASS_BYTES", size)
        seen = spark.sparkContext.accumulator(0)
        told = F.udf(lambda i: (seen.add(1), i)[1], "int").asNondeterministic()
        v = spark.createDataFrame(rows, SCHEMA).withColumn("index_id", told("index_id"))
        near = nb.nearest(v, spark.createDataFrame([(1, 32)], "index_id int, dimensions int"))
        got.append({tuple(r) for r in near.select("chunk_id", "neighbour").collect()})
        read.append(seen.value)
    assert read[0] == read[1]
    assert got[0] == got[1] and len(got[0]) == 5 * len(rows)


def test_asked_keep_the_k_best_of_all_that_they_meet():
    x = spread(900, 16, 3, 0.5)
    keys, cell = np.arange(900), np.zeros(900, dtype=np.int32)
    q, n, c = nb.neighbours_in_cell(keys, x, 5)
    floor = np.array([np.nan if i % 2 else -1.0 for i in range(40)])
    asked = nb.Asked(keys[:40], floor, cell[:40], x[:40], 5)
    for at in (0, 200, 500, 100):  # some come twice
        asked.meet(keys[at : at + 400], x[at : at + 400], cell[at : at + 400], None)
    got = {(int(a), int(b)) for a, b, _ in zip(*asked.result())}
    assert got == {(int(a), int(b)) for a, b in zip(q, n) if a < 40}
