"""The k most similar vectors of every vector by collision counting (problem 3).

Each vector is projected on single random lines, and each line's values are kept as
one sorted array. Around a query's own value a window is opened on every line; a
vector that lies in enough of the windows has collided often enough to be verified by
its exact cosine. A window is wide enough if it yields enough candidates and the k-th
cosine found lies within the distance at which a vector is sure to collide often
enough; else it is widened and counted again (virtual rehashing): widening is a wider
range of the same sorted array, nothing is hashed anew. The last level is exact.

A sorted array is kept as sets of the rows before each of its ``EDGES`` edges, a bit a
row. A window is the difference of two such sets, and all windows of a query are added
up bit by bit in parallel, so 64 vectors are counted at once.

Counting collisions against all vectors is quadratic, so it is done within cells. The
cells' centres are fitted on a bounded sample of every index, in two levels where they
are many, and shared out over the indexes by their size; every vector goes to its two
nearest cells, and neighbours found in either cell are merged. A cell that is still
large is divided again, where it is worked on. A vector whose k-th neighbour lies
farther off than its cells are sure to hold is compared with all vectors of its index.

Vectors that are exact copies are one class; cells hold one vector a class. The k + 1
smallest keys of a class stand for it, so a vector that a third of all rows share
never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.llm.stage import HOT_KEYS, binary_as_rows, cut, key_filter, look_up, release, rows_as_binary, small_side

#: Centres of all indexes together: 25 MB at 384 dimensions is what the driver sends.
CENTRES = 16_384
#: Vectors of an index on which its centres are fitted: so many, or so many a centre.
SAMPLE, SAMPLE_SHARE = 6_000, 8
#: Vectors a cell should have, and the size from which a cell is divided again.
CELL_ROWS, SPLIT_ROWS = 400, 4_000
#: Centres from which they are looked up in two levels, groups that are looked into, and centres that are known to a centre as near.
TWO_LEVELS, LOOK_INTO, NEAR = 512, 4, 64
LINES, EDGES = 64, 64
#: Half window on the first level and its growth; collisions that make a candidate.
WINDOW, GROWTH, LEVELS, THRESHOLD = 0.5, 1.5, 3, 31
#: Share of the rows in a window from which widening it further tells nothing, so that the exact level follows.
CROWDED = 0.36
#: At a distance of half / SURE a window holds a vector on 65 % of the lines: THRESHOLD is 2.8 standard deviations less.
SURE = 0.935
#: Standard deviations that a neighbour's way towards another cell is taken to be above its mean in a random direction.
STRAY = 2.0
#: Bytes of vectors that are compared on in one pass; bounds what the driver holds and sends.
PASS_BYTES = 32 << 20
#: Vectors, in the order of their cells, that a pass compares at once, and cells whose askers are told at once.
COMPARE_ROWS, ASK_CELLS = 20_000, 64


def usable(vectors: DataFrame, indexes: DataFrame) -> DataFrame:
    """Rows whose vector has its index's dimensions and more than one value."""
    dims = cut(indexes.where(F.col("index_id").isNotNull()).groupBy("index_id").agg(F.max("dimensions").alias("_d")))
    dims = small_side(dims)  # one row an index
    v = F.col("vector")
    return vectors.where(F.col("chunk_id").isNotNull()).join(dims, "index_id").where(
        v.isNotNull() & (F.size(v) == F.col("_d")) & F.exists(v, lambda x: x != v[0])
    ).select("chunk_id", "index_id", "embedded_at", "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal-length int8 lists or binaries as a matrix."""
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int8, copy=False)
        return flat.reshape(len(column), -1)
    return binary_as_rows(column, np.int8, 0)


def _unit(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)


def fit_centres(unit: np.ndarray, count: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means from randomly drawn rows."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(count, len(unit)), replace=False)].copy()
    for _ in range(rounds):
        home = np.argmax(unit @ centres.T, axis=1)
        order = np.argsort(home, kind="stable")
        used, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(unit[order], first, axis=0)
        centres[used] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def fit_levels(unit: np.ndarray, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centres, group of each): at once, or groups first and centres within each where they are many."""
    if count <= TWO_LEVELS:
        centres = fit_centres(unit, count, seed=seed)
        return centres, np.zeros(len(centres), dtype=np.int32)
    groups = fit_centres(unit, int(np.sqrt(count)), seed=seed)
    home = np.argmax(unit @ groups.T, axis=1)
    parts, group = [], []
    for g in np.unique(home):
        own = unit[home == g]
        parts.append(fit_centres(own, max(1, round(count * len(own) / len(unit))), seed=seed))
        group += [g] * len(parts[-1])
    return np.concatenate(parts), np.array(group, dtype=np.int32)


class Cells:
    """The cells of one index: which two a vector belongs to, and how far its neighbours are sure to share one."""

    def __init__(self, centres: np.ndarray, group: np.ndarray) -> None:
        order = np.argsort(group, kind="stable")
        self.centres, self.names = centres[order], order
        group = group[order]
        starts = np.unique(group, return_index=True)[1]
        self.bounds = np.append(starts, len(group))
        means = np.add.reduceat(self.centres, starts, axis=0)
        self.groups = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        near = min(NEAR, len(centres) - 1)
        self.near = np.empty((len(centres), near), dtype=np.int32)
        self.apart = np.empty((len(centres), near), dtype=np.float32)
        for at in range(0, len(centres), 1_000) if near else ():
            sims = self.centres[at : at + 1_000] @ self.centres.T
            rows = np.arange(len(sims))
            sims[rows, at + rows] = -9
            self.near[at : at + 1_000] = np.argpartition(-sims, near - 1, axis=1)[:, :near]
            self.apart[at : at + 1_000] = distance(np.take_along_axis(sims, self.near[at : at + 1_000], axis=1))

    def _own(self, unit: np.ndarray) -> np.ndarray:
        """The nearest centre, looked for in the nearest groups if there are many."""
        if len(self.groups) == 1:
            return np.argmax(unit @ self.centres.T, axis=1)
        sims = unit @ self.groups.T
        best, own = np.full(len(unit), -9.0, dtype=np.float32), np.zeros(len(unit), dtype=np.int64)
        top = np.argpartition(-sims, min(LOOK_INTO, sims.shape[1]) - 1, axis=1)[:, :LOOK_INTO]
        for g in np.unique(top):
            rows = np.nonzero((top == g).any(1))[0]
            inside = unit[rows] @ self.centres[self.bounds[g] : self.bounds[g + 1]].T
            which = inside.argmax(1)
            value = inside[np.arange(len(rows)), which]
            better = value > best[rows]
            best[rows[better]], own[rows[better]] = value[better], which[better] + self.bounds[g]
        return own

    def places(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((rows, 1 or 2) cells of every row, the distance up to which its neighbours are taken to share one).

        A vector shares neither cell only if two other centres are nearer to it than the row's
        own nearest, so it lies beyond two of the planes half way to other centres. How far it
        goes towards a plane is its distance times a random direction's share.
        """
        own = self._own(unit)
        sure = np.full(len(unit), 9.0, dtype=np.float32)
        if len(self.centres) == 1:
            return self.names[own][:, None], sure
        home = np.empty((len(unit), 2), dtype=np.int64)
        home[:, 0] = own
        order = np.argsort(own, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(own[order]))[0] + 1):
            c = own[rows[0]]
            x = unit[rows]
            sims = x @ self.centres[self.near[c]].T
            second = sims.argmax(1)
            home[rows, 1] = self.near[c][second]
            if len(self.centres) >= 4:  # of fewer, any two choices have one in common
                to_plane = ((x @ self.centres[c])[:, None] - sims) / np.maximum(self.apart[c], 1e-6)
                to_plane[np.arange(len(rows)), second] = np.inf
                beyond = np.partition(to_plane, 1, axis=1)[:, 1]
                sure[rows] = beyond * max(1.0, np.sqrt(unit.shape[1]) / STRAY)
        return self.names[home], sure

    def asked(self, unit: np.ndarray, own: np.ndarray, floor: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(rows, cells) whether a cell lies within the row's reach, given the row's own centre and its floor; all do without a floor."""
        some = self.centres[cells]
        to_own = np.einsum("ij,ij->i", unit, self.centres[own])
        apart = np.maximum(distance(self.centres @ some.T), 1e-6)[own]
        plane = (to_own[:, None] - unit @ some.T) / apart
        return ~(plane * max(1.0, np.sqrt(unit.shape[1]) / STRAY) > distance(floor)[:, None])


def distance(cosine: np.ndarray | float) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.asarray(cosine), 0))


def lines(dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, LINES)).astype(np.float32)


class SortedLines:
    """The sorted arrays of a cell's lines, as sets of the rows before each edge; ``values``: rows x lines."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = len(values)
        edges = np.arange(EDGES + 1) * self.rows // EDGES
        words = -(-self.rows // 64)
        across = np.ascontiguousarray(values.T)
        order = np.argsort(across, axis=1)
        self.sorted = np.take_along_axis(across, order, axis=1)
        self.rank = np.empty(across.shape, dtype=np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.rows, dtype=np.int32)[None], axis=1)
        self.before = np.zeros((len(across), EDGES + 1, words * 8), dtype=np.uint8)
        narrow = self.rank.astype(np.uint16) if self.rows < 1 << 16 else self.rank
        for line in range(len(across)):
            packed = np.packbits(narrow[line][None, :] < edges[:, None].astype(narrow.dtype), axis=1)
            self.before[line, :, : packed.shape[1]] = packed
        self.before = self.before.view(np.uint64)
        #: The last edge not after, and the first not before, each place in a sorted array.
        places = np.arange(self.rows + 1)
        self.down = np.searchsorted(edges, places, "right").astype(np.int32) - 1
        self.up = np.searchsorted(edges, places, "left").astype(np.int32)
        self._windows: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(lines, rows) edges at which the windows of a half width around every row begin and end."""
        if half not in self._windows:
            low, high = np.empty_like(self.rank), np.empty_like(self.rank)
            for line, array in enumerate(self.sorted):  # in the array's own order, which is quick to search
                low[line] = self.down[np.searchsorted(array, array - half, "left")][self.rank[line]]
                high[line] = self.up[np.searchsorted(array, array + half, "right")][self.rank[line]]
            self._windows[half] = low, high
        return self._windows[half]

    def crowded(self, half: float) -> bool:
        """Whether windows hold so many rows on the average that chance alone makes many candidates; seen from every eighth line."""
        held = [(np.searchsorted(a, a + half, "right") - np.searchsorted(a, a - half, "left")).mean() for a in self.sorted[::8]]
        return float(np.mean(held)) > CROWDED * self.rows

    def collided(self, who: np.ndarray, half: float, least: int) -> np.ndarray:
        """(len(who), rows) whether a row lies in ``least`` of a query's windows; windows reach to the next edges."""
        levels: list[list[np.ndarray]] = [[]]
        low, high = (edge[:, who] for edge in self.windows(half))
        for line in range(len(self.before)):
            _add(levels, 0, self.before[line][high[line]] ^ self.before[line][low[line]])
        enough = np.full_like(levels[0][0], np.iinfo(np.uint64).max)
        for level in range(len(levels) + 1):  # what waits in pairs is carried on
            if level < len(levels) and len(levels[level]) == 2:
                a, b = levels[level]
                levels[level] = [a ^ b]
                _add(levels, level + 1, a & b)
        for level, (bits, *_) in enumerate(levels):
            enough = enough & bits if least >> level & 1 else enough | bits
        if least >> len(levels):
            enough[:] = 0
        return np.unpackbits(enough.view(np.uint8), axis=1)[:, : self.rows].view(bool)


def _add(levels: list[list[np.ndarray]], level: int, bits: np.ndarray) -> None:
    """Adds numbers of weight 2 ** level, one a bit; three of a weight become one and a carry."""
    if level == len(levels):
        levels.append([])
    waiting = levels[level]
    waiting.append(bits)
    if len(waiting) == 3:
        a, b, c = waiting
        both = a ^ b
        levels[level] = [both ^ c]
        _add(levels, level + 1, (a & b) | (both & c))


#: Rounding of a product of unit vectors; what is so near to the k-th best is told by the exact cosine.
SLACK = 1e-5


def _cosines(a: np.ndarray, a_norms: np.ndarray, row: np.ndarray, b: np.ndarray, b_norms: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs of rows."""
    cosine = np.empty(len(row))
    for part in range(0, len(row), 60_000):
        i, j = row[part : part + 60_000], other[part : part + 60_000]
        dot = np.einsum("ij,ij->i", a[i].astype(np.float32, copy=False), b[j].astype(np.float32, copy=False)).astype(np.float64)
        cosine[part : part + 60_000] = dot / np.sqrt(a_norms[i] * b_norms[j])
    return cosine


def neighbours_in_cell(keys: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour row, cosine) of up to k neighbours for every row of one cell."""
    n = len(keys)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    exact = codes.astype(np.float32)  # integer sums below 2**24 are exact in float32
    norms = np.einsum("ij,ij->i", exact, exact).astype(np.float64)
    unit = exact / np.sqrt(norms)[:, None].astype(np.float32)
    arrays = SortedLines(unit @ lines(codes.shape[1]))
    need = min(k, n - 1)
    out_q, out_n, out_c = [], [], []
    block = max(1, min(n, 2_000_000 // n))
    for at in range(0, n, block):
        who = np.arange(at, min(at + block, n))
        half, level = WINDOW, 0
        while len(who):
            if 0 < level < LEVELS and arrays.crowded(half):
                level = LEVELS
            if level < LEVELS:
                q, x = np.nonzero(arrays.collided(who, half, THRESHOLD))
                if 4 * len(q) > len(who) * n:  # a window that takes so many costs more than the exact level
                    level = LEVELS
            if level >= LEVELS:  # every vector is a candidate; the k-th best is told by a product
                sims = unit[who] @ unit.T
                sims[np.arange(len(who)), who] = -9
                q, x = np.nonzero(sims >= np.partition(sims, n - need, axis=1)[:, [n - need]] - SLACK)
                del sims
            keep = who[q] != x
            q, x = q[keep], x[keep]
            take = (np.bincount(q, minlength=len(who)) >= need)[q]
            row, other = q[take], x[take]
            cosine = _cosines(exact, norms, who[row], exact, norms, other)
            order = np.lexsort((keys[other], -cosine, row))
            row, other, cosine = row[order], other[order], cosine[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, "left")
            last = place == need - 1
            done = np.zeros(len(who), dtype=bool)
            done[row[last]] = (level >= LEVELS) | (distance(cosine[last]) <= half / SURE)
            best = (place < k) & done[row]
            out_q.append(who[row[best]]), out_n.append(other[best]), out_c.append(cosine[best])
            who = who[~done]
            half, level = half * GROWTH, level + 1
    return np.concatenate(out_q), np.concatenate(out_n), np.concatenate(out_c)


def _divide(
    keys: np.ndarray, codes: np.ndarray, k: int, sure: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query keys, neighbour keys, cosines), dividing a large cell first, and its parts again while that makes them smaller.

    ``sure`` is lowered to what the divided cells are sure to hold.
    """
    waiting = [np.arange(len(keys))]
    while waiting:
        at = waiting.pop()
        if len(at) > SPLIT_ROWS:
            unit = _unit(codes[at])
            rng = np.random.default_rng(len(at))
            count = min(TWO_LEVELS, len(at) // CELL_ROWS)
            cells = Cells(*fit_levels(unit[rng.choice(len(at), min(len(at), SAMPLE), replace=False)], count))
            home, reach = cells.places(unit)
            parts = [np.nonzero((home == c).any(axis=1))[0] for c in range(len(cells.centres))]
            if max(map(len, parts)) <= 0.8 * len(at):
                if sure is not None:
                    sure[at] = np.minimum(sure[at], reach)
                waiting += [at[p] for p in parts if len(p)]
                continue
        q, x, c = neighbours_in_cell(keys[at], codes[at], k)
        yield keys[at][q], keys[at][x], c


def _fitted(rows: DataFrame, plan: DataFrame) -> Broadcast[dict[int, Cells]]:
    """The cells of every index that has more than one, fitted where its sample is."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(float(SAMPLE)), F.col("cells") * float(SAMPLE_SHARE)) / F.col("n"))
    chance = F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(plan.where("cells > 1"), "index_id").where(chance < share).select("index_id", "cells", "vector")

    def fit(table: pa.Table) -> pa.Table:
        centres, group = fit_levels(_unit(_matrix(table.column("vector").combine_chunks())), table.column("cells")[0].as_py())
        index = np.full(len(centres), table.column("index_id")[0].as_py(), dtype=np.int32)
        return pa.table({"index_id": index, "group": group, "centre": rows_as_binary(centres.astype(np.float32))})

    got = sample.groupBy("index_id").applyInArrow(fit, "index_id int, group int, centre binary").toArrow()  # at most CENTRES rows
    index = got.column("index_id").to_numpy()
    raw, group = got.column("centre").to_pylist(), got.column("group").to_numpy()
    at = {int(i): np.nonzero(index == i)[0] for i in np.unique(index)}
    cells = {i: Cells(np.stack([np.frombuffer(raw[r], dtype=np.float32) for r in rows]), group[rows]) for i, rows in at.items()}
    return plan.sparkSession.sparkContext.broadcast(cells)


def _to_cells(rows: DataFrame, cells: Broadcast[dict[int, Cells]]) -> DataFrame:
    """(index_id, cell, chunk_id, code, sure): each vector once for each of its two cells; an index without centres is one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.unique(index).tolist():
                at = np.nonzero(index == i)[0]
                codes = _matrix(batch.column(2).take(pa.array(at)))
                if i in cells.value:
                    home, sure = cells.value[i].places(_unit(codes))
                else:
                    home, sure = np.zeros((len(at), 1), dtype=np.int64), np.full(len(at), 9.0, dtype=np.float32)
                row = np.repeat(np.arange(len(at)), home.shape[1])
                blob = rows_as_binary(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), i, dtype=np.int32)), pa.array(home.ravel().astype(np.int32)),
                        batch.column(1).take(pa.array(at[row])), blob.take(pa.array(row)), pa.array(sure[row]),
                    ],
                    names=["index_id", "cell", "chunk_id", "code", "sure"],
                )

    return rows.select("index_id", "chunk_id", "vector").mapInArrow(run, "index_id int, cell int, chunk_id bigint, code binary, sure float")


def _one_version(rows: DataFrame) -> DataFrame:
    """(chunk_id, index_id, h1, h2, versions): of a key with several vectors the one of the earliest embedded_at holds."""
    vector = F.struct("index_id", "h1", "h2")
    return rows.groupBy("chunk_id").agg(
        F.min_by(vector, F.struct(F.col("embedded_at").isNull(), "embedded_at", "index_id", "h1", "h2")).alias("_r"),
        (F.min(vector) != F.max(vector)).alias("versions"),
    ).select("chunk_id", "_r.*", "versions")


def nearest(vectors: DataFrame, indexes: DataFrame, k: int = 5) -> DataFrame:
    """(index_id, chunk_id, neighbour, cosine): up to k most similar vectors of the same index for every usable vector.

    Ties go to the smaller key, and a vector has all others of its index where these are
    fewer than k. Repeated rows count once; where one key has several vectors, the earliest
    embedded_at holds. Unusable vectors (null, wrong length, one repeated value) give no row.
    """
    # Two vectors are copies by a hash of all values and one of the first eight by themselves.
    first = F.xxhash64(F.lit(77), *[F.get("vector", F.lit(i)) for i in range(8)])
    rows = usable(vectors, indexes).withColumn("h1", F.xxhash64("vector")).withColumn("h2", first)
    chosen = cut(_one_version(rows))
    classes = cut(chosen.groupBy("index_id", "h1", "h2").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies")))
    plan = classes.groupBy("index_id").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(CELL_ROWS), F.ceil(F.sum("n").over(Window.partitionBy()) / CENTRES))  # one row an index
    plan = small_side(cut(plan.withColumn("cells", F.floor(F.col("n") / size).cast("int"))))
    members = cut(_copies(chosen, classes))
    # Rows of keys that are not the first of their class, or have other versions, are looked at; all others pass.
    odd = members.where("chunk_id <> rep").select("chunk_id").union(chosen.where("versions").select("chunk_id"))
    suspect = key_filter(odd, "chunk_id")(F.col("chunk_id"))
    checked = rows.where(suspect).join(classes, ["chunk_id", "index_id", "h1", "h2"], "left_semi")
    checked = cut(checked.select("index_id", "chunk_id", "vector"))
    kept = rows.where(~suspect).select("index_id", "chunk_id", "vector").unionByName(checked)
    cells = _fitted(kept, plan)
    near = _search_on(_in_cells(kept, k, cells), kept, k, plan, cells)
    return _with_copies(near, members, k)


def _in_cells(kept: DataFrame, k: int, cells: Broadcast[dict[int, Cells]]) -> DataFrame:
    """(index_id, chunk_id, neighbour, cosine, sure, _r, found, floor): up to k neighbours that share a cell, or the vector itself besides fewer."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("chunk_id").to_numpy()
        keys, first = np.unique(keys, return_index=True)  # repeated rows meet in their cell
        codes = _matrix(table.column("code").combine_chunks().take(pa.array(first)))
        sure = table.column("sure").to_numpy()[first]
        parts = list(_divide(keys, codes, k, sure=sure))
        q, x, c = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
        found = np.bincount(np.searchsorted(keys, q.astype(np.int64)), minlength=len(keys))
        alone = keys[found < k]  # these come out with themselves, so that none is missing
        q, x, c = np.concatenate([q, alone]), np.concatenate([x, alone]), np.concatenate([c, np.full(len(alone), -9.0)])
        sure = sure[np.searchsorted(keys, q.astype(np.int64))]
        index = np.full(len(q), table.column("index_id")[0].as_py(), dtype=np.int32)
        return pa.table({"index_id": index, "chunk_id": q.astype(np.int64), "neighbour": x.astype(np.int64), "cosine": c.astype(np.float64), "sure": sure.astype(np.float32)})

    found = _to_cells(kept, cells).groupBy("index_id", "cell").applyInArrow(run, "index_id int, chunk_id bigint, neighbour bigint, cosine double, sure float")
    once = found.repartition("index_id", "chunk_id").groupBy("index_id", "chunk_id", "neighbour", "cosine").agg(F.min("sure").alias("sure"))
    own = Window.partitionBy("index_id", "chunk_id")
    ranked = once.withColumn("_r", F.row_number().over(own.orderBy(F.desc("cosine"), F.asc("neighbour")))).where(F.col("_r") <= k)
    real = F.when(F.col("neighbour") != F.col("chunk_id"), F.col("cosine"))
    return cut(ranked.withColumns({"found": F.count(real).over(own), "floor": F.min(real).over(own), "sure": F.min("sure").over(own)}))  # one shuffle


def _class() -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in ("index_id", "h1", "h2")]).alias("class")


def _copies(chosen: DataFrame, classes: DataFrame) -> DataFrame:
    """(chunk_id, index_id, rep, copies) of every key whose vector others have too."""
    several = classes.where("copies > 1")
    total = chosen.count()
    hot = several.where(F.col("copies") >= max(1_000, -(-total // HOT_KEYS))).select(_class())
    part = chosen.where(key_filter(several, "h1")(F.col("h1"))).select("chunk_id", "index_id", _class())
    table = several.select(_class(), F.col("chunk_id").alias("rep"), "copies")
    return look_up(part, table, "class", hot, "chunk_id", "inner").select("chunk_id", "index_id", "rep", "copies")


def _with_copies(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``near`` between classes of copies as neighbours of single keys.

    The k + 1 smallest keys of a class stand for it. A copy's neighbours are those of its own
    class at cosine 1, then those of the classes that are near. Copies beyond the first k + 1
    all have the first k.
    """
    if members.isEmpty():
        return near
    place = F.row_number().over(Window.partitionBy("rep").orderBy("chunk_id"))  # the limit is applied before the shuffle too
    heads = members.withColumn("_place", place).where(F.col("_place") <= k + 1)
    lists = cut(heads.groupBy("rep").agg(F.sort_array(F.collect_list("chunk_id")).alias("heads")))
    hot = members.where(F.col("copies") >= max(1_000, -(-members.count() // HOT_KEYS))).select("rep").distinct()
    several = cut(look_up(members.select("index_id", "chunk_id", "rep"), lists, "rep", hot, "chunk_id", "inner"))
    first = F.array_contains("heads", F.col("chunk_id"))
    own = several.where(first).select("index_id", "chunk_id", F.explode("heads").alias("neighbour"), F.lit(1.0).alias("cosine")).where("chunk_id <> neighbour")
    late = several.where(~first).select("index_id", "chunk_id", F.explode(F.slice("heads", 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine"))
    # Only queries that are of a class of several, or near to one, are ranked anew.
    copied = key_filter(lists.select("rep"), "rep")
    touched = cut(near.where(copied(F.col("neighbour")) | copied(F.col("chunk_id"))).select("chunk_id").distinct())
    changed = key_filter(touched, "chunk_id")(F.col("chunk_id"))
    part = cut(near.where(changed))
    spelt = part.join(lists.select(F.col("rep").alias("neighbour"), "heads"), "neighbour", "left")
    spelt = spelt.select("index_id", "chunk_id", F.explode(F.coalesce("heads", F.array("neighbour"))).alias("neighbour"), "cosine")
    askers = several.where(first).select(F.col("rep").alias("chunk_id"), F.col("chunk_id").alias("_one"))
    asked = spelt.join(askers, "chunk_id", "left").select("index_id", F.coalesce("_one", "chunk_id").alias("chunk_id"), "neighbour", "cosine")
    return near.where(~changed).unionByName(_best(asked.unionByName(own), k)).unionByName(late)


def _placed(rows: DataFrame, cells: Broadcast[dict[int, Cells]]) -> DataFrame:
    """(index_id, chunk_id, floor, cell, code) of rows with index_id, chunk_id, floor and vector: the cell is the nearest centre's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.unique(index).tolist():
                part = batch.take(pa.array(np.nonzero(index == i)[0]))
                codes = _matrix(part.column(3))
                own = cells.value[i]._own(_unit(codes)) if i in cells.value else np.zeros(len(codes))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(own.astype(np.int32)), rows_as_binary(codes)], names=["index_id", "chunk_id", "floor", "cell", "code"]
                )

    return rows.select("index_id", "chunk_id", "floor", "vector").mapInArrow(run, "index_id int, chunk_id bigint, floor double, cell int, code binary")


def _search_on(near: DataFrame, kept: DataFrame, k: int, plan: DataFrame, cells: Broadcast[dict[int, Cells]]) -> DataFrame:
    """``near`` (with each vector's number ``found`` and ``floor``, the least cosine) with better neighbours of the vectors whose cells may not hold all that are near enough.

    So it is where the k-th lies beyond ``sure``, and where the cells hold fewer than k others but the index more.
    These are compared with the vectors of all cells that lie within their reach, in passes of at most about ``PASS_BYTES``.
    For that all vectors are put in the order of their cells once, so that a pass meets every cell whole and places nothing anew.
    """
    short = F.col("found") < F.least(F.lit(k), F.col("n") - 1)
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("floor"))) > F.col("sure")
    unsure = near.where("_r = 1").join(plan, "index_id").where(short | far)
    unsure = cut(unsure.select("chunk_id", F.when(~short, F.col("floor")).alias("floor")))
    near = near.where("neighbour <> chunk_id").select("index_id", "chunk_id", "neighbour", "cosine")
    if unsure.isEmpty():
        return near
    release(kept.sparkSession)  # the vectors that were sent to their cells
    open_ = key_filter(unsure, "chunk_id")
    asked = kept.where(open_(F.col("chunk_id"))).join(unsure, "chunk_id")
    asked = cut(_placed(asked.dropDuplicates(["chunk_id"]), cells))
    size = asked.agg(F.sum(F.length("code"))).first()[0]
    passes = -(-size // PASS_BYTES)
    placed = _placed(kept.withColumn("floor", F.lit(None).cast("double")), cells).drop("floor")
    release(kept.sparkSession)
    placed = cut(placed.repartition("index_id", "cell").sortWithinPartitions("index_id", "cell"))
    again = near.where(open_(F.col("chunk_id")))
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.lit(passes)) == i).toArrow()
        if len(part):
            again = again.unionByName(cut(_best(_compare(placed, part, k, cells), k)))
            release(kept.sparkSession)
    return cut(near.where(~open_(F.col("chunk_id"))).unionByName(_best(again.repartition("index_id", "chunk_id").distinct(), k)))


class Asked:
    """The vectors of one index that are compared on, and the k best that were met for each of them; the k-th is its floor from then on."""

    def __init__(self, keys: np.ndarray, floor: np.ndarray, own: np.ndarray, codes: np.ndarray, k: int) -> None:
        self.keys, self.floor, self.own, self.codes, self.unit = keys, floor.astype(np.float32), own, codes, _unit(codes)
        self.norms = np.concatenate([np.zeros(0), *(_norms(codes[at : at + 10_000]) for at in range(0, len(codes), 10_000))])
        self.best, self.found = np.full((len(keys), k), -np.inf), np.zeros((len(keys), k), dtype=np.int64)

    def meet(self, others: np.ndarray, codes: np.ndarray, cell: np.ndarray, cells: Cells | None) -> None:
        """Compares vectors with those that have their cells within reach."""
        order = np.unique(others, return_index=True)[1]  # rows that come twice count once
        order = order[np.argsort(cell[order], kind="stable")]
        here, starts = np.unique(cell[order], return_index=True)
        members = np.split(order, starts[1:])
        for at in range(0, len(here), ASK_CELLS):
            if cells is not None:
                blocks = range(0, len(self.keys), 10_000)
                ask = np.concatenate([cells.asked(self.unit[b : b + 10_000], self.own[b : b + 10_000], self.floor[b : b + 10_000], here[at : at + ASK_CELLS]) for b in blocks])
            else:
                ask = np.ones((len(self.keys), 1), dtype=bool)
            got = []
            for j, rows in enumerate(members[at : at + ASK_CELLS]):
                queries = np.nonzero(ask[:, j])[0]
                unit, norms = _unit(codes[rows]), _norms(codes[rows])
                step = max(1, 4_000_000 // len(rows))
                for s in range(0, len(queries), step):
                    got.append(self._near(queries[s : s + step], others[rows], codes[rows], unit, norms))
            self._take(*(np.concatenate([part[i] for part in got]) for i in range(3))) if got else None

    def _near(self, who: np.ndarray, others: np.ndarray, codes: np.ndarray, unit: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, keys, cosines) of what is at least as near as a query's floor, without one the k best."""
        sims = self.unit[who] @ unit.T
        least = self.floor[who].copy()
        unknown = np.isnan(least)  # nothing is known of these: the k best here, themselves besides
        if unknown.any():
            most = min(self.best.shape[1] + 1, len(others))
            least[unknown] = np.partition(sims[unknown], -most, axis=1)[:, -most]
        q, x = np.nonzero(sims >= least[:, None] - SLACK)
        keep = self.keys[who[q]] != others[x]
        q, x = who[q[keep]], x[keep]
        return q, others[x], _cosines(self.codes, self.norms, q, codes, norms, x)

    def _take(self, q: np.ndarray, keys: np.ndarray, cosine: np.ndarray) -> None:
        """Keeps the k best of what was known and what was met; ties go to the smaller key."""
        k = self.best.shape[1]
        touched = np.unique(q)
        row, keys = np.concatenate([q, np.repeat(touched, k)]), np.concatenate([keys, self.found[touched].ravel()])
        cosine = np.concatenate([cosine, self.best[touched].ravel()])
        order = np.lexsort((-cosine, keys, row))  # a key that was met before counts once
        row, keys, cosine = row[order], keys[order], cosine[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
        row, keys, cosine = row[new], keys[new], cosine[new]
        order = np.lexsort((keys, -cosine, row))
        row, keys, cosine = row[order], keys[order], cosine[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        best = place < k
        self.best[touched] = -np.inf
        self.best[row[best], place[best]], self.found[row[best], place[best]] = cosine[best], keys[best]
        last = self.best[touched, k - 1]
        self.floor[touched] = np.where(np.isfinite(last), np.fmax(self.floor[touched], last), self.floor[touched])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(np.isfinite(self.best))
        return self.keys[row], self.found[row, place], self.best[row, place]


def _norms(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return np.einsum("ij,ij->i", x, x).astype(np.float64)


def _compare(placed: DataFrame, part: pa.Table, k: int, cells: Broadcast[dict[int, Cells]]) -> DataFrame:
    """(index_id, chunk_id, neighbour, cosine): the k best of each task for every vector of ``part``, as far as they reach its floor."""
    index = part.column("index_id").to_numpy()
    queries = {}
    for i in np.unique(index).tolist():
        own = part.take(pa.array(np.nonzero(index == i)[0]))
        queries[i] = *(own.column(c).to_numpy() for c in ("chunk_id", "floor", "cell")), _matrix(own.column("code").combine_chunks())
    sent = placed.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {i: Asked(*own, k) for i, own in sent.value.items()}
        for rows in _gathered(batches):
            index = rows.column("index_id").to_numpy()
            for i in np.unique(index).tolist():
                if i in ready:
                    own = rows.take(pa.array(np.nonzero(index == i)[0]))
                    others, cell, codes = own.column("chunk_id").to_numpy(), own.column("cell").to_numpy(), _matrix(own.column("code").combine_chunks())
                    ready[i].meet(others, codes, cell, cells.value.get(i))
        for i, asked in ready.items():
            keys, other, cosine = asked.result()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), i, dtype=np.int32)), pa.array(keys), pa.array(other), pa.array(cosine)], names=["index_id", "chunk_id", "neighbour", "cosine"]
            )

    # Each task gives k rows a query, so there are few of them, of at most some 32 partitions each.
    few = placed.coalesce(max(2 * placed.sparkSession.sparkContext.defaultParallelism, placed.rdd.getNumPartitions() // 32))
    return few.select("index_id", "chunk_id", "cell", "code").mapInArrow(run, "index_id int, chunk_id bigint, neighbour bigint, cosine double")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to ``COMPARE_ROWS`` rows or more."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= COMPARE_ROWS:
            yield pa.Table.from_batches(waiting)
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("index_id", "chunk_id").orderBy(F.desc("cosine"), F.asc("neighbour"))
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b): each pair once, the smaller key first."""
    a: Column = F.least("chunk_id", "neighbour")
    return near.select(a.alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()
