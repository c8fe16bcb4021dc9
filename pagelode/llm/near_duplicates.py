"""Near-duplicate records by deletion-variant signatures (problem 2).

A record's set of word shingles is sketched as a vector of ``SEGMENTS`` x ``WIDTH``
symbols, each a min- or max-hash: two records agree in a symbol as often as their
sets overlap (Jaccard). The vector is cut into few segments, so that some segment of
two similar records differs in one place at most. Every segment is indexed under its
one-wildcard variants, in each of which one symbol is left out: segments that differ
in one place have the variant that leaves that place out in common. Candidates are
found by an equality join on the variants alone, thinned by their bit sketches, and
verified on the full shingle sets. A symbol stands where a fingerprint has one bit:
at a similarity of a half, every fourth bit of two fingerprints differs, and no cut
into segments that differ by one bit at most would still tell records apart.

Records with the same words are one class and are sketched once; pairs are found
between class representatives and spread over the members only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.distinctive import words_of
from pagelode.llm.stage import HOT_KEYS, binary_as_rows, cut, earliest, key_filter, look_up, rows_as_binary

SEGMENTS, WIDTH = 12, 4
#: Hash functions; each gives a smallest and a largest value, so twice as many symbols. All of them give a
#: bit of the sketch, 64 bits go with the index rows; the first SEGMENTS * WIDTH symbols are indexed.
HASHES = 64
SYMBOLS = 2 * HASHES
#: Shingles that are hashed at once.
BLOCK = 400_000
#: Rows of one signature that one task compares; a longer bucket is compared in tiles of two such blocks.
BUCKET_ROWS = 4_000
#: Members of one class that meet in one task where pairs are spelt out.
SLICE = 1_000
#: Standard deviations that a sketch of a pair at the threshold may fall short of its mean.
DEVIATIONS = 3
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    return x ^ (x >> _U64(29))


def shingle_hashes(words: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, their number per record), in order; shorter records have none."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    if not len(distinct):
        return np.zeros(0, np.uint64), np.zeros(len(words), np.int64)
    word = _mix(pd.util.hash_array(distinct, categorize=False))[codes]
    record = np.repeat(np.arange(len(words)), lengths)
    count = np.maximum(lengths - size + 1, 0)
    total = len(word) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64), count
    h = np.zeros(total, dtype=np.uint64)
    for i in range(size):
        h = _mix(h * _U64(0x2545F4914F6CDD1D) + word[i : i + total])
    return h[record[:total] == record[size - 1 :]], count


def sketch(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Symbols of every record, (records, SYMBOLS) as uint16; every record must have a shingle."""
    starts = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    low = (hashes >> _U64(32)).astype(np.uint32)
    rng = np.random.default_rng(23)
    odd = rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1
    salt = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
    out = np.empty((len(count), SYMBOLS), dtype=np.uint16)
    for i in range(HASHES):
        x = (low ^ salt[i]) * odd[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        for j, extreme in ((2 * i, np.minimum), (2 * i + 1, np.maximum)):
            y = extreme.reduceat(x, starts)
            y = (y ^ (y >> np.uint32(15))) * np.uint32(0x297A2D39)
            out[:, j] = y >> np.uint32(16)
    return out


def _records(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Keys and words in blocks of bounded size."""
    texts = batch.column(1).to_pylist()
    at, words, size = 0, [], 0
    for i, t in enumerate(texts):
        words.append(words_of(t))
        size += len(words[-1])
        if size > BLOCK or i == len(texts) - 1:
            yield batch.column(0).slice(at, len(words)), words
            at, words, size = i + 1, [], 0


def sketches(records: DataFrame, key: str, text: str, at: str | None, shingle: int, least: int) -> DataFrame:
    """(key, at, c1, c2, symbols, b0, b1) of the records with ``least`` words and a shingle.

    c1, c2 name the class of equal words, b0, b1 are the 128 bits of the sketch.
    """
    least = max(least, shingle)
    names = ["key", "at", "c1", "c2", "symbols", "b0", "b1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for keys, words in _records(batch):
                times = batch.column(2).slice(done, len(words))
                done += len(words)
                keep = [i for i, w in enumerate(words) if len(w) >= least]
                if not keep:
                    continue
                words = [words[i] for i in keep]
                hashes, count = shingle_hashes(words, shingle)
                symbols = sketch(hashes, count)
                bits = bit_sketch(symbols)
                starts = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
                inside = np.arange(len(hashes)) - np.repeat(starts, count)
                c1 = np.add.reduceat(_mix(hashes + inside.astype(np.uint64) * _U64(0xD6E8FEB86659FD93)), starts)
                c2 = np.bitwise_xor.reduceat(_mix(hashes * _U64(0xA0761D6478BD642F) + inside.astype(np.uint64)), starts)
                indexed = np.ascontiguousarray(symbols[:, : SEGMENTS * WIDTH])
                chosen = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(chosen), times.take(chosen), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                        rows_as_binary(indexed), pa.array(bits[:, 0].view(np.int64)), pa.array(bits[:, 1].view(np.int64)),
                    ],
                    names=names,
                )

    kind = records.schema[key].dataType.simpleString()
    time = F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(0)
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("text"), time.cast("bigint").alias("at"))
    return rows.mapInArrow(run, f"key {kind}, at bigint, c1 bigint, c2 bigint, symbols binary, b0 bigint, b1 bigint")


def _symbols(column: pa.Array) -> np.ndarray:
    return binary_as_rows(column, np.uint16, SEGMENTS * WIDTH)


def variant_signatures(symbols: np.ndarray) -> np.ndarray:
    """(records, SEGMENTS * WIDTH) one-wildcard variants of all segments, as 64-bit signatures."""
    out = np.empty((len(symbols), SEGMENTS * WIDTH), dtype=np.uint64)
    wide = symbols.astype(np.uint64)
    for s in range(SEGMENTS):
        for gap in range(WIDTH):
            h = np.full(len(symbols), s * WIDTH + gap + 1, dtype=np.uint64)
            for i in range(WIDTH):
                if i != gap:
                    h = _mix((h << _U64(16)) + h + wide[:, s * WIDTH + i])
            out[:, s * WIDTH + gap] = h
    return out


def bit_sketch(symbols: np.ndarray) -> np.ndarray:
    """One bit of each symbol, (records, 2) words of 64."""
    return np.ascontiguousarray(np.packbits((symbols & 1).astype(np.uint8), axis=1)).view(np.uint64)


def differing_bits(similarity: float, bits: int, deviations: float) -> int:
    """Bits that may differ: the mean at that similarity plus so many standard deviations."""
    p = (1 - similarity) / 2
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def _variants(reps: DataFrame, kind: str) -> DataFrame:
    """(sig, key, b0): the index rows of all representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                sig = variant_signatures(_symbols(part.column(1)))
                each = pa.array(np.repeat(np.arange(len(sig)), sig.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.ravel().view(np.int64)), part.column(0).take(each), part.column(2).take(each)], names=["sig", "key", "b0"]
                )

    return reps.select("key", "symbols", "b0").mapInArrow(run, f"sig bigint, key {kind}, b0 bigint")


def bucket_pairs(sig: np.ndarray, bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal signature, in sorted rows, whose sketches differ in at most so many bits; in steps of rising distance."""
    at = np.arange(len(sig))
    gap = 1
    while True:
        at = at[at + gap < len(sig)]
        at = at[sig[at] == sig[at + gap]]
        if not len(at):
            return
        near = np.bitwise_count(bits[at] ^ bits[at + gap]) <= most
        yield at[near], at[near] + gap
        gap += 1


def _candidates(index: DataFrame, kind: str, most: int) -> DataFrame:
    """Pairs of representatives that share a variant, an equality join of the index with itself in one shuffle: (a, b, sig, block).

    Rows are sorted by signature within their partition (spilling if need be), and a task
    holds one signature's rows at a time, as three numbers each. A bucket of more than
    ``BUCKET_ROWS`` is not compared here: each of its rows comes out as (a, null, sig, block).
    """
    names = ["a", "b", "sig", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hot(rows: pa.Table, place: int) -> pa.RecordBatch:
            n = rows.num_rows
            block = pa.array((np.arange(place, place + n) // BUCKET_ROWS).astype(np.int32))
            keys = rows.column(1).combine_chunks()
            return pa.RecordBatch.from_arrays([keys, pa.nulls(n, keys.type), rows.column(0).combine_chunks(), block], names=names)

        def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            sig = rows.column(0).to_numpy()
            _, first, size = np.unique(sig, return_index=True, return_counts=True)
            long = size > BUCKET_ROWS
            for at, n in zip(first[long].tolist(), size[long].tolist()):
                yield hot(rows.slice(at, n), 0)
            if long.any():
                rows = rows.take(pa.array(np.nonzero(~np.repeat(long, size))[0]))
                sig = rows.column(0).to_numpy()
            bits = rows.column(2).to_numpy().view(np.uint64)
            keys = rows.column(1).combine_chunks()
            for x, y in bucket_pairs(sig.view(np.uint64), bits, most):
                a, b = keys.take(pa.array(x)), keys.take(pa.array(y))
                swap = pc.greater(a, b)
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=names
                )

        held: list[pa.RecordBatch] = []
        going, place = None, 0  # the signature whose rows are passed on, and how many were
        for batch in batches:
            if going is not None:
                n = int(np.searchsorted(batch.column(0).to_numpy(), going, "right"))
                if n:
                    yield hot(pa.Table.from_batches([batch.slice(0, n)]), place)
                    place += n
                if n == batch.num_rows:
                    continue
                going, batch = None, batch.slice(n)
            held.append(batch)
            if sum(b.num_rows for b in held) < 200_000:
                continue
            rows = pa.Table.from_batches(held)
            sig = rows.column(0).to_numpy()
            stop = int(np.searchsorted(sig, sig[-1], "left"))
            if stop:
                yield from compared(rows.slice(0, stop))
            rest = rows.slice(stop)
            held = rest.to_batches()
            if rest.num_rows > BUCKET_ROWS:
                yield hot(rest, 0)
                going, place, held = sig[-1], rest.num_rows, []
        if held:
            yield from compared(pa.Table.from_batches(held))

    spread = index.repartition("sig").sortWithinPartitions("sig")
    return spread.mapInArrow(run, f"a {kind}, b {kind}, sig bigint, block int")


def agreeing_symbols(similarity: float, symbols: int, deviations: float) -> int:
    """Symbols that must agree: the mean at that similarity less so many standard deviations."""
    return int(np.floor(symbols * similarity - deviations * np.sqrt(symbols * similarity * (1 - similarity))))


def _in_tiles(hot: DataFrame, records: DataFrame, key: str, text: str, at: str | None, kind: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of the rows (a, sig, block) of long buckets whose full sketches agree in enough symbols.

    Every pair of a bucket's blocks is one tile, and a tile is one task's work, so a bucket
    of any length is spread. All ``SYMBOLS`` symbols are compared, which tells records that
    share a phrase from near-duplicates far better than the bits that other buckets are thinned by.
    """
    asked = hot.select("a").distinct()
    texts = earliest(records.where(F.col(key).isNotNull() & key_filter(asked, "a")(F.col(key))), key, at, [text])

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words in _records(batch):
                keep = [i for i, w in enumerate(words) if len(w) >= shingle]
                if keep:
                    own = sketch(*shingle_hashes([words[i] for i in keep], shingle))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(keep)), rows_as_binary(own)], names=["a", "all"])

    full = texts.select(F.col(key).alias("a"), F.col(text).alias("text")).mapInArrow(symbols, f"a {kind}, all binary")
    blocks = hot.groupBy("sig").agg((F.max("block") + 1).alias("_blocks"))
    rows = hot.join(full, "a").join(blocks, "sig").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("sig", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "a", "all")
    least = agreeing_symbols(similarity, SYMBOLS, DEVIATIONS)

    def compare(tile: pa.Table) -> pa.Table:
        block = tile.column("block").to_numpy()
        keys = tile.column("a").combine_chunks()
        own = binary_as_rows(tile.column("all").combine_chunks(), np.uint16, SYMBOLS)
        left = np.nonzero(block == tile.column("i")[0].as_py())[0]
        right = np.nonzero(block == tile.column("j")[0].as_py())[0]
        found = []
        columns = np.ascontiguousarray(own[right].T)
        for part in range(0, len(left), 500):
            rows = left[part : part + 500]
            same = np.zeros((len(rows), len(right)), dtype=np.uint8)
            for s in range(SYMBOLS):
                same += own[rows, s][:, None] == columns[s][None]
            x, y = np.nonzero(same >= least)
            found.append((rows[x], right[y]))
        x, y = (pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1))
        a, b = keys.take(x), keys.take(y)
        ordered = pc.less(a, b) if tile.column("i")[0] == tile.column("j")[0] else pa.array(np.ones(len(a), dtype=bool))
        swap = pc.greater(a, b)
        return pa.table({"a": pc.if_else(swap, b, a), "b": pc.if_else(swap, a, b)}).filter(ordered)

    return rows.groupBy("sig", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _verified(pairs: DataFrame, kind: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, ta, tb) whose shingle sets are that similar, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, value = [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = words_of(x), words_of(y)
                sa = set(zip(*[a[j:] for j in range(shingle)]))
                sb = set(zip(*[b[j:] for j in range(shingle)]))
                both = len(sa & sb)
                if both >= similarity * (len(sa) + len(sb) - both) - 1e-9 and both:
                    keep.append(i)
                    value.append(both / (len(sa) + len(sb) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def near_duplicate_classes(
    records: DataFrame, key: str, text: str = "text", at: str | None = None, shingle: int = 5, similarity: float = 0.8, least_words: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: (key, rep, size) of every record long enough; links: (a, b, similarity) between representatives.

    A key counts once, by its earliest ``at``. ``rep`` is the smallest key with the same
    words and ``size`` their number; texts without a shingle (null, empty, short) are in
    neither table. Links hold for all members. Records as similar as the threshold share a
    variant with a probability of 1 - (1 - s**4 - 4 (1-s) s**3)**12, 0.989 at a half and
    above 0.999 from 0.6 on; each of the two sketch tests then loses 0.13 % of those at the
    threshold, and hardly any that are more alike, so 0.986 at a half are found.
    """
    kind = records.schema[key].dataType.simpleString()
    whole = F.struct("c1", "c2", "symbols", "b0", "b1")
    delivered = sketches(records.where(F.col(key).isNotNull()), key, text, at, shingle, least_words)
    sketched = cut(delivered.groupBy("key").agg(F.min_by(whole, F.struct(F.col("at").isNull(), "at", "c1", "c2")).alias("_s")).select("key", "_s.*"))
    classes = cut(sketched.groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.count("*").alias("size")))
    members = cut(_members(sketched.select("key", "c1", "c2"), classes))
    copies = members.where("key <> rep").select("key")
    copied = key_filter(copies, "key")(F.col("key"))
    reps = sketched.where(~copied).unionByName(sketched.where(copied).join(copies, "key", "left_anti"))
    found = cut(_candidates(_variants(reps, kind), kind, differing_bits(similarity, 64, DEVIATIONS)))
    candidates = found.where("sig IS NULL").select("a", "b").where("a <> b").distinct()
    hot = found.where("sig IS NOT NULL").select("a", "sig", "block")
    known = reps.select("key", "b0", "b1")
    both = candidates.join(known.toDF("a", "a0", "a1"), "a").join(known.toDF("b", "b0", "b1"), "b")
    far = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    close = both.where(far <= differing_bits(similarity, SYMBOLS, DEVIATIONS)).select("a", "b")
    if not hot.isEmpty():
        close = close.union(_in_tiles(hot, records, key, text, at, kind, shingle, similarity)).distinct()
    close = cut(close)
    asked = close.select("a").union(close.select("b")).distinct()
    # Texts that the filter lets through without need meet no pair in the joins below.
    texts = cut(earliest(records.where(F.col(key).isNotNull() & key_filter(asked, "a")(F.col(key))), key, at, [text]))
    with_texts = close.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return members, _verified(with_texts, kind, shingle, similarity)


def _members(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, rep, size) of every record. Only rows that seem to be of a class of several are joined with it, and hot classes are looked up apart."""
    name = F.concat_ws(" ", F.col("c1").cast("string"), F.col("c2").cast("string")).alias("class")
    several = classes.where("size > 1")
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one row
    hot = several.where(F.col("size") >= max(SLICE, -(-total // HOT_KEYS))).select(name)
    part = keys.where(key_filter(several, "c1")(F.col("c1"))).select("key", name)
    shared = look_up(part, several.select(name, "rep", "size"), "class", hot, "key", "inner").select("key", "rep", "size")
    return classes.where("size = 1").select(F.col("rep").alias("key"), "rep", "size").unionByName(shared)


def _slices(size: Column) -> Column:
    return F.ceil(size / SLICE).cast("int")


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) of single records, the smaller first: members of linked classes, and members of one class.

    Classes of more than ``SLICE`` members are sliced by a hash, and what they meet is dealt
    to every slice, so no class gathers in one task.
    """
    m = members.select(F.col("key").alias("_k"), F.col("rep").alias("_rep"), "size")
    sliced = m.withColumn("_slice", F.pmod(F.xxhash64("_k"), _slices(F.col("size")).cast("long")).cast("int"))
    large = m.where(F.col("size") > SLICE).select("_rep", _slices(F.col("size")).alias("_n")).distinct()

    def spread(rows: DataFrame, end: str, name: str) -> DataFrame:
        known = rows.join(large.withColumnRenamed("_rep", end), end, "left")
        dealt = known.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
        return dealt.join(sliced.select(F.col("_k").alias(name), F.col("_rep").alias(end), "_slice"), [end, "_slice"]).drop("_slice")

    across = spread(spread(links.select("a", "b"), "a", "ka"), "b", "kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    copies = sliced.where("size > 1")
    dealt = copies.select(F.col("_k").alias("b"), "_rep", F.explode(F.sequence(F.lit(0), _slices(F.col("size")) - 1)).alias("_slice"))
    within = copies.select(F.col("_k").alias("a"), "_rep", "_slice").join(dealt, ["_rep", "_slice"]).where(F.col("a") < F.col("b")).select("a", "b")
    return across.unionByName(within)


def connected_groups(links: DataFrame) -> DataFrame:
    """(node, group): the smallest node that the links (a, b) reach, for every node with a link.

    Large-star and small-star steps in turn; each step is an aggregation and a join, and
    its edges are cut into the shared folder. Ends when a round changes nothing, after a
    number of rounds in the order of the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("hi", "lo", "m")
        after = cut(
            small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo")))
            .where("hi <> lo").distinct()
        )
        same = after.count() == edges.count() and after.join(edges, ["hi", "lo"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("group"))
    return nodes.union(edges.select("lo", "lo")).distinct()


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, group, links): every record's group, its own key if it has no partner, and its number of linked records."""
    links = cut(links)
    groups = connected_groups(links)
    size = members.groupBy("rep").agg(F.max("size").alias("_n"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    partners = ends.join(size.toDF("other", "_n"), "other").groupBy("rep").agg(F.sum("_n").alias("_across"))
    known = partners.join(groups.toDF("rep", "_g"), "rep", "full_outer")
    large = members.where(F.col("size") >= max(SLICE, -(-members.count() // HOT_KEYS))).select("rep").distinct()
    named = look_up(members, known, "rep", large, "key")
    return named.select(
        "key", F.coalesce("_g", "rep").alias("group"), (F.coalesce("_across", F.lit(0)) + F.col("size") - 1).cast("long").alias("links")
    )
