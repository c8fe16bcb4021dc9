"""Mixing sources to target shares by systematic sampling (problem 8).

A document's expected copies are its source's rate: target tokens over the source's
tokens, at most ``max_repeats``. Within a source the expected copies are summed up in
a fixed order, one random offset is added, and a document comes out once for every
integer that its stretch of the sum crosses. So a source's copies differ from the
expected number by less than one, and no document exceeds its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.llm.bpe import BYTE_BPE_50K, TOKENIZERS, count_tokens
from pagelode.llm.stage import cut, small_side

#: Rows of one source that are numbered in one task.
SLICE_ROWS = 50_000


def plan_shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source, target_share, max_repeats, docs, tokens, total, rate, reachable.

    ``total`` is the size of all documents, listed source or not. The rate is capped by
    max_repeats; ``reachable`` tells whether the cap leaves the target share within
    reach. Sources without documents have 0 tokens and are out of reach unless their
    share is 0. A null share counts as 0, null repeats as 1; of several rows for one
    source the one with the largest share holds.
    """
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("_t")
    ).select("source", F.col("_t.s").alias("target_share"), F.col("_t.r").alias("max_repeats"))
    # The total is one row, joined on a constant.
    all_tokens = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).withColumn("_one", F.lit(1))
    joined = want.join(sizes, "source", "left").withColumn("_one", F.lit(1)).join(F.broadcast(all_tokens), "_one").drop("_one")
    tokens = F.coalesce("tokens", F.lit(0))
    goal = F.col("target_share") * F.col("total")
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), tokens.alias("tokens"), "total",
        F.when(tokens > 0, F.least(goal / tokens, F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("rate"),
        (tokens * F.col("max_repeats") >= goal).alias("reachable"),
    )


def emitted(rate: Column, position: Column, offset: Column) -> Column:
    """Integers crossed by the ``position``-th stretch of length ``rate`` (positions from 1)."""
    return (F.floor(offset + rate * position) - F.floor(offset + rate * (position - 1))).cast("int")


def source_offset(source: Column, seed: int) -> Column:
    """The source's one random number in [0, 1)."""
    return F.pmod(F.xxhash64(source, F.lit(seed)), F.lit(1 << 32)).cast("double") / float(1 << 32)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17, folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> tuple[DataFrame, DataFrame]:
    """(copies, shares): (key, source, tokens, copies) of the chosen documents, and each target's reached share.

    The order within a source is a hash of the key, so neither lengths nor ids line up
    with the sampling step. Positions come from two levels: counts of hash slices, summed
    up per source, then row numbers within a slice; no source gathers in one task.
    Documents without a listed source are not used. Repeated keys count as rows of their own.
    """
    sized = cut(count_tokens(docs, (key, "source"), folder=folder, name=name))
    plan = plan_shares(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), targets)
    plan = cut(plan)
    slices = max(1, -(-sized.count() // SLICE_ROWS))
    h = F.xxhash64(F.col(key), F.lit(seed))
    step = (1 << 64) // slices + 1
    rates = small_side(plan.where("rate > 0").select("source", "rate"))  # one row a target
    rows = sized.join(rates, "source").withColumn("_h", h)
    rows = rows.withColumn("_slice", F.floor((F.col("_h").cast("double") + float(1 << 63)) / float(step)).cast("long"))
    before = rows.groupBy("source", "_slice").agg(F.count("*").alias("_n")).select(
        "source", "_slice",
        F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = F.row_number().over(Window.partitionBy("source", "_slice").orderBy("_h", key, "tokens"))
    placed = rows.withColumn("_in", within).join(before, ["source", "_slice"])
    copies = placed.withColumn(
        "copies", emitted(F.col("rate"), F.col("_before") + F.col("_in"), source_offset(F.col("source"), seed))
    ).where("copies > 0").select(key, "source", "tokens", "copies")
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    shares = plan.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    everything = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a target
    return copies, shares.select(
        "source", "target_share", "max_repeats", "docs", "tokens", "total", "reachable", "mixed_tokens",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(F.col("total") > 0, F.col("mixed_tokens") / F.col("total")).otherwise(F.lit(0.0)).alias("share_of_target_size"),
        F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(F.lit(0.0)).alias("actual_share"),
    )


def out_of_reach(shares: DataFrame) -> DataFrame:
    """(source) of the targets whose sample uses all tokens max_repeats times and still falls short of the target share.

    At the cap the rate is a whole number, so every document comes out just so often, whatever the
    offset; below the cap the rate is what the target needs. So the sample's chance decides no row.
    """
    goal = F.col("target_share") * F.col("total")
    used_up = F.col("mixed_tokens") >= F.col("tokens") * F.col("max_repeats")
    return shares.where(used_up & (F.col("mixed_tokens") < goal)).select("source")
