"""A dense global ordinal without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.session import cut_lineage

#: ``monotonically_increasing_id`` keeps the row's place within its partition in so many low bits.
PLACE_BITS = 33
#: Columns in between, named so that the rows' own columns keep theirs.
PLACE, PART, BEFORE, COUNT = "_ordinal_place", "_ordinal_part", "_ordinal_before", "_ordinal_count"


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Adds ``name`` = 0, 1, 2 ... to rows whose partitions, and rows within them, already stand in order.

    Each row's partition and place are written down once, in the shared folder: the
    counts of the partitions and the rows moved on by them then speak of the same
    partitions, whatever columns are read and whichever executor is lost.
    """
    placed = cut_lineage(ordered.withColumn(PLACE, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(PLACE, PLACE_BITS)
    counts = placed.groupBy(part.alias(PART)).agg(F.count("*").alias(COUNT))
    running = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = counts.select(PART, F.coalesce(F.sum(COUNT).over(running), F.lit(0)).alias(BEFORE))
    place = F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        placed.withColumn(PART, part)
        .join(F.broadcast(before), PART)  # one row a partition
        .withColumn(name, (F.col(BEFORE) + place).cast("long"))
        .drop(PART, BEFORE, PLACE)
    )


def with_ordinal(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """Adds ``name`` = 0, 1, 2 ... in the order of the columns, nulls first.

    Rows are range-partitioned and sorted by the order, one shuffle in all. Rows that are
    equal in it get different numbers, in no stated order; an empty table stays empty.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) for c in order]
    return numbered(df.repartitionByRange(n, *columns).sortWithinPartitions(*columns), name)


def running_sums(df: DataFrame, order: str, values: dict[str, str], width: int = 4096) -> DataFrame:
    """(order, sums): for every new name the sum of its column up to and with the row, by the integer column ``order``.

    Two levels: a window within stretches of ``width`` order values, moved on by the
    sums of the stretches before, so that only one row a stretch meets in one task.
    ``order`` must be unique.
    """
    rows = df.select(order, *values.values()).withColumn("_stretch", F.floor(F.col(order) / width))
    sums = rows.groupBy("_stretch").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    w = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_stretch", *[F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(f"_{n}") for n in values])
    within = Window.partitionBy("_stretch").orderBy(order)
    numbered = rows.select(order, "_stretch", *[F.sum(v).over(within).alias(n) for n, v in values.items()])
    return numbered.join(before, "_stretch").select(order, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in values])
