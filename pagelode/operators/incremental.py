"""Change detection and maintenance of the file manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.operators.ordinal import running_sums


def _pair(current: DataFrame, previous: DataFrame, how: str) -> DataFrame:
    cur = current.select("path", F.struct("mtime", "size").alias("_c"))
    old = previous.select("path", F.struct("mtime", "size").alias("_p"))
    return cur.join(old, "path", how)


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, reason) of listed files that are new or differ in mtime or size; null differs from any value."""
    both = _pair(current, previous, "left")
    differs = ~F.col("_c.mtime").eqNullSafe(F.col("_p.mtime")) | ~F.col("_c.size").eqNullSafe(F.col("_p.size"))
    reason = F.when(F.col("_p").isNull(), F.lit("new")).when(differs, F.lit("modified"))
    return both.select("path", reason.alias("reason")).where(F.col("reason").isNotNull())


def unchanged_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    both = _pair(current, previous, "inner")
    return both.where(
        F.col("_c.mtime").eqNullSafe(F.col("_p.mtime")) & F.col("_c.size").eqNullSafe(F.col("_p.size"))
    ).select("path")


def deleted_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Paths of the manifest that the listing no longer has."""
    return previous.select("path").join(current.select("path"), "path", "left_anti")


def upsert_manifest(previous: DataFrame, current: DataFrame, drop_deleted: bool = True) -> DataFrame:
    """The next manifest: listed files win, their batches are kept; vanished files go unless asked for."""
    cur = current.select("path", F.struct("mtime", "size").alias("_c"))
    old = previous.select("path", F.struct("mtime", "size", "batches").alias("_p"))
    both = cur.join(old, "path", "left" if drop_deleted else "full_outer")
    pick = F.coalesce(F.col("_c"), F.struct(F.col("_p.mtime").alias("mtime"), F.col("_p.size").alias("size")))
    return both.select(
        "path", pick["mtime"].alias("mtime"), pick["size"].alias("size"),
        F.coalesce(F.col("_p.batches"), F.array().cast("array<int>")).alias("batches"),
    )


def parse_git_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """Paths of ``git status --porcelain`` lines: columns 4 on, trimmed; deletions and blank lines are left out."""
    text = F.col(line)
    path = F.trim(F.substring(text, 4, 1 << 30))
    deleted = text.startswith(" D") | text.startswith("D ")
    return lines.where((F.trim(text) != "") & ~deleted).select(path.alias("path")).distinct()


def detect_changes(current: DataFrame, previous: DataFrame, git_changed: DataFrame | None = None) -> DataFrame:
    """Paths to process. Files that git names are used where it names any listed file, else mtime and size decide.

    A git set that holds no listed file falls back too, so committed changes are not missed.
    """
    by_stat = changed_files(current, previous).select("path")
    if git_changed is None:
        return by_stat
    named = current.select("path").join(git_changed.select("path"), "path", "left_semi")
    return by_stat if named.isEmpty() else named


def running_counters(chunks: DataFrame) -> DataFrame:
    """(batch_id, total_chunks, indexed_files) after each stored batch."""
    first = chunks.groupBy("file").agg(F.min("batch_id").alias("batch_id")).groupBy("batch_id").agg(F.count("*").alias("_f"))
    each = chunks.groupBy("batch_id").agg(F.count("*").alias("_n")).join(first, "batch_id", "left")
    return running_sums(each.withColumn("_f", F.coalesce("_f", F.lit(0))), "batch_id", {"total_chunks": "_n", "indexed_files": "_f"})


def is_current(changed: DataFrame, status: str) -> bool:
    """True where nothing changed and the last run ended: the stored index can be used as it is."""
    return status == "complete" and changed.isEmpty()
