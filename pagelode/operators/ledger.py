"""Processing only new or changed records: a ledger of work items.

An item is one version of one record: its key and a fingerprint of what must be
processed. Its state is pending, leased or done. A worker claims pending items with
a lease that runs out and with a fencing token that grows with every claim of the
item; a commit counts only with the item's newest token, so a worker that woke up
late cannot overwrite its successor's work. Outputs go to a path made from the item
alone, so a retry replaces what a lost attempt left behind.

The ledger is an append-only table of events; states are folded from it by
aggregation. It never collects items to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.session import cut_lineage
from pagelode.sources.fs import SharedFolder

EVENTS = T.StructType([
    T.StructField("item", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("kind", T.StringType()),  # leased, done or failed
    T.StructField("token", T.LongType()),
    T.StructField("worker", T.StringType()),
    T.StructField("at", T.DoubleType()),
    T.StructField("until", T.DoubleType()),
])


def version_of(*columns: Column) -> Column:
    """A fingerprint in which null, absent and equal values are told apart."""
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def output_path(base: str, item: Column, version: Column) -> Column:
    """Where an item's result goes; the same for every attempt."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.substring(F.sha2(item, 256), 1, 2), F.lit("/"), F.sha2(F.concat_ws("\0", item, version), 256))


def fold_states(items: DataFrame, events: DataFrame, now: float) -> DataFrame:
    """(item, version, state, token) of the wanted items.

    done: a commit with the newest token of this version. leased: the newest lease
    still runs. pending: all else, also after a lease ran out or failed. Events of
    other versions are ignored for the state, but their tokens are never used again.
    Null items are left out; repeated items count once.
    """
    wanted = items.select("item", "version").where(F.col("item").isNotNull()).distinct()
    top = events.groupBy("item").agg(F.max(F.when(F.col("kind") == "leased", F.col("token"))).alias("_top"))
    last = events.groupBy("item", "version").agg(
        F.max(F.when(F.col("kind") == "leased", F.struct("token", "until"))).alias("_lease"),
        F.max(F.when(F.col("kind") == "done", F.col("token"))).alias("_done"),
        F.max(F.when(F.col("kind") == "failed", F.col("token"))).alias("_failed"),
    )
    at = wanted.join(top, "item", "left").join(last, ["item", "version"], "left")
    lease = F.col("_lease")
    live = lease.isNotNull() & (lease["until"] > F.lit(now)) & (F.coalesce(F.col("_failed"), F.lit(-1)) < lease["token"])
    state = (
        F.when(F.col("_done") == lease["token"], F.lit("done")).when(live, F.lit("leased")).otherwise(F.lit("pending"))
    )
    return at.select("item", "version", state.alias("state"), F.coalesce("_top", F.lit(0)).cast("long").alias("token"))


def newest_leases(events: DataFrame) -> DataFrame:
    """(item, _top, _until): the newest lease of every item."""
    lease = F.max(F.when(F.col("kind") == "leased", F.struct("token", "until"))).alias("_l")
    return events.groupBy("item").agg(lease).select("item", F.col("_l.token").alias("_top"), F.col("_l.until").alias("_until"))


def judge_commits(asked: DataFrame, events: DataFrame, now: float | None) -> DataFrame:
    """(item, version, token, accepted) of commits asked for: accepted under the item's newest token, while its lease runs.

    A stale token is rejected whatever its lease says. Without ``now`` only tokens decide.
    Items that were never leased are rejected.
    """
    fits = F.col("token") == F.col("_top")
    if now is not None:
        fits = fits & (F.col("_until") > F.lit(float(now)))
    joined = asked.select("item", "version", "token").join(newest_leases(events), "item", "left")
    return joined.select("item", "version", "token", F.coalesce(fits, F.lit(False)).alias("accepted"))


class WorkLedger:
    """The ledger of one job in a shared folder. One coordinator claims and compacts; any worker may commit.

    Events lie in ``log-G``; ``current.json`` names the G that counts.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = SharedFolder(spark, self.path)

    def _generation(self) -> int:
        return int((self.folder.read_json("current.json") or {}).get("log", 0))

    def events(self) -> DataFrame:
        """All events; none before the first claim."""
        name = f"log-{self._generation()}"
        if not self.folder.exists(name):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/{name}")

    def compact(self, now: float) -> int:
        """Writes the log anew with what still matters, and returns the number of events left.

        Of each item its newest lease stays, and of each version the commits and failures
        under its newest token; states and tokens are as before. Refused while a lease runs,
        so that no worker commits into the log that is given up.
        """
        events = self.events()
        leases = events.where("kind = 'leased'").groupBy("item", "version").agg(F.max(F.struct(*[F.col(f.name) for f in EVENTS])).alias("_e"), F.max("token").alias("_t"))
        ended = events.where("kind <> 'leased'").groupBy("item", "version", "kind").agg(F.max("token").alias("token"))
        running = newest_leases(events).join(ended.groupBy("item").agg(F.max("token").alias("_ended")), "item", "left")
        if not running.where((F.col("_until") > F.lit(float(now))) & (F.coalesce("_ended", F.lit(-1)) < F.col("_top"))).isEmpty():
            raise RuntimeError("a lease is still running")
        blank = {"worker": "string", "at": "double", "until": "double"}
        kept = leases.select("_e.*").unionByName(ended.select(
            "item", "version", "kind", "token", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()]
        ).select(*[f.name for f in EVENTS]))
        after = self._generation() + 1
        kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS]).write.mode("overwrite").parquet(f"{self.path}/log-{after}")
        self.folder.write_json("current.json", {"log": after})
        self.folder.delete(f"log-{after - 1}")
        return self.events().count()

    def _append(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS]).write.mode("append").parquet(f"{self.path}/log-{self._generation()}")

    def states(self, items: DataFrame, now: float) -> DataFrame:
        return fold_states(items, self.events(), now)

    def claim(self, items: DataFrame, worker: str, now: float, lease: float) -> DataFrame:
        """Leases every pending item to ``worker`` and returns what it holds: (item, version, token).

        The returned rows are read back from the written events, so the caller works
        on exactly what the ledger granted.
        """
        pending = self.states(items, now).where(F.col("state") == "pending")
        self._append(pending.select(
            "item", "version", F.lit("leased").alias("kind"), (F.col("token") + 1).alias("token"),
            F.lit(worker).alias("worker"), F.lit(float(now)).alias("at"), F.lit(float(now + lease)).alias("until"),
        ))
        return self.held(worker, now)

    def held(self, worker: str, now: float) -> DataFrame:
        """(item, version, token) that ``worker`` holds under the newest, still running lease."""
        last = self.events().groupBy("item").agg(
            F.max(F.when(F.col("kind") == "leased", F.struct("token", "until", "worker", "version"))).alias("_l"),
            F.max(F.when(F.col("kind") != "leased", F.col("token"))).alias("_ended"),
        )
        lease = F.col("_l")
        mine = (lease["worker"] == worker) & (lease["until"] > F.lit(now)) & (F.coalesce(F.col("_ended"), F.lit(-1)) < lease["token"])
        return last.where(mine).select("item", lease["version"].alias("version"), lease["token"].alias("token"))

    def _end(self, kind: str, held: DataFrame, worker: str, now: float) -> DataFrame:
        judged = judge_commits(held, self.events(), now)
        valid = cut_lineage(judged.where("accepted").drop("accepted"))  # judged once, before its own events are written
        self._append(valid.select(
            "item", "version", F.lit(kind).alias("kind"), "token", F.lit(worker).alias("worker"),
            F.lit(float(now)).alias("at"), F.lit(None).cast("double").alias("until"),
        ))
        return valid

    def commit(self, held: DataFrame, worker: str, now: float) -> DataFrame:
        """Marks items done; rows with a stale token or a lease that ran out are rejected. Returns what was accepted."""
        return self._end("done", held, worker, now)

    def fail(self, held: DataFrame, worker: str, now: float) -> DataFrame:
        """Gives items back to pending at once."""
        return self._end("failed", held, worker, now)


def latest_listing(source_files: DataFrame) -> DataFrame:
    """(path, mtime, size): each path's latest listing that has both; failed listings are skipped."""
    ok = source_files.where(F.col("mtime").isNotNull() & F.col("size").isNotNull() & F.col("path").isNotNull())
    best = F.max_by(F.struct("mtime", "size"), F.struct("listed_at", "mtime", "size")).alias("_l")
    return ok.groupBy("path").agg(best).select("path", "_l.mtime", "_l.size")


def run_log(file_records: DataFrame, index_runs: DataFrame, index_batches: DataFrame) -> DataFrame:
    """What the log of runs says of each path: (path, mtime, size, has_record, stored, token, open_token).

    A run is an attempt and its run_id the fencing token. A record of a complete run
    is that attempt's commit; one of a run that never ended is a lease without commit,
    which is expired as soon as a later run is planned. Only the commit with the
    highest token counts, then the latest recorded_at. ``stored`` is false where the
    commit's batches are null or name a batch that was not stored; no batch at all is fine.
    """
    runs = index_runs.select("run_id", "status").distinct()
    rec = file_records.join(runs, "run_id").where(F.col("path").isNotNull())
    done = F.when(
        F.col("status") == "complete",
        F.struct("run_id", "recorded_at", F.col("mtime"), F.col("size"), F.col("batches")),
    )
    last = rec.groupBy("path").agg(
        F.max(done).alias("_d"), F.max(F.when(F.col("status") != "complete", F.col("run_id"))).alias("open_token")
    )
    flat = last.select(
        "path", F.col("_d.mtime").alias("mtime"), F.col("_d.size").alias("size"), F.col("_d.batches").alias("batches"),
        F.col("_d").isNotNull().alias("has_record"), F.col("_d.run_id").cast("long").alias("token"),
        F.col("open_token").cast("long").alias("open_token"),
    )
    stored = index_batches.where(F.col("stored_at").isNotNull() & F.col("batch_id").isNotNull()).select("batch_id").distinct()
    missing = (
        flat.where(F.size("batches") > 0)
        .select("path", F.explode("batches").alias("batch_id"))
        .join(stored, "batch_id", "left_anti")
        .select("path").distinct().withColumn("_missing", F.lit(True))
    )
    return flat.join(missing, "path", "left").select(
        "path", "mtime", "size", "has_record",
        (F.col("has_record") & F.col("batches").isNotNull() & F.col("_missing").isNull()).alias("stored"),
        "token", "open_token",
    )


def file_version(mtime: Column, size: Column) -> Column:
    """A file's version: equal numbers, 0 and -0 too, give equal versions."""
    return version_of(mtime.cast("double") + F.lit(0.0), size.cast("long"))


def run_events(log: DataFrame) -> DataFrame:
    """A ``run_log`` as rows of ``EVENTS``.

    The record that counts is a lease of its version under its run's token, and done
    if its batches are stored. A record of a run that never ended is a lease that has
    run out; it names no version, so it unseats no commit, but its token stays used.
    """
    def event(kind: str, version: Column, token: Column) -> Column:
        values = {"item": F.col("path"), "version": version, "kind": F.lit(kind), "token": token, "worker": F.lit(None), "at": F.lit(None), "until": F.lit(None)}
        return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in EVENTS])

    version = file_version(F.col("mtime"), F.col("size"))
    rows = F.array_compact(F.array(
        F.when(F.col("has_record"), event("leased", version, F.col("token"))),
        F.when(F.col("stored"), event("done", version, F.col("token"))),
        F.when(F.col("open_token").isNotNull(), event("leased", F.lit(None).cast("string"), F.col("open_token"))),
    ))
    return log.select(F.explode(rows).alias("_e")).select("_e.*")


def plan_run(
    source_files: DataFrame, file_records: DataFrame, index_runs: DataFrame, index_batches: DataFrame,
    events: DataFrame | None = None, now: float = 0.0,
) -> DataFrame:
    """Every listed file's ledger state: (path, mtime, size, state, reason, token, next_token).

    The state is folded from the run log's events and from ``events``, those of a
    ``WorkLedger`` whose items are paths and whose versions are ``file_version``; with
    them a file that a worker holds at ``now`` is ``leased``. ``done`` files carry no
    reason. Others are new, changed or lost their batches; ``expired`` marks one whose
    newer lease never committed. ``next_token`` is above every token that the path ever
    had, so a late writer of an older run is rejected. Paths that are no longer listed
    are no work and give no row.
    """
    listing = latest_listing(source_files).withColumn("version", file_version(F.col("mtime"), F.col("size"))).withColumnRenamed("mtime", "_m").withColumnRenamed("size", "_s")
    log = run_log(file_records, index_runs, index_batches)
    every = run_events(log) if events is None else run_events(log).unionByName(events)
    states = fold_states(listing.select(F.col("path").alias("item"), "version"), every, now)
    states = states.select(F.col("item").alias("path"), "state", F.col("token").alias("_top"))
    both = listing.join(states, "path").join(log, "path", "left")
    differs = F.col("version") != file_version(F.col("mtime"), F.col("size"))
    reason = (
        F.when(F.col("state") == "done", F.lit(None).cast("string"))
        .when(F.coalesce(F.col("has_record"), F.lit(False)) == F.lit(False),
              F.when(F.col("open_token").isNotNull(), F.lit("expired")).otherwise(F.lit("new")))
        .when(differs, F.lit("changed"))
        .when(~F.col("stored"), F.lit("unstored"))
        .otherwise(F.lit("expired"))
    )
    return both.select(
        "path", F.col("_m").alias("mtime"), F.col("_s").alias("size"), "state",
        reason.alias("reason"), "token", (F.col("_top") + 1).cast("long").alias("next_token"),
    )
