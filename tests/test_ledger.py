import pytest
from pyspark.sql import functions as F

from pagelode.operators import ledger as lg


def states(ledger, items, now):
    return {r["item"]: r["state"] for r in ledger.states(items, now).collect()}


def test_lease_expiry_fencing_and_retry(spark, tmp_path):
    ledger = lg.WorkLedger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1"), (None, "1")], "item string, version string")
    assert states(ledger, items, 0) == {"a": "pending", "b": "pending"}
    first = ledger.claim(items, "w1", now=0, lease=10)
    held = spark.createDataFrame(first.collect(), first.schema)
    assert {(r["item"], r["token"]) for r in held.collect()} == {("a", 1), ("b", 1)}
    assert ledger.claim(items, "w2", now=5, lease=10).count() == 0
    assert ledger.commit(held.where("item = 'a'"), "w1", now=6).count() == 1
    assert states(ledger, items, 7) == {"a": "done", "b": "leased"}
    # the lease of b runs out; another worker takes it under a newer token
    assert states(ledger, items, 11) == {"a": "done", "b": "pending"}
    again = spark.createDataFrame(ledger.claim(items, "w2", now=12, lease=10).collect(), first.schema)
    assert [(r["item"], r["token"]) for r in again.collect()] == [("b", 2)]
    # the first worker wakes up: its token is stale
    assert ledger.commit(held.where("item = 'b'"), "w1", now=13).count() == 0
    assert states(ledger, items, 13)["b"] == "leased"
    assert ledger.fail(again, "w2", now=14).count() == 1
    assert states(ledger, items, 14)["b"] == "pending"
    # a new version of a done item is pending again, under a higher token
    newer = spark.createDataFrame([("a", "2")], "item string, version string")
    assert ledger.states(newer, 15).collect()[0][2:] == ("pending", 1)


def test_compaction_keeps_states_and_tokens(spark, tmp_path):
    ledger = lg.WorkLedger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "item string, version string")
    for now in (0, 20, 40):
        held = ledger.claim(items, "w", now=now, lease=10)
        if now == 20:
            ledger.commit(held.where("item = 'a'"), "w", now=21)
            with pytest.raises(RuntimeError):
                ledger.compact(22)
    ledger.fail(ledger.held("w", 41).where("item = 'b'"), "w", now=41)
    view = lambda now: sorted(map(tuple, ledger.states(items, now).collect()))
    before, n = view(60), ledger.events().count()
    assert ledger.compact(60) < n
    assert view(60) == before == [("a", "1", "done", 2), ("b", "1", "pending", 3), ("c", "1", "pending", 3)]
    assert [r["token"] for r in ledger.claim(items, "w", now=61, lease=5).orderBy("item").collect()] == [4, 4]


def test_judge_commits(spark):
    leases = spark.createDataFrame([("a", "1", "leased", 1, "w", 0.0, 5.0), ("a", "1", "leased", 2, "v", 6.0, 9.0)], lg.EVENTS)
    asked = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("b", "1", 1)], "item string, version string, token long")
    for now, want in ((None, [False, True, False]), (7.0, [False, True, False]), (10.0, [False] * 3)):
        assert [r["accepted"] for r in lg.judge_commits(asked, leases, now).orderBy("item", "token").collect()] == want


def test_output_paths_are_deterministic(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("a", None, 1)], "item string, m double, s long")
    rows = df.select(lg.output_path("/out/", F.col("item"), lg.version_of(F.col("m"), F.col("s"))).alias("p")).collect()
    assert rows[0] == rows[1] != rows[2]


LISTED = [
    ("same", 1.5, 10, 1), ("same", 1.0, 9, 0), ("touched", 2.5, 10, 1), ("grown", 1.5, 11, 1), ("new", 1.0, 1, 1), ("failed", None, 1, 5), ("failed", 1.0, 1, 1),
    ("nobatches", 1.0, 1, 1), ("nullbatches", 1.0, 1, 1), ("lost", 1.0, 1, 1), ("open", 1.0, 1, 1), ("retried", 1.0, 1, 1), ("onlyfailed", None, None, 1), (None, 1.0, 1, 1),
]
RECORDS = [
    ("same", 1, 1.5, 10, [1]), ("touched", 1, 1.5, 10, [1]), ("grown", 1, 1.5, 10, [1]), ("failed", 1, 1.0, 1, [1]), ("nobatches", 1, 1.0, 1, []),
    ("nullbatches", 1, 1.0, 1, None), ("lost", 1, 1.0, 1, [1, 2]), ("open", 2, 1.0, 1, [1]), ("retried", 1, 9.0, 1, [1]), ("retried", 3, 1.0, 1, [1]), ("retried", 3, 1.0, 1, [1]), ("gone", 1, 1.0, 1, [1]),
]


def tables(spark, times=1):
    files = spark.createDataFrame(LISTED * times, "path string, mtime double, size long, listed_at long")
    records = spark.createDataFrame([(*r, i) for i, r in enumerate(RECORDS)] * times, "path string, run_id int, mtime double, size long, batches array<int>, recorded_at long")
    runs = spark.createDataFrame([(1, "complete"), (2, "indexing"), (3, "complete")], "run_id int, status string")
    batches = spark.createDataFrame([(1, 5), (1, None), (2, None)], "batch_id int, stored_at int")
    return files, records, runs, batches


@pytest.mark.parametrize("times", [1, 3])
def test_plan_run(spark, times):
    rows = lg.plan_run(*tables(spark, times)).collect()
    got = {r["path"]: r["reason"] for r in rows}
    assert len(rows) == len(got)
    assert got == {
        "same": None, "touched": "changed", "grown": "changed", "new": "new", "failed": None, "nobatches": None, "nullbatches": "unstored",
        "lost": "unstored", "open": "expired", "retried": None,
    }
    assert {r["path"]: r["next_token"] for r in rows}["retried"] == 4


def test_plan_run_empty(spark):
    files, records, runs, batches = tables(spark)
    assert lg.plan_run(files.limit(0), records, runs, batches).count() == 0
    assert {r["reason"] for r in lg.plan_run(files, records.limit(0), runs.limit(0), batches.limit(0)).collect()} == {"new"}


def test_plan_run_folds_events(spark):
    log = lg.run_log(*tables(spark)[1:])
    events = lg.run_events(log)
    assert events.schema.names == lg.EVENTS.names
    got = sorted((r["item"], r["kind"], r["token"]) for r in events.where("item IN ('lost', 'open', 'retried')").collect())
    assert got == [("lost", "leased", 1), ("open", "leased", 2), ("retried", "done", 3), ("retried", "leased", 3)]


def test_plan_run_knows_running_leases(spark):
    files = tables(spark)
    items = lg.latest_listing(files[0]).select(F.col("path").alias("item"), lg.file_version(F.col("mtime"), F.col("size")).alias("version"))
    held = items.where("item = 'new'").select(
        "item", "version", F.lit("leased").alias("kind"), F.lit(9).cast("long").alias("token"), F.lit("w").alias("worker"),
        F.lit(1.0).alias("at"), F.lit(5.0).alias("until"),
    )
    done = held.withColumn("kind", F.lit("done")).withColumn("until", F.lit(None).cast("double"))
    for now, events, state in ((2.0, held, "leased"), (6.0, held, "pending"), (6.0, held.unionByName(done), "done")):
        row = {r["path"]: r for r in lg.plan_run(*files, events=events, now=now).collect()}
        assert (row["new"]["state"], row["new"]["next_token"]) == (state, 10)
        assert (row["same"]["state"], row["open"]["state"], row["touched"]["state"]) == ("done", "pending", "pending")
