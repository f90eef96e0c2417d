import datetime as dt

import pytest

from strandline.operators.increments import ChangeCapture, StopHere, latest_usable, repo_state
from strandline.session import fresh_dir

PROBES = "probe_id long, full_name string, fingerprint string, kind string, outcome string, probed_at timestamp, batch string"
STATE = "full_name string, fingerprint string, kind string, last_indexed_at string, last_chunks long"


def probe(i, name, print_, minute, outcome="ok"):
    return (i, name, print_, "git", outcome, dt.datetime(2025, 1, 1, 0, minute), "x")


ROWS = [
    probe(1, "a", "f1", 1), probe(2, "b", "f1", 2), probe(3, "c", "f9", 3), probe(3, "c", "f9", 3), probe(4, "a", "f2", 4), probe(5, "a", "f0", 0),
    probe(6, "b", None, 9, "timeout"), probe(7, "d", "f1", 5, "error"), probe(8, None, "f1", 5),
]
LOG = [("b", "f1", "git", "2025-01-01T02:00:00+02:00", 1), ("c", "f1", "git", "2025-01-01T01:00:00Z", 1), ("c", "f9", "git", "2025-01-01T02:30:00+02:00", 1), ("b", "f0", "git", "2024-12-31T23:00:00Z", 1)]


def frames(spark, rows=ROWS, log=LOG):
    return spark.createDataFrame(rows, PROBES), spark.createDataFrame(log, STATE)


def names(capture):
    return sorted(r["full_name"] for r in capture.changes().collect())


def test_state_is_the_latest_instant(spark):
    got = {r["full_name"]: r["state_fingerprint"] for r in repo_state(frames(spark)[1]).collect()}
    assert got == {"b": "f1", "c": "f1"}


def test_latest_is_by_time_not_by_arrival(spark):
    assert {r["full_name"]: r["fingerprint"] for r in latest_usable(frames(spark)[0]).collect()} == {"a": "f2", "b": "f1", "c": "f9"}


def test_what_is_due(spark):
    capture = ChangeCapture(spark, fresh_dir(spark, "t"), 3)
    capture.run(*frames(spark))
    assert names(capture) == ["a", "c"]


@pytest.mark.parametrize("step", ["plan", "latest", "sink"])
def test_a_failed_run_neither_skips_nor_repeats(spark, step):
    capture = ChangeCapture(spark, fresh_dir(spark, "t"), 3)
    probes, log = frames(spark)
    with pytest.raises(StopHere):
        capture.run(probes, log, stop_after=step)
    assert names(capture) == []
    more = frames(spark, ROWS + [probe(9, "e", "f1", 10), probe(10, "a", "f3", 11)])[0]
    assert capture.run(more, log) == 0  # replays the plan: what came later waits
    assert names(capture) == ["a", "c"]
    assert capture.run(more, log) == 1
    given = [(r["full_name"], r["offset"]) for r in capture.changes().collect()]
    assert sorted(given) == [("a", 4), ("a", 10), ("c", 3), ("e", 9)]
    assert capture.run(more, log) == 2
    assert len(capture.changes().collect()) == 4


def test_late_probe_changes_nothing(spark):
    capture = ChangeCapture(spark, fresh_dir(spark, "t"), 3)
    probes, log = frames(spark)
    capture.run(probes, log)
    capture.run(frames(spark, ROWS + [probe(11, "a", "f1", 1)])[0], log)
    assert names(capture) == ["a", "c"]


def test_empty(spark):
    capture = ChangeCapture(spark, fresh_dir(spark, "t"), 2)
    capture.run(*frames(spark, [], []))
    assert names(capture) == []


def test_a_run_reads_only_what_is_new(spark):
    root = fresh_dir(spark, "t")
    spark.createDataFrame([probe(i, f"r{i % 50}", f"f{i}", i % 60) for i in range(1, 201)], PROBES).repartitionByRange(4, "probe_id").write.parquet(f"{root}/log")
    capture = ChangeCapture(spark, f"{root}/runs", 8)
    log, state = spark.read.parquet(f"{root}/log"), spark.createDataFrame(LOG, STATE)
    capture.run(log, state)
    spark.createDataFrame([probe(301, "r1", "g", 59), probe(302, "new", "g", 59)], PROBES).coalesce(1).write.mode("append").parquet(f"{root}/log")
    log = spark.read.parquet(f"{root}/log")
    assert capture.run(log, state) == 1
    plan = capture.records(log, 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(probe_id,1" in plan and "LessThanOrEqual(probe_id,302)" in plan
    assert capture.records(log, 1).count() == 2
    files = capture._files()
    assert len(files.names(f"{root}/runs/latest/1")) <= 2 and len(files.names(f"{root}/runs/latest/0")) == 8  # only the partitions touched
    assert sorted((r["full_name"], r["offset"]) for r in capture.changes(after=0).collect()) == [("new", 302), ("r1", 301)]


def test_of_two_runs_at_once_one_fails(spark):
    capture = ChangeCapture(spark, fresh_dir(spark, "t"), 2)
    probes, log = frames(spark)
    with pytest.raises(StopHere):
        capture.run(probes, log, stop_after="sink")
    other = ChangeCapture(spark, capture.root, 2)
    other.run(probes, log)
    with pytest.raises(FileExistsError):
        capture._files().write_new(f"{capture.root}/commits/0", "{}")
    assert names(capture) == ["a", "c"]
