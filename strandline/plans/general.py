"""Queries of the general problems: sessions (p5) and processing only changes (p6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.increments import ChangeCapture, StopHere
from strandline.operators.sessions import cut_many, cut_sessions, gap_tree
from strandline.plans.registry import Registry
from strandline.session import fresh_dir, table

R = Registry()
SESSION_GAP_MS = 1_800_000

_SESSIONS = """
WITH e AS (SELECT DISTINCT "user", ts, id FROM search_events WHERE ts IS NOT NULL),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY "user" ORDER BY ts, id) <= {gap} THEN 0 ELSE 1 END AS first FROM e),
s AS (SELECT *, sum(first) OVER (PARTITION BY "user" ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT "user", min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration_ms, count(*) AS n_events FROM s GROUP BY "user", no
"""


@R.query("p5_found", f"SELECT \"user\", start_ts FROM ({_SESSIONS.format(gap=SESSION_GAP_MS)})")
def p5_found(spark, sf_dir):
    return cut_sessions(gap_tree(table(spark, sf_dir, "search_events")), SESSION_GAP_MS).select("user", "start_ts")


@R.query("p5_sessions", _SESSIONS.format(gap=SESSION_GAP_MS))
def p5_sessions(spark, sf_dir):
    return cut_sessions(gap_tree(table(spark, sf_dir, "search_events")), SESSION_GAP_MS)


@R.query("p5_sessions_5min", _SESSIONS.format(gap=300_000))
def p5_sessions_5min(spark, sf_dir):
    return cut_sessions(gap_tree(table(spark, sf_dir, "search_events")), 300_000)


_SETTINGS = (60_000, 300_000, 1_800_000, 7_200_000)


@R.query("p5_settings", " UNION ALL ".join(f"SELECT {g}::BIGINT AS gap_ms, count(*) AS sessions, sum(n_events)::BIGINT AS events, max(duration_ms) AS longest FROM ({_SESSIONS.format(gap=g)})" for g in _SETTINGS))
def p5_settings(spark, sf_dir):
    """One tree, cut at several settings."""
    cut = cut_many(gap_tree(table(spark, sf_dir, "search_events")), list(_SETTINGS))
    return cut.groupBy("gap_ms").agg(F.count("*").alias("sessions"), F.sum("n_events").alias("events"), F.max("duration_ms").alias("longest"))


_DUE = """
WITH p AS (SELECT full_name, arg_max(fingerprint, (probed_at, probe_id)) AS fingerprint, arg_max(kind, (probed_at, probe_id)) AS kind,
                  arg_max(probe_id, (probed_at, probe_id)) AS "offset"
           FROM repo_probes WHERE outcome = 'ok' AND fingerprint IS NOT NULL GROUP BY full_name),
f AS (SELECT full_name, arg_max(fingerprint, last_indexed_at::TIMESTAMPTZ) AS state FROM repo_fingerprints GROUP BY full_name)
SELECT p.* FROM p LEFT JOIN f USING (full_name) WHERE f.full_name IS NULL OR p.fingerprint IS DISTINCT FROM f.state
"""


def _changes(spark, sf_dir):
    capture = ChangeCapture(spark, fresh_dir(spark, "changes"))
    capture.run(table(spark, sf_dir, "repo_probes"), table(spark, sf_dir, "repo_fingerprints"))
    return capture.changes()


@R.query("p6_found", f"SELECT full_name FROM ({_DUE})")
def p6_found(spark, sf_dir):
    return _changes(spark, sf_dir).select("full_name")


@R.query("p6_changes", f'SELECT full_name, fingerprint, kind, "offset" FROM ({_DUE})')
def p6_changes(spark, sf_dir):
    return _changes(spark, sf_dir).select("full_name", "fingerprint", "kind", "offset")


@R.query(
    "p6_batches",
    """
WITH m AS (SELECT max(probe_id) AS most FROM repo_probes),
p AS (SELECT *, CASE WHEN probe_id * 3 <= most THEN 0 WHEN probe_id * 3 <= most * 2 THEN 1 ELSE 2 END AS b FROM repo_probes, m
      WHERE outcome = 'ok' AND fingerprint IS NOT NULL AND probe_id IS NOT NULL AND probed_at IS NOT NULL AND full_name IS NOT NULL),
k AS (SELECT DISTINCT full_name, b FROM p),
n AS (SELECT k.full_name, k.b, max(probed_at) AS newest FROM k JOIN p ON p.full_name = k.full_name AND p.b <= k.b GROUP BY ALL),
l AS (SELECT n.full_name, n.b, max(probe_id) AS "offset" FROM n JOIN p ON p.full_name = n.full_name AND p.b <= n.b AND probed_at = newest GROUP BY ALL),
f AS (SELECT full_name, arg_max(fingerprint, last_indexed_at::TIMESTAMPTZ) AS state FROM repo_fingerprints GROUP BY full_name)
SELECT l.full_name, "offset", min(l.b)::BIGINT AS batch FROM l JOIN (SELECT DISTINCT probe_id, fingerprint FROM p) q ON q.probe_id = "offset" LEFT JOIN f ON f.full_name = l.full_name
WHERE f.full_name IS NULL OR q.fingerprint IS DISTINCT FROM f.state GROUP BY ALL
""",
)
def p6_batches(spark, sf_dir):
    """The log as it grows by thirds, a run after each, the second of which fails at first after its snapshot and is repeated."""
    probes, state = table(spark, sf_dir, "repo_probes"), table(spark, sf_dir, "repo_fingerprints")
    most = probes.agg(F.max("probe_id")).first()[0]
    capture = ChangeCapture(spark, fresh_dir(spark, "changes"))
    for third in (1, 2, 3):
        log = probes.where(F.col("probe_id") * 3 <= most * third)
        if third == 2:
            try:
                capture.run(log, state, stop_after="latest")
            except StopHere:
                log = probes  # what came since has to wait
        capture.run(log, state)
    return capture.changes().select("full_name", "offset", "batch")
