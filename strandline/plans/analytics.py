"""Queries of the usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.operators import analytics as A
from strandline.plans.registry import Registry
from strandline.views import oracle, view

R = Registry()
SINCE, UNTIL = 1_735_000_000_000, 1_739_000_000_000
DAY, QUARTER = 86_400_000, 21_600_000


def _inputs(spark, sf_dir):
    return (view(spark, sf_dir, "searches"), view(spark, sf_dir, "search_results"), view(spark, sf_dir, "fetches"))


_RATE = "coalesce(CASE r.language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TOKENS_PER_LINE.items()) + " END, 4.0)"


@R.query(
    "token_savings_report",
    oracle(f"""
    WITH e AS (SELECT s.id, sum(r.chunk_lines * {_RATE}) AS found, sum(coalesce(r.file_total_lines, r.chunk_lines * 5) * {_RATE}) AS whole, sum(CASE WHEN f.id IS NULL THEN 0 ELSE r.chunk_lines * {_RATE} END) AS used
        FROM searches s JOIN search_results r ON r.search_id = s.id LEFT JOIN fetches f ON f.preceding_search_id = s.id AND f.chunk_id = r.chunk_id GROUP BY s.id)
    SELECT count(*) AS searches, round(sum(whole), 3)::DOUBLE AS naive_baseline, round(sum(found), 3)::DOUBLE AS search_only, round(sum(used), 3)::DOUBLE AS actually_consumed,
           round(1.0 - sum(found) / sum(whole), 6) AS savings_vs_naive, round(1.0 - sum(used) / sum(whole), 6) AS savings_realized FROM e"""),
)
def token_savings_report(spark, sf_dir):
    return A.token_savings(*_inputs(spark, sf_dir))


@R.query(
    "top_queries",
    oracle("SELECT query_hash, max(query_text) AS example, count(*) AS count, round(avg(duration_ms)) AS avg_duration_ms, round(avg(result_count)) AS result_count_avg FROM searches GROUP BY query_hash ORDER BY count DESC, query_hash LIMIT 20"),
)
def top_queries(spark, sf_dir):
    return A.top_queries(view(spark, sf_dir, "searches"))


@R.query("slowest_searches", oracle("SELECT id, ts, {q}user{q}, group_name, query_text AS query_example, duration_ms, result_count FROM searches ORDER BY duration_ms DESC, id LIMIT 20"))
def slowest_searches(spark, sf_dir):
    return A.slowest_searches(view(spark, sf_dir, "searches"))


@R.query("failed_searches", oracle("SELECT id, ts, {q}user{q}, group_name, query_text AS query_example, error FROM searches WHERE error IS NOT NULL ORDER BY ts DESC, id LIMIT 50"))
def failed_searches(spark, sf_dir):
    return A.failed_searches(view(spark, sf_dir, "searches"))


_OFF = "off_anchor AS (SELECT r.search_id, count(*) AS cnt FROM search_results r JOIN searches e ON e.id = r.search_id WHERE r.project <> e.anchor_project GROUP BY r.search_id)"


@R.query(
    "cross_project_share",
    oracle(f"""WITH {_OFF} SELECT s.{{q}}user{{q}}, s.anchor_project, count(*) AS searches, round(avg(o.cnt * 1.0 / nullif(s.result_count, 0)), 6) AS share
    FROM searches s LEFT JOIN off_anchor o ON o.search_id = s.id WHERE s.anchor_project IS NOT NULL GROUP BY s.{{q}}user{{q}}, s.anchor_project"""),
)
def cross_project_share(spark, sf_dir):
    s, r, _ = _inputs(spark, sf_dir)
    return A.cross_project_share(s, r)


_BY_ANCHOR = f"""WITH {_OFF}, used AS (SELECT f.preceding_search_id AS search_id, count(*) AS cnt FROM fetches f JOIN search_results r ON r.search_id = f.preceding_search_id AND r.chunk_id = f.chunk_id
        JOIN searches e ON e.id = f.preceding_search_id WHERE r.project <> e.anchor_project GROUP BY 1)
    SELECT s.anchor_project, count(*) AS searches, round(coalesce(avg(coalesce(o.cnt, 0) * 1.0 / nullif(s.result_count, 0)), 0), 6) AS off_anchor_share, coalesce(sum(u.cnt), 0)::BIGINT AS off_anchor_fetches
    FROM searches s LEFT JOIN off_anchor o ON o.search_id = s.id LEFT JOIN used u ON u.search_id = s.id WHERE s.anchor_project IS NOT NULL
    GROUP BY s.anchor_project ORDER BY searches DESC, s.anchor_project LIMIT 20"""


@R.query("cross_project_by_anchor", oracle(_BY_ANCHOR))
def cross_project_by_anchor(spark, sf_dir):
    return A.cross_project_by_anchor(*_inputs(spark, sf_dir))


@R.query("cross_project_weighted", oracle(f"WITH {_BY_ANCHOR[5:].replace(') SELECT s.anchor_project', '), z AS (SELECT s.anchor_project').replace(chr(10) + '    SELECT s.anchor_project', ', z AS (SELECT s.anchor_project')}) SELECT round(sum(off_anchor_share * searches) / sum(searches), 5) AS share FROM z"))
def cross_project_weighted(spark, sf_dir):
    return A.weighted_share(A.cross_project_by_anchor(*_inputs(spark, sf_dir)))


@R.query(
    "cross_project_pairs",
    oracle("""SELECT e.anchor_project, r.project AS result_project, count(*) AS results_count, count(f.id) AS fetches FROM searches e JOIN search_results r ON r.search_id = e.id
    LEFT JOIN fetches f ON f.preceding_search_id = e.id AND f.chunk_id = r.chunk_id WHERE r.project <> e.anchor_project GROUP BY 1, 2 ORDER BY results_count DESC, 1, 2 LIMIT 20"""),
)
def cross_project_pairs(spark, sf_dir):
    return A.cross_project_pairs(*_inputs(spark, sf_dir))


def _retry(window: int) -> str:
    return oracle(f"""
    WITH pairs AS (SELECT a.id, a.{{q}}user{{q}} AS usr, a.query_tokens AS t1, b.query_tokens AS t2 FROM searches a JOIN searches b
        ON a.{{q}}user{{q}} = b.{{q}}user{{q}} AND a.session IS NOT DISTINCT FROM b.session AND b.ts > a.ts AND b.ts - a.ts <= {window}
        AND NOT EXISTS (SELECT 1 FROM fetches f WHERE f.preceding_search_id = a.id AND f.ts < b.ts)),
    again AS (SELECT usr, count(DISTINCT id) AS n FROM pairs WHERE CASE WHEN t1 = t2 THEN 1.0 ELSE len(list_intersect(t1::JSON::VARCHAR[], t2::JSON::VARCHAR[])) * 1.0
        / nullif(len(list_distinct(list_concat(t1::JSON::VARCHAR[], t2::JSON::VARCHAR[]))), 0) END >= {fixed.REFORMULATION_JACCARD} GROUP BY usr)
    SELECT s.{{q}}user{{q}}, count(*) AS total_searches, coalesce(any_value(n), 0) AS reformulations, round(coalesce(any_value(n), 0) * 1.0 / count(*), 6) AS rate
    FROM searches s LEFT JOIN again ON usr = s.{{q}}user{{q}} GROUP BY s.{{q}}user{{q}}""")


@R.query("retry_rate", _retry(fixed.REFORMULATION_MS))
def retry_rate(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.retry_rate(s, f)


@R.query("retry_rate_10min", _retry(600_000))
def retry_rate_10min(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.retry_rate(s, f, 600_000)


@R.query("failed_chunks", oracle("SELECT error_class, language, count(*) AS count, max(file) AS example_file FROM chunking_errors GROUP BY 1, 2"))
def failed_chunks(spark, sf_dir):
    return A.failed_chunks(view(spark, sf_dir, "chunking_errors"))


_ZERO = "SELECT s.query_hash, count(*) AS searches, round(avg(CASE WHEN f.id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM searches s LEFT JOIN (SELECT DISTINCT preceding_search_id AS id FROM fetches) f ON f.id = s.id GROUP BY s.query_hash"


@R.query("zero_click_rate", oracle(_ZERO))
def zero_click_rate(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.zero_click(s, f)


@R.query(
    "top_queries_zero_click",
    oracle(f"SELECT t.query_hash, t.example, t.count, coalesce(z.rate, 0) AS zero_click_rate FROM (SELECT query_hash, max(query_text) AS example, count(*) AS count FROM searches GROUP BY query_hash ORDER BY count DESC, query_hash LIMIT 20) t LEFT JOIN ({_ZERO}) z USING (query_hash)"),
)
def top_queries_zero_click(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.top_queries_with_zero_click(s, f)


@R.query(
    "user_activity",
    oracle("""
    WITH f AS (SELECT s.{q}user{q} AS usr, count(*) AS n FROM fetches c JOIN searches s ON s.id = c.preceding_search_id GROUP BY 1),
    a AS (SELECT {q}user{q} AS usr, anchor_project, row_number() OVER (PARTITION BY {q}user{q} ORDER BY count(*) DESC, anchor_project) AS rn FROM searches WHERE anchor_project IS NOT NULL GROUP BY 1, 2)
    SELECT s.{q}user{q}, count(*) AS searches, coalesce(any_value(f.n), 0) AS fetches, max(s.ts) AS last_active_ts, any_value(a.anchor_project) AS top_anchor_project, count(DISTINCT s.session) AS sessions
    FROM searches s LEFT JOIN f ON f.usr = s.{q}user{q} LEFT JOIN a ON a.usr = s.{q}user{q} AND a.rn = 1 GROUP BY s.{q}user{q} ORDER BY searches DESC, s.{q}user{q} LIMIT 50"""),
)
def user_activity(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.user_activity(s, f)


def _over_time(width: int, since: int, until: int) -> str:
    return oracle(f"""
    WITH c AS (SELECT unnest(range({since // width * width}, {until // width * width + 1}, {width})) AS bucket),
    s AS (SELECT ts // {width} * {width} AS bucket, count(*) AS n, count(error) AS errors FROM searches WHERE ts BETWEEN {since} AND {until} GROUP BY 1),
    f AS (SELECT ts // {width} * {width} AS bucket, count(*) AS n FROM fetches WHERE ts BETWEEN {since} AND {until} GROUP BY 1)
    SELECT c.bucket, coalesce(s.n, 0) AS searches, coalesce(f.n, 0) AS fetches, coalesce(s.errors, 0) AS errors FROM c LEFT JOIN s USING (bucket) LEFT JOIN f USING (bucket)""")


@R.query("searches_over_time", _over_time(DAY, SINCE, UNTIL))
def searches_over_time(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.over_time(s, f, SINCE, UNTIL, DAY)


@R.query("searches_over_week", _over_time(QUARTER, 1_736_000_000_000, 1_736_604_800_000))
def searches_over_week(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.over_time(s, f, 1_736_000_000_000, 1_736_604_800_000, QUARTER)


@R.query(
    "embedding_health",
    oracle("""
    WITH o AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM embedding_calls)
    SELECT (SELECT count(*) FROM embedding_calls) AS total, (SELECT sum(cache_hits)::BIGINT FROM embedding_calls) AS cache_hits, (SELECT sum(cache_miss)::BIGINT FROM embedding_calls) AS cache_misses,
           (SELECT count(error) FROM embedding_calls) AS errors, (SELECT sum(timeout)::BIGINT FROM embedding_calls) AS timeouts,
           max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN duration_ms END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN duration_ms END) AS p95,
           max(CASE WHEN i = least(n - 1, floor(n * 0.99)) THEN duration_ms END) AS p99 FROM o"""),
)
def embedding_health(spark, sf_dir):
    return A.embedding_health(view(spark, sf_dir, "embedding_calls"))


@R.query(
    "tool_durations",
    oracle("""WITH o AS (SELECT tool, duration_ms, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM tool_calls)
    SELECT tool, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN duration_ms END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN duration_ms END) AS p95 FROM o GROUP BY tool"""),
)
def tool_durations(spark, sf_dir):
    return A.nearest_rank(view(spark, sf_dir, "tool_calls"), "duration_ms", {"p50": 0.5, "p95": 0.95}, ["tool"])


@R.query("overview_counts", oracle("SELECT (SELECT count(*) FROM searches) AS searches, (SELECT count(*) FROM fetches) AS fetches, (SELECT count(DISTINCT {q}user{q}) FROM searches) AS users, round((SELECT count(*) FROM fetches) / (SELECT count(*) FROM searches), 6) AS fetch_rate"))
def overview_counts(spark, sf_dir):
    s, _, f = _inputs(spark, sf_dir)
    return A.overview(s, f)


@R.query("likely_anchored", oracle("SELECT bool_or(anchor_project IS NOT NULL) AS anchored, count(anchor_project) AS n_anchored FROM searches"))
def likely_anchored(spark, sf_dir):
    return A.likely_anchored(view(spark, sf_dir, "searches"))


@R.query(
    "preceding_search",
    oracle("""SELECT DISTINCT f.id, (SELECT max((s.ts, s.id)) FROM searches s JOIN search_results r ON r.search_id = s.id WHERE s.{q}user{q} = f.{q}user{q} AND s.session IS NOT DISTINCT FROM f.session
        AND r.chunk_id = f.chunk_id AND s.ts <= f.ts)[2] AS preceding_search_id FROM fetches f"""),
)
def preceding_search(spark, sf_dir):
    s, r, f = _inputs(spark, sf_dir)
    return A.preceding_search(f.dropDuplicates(["id"]), s, r)


_RESPONSES = """
    WITH l AS (SELECT chunk_id, max(length(content)) AS n_chars FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
    x AS (SELECT search_id, file, sum(ceil(coalesce(n_chars, 0) / 4)) AS got, max(end_line) AS lines FROM search_results LEFT JOIN l USING (chunk_id) GROUP BY search_id, file),
    y AS (SELECT search_id, sum(got)::BIGINT AS tokens_returned, sum(ceil(lines * 50 / 4))::BIGINT AS full_file_tokens FROM x GROUP BY search_id),
    z AS (SELECT *, greatest(0, full_file_tokens - tokens_returned) AS tokens_saved FROM y)
"""


def _responses(spark, sf_dir):
    sizes = view(spark, sf_dir, "chunks").where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(F.length("content")).alias("n_chars"))
    return A.response_metrics(view(spark, sf_dir, "search_results").join(sizes, "chunk_id", "left"))


@R.query("response_metrics", oracle(_RESPONSES + "SELECT *, CASE WHEN full_file_tokens > 0 THEN round(tokens_saved * 100.0 / full_file_tokens) ELSE 0 END::BIGINT AS savings_percent FROM z"))
def response_metrics(spark, sf_dir):
    return _responses(spark, sf_dir)


@R.query("usage_counters", oracle(_RESPONSES + "SELECT count(*) AS search_count, sum(tokens_saved)::BIGINT AS total_tokens_saved, round(sum(tokens_saved) / count(*))::BIGINT AS avg_tokens_saved FROM z"))
def usage_counters(spark, sf_dir):
    return A.usage_counters(_responses(spark, sf_dir))


EDGES = [10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]


@R.query("duration_histogram", oracle("SELECT tool, " + ", ".join(f"count(*) FILTER (duration_ms <= {e}) AS le_{e}" for e in EDGES) + ", round(sum(duration_ms), 3)::BIGINT AS sum, count(duration_ms) AS count FROM tool_calls GROUP BY tool"))
def duration_histogram(spark, sf_dir):
    return A.histogram(view(spark, sf_dir, "tool_calls"), "duration_ms", EDGES, ["tool"])


@R.query("metric_counters", oracle("SELECT tool, count(*) AS calls, count(error) AS errors, count(*) FILTER (ok = 1) AS succeeded FROM tool_calls GROUP BY tool"))
def metric_counters(spark, sf_dir):
    return view(spark, sf_dir, "tool_calls").groupBy("tool").agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.count_if(F.col("ok") == 1).alias("succeeded"))


CUTOFF = 1_737_000_000_000


@R.query(
    "retention_prune",
    oracle(f"""SELECT 'searches' AS name, count(*) AS kept FROM searches WHERE ts >= {CUTOFF} UNION ALL SELECT 'fetches', count(*) FROM fetches WHERE ts >= {CUTOFF}
    UNION ALL SELECT 'results', count(*) FROM search_results r WHERE EXISTS (SELECT 1 FROM searches s WHERE s.id = r.search_id AND s.ts >= {CUTOFF})"""),
)
def retention_prune(spark, sf_dir):
    s, r, f = _inputs(spark, sf_dir)
    kept = A.prune({"searches": s, "results": r, "fetches": f}, CUTOFF)
    one = lambda n: kept[n].agg(F.count("*").alias("kept")).select(F.lit(n).alias("name"), "kept")
    return one("searches").unionByName(one("fetches")).unionByName(one("results"))


@R.query("period_filter", oracle("SELECT id, ts, {q}user{q} FROM searches WHERE ts BETWEEN 1736000000000 AND 1736604800000 AND group_name = 'atlas'"))
def period_filter(spark, sf_dir):
    return A.in_period(view(spark, sf_dir, "searches"), 1_736_000_000_000, 1_736_604_800_000, group="atlas").select("id", "ts", "user")


@R.query("cache_gauges", "SELECT tool, arg_max(result_count, (ts, result_count)) AS value, max(ts) AS \"at\" FROM search_events WHERE ts IS NOT NULL AND result_count IS NOT NULL GROUP BY 1")
def cache_gauges(spark, sf_dir):
    return A.gauges(view(spark, sf_dir, "search_events"), "ts", "result_count", ["tool"])


@R.query("search_rates", "SELECT tool, ts // 3600000 * 3600000 AS start_ms, round(count(*) / 3600.0, 6) AS per_second FROM search_events WHERE ts IS NOT NULL GROUP BY 1, 2")
def search_rates(spark, sf_dir):
    return A.rates(view(spark, sf_dir, "search_events"), "ts", 3_600_000, ["tool"])


_EDGES = (10, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


@R.query(
    "duration_quantile",
    f"""WITH c AS (SELECT tool, count(*) AS n, {", ".join(f"count(*) FILTER (duration_ms <= {e}) AS c{i}" for i, e in enumerate(_EDGES, 1))} FROM search_events WHERE duration_ms IS NOT NULL GROUP BY 1)
    SELECT tool, round(CASE {" ".join(f"WHEN c{i} >= 0.95 * n THEN {([0, *_EDGES])[i - 1]} + ({e} - {([0, *_EDGES])[i - 1]}) * (0.95 * n - {f'c{i - 1}' if i > 1 else '0'}) / (c{i} - {f'c{i - 1}' if i > 1 else '0'})" for i, e in enumerate(_EDGES, 1))} ELSE {_EDGES[-1]} END, 6)::DOUBLE AS quantile FROM c""",
)
def duration_quantile(spark, sf_dir):
    return A.histogram_quantile(view(spark, sf_dir, "search_events"), "duration_ms", list(_EDGES), 0.95, ["tool"])
