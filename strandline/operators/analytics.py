"""Reports on how search is used. Inputs are tables of searches, results and fetches by their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions.vectors import bucket, jaccard


def in_period(df: DataFrame, since: int, until: int, user: str | None = None, group: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows between both ends, inclusive, of a user and a group if given."""
    df = df.where(F.col(ts).between(since, until))
    if user is not None:
        df = df.where(F.col("user") == user)
    return df if group is None else df.where(F.col("group_name") == group)


def tokens_per_line(language) -> F.Column:
    """The language's tokens a line; those of 'generic' for any other."""
    known = F.create_map(*(F.lit(x) for kv in fixed.TOKENS_PER_LINE.items() for x in kv))
    return F.coalesce(known[language], F.lit(fixed.TOKENS_PER_LINE["generic"]))


def opened(results: DataFrame, fetches: DataFrame) -> DataFrame:
    """Results with fetch_id of their fetches: one row for each fetch, one with null where there is none."""
    f = fetches.select(F.col("id").alias("fetch_id"), F.col("preceding_search_id").alias("search_id"), "chunk_id")
    return results.join(f, ["search_id", "chunk_id"], "left")


def token_savings(searches: DataFrame, results: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row: searches with results, tokens of whole files, of all results, of opened results, and the two savings.

    A result fetched twice counts twice; searches without results don't count.
    """
    rate = tokens_per_line(F.col("language"))
    part = F.col("chunk_lines") * rate
    rows = opened(results, fetches).join(searches.select(F.col("id").alias("search_id")), "search_id")
    each = rows.groupBy("search_id").agg(
        F.sum(part).alias("found"), F.sum(F.coalesce("file_total_lines", F.col("chunk_lines") * 5) * rate).alias("whole"), F.sum(F.when(F.col("fetch_id").isNotNull(), part).otherwise(0.0)).alias("used")
    )
    whole = F.sum("whole")
    saved = lambda c: F.round(F.when(whole > 0, 1.0 - F.sum(c) / whole), 6)
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 3)
    return each.agg(
        F.count("*").alias("searches"), total("whole").alias("naive_baseline"), total("found").alias("search_only"), total("used").alias("actually_consumed"),
        saved("found").alias("savings_vs_naive"), saved("used").alias("savings_realized"),
    )


def top_queries(searches: DataFrame, limit: int = 20) -> DataFrame:
    return (
        searches.groupBy("query_hash")
        .agg(F.max("query_text").alias("example"), F.count("*").alias("count"), F.round(F.avg("duration_ms")).alias("avg_duration_ms"), F.round(F.avg("result_count")).alias("result_count_avg"))
        .orderBy(F.col("count").desc(), "query_hash")
        .limit(limit)
    )


def slowest_searches(searches: DataFrame, limit: int = 20) -> DataFrame:
    return searches.select("id", "ts", "user", "group_name", F.col("query_text").alias("query_example"), "duration_ms", "result_count").orderBy(F.col("duration_ms").desc(), "id").limit(limit)


def failed_searches(searches: DataFrame, limit: int = 50) -> DataFrame:
    return searches.where(F.col("error").isNotNull()).select("id", "ts", "user", "group_name", F.col("query_text").alias("query_example"), "error").orderBy(F.col("ts").desc(), "id").limit(limit)


def off_anchor(searches: DataFrame, results: DataFrame) -> DataFrame:
    """Results of another project than their search's anchor, with the anchor."""
    anchors = searches.where(F.col("anchor_project").isNotNull()).select(F.col("id").alias("search_id"), "anchor_project")
    return results.join(anchors, "search_id").where(F.col("project") != F.col("anchor_project"))


def cross_project_share(searches: DataFrame, results: DataFrame) -> DataFrame:
    """By user and anchor: searches and the mean share of other projects, over searches that have such results."""
    off = off_anchor(searches, results).groupBy(F.col("search_id").alias("id")).agg(F.count("*").alias("off"))
    share = F.try_divide(F.col("off").cast("double"), F.col("result_count").cast("double"))
    rows = searches.where(F.col("anchor_project").isNotNull()).join(off, "id", "left")
    return rows.groupBy("user", "anchor_project").agg(F.count("*").alias("searches"), F.round(F.avg(share), 6).alias("share"))


def cross_project_by_anchor(searches: DataFrame, results: DataFrame, fetches: DataFrame, limit: int = 20) -> DataFrame:
    """By anchor: searches, mean share of other projects (0 where there are none), and fetches of such results."""
    away = off_anchor(searches, results)
    off = away.groupBy(F.col("search_id").alias("id")).agg(F.count("*").alias("off"))
    used = fetches.select(F.col("preceding_search_id").alias("search_id"), "chunk_id").join(away, ["search_id", "chunk_id"]).groupBy(F.col("search_id").alias("id")).agg(F.count("*").alias("used"))
    share = F.try_divide(F.coalesce("off", F.lit(0)).cast("double"), F.col("result_count").cast("double"))
    rows = searches.where(F.col("anchor_project").isNotNull()).join(off, "id", "left").join(used, "id", "left")
    out = rows.groupBy("anchor_project").agg(F.count("*").alias("searches"), F.round(F.coalesce(F.avg(share), F.lit(0.0)), 6).alias("off_anchor_share"), F.coalesce(F.sum("used"), F.lit(0)).alias("off_anchor_fetches"))
    return out.orderBy(F.col("searches").desc(), "anchor_project").limit(limit)


def cross_project_pairs(searches: DataFrame, results: DataFrame, fetches: DataFrame, limit: int = 20) -> DataFrame:
    """From anchor to the other projects that its searches found: results and fetches of them."""
    rows = opened(off_anchor(searches, results), fetches)
    out = rows.groupBy("anchor_project", F.col("project").alias("result_project")).agg(F.count("*").alias("results_count"), F.count("fetch_id").alias("fetches"))
    return out.orderBy(F.col("results_count").desc(), "anchor_project", "result_project").limit(limit)


def reformulation_pairs(searches: DataFrame, fetches: DataFrame, window_ms: int = fixed.REFORMULATION_MS) -> DataFrame:
    """Searches of a user and session (no session being one, too) that follow one another within the window without a fetch of the first in between.

    The interval join meets rows of the same or the next bucket of the window's width, so a busy user's
    rows meet only those near in time.
    """
    first = fetches.groupBy(F.col("preceding_search_id").alias("a_id")).agg(F.min("ts").alias("first_fetch"))
    base = searches.select("id", "ts", "user", F.coalesce("session", F.lit("\x00")).alias("session"), "query_tokens", F.floor(F.col("ts") / window_ms).alias("slot"))
    a = base.select(F.col("id").alias("a_id"), F.col("ts").alias("a_ts"), "user", "session", F.col("query_tokens").alias("a_tokens"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    b = base.select(F.col("id").alias("b_id"), F.col("ts").alias("b_ts"), "user", "session", F.col("query_tokens").alias("b_tokens"), "slot")
    pairs = a.join(b, ["user", "session", "slot"]).where((F.col("b_ts") > F.col("a_ts")) & (F.col("b_ts") - F.col("a_ts") <= window_ms))
    return pairs.join(first, "a_id", "left").where(F.col("first_fetch").isNull() | (F.col("first_fetch") >= F.col("b_ts"))).select("user", "a_id", "b_id", "a_tokens", "b_tokens")


def retry_rate(searches: DataFrame, fetches: DataFrame, window_ms: int = fixed.REFORMULATION_MS) -> DataFrame:
    """By user: searches, those asked again in similar words, and their rate."""
    parsed = lambda c: F.from_json(c, "array<string>")
    alike = F.when(F.col("a_tokens") == F.col("b_tokens"), 1.0).otherwise(jaccard(parsed(F.col("a_tokens")), parsed(F.col("b_tokens"))))
    again = reformulation_pairs(searches, fetches, window_ms).where(alike >= fixed.REFORMULATION_JACCARD).groupBy("user").agg(F.countDistinct("a_id").alias("n"))
    totals = searches.groupBy("user").agg(F.count("*").alias("total_searches")).join(again, "user", "left")
    n = F.coalesce("n", F.lit(0))
    return totals.select("user", "total_searches", n.alias("reformulations"), F.round(n / F.col("total_searches"), 6).alias("rate"))


def failed_chunks(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_class", "language").agg(F.count("*").alias("count"), F.max("file").alias("example_file"))


def zero_click(searches: DataFrame, fetches: DataFrame) -> DataFrame:
    """By query: searches and the share of those without any fetch."""
    used = fetches.where(F.col("preceding_search_id").isNotNull()).select(F.col("preceding_search_id").alias("id")).distinct().withColumn("used", F.lit(1))
    return searches.join(used, "id", "left").groupBy("query_hash").agg(F.count("*").alias("searches"), F.round(F.avg(F.when(F.col("used").isNull(), 1.0).otherwise(0.0)), 6).alias("rate"))


def top_queries_with_zero_click(searches: DataFrame, fetches: DataFrame, limit: int = 20) -> DataFrame:
    rates = zero_click(searches, fetches).select("query_hash", "rate")
    return top_queries(searches, limit).join(rates, "query_hash", "left").select("query_hash", "example", "count", F.coalesce("rate", F.lit(0.0)).alias("zero_click_rate"))


def user_activity(searches: DataFrame, fetches: DataFrame, limit: int = 50) -> DataFrame:
    """By user: searches, fetches, last activity, sessions (null is none) and the most frequent anchor."""
    done = fetches.select(F.col("preceding_search_id").alias("id")).join(searches.select("id", "user"), "id").groupBy("user").agg(F.count("*").alias("fetches"))
    anchors = searches.where(F.col("anchor_project").isNotNull()).groupBy("user", "anchor_project").agg(F.count("*").alias("n"))
    most = Window.partitionBy("user").orderBy(F.col("n").desc(), "anchor_project")
    top = anchors.withColumn("rn", F.row_number().over(most)).where("rn = 1").select("user", F.col("anchor_project").alias("top_anchor_project"))
    out = searches.groupBy("user").agg(F.count("*").alias("searches"), F.max("ts").alias("last_active_ts"), F.countDistinct("session").alias("sessions"))
    out = out.orderBy(F.col("searches").desc(), "user").limit(limit).join(done, "user", "left").join(top, "user", "left")
    return out.select("user", "searches", F.coalesce("fetches", F.lit(0)).alias("fetches"), "last_active_ts", "top_anchor_project", "sessions")


def over_time(searches: DataFrame, fetches: DataFrame, since: int, until: int, width: int) -> DataFrame:
    """Searches, fetches and errors of every bucket from since to until, empty ones too."""
    spark: SparkSession = searches.sparkSession
    first, last = since // width * width, until // width * width
    calendar = spark.range(first, last + 1, width).withColumnRenamed("id", "bucket")
    counted = in_period(searches, since, until).groupBy(bucket(F.col("ts"), width).alias("bucket")).agg(F.count("*").alias("searches"), F.count("error").alias("errors"))
    used = in_period(fetches, since, until).groupBy(bucket(F.col("ts"), width).alias("bucket")).agg(F.count("*").alias("fetches"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return calendar.join(counted, "bucket", "left").join(used, "bucket", "left").select("bucket", n("searches"), n("fetches"), n("errors"))


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Values at rank min(n - 1, floor(n * p)), counted from 0, of each group.

    Ranks come from counts of distinct values, so a task sorts a group's distinct values and not its rows.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ordered = Window.partitionBy(*by).orderBy("v") if by else Window.partitionBy(F.lit(0)).orderBy("v")
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("upto", F.sum("c").over(ordered)).withColumn("n", F.sum("c").over(every))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(name) for name, p in shares.items()))


def embedding_health(calls: DataFrame) -> DataFrame:
    """One row: calls, hits, misses, errors, timeouts and the durations' nearest-rank percentiles."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = calls.agg(F.count("*").alias("total"), zero(F.sum("cache_hits")).alias("cache_hits"), zero(F.sum("cache_miss")).alias("cache_misses"), F.count("error").alias("errors"), zero(F.sum("timeout")).alias("timeouts"))
    ranks = nearest_rank(calls, "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    both = totals.join(F.broadcast(ranks), F.lit(True), "left")  # one row each
    return both.select("total", "cache_hits", "cache_misses", "errors", "timeouts", *(zero(F.col(p)).alias(p) for p in ("p50", "p95", "p99")))


def overview(searches: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row: searches, users, fetches and fetches for each search."""
    rows = searches.select("user", F.lit(1).alias("s"), F.lit(0).alias("f")).unionByName(fetches.select("user", F.lit(0).alias("s"), F.lit(1).alias("f")))
    out = rows.agg(F.sum("s").alias("searches"), F.sum("f").alias("fetches"), F.countDistinct(F.when(F.col("s") == 1, F.col("user"))).alias("users"))
    return out.select(F.coalesce("searches", F.lit(0)).alias("searches"), F.coalesce("fetches", F.lit(0)).alias("fetches"), "users", F.round(F.try_divide(F.col("fetches"), F.col("searches")), 6).alias("fetch_rate"))


def likely_anchored(searches: DataFrame) -> DataFrame:
    """One row: whether any search has an anchor, and how many have."""
    return searches.agg(F.coalesce(F.bool_or(F.col("anchor_project").isNotNull()), F.lit(False)).alias("anchored"), F.count("anchor_project").alias("n_anchored"))


def weighted_share(by_anchor: DataFrame) -> DataFrame:
    """The mean of off_anchor_share, weighed by searches."""
    return by_anchor.agg(F.round(F.try_divide(F.sum(F.col("off_anchor_share") * F.col("searches")), F.sum("searches")), 5).alias("share"))


def preceding_search(fetches: DataFrame, searches: DataFrame, results: DataFrame) -> DataFrame:
    """For every fetch the latest search before it by the same user and session that returned its chunk.

    Columns: id, preceding_search_id (null if there is none). A backward as-of join: what both tables share
    are the user, session and chunk, so only their rows meet.
    """
    where = [F.col("user"), F.coalesce("session", F.lit("\x00")).alias("session"), F.col("chunk_id")]
    found = results.where(F.col("chunk_id").isNotNull()).select(F.col("search_id").alias("sid"), "chunk_id").distinct().join(searches.select(F.col("id").alias("sid"), "ts", "user", "session"), "sid")
    events = found.select(*where, F.col("ts"), F.lit(0).alias("side"), "sid", F.lit(None).cast("string").alias("id"))
    asked = fetches.select(*where, F.col("ts"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("sid"), "id")
    before = Window.partitionBy("user", "session", "chunk_id").orderBy("ts", "side", "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.unionByName(asked).withColumn("preceding_search_id", F.last("sid", ignorenulls=True).over(before)).where("side = 1").select("id", "preceding_search_id")


def response_metrics(results: DataFrame, key: str = "search_id") -> DataFrame:
    """Of each response: tokens returned, tokens of the whole files (50 characters a line up to the last line returned), tokens saved and their percentage."""
    files = results.groupBy(key, "file").agg(F.sum(F.ceil(F.coalesce("n_chars", F.lit(0)) / 4)).alias("got"), F.max("end_line").alias("lines"))
    out = files.groupBy(key).agg(F.sum("got").alias("tokens_returned"), F.sum(F.ceil(F.col("lines") * 50 / 4)).alias("full_file_tokens"))
    saved = F.greatest(F.lit(0), F.col("full_file_tokens") - F.col("tokens_returned"))
    return out.select(key, "tokens_returned", "full_file_tokens", saved.alias("tokens_saved"), F.coalesce(F.round(F.try_divide(saved * 100.0, F.col("full_file_tokens"))), F.lit(0.0)).cast("long").alias("savings_percent"))


def usage_counters(metrics: DataFrame) -> DataFrame:
    """One row: searches, tokens saved and their rounded mean."""
    n = F.greatest(F.count("*"), F.lit(1))
    return metrics.agg(F.count("*").alias("search_count"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("total_tokens_saved"), F.round(F.coalesce(F.sum("tokens_saved"), F.lit(0)) / n).cast("long").alias("avg_tokens_saved"))


def histogram(df: DataFrame, value: str, edges: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts of values up to each edge, their sum and count."""
    cells = [F.count_if(F.col(value) <= e).alias(f"le_{e:g}".replace(".", "_")) for e in edges]
    return df.groupBy(*(by or [])).agg(*cells, F.round(F.sum(value), 3).alias("sum"), F.count(value).alias("count"))


def gauges(df: DataFrame, at: str, value: str, by: list[str]) -> DataFrame:
    """The latest value of each series: by, value, at. Of values at one time the greatest."""
    last = F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))).alias("l")
    return df.where(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*by).agg(last).select(*by, "l.value", "l.at")


def rates(df: DataFrame, at: str, width_ms: int, by: list[str]) -> DataFrame:
    """Events a second in each bucket of time: by, start_ms, per_second."""
    return df.where(F.col(at).isNotNull()).groupBy(*by, (F.floor(F.col(at) / width_ms) * width_ms).cast("long").alias("start_ms")).agg(F.round(F.count("*") / (width_ms / 1000), 6).alias("per_second"))


def histogram_quantile(df: DataFrame, value: str, edges: list[float], q: float, by: list[str]) -> DataFrame:
    """A quantile as buckets tell it, evenly spread within the bucket it falls in; beyond the last edge, that edge: by, quantile."""
    counts = F.array(*(F.count_if(F.col(value) <= e) for e in edges))
    rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), counts.alias("c"))
    rank, lower = F.col("n") * F.lit(q), F.array(F.lit(0.0), *(F.lit(float(e)) for e in edges[:-1]))
    at = F.array_position(F.transform("c", lambda c: c >= rank), True).cast("int")
    upper, below = F.array(*(F.lit(float(e)) for e in edges)), F.when(at > 1, F.try_element_at("c", F.greatest(at - 1, F.lit(1)))).otherwise(F.lit(0))
    place = F.greatest(at, F.lit(1))
    inside = F.element_at(lower, place) + (F.element_at(upper, place) - F.element_at(lower, place)) * F.try_divide(rank - below, F.element_at("c", place) - below)
    return rows.select(*by, F.round(F.when(at == 0, F.lit(float(edges[-1]))).otherwise(F.coalesce(inside, F.lit(0.0))), 6).alias("quantile"))


def prune(tables: dict[str, DataFrame], cutoff: int) -> dict[str, DataFrame]:
    """Tables of events without rows before the cutoff; results stay with their searches."""
    kept = {name: df.where(F.col("ts") >= cutoff) for name, df in tables.items() if name != "results"}
    if "results" in tables:
        kept["results"] = tables["results"].join(kept["searches"].select(F.col("id").alias("search_id")), "search_id", "left_semi")
    return kept
