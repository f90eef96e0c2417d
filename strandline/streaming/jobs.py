"""Streams of search and file events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.session import fresh_dir


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """With `at`, the instant of a column of epoch milliseconds."""
    return df.withColumn("at", F.timestamp_millis(ts))


def debounced(changes: DataFrame, quiet: str = "1 second", late: str = "1 minute") -> DataFrame:
    """The last kind of change of each file after it has been quiet: project, file, event, changes, at. changes: project, file, event, at."""
    rows = changes.withWatermark("at", late)
    last = rows.groupBy(F.session_window("at", quiet).alias("w"), "project", "file").agg(F.max(F.struct("at", "event")).alias("l"), F.count("*").alias("changes"))
    return last.select("project", "file", "l.event", "changes", "l.at")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Searches and errors of each window: start (ms), searches, errors. Events later than `late` don't count."""
    rows = event_time(events).withWatermark("at", late)
    out = rows.groupBy(F.window("at", width).alias("w")).agg(F.count("*").alias("searches"), F.count("error").alias("errors"))
    return out.select(F.unix_millis("w.start").alias("start_ms"), "searches", "errors")


def once(events: DataFrame, key: str = "id", late: str = "30 days") -> DataFrame:
    """Events once each, whatever their deliveries; keys are remembered for as long as a delivery may be late."""
    return event_time(events).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def fetch_searches(fetches: DataFrame, searches: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Every fetch with the searches of the same user before it, one row each, or one without: fetch_id, search_id, asked_ts.

    fetches: id, user, ts; searches: id, user, ts. For latest_search.
    """
    f = event_time(fetches.select(F.col("id").alias("fetch_id"), "user", "ts")).withColumnRenamed("at", "fetched").withWatermark("fetched", late)
    s = event_time(searches.select(F.col("id").alias("search_id"), F.col("user").alias("who"), F.col("ts").alias("asked_ts")), "asked_ts").withColumnRenamed("at", "asked").withWatermark("asked", late)
    before = (F.col("user") == F.col("who")) & (F.col("asked") <= F.col("fetched")) & (F.col("asked") >= F.col("fetched") - F.expr(f"INTERVAL {within}"))
    return f.join(s, before, "left_outer").select("fetch_id", "search_id", "asked_ts")


def latest_search(pairs: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Of what fetch_searches gave out, each fetch with its latest search, or none: fetch_id, search_id. Of searches at one time the greater id.

    A stream gives out a fetch without a search only when no search before it can arrive any more; with fetches (id), a
    table of those that have arrived, the ones still waiting come out without a search.
    """
    last = F.max(F.struct("asked_ts", "search_id")).alias("l")
    found = pairs.groupBy("fetch_id").agg(last).select("fetch_id", "l.search_id")
    return found if fetches is None else fetches.select(F.col("id").alias("fetch_id")).distinct().join(found, "fetch_id", "left")


def reformulations(searches: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pairs of searches of a user and session within the window of a reformulation: a_id, b_id."""
    w = F.expr(f"INTERVAL {fixed.REFORMULATION_MS // 1000} SECONDS")
    side = lambda x: event_time(searches).select(F.col("id").alias(f"{x}_id"), F.col("user").alias(f"{x}_user"), F.coalesce("session", F.lit("")).alias(f"{x}_session"), F.col("at").alias(f"{x}_at")).withWatermark(f"{x}_at", late)
    a, b = side("a"), side("b")
    same = (F.col("a_user") == F.col("b_user")) & (F.col("a_session") == F.col("b_session"))
    return a.join(b, same & (F.col("b_at") > F.col("a_at")) & (F.col("b_at") <= F.col("a_at") + w)).select("a_id", "b_id")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/{name}.parque[t]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives out over all that is there now. The sink replaces a batch that is written again."""
    spark = df.sparkSession
    root = fresh_dir(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/{'all' if mode == 'complete' else f'batch={n}'}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows/{'all' if mode == 'complete' else 'batch=*'}")


def append_events(stream: DataFrame, path: str, progress: str):
    """Appends a stream of events to a table by day; a batch that is replayed replaces what it wrote."""

    def write(batch: DataFrame, n: int) -> None:
        day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
        batch.withColumn("day", day).withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path)

    return stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()


def with_retries(work, dead: str, most: int = 3):
    """A foreachBatch function that tries work(rows, n) again and writes what fails every time below dead, with the batch and the reason; a batch met again replaces what it left there."""

    def run(batch: DataFrame, n: int) -> None:
        for attempt in range(most):
            try:
                return work(batch, n)
            except Exception as e:  # noqa: BLE001
                reason = str(e)
        batch.withColumn("batch", F.lit(n)).withColumn("reason", F.lit(reason)).write.mode("overwrite").parquet(f"{dead}/batch={n}")

    return run


def dead_letters(spark: SparkSession, dead: str, schema: str) -> DataFrame:
    """What with_retries left; schema: of the stream's rows."""
    return spark.read.schema(f"{schema}, batch int, reason string").option("recursiveFileLookup", "true").parquet(dead)
