"""Most frequent items by exact spillable aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_values(events: DataFrame, value: str = "query_hash", event_id: str = "id", k: int = 20) -> DataFrame:
    """The k values with the most distinct events: value, n_events.

    Repeated deliveries are folded by (value, id), which spreads a value of any frequency over all tasks;
    counts are then combined before they move, so that a frequent value sends one row per task. Partitions
    spill to disk and hold no more than they read. The last step takes each partition's own k before the
    one ordered limit. Null values and null ids don't count; ties go to the smaller value. An empty table
    gives no rows; other columns are ignored.
    """
    pairs = events.select(F.col(value).alias("value"), F.col(event_id).alias("event")).where(F.col("value").isNotNull() & F.col("event").isNotNull())
    counts = pairs.distinct().groupBy("value").agg(F.count("*").alias("n_events"))
    return counts.orderBy(F.col("n_events").desc(), "value").limit(k)


def top_with_text(events: DataFrame, value: str = "query_hash", text: str = "query_text", event_id: str = "id", k: int = 20) -> DataFrame:
    """top_values with the greatest text of each value (null where all are withheld): value, n_events, text.

    The k values are broadcast, k being the bound of their number.
    """
    top = top_values(events, value, event_id, k)
    rows = events.select(F.col(value).alias("value"), F.col(text).alias("text"))
    texts = rows.where(F.col("text").isNotNull()).join(F.broadcast(top.select("value")), "value", "left_semi").groupBy("value").agg(F.max("text").alias("text"))
    return top.join(texts, "value", "left").select("value", "n_events", "text")
