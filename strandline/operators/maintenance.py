"""Keeping tables: upserts, deletes, orphans, moves, and what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, the greatest version of each key; of equal versions a new row."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc())
    return every.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones of keys that are not there."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """New rows, and old ones of parents that have no new rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(new.columns).unionByName(new)


def replace_group(old: DataFrame, new: DataFrame, group: str, column: str = "grp") -> DataFrame:
    """The table with a group made anew: none of its old rows, and the new rows that are of it."""
    return old.where(~F.col(column).eqNullSafe(F.lit(group))).unionByName(new.where(F.col(column) == group).select(old.columns))


def healed(points: DataFrame, vectors: DataFrame, key: str = "hash") -> DataFrame:
    """Points whose vector is missing get the one that their text has elsewhere; other columns stay. vectors: key, vector."""
    found = vectors.where("vector IS NOT NULL").groupBy(key).agg(F.min("vector").alias("_vector"))
    return points.join(found, key, "left").withColumn("vector", F.coalesce("vector", "_vector")).select(points.columns)


def add_counts(old: DataFrame, delta: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts of both, added up; those that fall to 0 are gone."""
    return old.select(*keys, count).unionByName(delta.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) > 0)


def delete_prefix(rows: DataFrame, prefix: str, column: str = "chunk_id") -> DataFrame:
    """Rows whose key doesn't start with a prefix, taken as it stands."""
    return rows.where(~F.startswith(column, F.lit(prefix)) | F.col(column).isNull())


def delete_where(rows: DataFrame, **equal) -> DataFrame:
    """Rows that differ in one of the columns."""
    gone = F.lit(True)
    for c, v in equal.items():
        gone = gone & F.col(c).eqNullSafe(v)
    return rows.where(~gone)


def orphans(indexed: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Indexed keys that are no longer present."""
    return indexed.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def elsewhere(chunks: DataFrame, homes: DataFrame) -> DataFrame:
    """Chunks of projects outside their group. homes: project, home."""
    return chunks.join(homes, "project").where(F.col("grp") != F.col("home"))


def found_and_missing(asked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Asked keys with whether they are there."""
    there = rows.select(key).distinct().withColumn("found", F.lit(True))
    return asked.select(key).distinct().join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def config_changes(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that were added, removed or modified, with what became of them."""
    pack = lambda df, name: df.select(key, F.struct(*values).alias(name))
    both = pack(before, "old").join(pack(after, "new"), key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    changed = F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise(change)
    return both.select(key, changed.alias("change")).where("change IS NOT NULL")


def reconcile(discovered: DataFrame, registered: DataFrame, live_groups: DataFrame) -> DataFrame:
    """Projects of both (grp, project), a registered one before a discovered one, of groups that are alive."""
    every = registered.select("grp", "project", F.lit(0).alias("rank"), F.lit("registered").alias("source")).unionByName(discovered.select("grp", "project", F.lit(1).alias("rank"), F.lit("discovered").alias("source")))
    best = Window.partitionBy("grp", "project").orderBy("rank")
    return every.withColumn("rn", F.row_number().over(best)).where("rn = 1").join(live_groups.select("grp").distinct(), "grp", "left_semi").select("grp", "project", "source")


def file_fingerprints(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each file its chunks' hashes as one digest, whatever their order and number."""
    return chunks.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("hash")), ","), 256).alias("fingerprint"))


def unchanged_files(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose chunks are the same in both."""
    return file_fingerprints(before, keys).join(file_fingerprints(after, keys), [*keys, "fingerprint"]).select(*keys)


def folder_fingerprints(files: DataFrame, by: list[str], path: str = "file", changed: str = "indexed_at", size: str = "total_bytes") -> DataFrame:
    """A digest of each folder's sorted paths, times and sizes, headed by their number."""
    line = F.concat_ws("\x00", path, F.col(changed).cast("string"), F.col(size).cast("string"))
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return files.groupBy(*by).agg(F.sha2(F.concat(F.count("*").cast("string"), F.lit("\n"), lines), 256).alias("fingerprint"))


def cache_misses(texts: DataFrame, cache: DataFrame, key: str = "hash", model: str | None = None) -> DataFrame:
    """Distinct keys that the cache (of a model) lacks."""
    there = cache if model is None else cache.where(F.col("model") == model)
    return texts.select(key).distinct().join(there.select(key).distinct(), key, "left_anti")


def newest(cache: DataFrame, most: int, at: str = "created_at", key: tuple[str, ...] = ("hash", "model")) -> DataFrame:
    """The `most` latest rows of a cache, one for each key."""
    order = Window.partitionBy(*key).orderBy(F.col(at).desc())
    return cache.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn").orderBy(F.col(at).desc(), *key).limit(most)


def not_contained(ranges: DataFrame, by: list[str], start: str = "start_line", end: str = "end_line", order: str = "idx") -> DataFrame:
    """Ranges that no earlier or equal one of their file holds; of equal ones the first."""
    before = Window.partitionBy(*by).orderBy(F.col(start), F.col(end).desc(), F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_max", F.coalesce(F.max(end).over(before), F.lit(-1))).where(F.col(end) > F.col("_max")).drop("_max")


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Rows that have all that a hit needs."""
    need = ("grp", "project", "file", "startLine", "endLine", "content", "hash")
    keep = F.lit(True)
    for c in need:
        keep = keep & F.col(c).isNotNull()
    return chunks.where(keep)


def require_same_model(meta: dict, model: str, dims: int) -> dict:
    """The model that a collection was written with; raises where it is another. An empty meta is filled."""
    if meta and (meta.get("model"), meta.get("dims")) != (model, dims):
        raise ValueError(f"written with {meta.get('model')} of {meta.get('dims')} dimensions, not {model} of {dims}")
    return meta or {"model": model, "dims": dims}
