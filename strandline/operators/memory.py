"""Cards and glossary terms: gates, boosts, context, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions.vectors import boost, gate
from strandline.operators.retrieval import best_of_each, top_k

RETIRED = ("superseded", "deprecated")


def card_text() -> F.Column:
    """The text that stands for a card of any kind."""
    lines = lambda *c: F.concat_ws("\n", *c)
    return (
        F.when(F.col("arch_kind") == "component", lines("name", "summary", F.array_join("files", " ")))
        .when(F.col("arch_kind") == "decision", lines("title", "context", "decision", "alternativesRejected", "consequences"))
        .otherwise(lines("rule", "why", "when_applies", "evidence"))
    )


def term_text() -> F.Column:
    return F.concat_ws("\n", "term", "definition", F.array_join("aliases", ", "))


def current(cards: DataFrame, history: bool = False) -> DataFrame:
    """Cards in force; one without a status is."""
    return cards if history else cards.where(~F.coalesce(F.col("status"), F.lit("")).isin(*RETIRED))


def visible(cards: DataFrame, project: str, kind: str = "arch_kind", column: str = "project") -> DataFrame:
    """A project's cards: components of just this project, others of it or of the whole group (null)."""
    same = F.coalesce(F.col(column) == project, F.lit(False))
    return cards.where(F.when(F.col(kind) == "component", same).otherwise(same | F.col(column).isNull()))


def visible_terms(terms: DataFrame, project: str, column: str = "project") -> DataFrame:
    return terms.where(F.col(column).isNull() | (F.col(column) == project))


def gated(pairs: DataFrame, key: str, other: str, score: str = "score") -> DataFrame:
    """What becomes of each new record, by its nearest visible neighbour: key, nearest, score, outcome."""
    best = pairs.groupBy(key).agg(F.max(F.struct(F.col(score).alias("score"), F.col(other).alias("nearest"))).alias("b"))
    return best.select(key, "b.nearest", "b.score", gate(F.col("b.score")).alias("outcome"))


def boosted(hits: DataFrame, project: str, min_score: float = fixed.MIN_SCORE, column: str = "project") -> DataFrame:
    """Hits with the project's boost, those above min_score after it."""
    return hits.withColumn("score", boost(F.col("score"), F.coalesce(F.col(column) == project, F.lit(False)))).where(F.col("score") >= min_score)


def top_by_kind(hits: DataFrame, limits: dict[str, int], kind: str = "arch_kind", key: str = "id", default: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The best hits of every kind, as many as its limit; 0 leaves a kind out. by: columns that tell searches apart."""
    most = F.coalesce(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col(kind)], F.lit(default)) if limits else F.lit(default)
    order = Window.partitionBy(*by, kind).orderBy(F.col("score").desc(), key)
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max([default, *limits.values()])).where(F.col("rank") <= most)


def overfetched(hits: DataFrame, keep, limit: int, key: str = "id", factor: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """The limit best of those among the factor * limit best that a later filter keeps; may come out short. by: columns that tell searches apart."""
    if by:
        return best_of_each(best_of_each(hits, [*by], factor * limit, key).where(keep), [*by], limit, key)
    order = [F.col("score").desc(), key]
    return hits.orderBy(*order).limit(factor * limit).where(keep).orderBy(*order).limit(limit)


def page(rows: DataFrame, key: str, after: str | None, limit: int) -> DataFrame:
    """The next rows in the order of a key, after the last one seen."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def stats(cards: DataFrame) -> DataFrame:
    """By kind: cards, those in force, retired ones, and the first and last update."""
    retired = F.coalesce(F.col("status"), F.lit("")).isin(*RETIRED)
    return cards.groupBy("arch_kind").agg(F.count("*").alias("total"), F.count_if(~retired).alias("current"), F.count_if(retired).alias("retired"), F.min("updatedAt").alias("first_update"), F.max("updatedAt").alias("last_update"))


def supersede(cards: DataFrame, newer: DataFrame) -> DataFrame:
    """Cards, those that a newer one supersedes marked so. newer: id, supersedes."""
    old = newer.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("id"), F.lit(True).alias("gone")).distinct()
    return cards.join(old, "id", "left").withColumn("status", F.when(F.col("gone"), "superseded").otherwise(F.col("status"))).drop("gone")


def upsert_components(cards: DataFrame) -> DataFrame:
    """Components by name and project: the latest update's row with the first createdAt."""
    latest = F.max_by(F.struct("id", "summary", "updatedAt"), F.struct("updatedAt", "id")).alias("c")
    return cards.where(F.col("arch_kind") == "component").groupBy("name", "project").agg(latest, F.min("createdAt").alias("createdAt")).select("name", "project", "c.id", "c.summary", "createdAt", "c.updatedAt")


def near_new(cards: DataFrame, new: DataFrame, kind: str | None = "arch_kind") -> DataFrame:
    """What becomes of new records (id, project, vector, and kind if there is one; supersedes if there is one): id, nearest, score, outcome.

    A record is held against those of its kind in force that its project sees: the project's own and the group's (null);
    one of the group sees the group's only. Those that supersede another are created whatever is near. Every fitting
    vector is scored; of equal scores the id that hashes least is nearest. Ids are strings; null ones take no part.
    """
    own = lambda df: df.where("id IS NOT NULL").select("id", F.coalesce("project", F.lit("")).alias("at"), (F.col(kind) if kind else F.lit("")).alias("kind"), "vector")
    old = own(current(cards) if "status" in cards.columns else cards)
    asked = new.withColumn("supersedes", F.col("supersedes") if "supersedes" in new.columns else F.lit(None).cast("string"))
    gated_ = own(asked.where("supersedes IS NULL")).withColumn("no", F.xxhash64("id"))
    place = F.concat_ws("\x1f", "kind", "at")
    corpus = old.select(F.xxhash64("id").alias("id"), F.col("id").alias("card"), place.alias("place"), "vector")
    hits = top_k(gated_.select(F.col("no").alias("id"), "vector"), corpus, 1, by="place").join(corpus.select("id", "card"), "id")
    seen = F.array(place, F.concat_ws("\x1f", "kind", F.lit("")))
    pairs = gated_.select("id", "no", F.explode(F.array_distinct(seen)).alias("place")).join(hits.select(F.col("query_id").alias("no"), "place", "card", "score"), ["no", "place"])
    best = pairs.groupBy("id").agg(F.min_by(F.struct("card", "score"), F.struct(-F.col("score"), "card")).alias("b")).select("id", F.col("b.card").alias("nearest"), F.col("b.score").alias("score"))
    return asked.where("id IS NOT NULL").select("id").distinct().join(best, "id", "left").select("id", "nearest", "score", F.coalesce(gate(F.col("score")), F.lit("created")).alias("outcome"))


def recorded(cards: DataFrame, new: DataFrame, kind: str | None = "arch_kind", now: str = "createdAt") -> tuple[DataFrame, DataFrame]:
    """The table after new records, and what became of each (see near_new).

    Created ones are added and mark what they supersede; a lesson that repeats one in force updates that one's updatedAt
    and comes out as `updated`; others that are near one are not added. Components, and terms of a name that their
    project has, replace the old row and keep its id and createdAt. cards and new have the same columns.
    """
    named = "name" if kind else "term"
    by_name = (F.col(kind) == "component") if kind else F.lit(True)
    found = near_new(cards, new, kind)
    keys = [F.coalesce("project", F.lit("")).alias("_at"), F.col(named).alias("_name")]
    had = cards.where(by_name).select(F.col("id").alias("_id"), F.col("createdAt").alias("_created"), *keys).where("_name IS NOT NULL").groupBy("_at", "_name").agg(F.min(F.struct("_created", "_id")).alias("_had"))
    rows = new.where("id IS NOT NULL").select("*", *keys, by_name.alias("_named")).join(had, ["_at", "_name"], "left").join(found, "id")
    replaced = F.col("_named") & F.col("_had").isNotNull()
    outcome = F.when(replaced, "updated").when(F.col("_named") & F.lit(kind is not None), "created")
    if kind:
        outcome = outcome.when((F.col(kind) == "lesson") & (F.col("outcome") == "duplicate"), "updated")
    rows = rows.withColumn("_outcome", outcome.otherwise(F.col("outcome"))).withColumn("_replaced", replaced)
    written = rows.where(F.col("_replaced") | (F.col("_outcome") == "created"))
    written = written.withColumn("id", F.when(F.col("_replaced"), F.col("_had._id")).otherwise(F.col("id"))).withColumn("createdAt", F.when(F.col("_replaced"), F.col("_had._created")).otherwise(F.col("createdAt")))
    newest = Window.partitionBy("id").orderBy(F.col("updatedAt").desc_nulls_last())
    written = written.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select(cards.columns)
    confirmed = rows.where((F.col("_outcome") == "updated") & ~F.col("_replaced")).groupBy(F.col("nearest").alias("id")).agg(F.max(now).alias("_now"))
    kept = cards.join(written.select("id"), "id", "left_anti").join(confirmed, "id", "left").withColumn("updatedAt", F.greatest("updatedAt", "_now")).select(cards.columns)
    if kind:
        kept = supersede(kept, written.select("id", "supersedes")).select(cards.columns)
    return kept.unionByName(written), rows.select("id", "nearest", "score", F.col("_outcome").alias("outcome"))


def deleted(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows but those of some ids; ids that aren't there change nothing."""
    return rows.where(~F.coalesce(F.col("id").isin(ids), F.lit(False)))
