"""The symbol graph: edges from uses to definitions, degrees, hubs, usages and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.operators.analytics import nearest_rank


def symbol_edges(uses: DataFrame, defs: DataFrame, most: int = fixed.MAX_FANOUT) -> DataFrame:
    """Edges from using to defining chunks, within a project.

    uses, defs: project, symbol, chunk_id, file. Symbols with more than `most` defining chunks have no
    edges: they are counted and left out before the join, which therefore yields at most `most` rows for a
    use. No chunk has an edge to itself, and each (from, to, symbol) comes once. Confidence: AMBIGUOUS with
    several definitions, EXTRACTED within a file, else INFERRED.
    """
    d = defs.select("project", "symbol", F.col("chunk_id").alias("to_chunk_id"), F.col("file").alias("to_file")).distinct()
    fanout = d.groupBy("project", "symbol").agg(F.countDistinct("to_chunk_id").alias("n")).where(F.col("n") <= most)
    d = d.join(fanout, ["project", "symbol"])
    u = uses.select("project", "symbol", F.col("chunk_id").alias("from_chunk_id"), F.col("file").alias("from_file")).distinct()
    e = u.join(d, ["project", "symbol"]).where(F.col("from_chunk_id") != F.col("to_chunk_id"))
    sure = F.when(F.col("n") > 1, "AMBIGUOUS").when(F.col("from_file") == F.col("to_file"), "EXTRACTED").otherwise("INFERRED")
    return e.select("project", "from_chunk_id", "to_chunk_id", F.lit("calls").alias("relation_type"), F.col("symbol").alias("symbol_name"), sure.alias("confidence"))


def edge_stats(uses: DataFrame, defs: DataFrame, most: int = fixed.MAX_FANOUT) -> DataFrame:
    """One row: used symbols that the fan-out limit left out, and the edges they would have had, for every use."""
    fanout = defs.select("project", "symbol", "chunk_id").distinct().groupBy("project", "symbol").agg(F.count("*").alias("n")).where(F.col("n") > most)
    used = uses.groupBy("project", "symbol").agg(F.count("*").alias("uses")).join(fanout, ["project", "symbol"])
    return used.agg(F.count("*").alias("skipped_symbols"), F.coalesce(F.sum(F.col("uses") * F.col("n")), F.lit(0)).alias("skipped_edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every chunk that has an edge."""
    ends = edges.select(F.col("to_chunk_id").alias("chunk_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("from_chunk_id").alias("chunk_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("chunk_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def p95_degrees(degree: DataFrame) -> DataFrame:
    """One row: nearest-rank 95th percentiles of the degrees above 0."""
    one = lambda c: nearest_rank(degree.where(F.col(c) > 0), c, {f"p95_{c}": 0.95})
    return one("in_degree").join(F.broadcast(one("out_degree")), F.lit(True), "full")  # one row each


def hubs(degree: DataFrame, least: int = 5) -> DataFrame:
    """Chunks whose degree either way reaches the 95th percentile, and at least `least`."""
    p = F.broadcast(p95_degrees(degree))  # one row
    over = lambda c: F.col(c) >= F.greatest(F.lit(least), F.coalesce(f"p95_{c}", F.lit(0)))
    return degree.join(p, F.lit(True)).where(over("in_degree") | over("out_degree")).select("chunk_id", "in_degree", "out_degree")


def find_usages(edges: DataFrame, chunks: DataFrame, hub_ids: DataFrame, direction: str = "both", relations: list[str] | None = None, limit: int = 20, include_hubs: bool = True) -> DataFrame:
    """Edges of the asked chunks: chunk_id, direction, other, symbol_name, confidence, hub; up to limit each way.

    chunks: chunk_id. A hub is told by the other end. The order is by symbol, then the other end.
    """
    e = edges if relations is None else edges.where(F.col("relation_type").isin(relations))
    sides = []
    for name, mine, other in (("incoming", "to_chunk_id", "from_chunk_id"), ("outgoing", "from_chunk_id", "to_chunk_id")):
        if direction in (name, "both"):
            sides.append(e.select(F.col(mine).alias("chunk_id"), F.lit(name).alias("direction"), F.col(other).alias("other"), "symbol_name", "confidence"))
    found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    found = found.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").join(hub_ids.select(F.col("chunk_id").alias("other"), F.lit(True).alias("hub")), "other", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    if not include_hubs:
        found = found.where(~F.col("hub"))
    order = Window.partitionBy("chunk_id", "direction").orderBy("symbol_name", "other")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("chunk_id", "direction", "other", "symbol_name", "confidence", "hub")


def _touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among nodes: seen from that end as node and other."""
    both = edges.select(F.col("from_chunk_id").alias("node"), F.col("to_chunk_id").alias("other"), "symbol_name", F.lit(0).alias("back")).unionByName(edges.select(F.col("to_chunk_id").alias("node"), F.col("from_chunk_id").alias("other"), "symbol_name", F.lit(1).alias("back")))
    return both.join(nodes.select(F.col("chunk_id").alias("node")).distinct(), "node", "left_semi")


def impact(edges: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 50) -> DataFrame:
    """Chunks within reach of the seeds against or along the edges: chunk_id, hop.

    The second hop goes on from the first `most` chunks of the first, in the order of their ids, and adds
    up to `most` chunks. Reports are about a question's seeds, so both limits are part of the result.
    """
    first = _touching(edges, seeds).select(F.col("other").alias("chunk_id")).distinct().join(seeds.select("chunk_id").distinct(), "chunk_id", "left_anti").withColumn("hop", F.lit(1))
    if hops < 2:
        return first
    start = first.orderBy("chunk_id").limit(most)
    second = _touching(edges, start).select(F.col("other").alias("chunk_id")).distinct().join(seeds.select("chunk_id").distinct(), "chunk_id", "left_anti").join(first.select("chunk_id"), "chunk_id", "left_anti")
    return first.unionByName(second.orderBy("chunk_id").limit(most).withColumn("hop", F.lit(2)))


def impact_edges(edges: DataFrame, seeds: DataFrame, most: int = 50) -> DataFrame:
    """Distinct edges that impact() walks over two hops: from_chunk_id, to_chunk_id, symbol_name."""
    start = impact(edges, seeds, 1).orderBy("chunk_id").limit(most)
    seen = _touching(edges, seeds.select("chunk_id").unionByName(start.select("chunk_id")))
    ahead = F.col("back") == 0
    return seen.select(F.when(ahead, F.col("node")).otherwise(F.col("other")).alias("from_chunk_id"), F.when(ahead, F.col("other")).otherwise(F.col("node")).alias("to_chunk_id"), "symbol_name").distinct()


def by_service(reached: DataFrame, places: DataFrame) -> DataFrame:
    """Reached chunks that have a place, counted by service, else bounded context, else 'unknown', and hop."""
    where = F.coalesce("service", "bounded_context", F.lit("unknown")).alias("service")
    return reached.join(places.select("chunk_id", "service", "bounded_context"), "chunk_id").groupBy(where, "hop").agg(F.count("*").alias("chunks"))


def by_symbol(edges: DataFrame) -> DataFrame:
    """Edges gathered by symbol: symbol_name, edges, callers, definitions."""
    return edges.groupBy("symbol_name").agg(F.count("*").alias("edges"), F.countDistinct("from_chunk_id").alias("callers"), F.countDistinct("to_chunk_id").alias("definitions"))


def top_called(edges: DataFrame, limit: int = 10, project: str | None = None) -> DataFrame:
    e = edges if project is None else edges.where(F.col("project") == project)
    return e.groupBy(F.col("to_chunk_id").alias("chunk_id")).agg(F.count("*").alias("in_degree")).orderBy(F.col("in_degree").desc(), "chunk_id").limit(limit)


def suggest_components(edges: DataFrame, places: DataFrame, covered: DataFrame, limit: int = 10, factor: int = 5) -> DataFrame:
    """Files that lack a component card, by their most called chunk: the best of the factor * limit most called, one a file."""
    found = top_called(edges, factor * limit).join(places.select("chunk_id", "file"), "chunk_id").join(covered.select("file").distinct(), "file", "left_anti")
    best = Window.partitionBy("file").orderBy(F.col("in_degree").desc(), "chunk_id")
    return found.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("file", "chunk_id", "in_degree").orderBy(F.col("in_degree").desc(), "file").limit(limit)
