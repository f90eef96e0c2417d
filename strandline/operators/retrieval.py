"""Vector, full-text and hybrid search, and the merges of their results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strandline.functions import fixed
from strandline.functions import text as T
from strandline.functions import vectors as V
from strandline.session import fresh_dir

#: Queries that are sent to every task; more of them meet the corpus block by block.
QUERIES = 65_536
#: Vectors of a block.
BLOCK = 2048
_HIT = "query_id long, id long, part string, score double"


class _Best:
    """The k best hits so far of every query and part, by score and then key."""

    def __init__(self, k: int):
        self.k, self.rows = k, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)]
        self.parts: dict = {}

    def add(self, queries: np.ndarray, keys: np.ndarray, parts: list, score: np.ndarray) -> None:
        """score: queries x keys."""
        numbers = np.array([self.parts.setdefault(p, len(self.parts)) for p in parts], np.int32)
        for number in np.unique(numbers):
            own = np.flatnonzero(numbers == number)
            k = min(self.k, len(own))
            some = score[:, own]
            # all that tie with the last are kept: the order among them is by key
            least = np.partition(some, len(own) - k, axis=1)[:, len(own) - k, None]
            q, i = np.nonzero(some >= least)
            fresh = queries[q], keys[own[i]], np.full(len(q), number, np.int32), some[q, i]
            self.rows = [np.concatenate(x) for x in zip(self.rows, fresh)]
        if len(self.rows[0]) > 2_000_000:
            self.prune()

    def prune(self) -> None:
        q, key, part, score = self.rows
        order = np.lexsort((key, -np.round(score, 9), part, q))
        group = np.stack([q[order], part[order]])
        begins = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        self.rows = [c[order[rank < self.k]] for c in self.rows]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.prune()
        names = list(self.parts)
        for at in range(0, len(self.rows[0]), 50_000):
            q, key, part, score = (c[at : at + 50_000] for c in self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(key), pa.array([names[x] for x in part], pa.string()), pa.array(score)], ["query_id", "id", "part", "score"])


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _held(shared, k: int):
    """Rows id, part, vector against all of some queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, matrix), best = shared.value, _Best(k)
        for batch in batches:
            if batch.num_rows:
                x, keys, parts = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.num_rows), batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for at in range(0, len(ids), BLOCK):
                    best.add(ids[at : at + BLOCK], keys, parts, matrix[at : at + BLOCK] @ x.T)
        yield from best.batches()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, part, vector in blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = _unit(part.column(2).flatten().to_numpy(zero_copy_only=False), part.num_rows).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()]), pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary())], ["ids", "parts", "matrix"])


def _blocks(k: int):
    """Pairs of blocks of queries and of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for ids, asked, keys, parts, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                q, x = (np.frombuffer(m, np.float32).astype(np.float64).reshape(n, -1) for m, n in ((asked, len(ids)), (matrix, len(keys))))
                best.add(np.array(ids), np.array(keys), parts, q @ x.T)
        yield from best.batches()

    return run


def _some() -> F.Column:
    """Whether a vector takes part."""
    return F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull())


def scored(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every row of the corpus with its cosine to each query: query_id, id, score. For what is ranked only after filters or boosts; see top_k for what takes part."""
    q = queries.where(_some()).select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    pairs = F.broadcast(q).join(corpus.where(_some()).select("id", "vector"), F.size("asked") == F.size("vector"))
    return pairs.select("query_id", "id", F.round(V.cosine(F.col("asked"), F.col("vector")), 6).alias("score"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The k most similar rows of the corpus for each query, by cosine: query_id, id, score, rank; with by, k for each of its values, as another column.

    queries: id (long), vector; corpus: id (long), vector. Exact: every vector is scored, in one pass over the corpus;
    a task keeps its own best. Up to QUERIES queries, by their count, are sent to every task; beyond, blocks of both
    sides meet as rows. Ties go to the smaller id. Null vectors, zero vectors, and vectors of another length than
    the first query's take no part.
    """
    spark, asked = corpus.sparkSession, queries.where(_some()).select("id", "vector")
    names = ["query_id", "id", *([by] if by else [])]
    few = asked.limit(QUERIES + 1).toArrow()
    if not few.num_rows:
        kind = f", {by} string" if by else ""
        return spark.createDataFrame([], f"query_id long, id long{kind}, score double, rank int")
    part = F.col(by).cast("string") if by else F.lit("")
    if few.num_rows <= QUERIES:
        few = few.sort_by("id")
        width = len(few.column("vector")[0])
        few = few.filter(pc.equal(pc.list_value_length(few.column("vector")), width))
        matrix = _unit(few.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), few.num_rows)
        shared = spark.sparkContext.broadcast((few.column("id").to_numpy(), matrix))
        rows = corpus.where(_some() & (F.size("vector") == width)).select("id", part.alias("part"), "vector")
        found = rows.mapInArrow(_held(shared, k), _HIT)
    else:
        width = len(asked.orderBy("id").first()["vector"])
        packed = lambda rows: rows.where(F.size("vector") == width).mapInArrow(_packed, "ids array<long>, parts array<string>, matrix binary")
        q = packed(asked.select("id", F.lit("").alias("part"), "vector")).select(F.col("ids").alias("asked_ids"), F.col("matrix").alias("asked"))
        rows = packed(corpus.where(_some()).select("id", part.alias("part"), "vector"))
        found = q.crossJoin(rows).select("asked_ids", "asked", "ids", "parts", "matrix").mapInArrow(_blocks(k), _HIT)  # rows are blocks
    order = Window.partitionBy("query_id", *(["part"] if by else [])).orderBy(F.round("score", 9).desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("part", by or "part").select(*names, F.round("score", 6).alias("score"), "rank")


def best_of_each(rows: DataFrame, by: list[str], limit: int, key: str) -> DataFrame:
    """The limit best rows, by score and key, of every group."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), key)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn")


def merge_variations(hits: DataFrame, limit: int, key: str = "hash", by: tuple[str, ...] = ()) -> DataFrame:
    """Hits of several variations (variation, key, score): the best score of each key and the variation that first found it, the best first.

    by: columns that tell searches apart; each has its own limit.
    """
    best = hits.groupBy(*by, key).agg(F.max("score").alias("score"), F.min("variation").alias("first_variation"))
    if by:
        return best_of_each(best, [*by], limit, key)
    return best.orderBy(F.col("score").desc(), key).limit(limit)


def first_seen(hits: DataFrame, limit: int, key: str = "hash", place: str = "place", by: tuple[str, ...] = ()) -> DataFrame:
    """Hits of several groups (place, rank, key, score) without repeats: the first occurrence by place and rank counts, not the best. by: as in merge_variations."""
    order = Window.partitionBy(*by, key).orderBy(place, "rank")
    kept = hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    if by:
        return best_of_each(kept, [*by], limit, key)
    return kept.orderBy(F.col("score").desc(), key).limit(limit)


def best_per(hits: DataFrame, by: str, key: str) -> DataFrame:
    """The best hit of every document."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), key)
    return hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


#: Terms asked that are sent to every task; more of them go through the vectors of all terms.
TERMS = 10_000


def search_text(parts: DataFrame, queries: DataFrame, k: int, group: str = "grp", key: str = "id", text: str = "text") -> DataFrame:
    """The k best parts of each group for each text query, as sparse_search over document_vectors gives them: query_id, group, key, score, rank.

    Only the terms asked are counted and weighed: one pass over the texts leaves, for each part, its length and those
    of its terms that a query names; only these are written, and read for the frequencies and for the scores.
    queries: query_id, query.
    """
    spark = parts.sparkSession
    asked = queries.select(F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term")).distinct().limit(TERMS + 1).collect()
    if len(asked) > TERMS:
        df, totals = corpus_stats(parts, group, key, text)
        return sparse_search(document_vectors(parts, group, key, text), query_vectors(queries, df, totals), k)
    names = [r["term"] for r in asked]
    path = fresh_dir(spark, "terms")
    terms = parts.select(group, key, T.terms(F.col(text)).alias("terms"))
    terms.select(group, key, F.size("terms").alias("length"), F.filter("terms", lambda t: t.isin(names)).alias("terms")).write.parquet(path)
    held = spark.read.parquet(path)
    df = held.select(group, F.explode(F.array_distinct("terms")).alias("term")).groupBy(group, "term").agg(F.count("*").alias("df"))
    totals = held.groupBy(group).agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    tf = held.select(group, key, "length", F.explode("terms").alias("term")).groupBy(group, key, "length", "term").agg(F.count("*").alias("tf"))
    weight = V.bm25(F.col("tf"), F.col("length"), F.col("average"), F.col("df"), F.col("n"))
    vectors = tf.join(df, [group, "term"]).join(totals, group).select(group, key, "term", weight.alias("weight"))
    return sparse_search(vectors, query_vectors(queries, df, totals), k)


def corpus_stats(parts: DataFrame, group: str = "grp", key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Document frequencies (group, term, df) and totals (group, n, average) of a corpus of parts."""
    rows = parts.select(group, key, T.terms(F.col(text)).alias("terms"))
    df = rows.select(group, F.explode(F.array_distinct("terms")).alias("term")).groupBy(group, "term").agg(F.count("*").alias("df"))
    return df, rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("average"))


def document_vectors(parts: DataFrame, group: str = "grp", key: str = "id", text: str = "text") -> DataFrame:
    """Sparse vectors of all parts: group, key, term, weight. Weights are positive, for no term is in more parts than there are.

    Document frequencies and lengths come from the term counts, whose exchange all uses share. The outer explode keeps
    the planner from adding a filter on the terms, which would find them twice.
    """
    rows = parts.select(group, key, T.terms(F.col(text)).alias("terms"))
    tf = rows.select(group, key, F.size("terms").alias("length"), F.explode_outer("terms").alias("term")).where("term IS NOT NULL").groupBy(group, key, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(group, "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    lengths = tf.groupBy(group).agg(F.sum("tf").alias("all"))
    totals = parts.groupBy(group).agg(F.count("*").alias("n")).join(lengths, group).select(group, "n", (F.col("all") / F.col("n")).alias("average"))
    every = tf.join(df, [group, "term"]).join(totals, group)
    weight = V.bm25(F.col("tf"), F.col("length"), F.col("average"), F.col("df"), F.col("n"))
    return every.select(group, key, "term", weight.alias("weight"))


def query_vectors(queries: DataFrame, df: DataFrame, totals: DataFrame, group: str = "grp") -> DataFrame:
    """Sparse vectors of queries (query_id, query) in every group: the idf of their terms; unknown terms count as in no document."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    rows = terms.join(totals.select(group, "n"), F.lit(True)).join(df, [group, "term"], "left")
    weight = V.idf(F.coalesce("df", F.lit(0)), F.col("n"))
    return rows.select("query_id", group, "term", weight.alias("weight")).where("weight > 0")


def sparse_search(vectors: DataFrame, queries: DataFrame, k: int, group: str = "grp", key: str = "id") -> DataFrame:
    """The k parts of the greatest product with each query in each group: query_id, group, key, score, rank."""
    q = queries.select("query_id", group, "term", F.col("weight").alias("q"))
    scored = vectors.join(q, [group, "term"]).groupBy("query_id", group, key).agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score"))
    order = Window.partitionBy("query_id", group).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(rankings: list[DataFrame], by: list[str], k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (by..., rank): by..., score."""
    every = rankings[0].select(*by, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(*by, "rank"))
    return every.groupBy(*by).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + k)), 9).alias("score"))


def with_neighbours(hits: DataFrame, parts: DataFrame, n: int = 1) -> DataFrame:
    """Each hit (doc_id, idx) with the parts up to n before and after it as one text, in order, without their breadcrumbs; and its first and last line."""
    near = hits.select("doc_id", F.col("idx").alias("hit"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("idx") - n), F.col("idx") + n)).alias("idx"))
    rows = near.join(parts, ["doc_id", "idx"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", T.strip_breadcrumb(F.col("content")).alias("c")))), lambda p: p["c"]), "\n\n")
    return rows.groupBy("doc_id", "hit").agg(joined.alias("content"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def audience_ceiling(asked: list[str] | None, ceiling: list[str] | None) -> list[str] | None:
    """Labels that a request may see: None is all, and a request outside the ceiling sees none."""
    clean = lambda v: list(dict.fromkeys(s for x in v or [] if (s := x.strip()))) or None
    asked, ceiling = clean(asked), clean(ceiling)
    if asked is None or ceiling is None:
        return asked or ceiling
    return [a for a in asked if a in ceiling]


def for_audience(parts: DataFrame, labels: list[str] | None) -> DataFrame:
    """Parts of these labels, by a label or an array of labels of which one is enough; one without a label is of none."""
    if labels is None:
        return parts
    several = isinstance(parts.schema["audience"].dataType, ArrayType)
    return parts.where(F.arrays_overlap("audience", F.array(*map(F.lit, labels)).cast("array<string>")) if several else F.col("audience").isin(labels))


def allowed_projects(asked: str, known: list[str]) -> list[str]:
    """Projects that a search covers: all, the one asked for, or none."""
    return known if asked == "all" else [p for p in known if p == asked]


def overlapping(places: DataFrame, lo: int, hi: int) -> DataFrame:
    """Chunks whose lines meet lo..hi."""
    return places.where((F.col("start_line") <= hi) & (F.col("end_line") >= lo))


def adjacent(places: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """Other chunks of the asked chunks' files within radius lines of them: chunk_id, near, start_line."""
    a = asked.join(places, "chunk_id").select(F.col("chunk_id"), "grp", "project", "file", (F.col("start_line") - radius).alias("lo"), (F.col("end_line") + radius).alias("hi"))
    p = places.select("grp", "project", "file", F.col("chunk_id").alias("near"), "start_line", "end_line")
    return a.join(p, ["grp", "project", "file"]).where((F.col("start_line") <= F.col("hi")) & (F.col("end_line") >= F.col("lo")) & (F.col("near") != F.col("chunk_id"))).select("chunk_id", "near", "start_line")


def project_facets(chunks: DataFrame) -> DataFrame:
    """By group and project: chunks and their languages."""
    return chunks.groupBy("grp", "project").agg(F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set(F.lower("language"))), " ").alias("languages"))
