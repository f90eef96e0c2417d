"""The search tools as one call each: composed of the operators, over the tables of an index.

`Index` holds the tables by name; each tool gives a DataFrame, and render() turns one into markdown.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions import text as T
from strandline.functions import vectors as V
from strandline.operators import graph as G
from strandline.operators import history as H
from strandline.operators import maintenance as K
from strandline.operators import memory as M
from strandline.operators import retrieval as S
from strandline.sources.embedders import Embedder, HashingEmbedder

#: Tools that a mode offers.
MODES = {
    "coding": ["search_code", "get_chunk", "get_chunk_meta", "search_changes", "find_usages", "explain_feature", "recent_changes", "impact_analysis", "list_projects", "arch_context", "arch_list", "term_search", "term_list"],
    "support": ["search_docs", "explain_feature", "recent_changes", "impact_analysis", "list_projects", "arch_context", "term_search", "term_list", "token_savings_report", "top_queries", "retry_rate"],
}


@dataclass
class Index:
    """chunks: chunk_id, grp, project, file, start_line, end_line, content, hash, vector, service, bounded_context; the others as their operators take them."""

    chunks: DataFrame
    edges: DataFrame | None = None
    commits: DataFrame | None = None  # chunk commits
    parts: DataFrame | None = None  # doc_id, idx, grp, project, content, audience, vector, start_line, end_line
    cards: DataFrame | None = None
    terms: DataFrame | None = None
    embedder: Embedder = field(default_factory=HashingEmbedder)

    @property
    def spark(self):
        return self.chunks.sparkSession

    def vectors_of(self, texts: list[str]) -> DataFrame:
        rows = [(i, v.tolist()) for i, v in enumerate(self.embedder.embed(texts))]
        return self.spark.createDataFrame(rows, "id long, vector array<float>")


def clamp(limit: int | None, most: int = 100, usual: int = 5) -> int:
    return max(1, min(most, usual if limit is None else limit))


def _asked(query: str) -> str:
    if not query or not query.strip():
        raise ValueError("the query is blank")
    return query.strip()


def variations(index: Index, query: str) -> list[str]:
    """The query and its variants, as the driver needs them: one row."""
    one = index.spark.createDataFrame([(query,)], "q string")
    return one.select(T.expand_query(F.col("q")).alias("v")).first()["v"]


def _ranked(index: Index, rows: DataFrame, texts: list[str], k: int, key: str) -> DataFrame:
    """The k nearest rows for every text; key names a row, and its hash is the id that scoring needs."""
    corpus = rows.withColumn("id", F.xxhash64(key))
    hits = S.top_k(index.vectors_of(texts), corpus, k)
    return hits.withColumnRenamed("query_id", "variation").join(corpus.drop("vector"), "id").drop("id")


def search_code(index: Index, query: str, group: str | None = None, project: str = "all", limit: int | None = None) -> DataFrame:
    """The best chunks for a query and its variants: chunk columns with score and confidence.

    Within a group the best score of a content counts; over groups the first group that has it.
    """
    n = clamp(limit, 20)
    rows = K.valid_chunks(index.chunks.withColumnRenamed("start_line", "startLine").withColumnRenamed("end_line", "endLine"))
    rows = rows if group is None else rows.where(F.col("grp") == group)
    rows = rows if project == "all" else rows.where(F.col("project") == project)
    hits = _ranked(index, rows.dropDuplicates(["chunk_id"]), variations(index, _asked(query)), min(4 * n, 100), "chunk_id")
    best = Window.partitionBy("grp", "hash").orderBy(F.col("score").desc(), "variation", "chunk_id")
    hits = hits.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    place = Window.partitionBy("grp").orderBy(F.col("score").desc(), "hash")
    merged = S.first_seen(hits.withColumn("place", F.col("grp")).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= 2 * n), n)
    return merged.withColumn("confidence", T.confidence(F.col("score"))).drop("place", "rank", "variation")


def get_chunk(index: Index, chunk_id: str, radius: int = 0) -> DataFrame:
    """A chunk, and with a radius the chunks of its file that are near: chunk_id, start_line, end_line, content, asked."""
    rows = index.chunks.select("chunk_id", "grp", "project", "file", "start_line", "end_line", "content").dropDuplicates(["chunk_id"])
    one = rows.where(F.col("chunk_id") == chunk_id)
    own = one.select("chunk_id", "start_line", "end_line", "content", F.lit(True).alias("asked"))
    if radius <= 0:
        return own
    near = S.adjacent(rows, one.select("chunk_id"), min(radius, 200)).select(F.col("near").alias("chunk_id"))
    return own.unionByName(rows.join(near, "chunk_id", "left_semi").select("chunk_id", "start_line", "end_line", "content", F.lit(False).alias("asked"))).orderBy("start_line")


def get_chunk_meta(index: Index, chunk_id: str, commit_limit: int = 10) -> DataFrame:
    """A chunk's latest commits with their rank."""
    return H.top_commits(index.commits.where(F.col("chunk_id") == chunk_id), clamp(commit_limit, 50, 10))


def search_changes(index: Index, query: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """search_code over chunks changed since an instant."""
    rows = index.chunks if since is None else index.chunks.join(H.changed_since(index.commits, since), "chunk_id", "left_semi")
    return search_code(Index(rows, embedder=index.embedder), query, limit=limit)


def explain_feature(index: Index, question: str, limit: int | None = None) -> DataFrame:
    """The chunks of a feature with their latest commit, tickets and number of edges."""
    top = search_code(index, question, limit=clamp(limit, 20))
    last = H.top_commits(index.commits.join(top.select("chunk_id"), "chunk_id", "left_semi"), 1).select("chunk_id", "commit_hash", "committed_at")
    tickets = H.chunk_tickets(index.commits.join(top.select("chunk_id"), "chunk_id", "left_semi")).groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("ticket_key")), " ").alias("tickets"))
    degree = G.degrees(index.edges).select("chunk_id", (F.col("in_degree") + F.col("out_degree")).alias("edges"))
    return top.join(last, "chunk_id", "left").join(tickets, "chunk_id", "left").join(degree, "chunk_id", "left")


def recent_changes(index: Index, question: str, since: str | None = None, limit: int = 10) -> DataFrame:
    """The commits of the chunks that a question finds, the latest first."""
    top = search_changes(index, question, since, limit)
    return H.timeline(H.top_commits(index.commits.join(top.select("chunk_id"), "chunk_id", "left_semi"), 10), 50)


def impact_analysis(index: Index, question: str, limit: int | None = None, hops: int = 1) -> DataFrame:
    """Chunks by service within reach of those that a question finds."""
    seeds = search_code(index, question, limit=clamp(limit, 10)).select("chunk_id")
    return G.by_service(G.impact(index.edges, seeds, max(1, min(2, hops))), index.chunks.dropDuplicates(["chunk_id"]))


def list_projects(index: Index, group: str | None = None) -> DataFrame:
    return S.project_facets(index.chunks if group is None else index.chunks.where(F.col("grp") == group))


def arch_context(index: Index, question: str, project: str | None = None, min_score: float = fixed.MIN_SCORE, limits: dict[str, int] | None = None, history: bool = False) -> DataFrame:
    """The cards that bear on a question, as many of a kind as its limit allows. cards: id, arch_kind, project, status, vector.

    Each kind is searched by itself, and within it the project's own cards, which the boost lifts alike; so no kind crowds
    out another.
    """
    cards = M.current(index.cards, history)
    cards = cards if project is None else M.visible(cards, project)
    own = F.coalesce(F.col("project") == F.lit(project), F.lit(False)).cast("string")
    corpus = cards.withColumnRenamed("id", "card_id").withColumn("id", F.xxhash64("card_id")).withColumn("place", F.concat_ws("/", own, "arch_kind"))
    hits = S.top_k(index.vectors_of([_asked(question)]), corpus, max([5, *(limits or {}).values()]), by="place").join(corpus.drop("vector", "place"), "id").drop("id", "rank")
    return M.top_by_kind(M.boosted(hits, project or "", min_score), limits or {}, key="card_id")


def record_cards(index: Index, cards: DataFrame) -> tuple[Index, DataFrame]:
    """The index with new cards (columns of index.cards), and what became of each; see memory.recorded."""
    after, outcome = M.recorded(index.cards, cards)
    return replace(index, cards=after), outcome


def record_terms(index: Index, terms: DataFrame) -> tuple[Index, DataFrame]:
    after, outcome = M.recorded(index.terms, terms, kind=None)
    return replace(index, terms=after), outcome


def search_docs(index: Index, query: str, project: str | None = None, audience: list[str] | None = None, ceiling: list[str] | None = None, limit: int = 8) -> DataFrame:
    """The best documents by dense and full-text rank, fused, each with the parts around its best one: doc_id, content, start_line, end_line, score."""
    rows = S.for_audience(index.parts, S.audience_ceiling(audience, ceiling))
    rows = rows if project is None else rows.where(F.col("project") == project)
    rows = rows.withColumn("id", F.xxhash64("doc_id", "idx"))
    most = max(4 * limit, 20)
    dense = S.top_k(index.vectors_of([_asked(query)]), rows.select("id", "vector"), most).select("id", "rank")
    sparse_rows = rows.select(F.lit("all").alias("grp"), "id", F.col("content").alias("text"))
    q = S.query_vectors(index.spark.createDataFrame([(0, query)], "query_id int, query string"), *S.corpus_stats(sparse_rows))
    sparse = S.sparse_search(S.document_vectors(sparse_rows), q, most).select("id", "rank")
    fused = S.rrf([dense, sparse], ["id"]).orderBy(F.col("score").desc(), "id").limit(2 * limit).join(rows.select("id", "doc_id", "idx"), "id")
    top = S.best_per(fused, "doc_id", "idx").orderBy(F.col("score").desc(), "doc_id").limit(limit)
    return S.with_neighbours(top.select("doc_id", "idx"), rows.select("doc_id", "idx", "content", "start_line", "end_line")).join(top.select("doc_id", "score"), "doc_id").orderBy(F.col("score").desc(), "doc_id")


def term_search(index: Index, query: str, project: str | None = None, limit: int = 8) -> DataFrame:
    terms = index.terms if project is None else M.visible_terms(index.terms, project)
    rows = terms.withColumn("term_id", F.col("id"))
    return _ranked(index, rows.drop("id"), [_asked(query)], limit, "term_id").select("term_id", "term", "score", "rank")


def delete_project(index: Index, group: str, project: str) -> Index:
    """The index without a project of a group: its chunks, parts, cards and terms, and the edges and commits of its chunks."""
    gone = index.chunks.where((F.col("grp") == group) & (F.col("project") == project)).select("chunk_id").distinct()
    kept = K.delete_where(index.chunks, grp=group, project=project)
    gone = gone.join(kept.select("chunk_id"), "chunk_id", "left_anti")
    edges = index.edges
    for end in ("from_chunk_id", "to_chunk_id"):
        edges = edges if edges is None else edges.join(gone.withColumnRenamed("chunk_id", end), end, "left_anti").select(index.edges.columns)
    commits = None if index.commits is None else index.commits.join(gone, "chunk_id", "left_anti")
    own = lambda rows: rows if rows is None else K.delete_where(rows, **({"grp": group} if "grp" in rows.columns else {}), project=project)
    return Index(kept, edges, commits, own(index.parts), own(index.cards), own(index.terms), index.embedder)


def health_check(index: Index) -> DataFrame:
    """Rows and the rows without a vector of each table that there is: name, rows, without_vector."""
    found = None
    for name in ("chunks", "edges", "commits", "parts", "cards", "terms"):
        rows = getattr(index, name)
        if rows is not None:
            lacks = F.count_if(F.col("vector").isNull()) if "vector" in rows.columns else F.lit(0)
            one = rows.agg(F.count("*").alias("rows"), lacks.cast("long").alias("without_vector")).select(F.lit(name).alias("name"), "rows", "without_vector")
            found = one if found is None else found.unionByName(one)
    return found


def fetched(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks for requests (id, ts, user, chunk_id, radius_lines): id with the chunk's columns, and an event for every request, found or not.

    Of rows of a chunk_id that differ the one of least startLine, then content counts.
    """
    order = Window.partitionBy("chunk_id").orderBy("start_line", "end_line", "hash", "file")
    rows = index.chunks.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("chunk_id", "grp", "project", "file", "start_line", "end_line", "content")
    hits = asked.select("id", "chunk_id").join(rows, "chunk_id")
    events = asked.join(rows.select("chunk_id", F.lit(True).alias("there")), "chunk_id", "left").select("id", "ts", "user", "chunk_id", "radius_lines", F.coalesce("there", F.lit(False)).alias("found"))
    return hits, events


def tools_of(mode: str) -> list[str]:
    """The tools that a mode offers; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(sorted(MODES))}")
    return MODES[mode]


def render(rows: DataFrame, title: str, *columns: str) -> DataFrame:
    """One text: a heading and a line for each row, in the order of the lines."""
    line = F.concat(F.lit("- "), F.concat_ws(" | ", *(T.inline(F.col(c).cast("string")) for c in columns)))
    return rows.agg(F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("markdown"))
