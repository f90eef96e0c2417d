"""Queries of the search tools, over an index made of the tables with hashed vectors."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import history as H
from strandline.operators import retrieval as S
from strandline.operators import symbols as Y
from strandline.operators import tools as L
from strandline.plans.registry import Registry
from strandline.sources.embedders import HashingEmbedder
from strandline.views import view

R = Registry()


def _embedded(rows: DataFrame, text) -> DataFrame:
    """rows with the vector of a text, by the hashing embedder."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(HashingEmbedder().embed([t or "" for t in texts])))

    return rows.withColumn("vector", embed(text))


def _index(spark, sf_dir, *need: str) -> L.Index:
    chunks = view(spark, sf_dir, "chunks").where("file IS NOT NULL AND startLine IS NOT NULL").withColumnRenamed("startLine", "start_line").withColumnRenamed("endLine", "end_line").dropDuplicates(["chunk_id"])
    index = L.Index(_embedded(chunks, F.col("content")))
    if "edges" in need:
        index.edges = G.symbol_edges(*Y.uses_and_defs(Y.chunk_symbols(chunks), chunks))
    if "commits" in need:
        index.commits = H.chunk_commits(view(spark, sf_dir, "placed"), view(spark, sf_dir, "commits"), view(spark, sf_dir, "hunks"))
    if "parts" in need:
        parts = view(spark, sf_dir, "doc_parts").select("doc_id", "project", "audience", F.posexplode(F.split("text", "\n\n")).alias("idx", "content")).where("trim(content) <> ''")
        index.parts = _embedded(parts, F.col("content")).withColumn("start_line", F.col("idx")).withColumn("end_line", F.col("idx"))
    if "cards" in need:
        from strandline.operators.memory import card_text

        index.cards = _embedded(view(spark, sf_dir, "arch_cards"), card_text())
    if "terms" in need:
        index.terms = _embedded(view(spark, sf_dir, "glossary_terms"), F.col("definition"))
    return index


def _tool(name: str, need: tuple[str, ...], call, *columns: str):
    @R.query(name)
    @functools.wraps(call)
    def run(spark, sf_dir):
        out = call(_index(spark, sf_dir, *need))
        return out.select(*columns) if columns else out

    return run


_tool("search_code", (), lambda i: L.search_code(i, "restart the cache config", limit=10), "chunk_id", "score", "confidence")
_tool("search_changes", ("commits",), lambda i: L.search_changes(i, "archive bundle", "2025-01-15T00:00:00Z"), "chunk_id", "score")
_tool("explain_feature", ("edges", "commits"), lambda i: L.explain_feature(i, "how does the session cache work"), "chunk_id", "score", "commit_hash", "tickets", "edges")
_tool("recent_changes_for", ("commits",), lambda i: L.recent_changes(i, "session cache"))
_tool("impact_analysis", ("edges",), lambda i: L.impact_analysis(i, "open the socket", hops=2))
_tool("search_docs", ("parts",), lambda i: L.search_docs(i, "restart the queue", ceiling=["public", "internal"]), "doc_id", "start_line", "end_line", "score")
_tool("arch_context_for", ("cards",), lambda i: L.arch_context(i, "pin the cold cache", min_score=0.1, limits={"lesson": 3}), "card_id", "arch_kind", "score", "rank")
_tool("term_search_for", ("terms",), lambda i: L.term_search(i, "word for the neighbour"))
_tool("render_search", (), lambda i: L.render(L.search_code(i, "restart the cache config"), "Results", "chunk_id", "score", "confidence"))


@R.query("fetch_events", "SELECT r.chunk_id, r.chunk_id IN (SELECT chunk_id FROM chunks WHERE file IS NOT NULL AND startLine IS NOT NULL AND chunk_id IS NOT NULL) AS found FROM (SELECT DISTINCT chunk_id FROM search_results WHERE chunk_id IS NOT NULL) r")
def fetch_events(spark, sf_dir):
    """The event that fetching each chunk of the results leaves."""
    chunks = view(spark, sf_dir, "chunks").where("file IS NOT NULL AND startLine IS NOT NULL").withColumnRenamed("startLine", "start_line").withColumnRenamed("endLine", "end_line")
    asked = view(spark, sf_dir, "search_results").where("chunk_id IS NOT NULL").select("chunk_id").distinct().select(F.col("chunk_id").alias("id"), F.lit(0).alias("ts"), F.lit("").alias("user"), "chunk_id", F.lit(0).alias("radius_lines"))
    return L.fetched(L.Index(chunks), asked)[1].select("chunk_id", "found")


@R.query("project_allow_list", "SELECT DISTINCT chunk_id FROM chunks WHERE project = 'atlas-core'")
def project_allow_list(spark, sf_dir):
    chunks = view(spark, sf_dir, "chunks")
    return chunks.where(F.col("project").isin(S.allowed_projects("atlas-core", ["atlas-core", "search-api"]))).select("chunk_id").distinct()


@R.query("audience_any", "SELECT doc_id FROM documents WHERE list_has_any(string_split(audience, ','), ['public', 'internal'])")
def audience_any(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").withColumn("audience", F.split("audience", ","))
    return S.for_audience(docs, ["public", "internal"]).select("doc_id")
