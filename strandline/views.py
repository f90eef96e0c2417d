"""Input tables that the data folders don't hold, derived from those they hold.

Each view is one SELECT that Spark and DuckDB read alike: {q} quotes a name, and names of tables and of
other views stand for themselves. They are stand-ins for logs and indexes of a running system, made by
fixed rules, so that every operator has a whole table to run over.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings search_events search_results source_files chunks chunker_config arch_cards glossary_terms "
    "repo_fingerprints repo_probes embedding_cache doc_levels token_windows"
).split()

VIEWS = {
    # each search once, whatever its deliveries
    "searches": """
        SELECT DISTINCT id, request_id, ts, {q}user{q}, session, client, tool, group_name, anchor_project, query_text, query_hash, query_tokens, limit_param, duration_ms,
               result_count, cache_hit, error
        FROM search_events""",
    # part of the results were opened, some of them twice
    "fetches": """
        SELECT r.search_id || '/' || CAST(r.{q}rank{q} AS STRING) AS id, s.ts + 1500 * (r.{q}rank{q} + 1) AS ts, s.{q}user{q}, s.session, r.chunk_id, r.search_id AS preceding_search_id,
               (r.{q}rank{q} % 3) * 20 AS radius_lines, 5 + r.{q}rank{q} AS duration_ms, 1 AS found
        FROM search_results r JOIN searches s ON s.id = r.search_id
        WHERE r.chunk_id IS NOT NULL AND (r.start_line + r.{q}rank{q}) % 4 = 0""",
    "embedding_calls": """
        SELECT id, ts, {q}user{q}, CASE WHEN tool = 'search_docs' THEN 'text' ELSE 'code' END AS kind, limit_param AS batch_size, cache_hit AS cache_hits, 1 - cache_hit AS cache_miss,
               duration_ms, CASE WHEN error IS NULL THEN 0 ELSE 1 END AS timeout, error
        FROM searches""",
    "tool_calls": "SELECT id, ts, {q}user{q}, session, tool, duration_ms, CASE WHEN error IS NULL THEN 1 ELSE 0 END AS ok, error FROM searches",
    "chunking_errors": """
        SELECT CAST(file_id AS STRING) AS id, indexed_at AS ts, group_name, project_name, file, language,
               CASE WHEN total_bytes = 0 THEN 'ast_chunk_zero' WHEN total_lines % 2 = 0 THEN 'regex_fallback' ELSE 'ast_parse_failed' END AS error_class
        FROM source_files WHERE total_bytes = 0 OR file_id % 7 = 0""",
    "indexing_runs": "SELECT full_name, kind, last_indexed_at, last_chunks FROM repo_fingerprints",
    # definitions and calls by their look in the text
    "chunk_symbols": """
        SELECT chunk_id, grp, project, file,
               CASE WHEN symbol_name IS NULL THEN '' ELSE symbol_name END AS defines, content
        FROM (SELECT chunk_id, grp, project, file, max(symbol_name) AS symbol_name, max(content) AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id, grp, project, file)""",
    "defs": """
        SELECT DISTINCT p AS project, s AS symbol, c AS chunk_id, f AS file FROM (
            SELECT 'p' || CAST(l_suppkey % 5 AS STRING) AS p, 's' || CAST(l_partkey % 400 AS STRING) AS s, CAST(l_orderkey AS STRING) AS c, 'f' || CAST(l_orderkey % 97 AS STRING) AS f, l_returnflag AS r FROM lineitem
        ) WHERE r = 'A'""",
    "uses": """
        SELECT project, symbol, chunk_id, file FROM (
            SELECT 'p' || CAST(l_suppkey % 5 AS STRING) AS project, 's' || CAST(l_partkey % 400 AS STRING) AS symbol, CAST(l_orderkey AS STRING) AS chunk_id, 'f' || CAST(l_orderkey % 97 AS STRING) AS file,
                   l_returnflag AS r, l_linenumber AS n FROM lineitem
        ) WHERE r = 'R' AND n <= 3""",
    # the same of every line item: it either defines or uses its part, so symbols grow with the data and definers per symbol don't
    "all_defs": """
        SELECT DISTINCT 'p' || CAST(l_suppkey % 5 AS STRING) AS project, 's' || CAST(l_partkey AS STRING) AS symbol, CAST(l_orderkey AS STRING) AS chunk_id, 'f' || CAST(l_orderkey % 97 AS STRING) AS file
        FROM lineitem WHERE l_returnflag = 'A'""",
    "all_uses": """
        SELECT 'p' || CAST(l_suppkey % 5 AS STRING) AS project, 's' || CAST(l_partkey AS STRING) AS symbol, CAST(l_orderkey AS STRING) AS chunk_id, 'f' || CAST(l_orderkey % 97 AS STRING) AS file
        FROM lineitem WHERE l_returnflag <> 'A'""",
    "file_heads": """
        SELECT min(file_id) AS file_id, file, min(project_name) AS project_name, max(total_lines) AS total_lines, CAST(min(file_id) % 20 AS INT) AS day FROM source_files GROUP BY file""",
    "commits": """
        SELECT DISTINCT file, substring(md5(file || '/' || n), 1, 12) AS commit_hash,
               CASE WHEN day % 2 = 0 THEN '2025-01-' || substring(CAST(110 + day AS STRING), 2, 2) || 'T0' || n || ':30:00+03:00' ELSE '2025-01-' || substring(CAST(110 + day AS STRING), 2, 2) || 'T0' || n || ':30:00Z' END AS committed_at,
               project_name || '@example.org' AS author_email,
               CASE WHEN n = '1' THEN 'feat: PROJ-' || CAST(file_id % 50 AS STRING) || ' for ' || project_name || '/core#7' WHEN n = '2' THEN 'fix: closes #' || CAST(file_id % 30 AS STRING) ELSE 'chore' END AS subject,
               CAST(n AS INT) AS n, total_lines
        FROM (SELECT *, '1' AS n FROM file_heads UNION ALL SELECT *, '2' AS n FROM file_heads UNION ALL SELECT *, '3' AS n FROM file_heads)""",
    # the third commit of a file has no hunks
    "hunks": "SELECT file, commit_hash, n * 10 AS start_line, n * 10 + 25 AS end_line FROM commits WHERE n < 3",
    "placed": """
        SELECT DISTINCT chunk_id, grp, project, file, startLine AS start_line, endLine AS end_line, symbol_name, kind, service, bounded_context
        FROM chunks WHERE chunk_id IS NOT NULL AND file IS NOT NULL AND startLine IS NOT NULL""",
    # vectors with what a chunk, card or term has besides
    "points": """
        SELECT vec_id, embedding AS vector, 'g' || CAST(label % 2 AS STRING) AS grp, 'p' || CAST(label AS STRING) AS project, 'f' || CAST(vec_id % 37 AS STRING) AS file,
               'h' || CAST(vec_id % 450 AS STRING) AS hash, CASE WHEN label % 3 = 0 THEN 'component' WHEN label % 3 = 1 THEN 'decision' ELSE 'lesson' END AS arch_kind,
               CASE WHEN vec_id % 4 = 0 THEN NULL ELSE 'p' || CAST(label AS STRING) END AS scope_project,
               CASE WHEN vec_id % 10 = 0 THEN 'superseded' WHEN vec_id % 10 = 1 THEN 'deprecated' WHEN vec_id % 10 = 2 THEN NULL ELSE 'accepted' END AS status
        FROM embeddings""",
    # lines of a page as its parts
    "doc_parts": """
        SELECT doc_id, text, project, file, doc_title, CASE WHEN audience IS NULL THEN 'internal' ELSE audience END AS audience, lang
        FROM documents WHERE text IS NOT NULL""",
}


def needed(sql: str) -> list[str]:
    """The views a statement uses, in order of definition, with those they use."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                todo.append(VIEWS[name])
    order: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other in found and other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", VIEWS[name]):
                add(other)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if name in found:
            add(name)
    return order


def oracle(sql: str) -> str:
    """A DuckDB statement with the views it uses."""
    sql = sql.strip().replace("{q}", '"')
    views = needed(sql)
    if not views:
        return sql
    heads = ",\n".join(f"{v} AS ({VIEWS[v].strip().replace('{q}', chr(34))})" for v in views)
    return f"WITH {heads}{',' if sql.upper().startswith('WITH ') else ''}\n{sql[5:] if sql.upper().startswith('WITH ') else sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table of a data folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    heads = [f"{v} AS ({VIEWS[v]})" for v in needed(f"FROM {name}") if v != name]
    sql = f"WITH {', '.join(heads)} {sql}" if heads else sql
    sql = sql.replace("{q}", "`")
    for t in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)
