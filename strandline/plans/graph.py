"""Queries of the symbol graph and of history."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.operators import graph as G
from strandline.operators import history as H
from strandline.plans.registry import Registry
from strandline.views import oracle, view

R = Registry()

_EDGES = f"""
    f AS (SELECT project, symbol, count(DISTINCT chunk_id) AS n FROM all_defs GROUP BY 1, 2),
    edges AS (SELECT DISTINCT u.project, u.chunk_id AS from_chunk_id, d.chunk_id AS to_chunk_id, 'calls' AS relation_type, u.symbol AS symbol_name,
        CASE WHEN f.n > 1 THEN 'AMBIGUOUS' WHEN u.file = d.file THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence
        FROM all_uses u JOIN f ON f.project = u.project AND f.symbol = u.symbol AND f.n <= {fixed.MAX_FANOUT} JOIN all_defs d ON d.project = u.project AND d.symbol = u.symbol WHERE u.chunk_id <> d.chunk_id),
    ends AS (SELECT to_chunk_id AS chunk_id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT from_chunk_id, 0, 1 FROM edges),
    degree AS (SELECT chunk_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM ends GROUP BY 1),
    pin AS (SELECT in_degree AS p95_in_degree FROM (SELECT in_degree, row_number() OVER (ORDER BY in_degree) - 1 AS i, count(*) OVER () AS n FROM degree WHERE in_degree > 0) WHERE i = least(n - 1, floor(n * 0.95))),
    pout AS (SELECT out_degree AS p95_out_degree FROM (SELECT out_degree, row_number() OVER (ORDER BY out_degree) - 1 AS i, count(*) OVER () AS n FROM degree WHERE out_degree > 0) WHERE i = least(n - 1, floor(n * 0.95))),
    hub AS (SELECT chunk_id, in_degree, out_degree FROM degree, pin, pout WHERE in_degree >= greatest(5, p95_in_degree) OR out_degree >= greatest(5, p95_out_degree)),
    seeds AS (SELECT DISTINCT chunk_id FROM all_uses WHERE symbol = 's7'),
    ways AS (SELECT from_chunk_id AS node, to_chunk_id AS other, symbol_name FROM edges UNION ALL SELECT to_chunk_id, from_chunk_id, symbol_name FROM edges),
    hop1 AS (SELECT DISTINCT other AS chunk_id FROM ways WHERE node IN (SELECT chunk_id FROM seeds) AND other NOT IN (SELECT chunk_id FROM seeds)),
    start1 AS (SELECT chunk_id FROM hop1 ORDER BY chunk_id LIMIT 50),
    hop2 AS (SELECT DISTINCT other AS chunk_id FROM ways WHERE node IN (SELECT chunk_id FROM start1) AND other NOT IN (SELECT chunk_id FROM seeds) AND other NOT IN (SELECT chunk_id FROM hop1)),
    reached AS (SELECT chunk_id, 1 AS hop FROM hop1 UNION ALL (SELECT chunk_id, 2 FROM hop2 ORDER BY chunk_id LIMIT 50))
"""


def _sql(select: str) -> str:
    return oracle(f"WITH {_EDGES.strip()} {select}")


def _edges(spark, sf_dir):
    return G.symbol_edges(view(spark, sf_dir, "all_uses"), view(spark, sf_dir, "all_defs"))


def _seeds(spark, sf_dir):
    return view(spark, sf_dir, "all_uses").where("symbol = 's7'").select("chunk_id").distinct()


@R.query("symbol_edges", _sql("SELECT * FROM edges"))
def symbol_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@R.query("edge_stats", oracle(f"WITH f AS (SELECT project, symbol, count(DISTINCT chunk_id) AS n FROM all_defs GROUP BY 1, 2 HAVING count(DISTINCT chunk_id) > {fixed.MAX_FANOUT}) SELECT count(DISTINCT (u.project, u.symbol)) AS skipped_symbols, coalesce(sum(n), 0)::BIGINT AS skipped_edges FROM all_uses u JOIN f USING (project, symbol)"))
def edge_stats(spark, sf_dir):
    return G.edge_stats(view(spark, sf_dir, "all_uses"), view(spark, sf_dir, "all_defs"))


@R.query("degree_stats", _sql("SELECT * FROM degree"))
def degree_stats(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@R.query("degree_p95", _sql("SELECT p95_in_degree, p95_out_degree FROM pin, pout"))
def degree_p95(spark, sf_dir):
    return G.p95_degrees(G.degrees(_edges(spark, sf_dir)))


@R.query("hubs", _sql("SELECT * FROM hub"))
def hubs(spark, sf_dir):
    return G.hubs(G.degrees(_edges(spark, sf_dir)))


@R.query(
    "find_usages",
    _sql("""SELECT chunk_id, direction, other, symbol_name, confidence, hub FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, direction ORDER BY symbol_name, other) AS rn FROM (
        SELECT to_chunk_id AS chunk_id, 'incoming' AS direction, from_chunk_id AS other, symbol_name, confidence, from_chunk_id IN (SELECT chunk_id FROM hub) AS hub FROM edges
        UNION ALL SELECT from_chunk_id, 'outgoing', to_chunk_id, symbol_name, confidence, to_chunk_id IN (SELECT chunk_id FROM hub) FROM edges) WHERE chunk_id IN (SELECT chunk_id FROM seeds)) WHERE rn <= 20"""),
)
def find_usages(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.find_usages(e, _seeds(spark, sf_dir), G.hubs(G.degrees(e)))


@R.query("find_usages_no_hubs", _sql("SELECT chunk_id, 'incoming' AS direction, other, symbol_name, confidence, false AS hub FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY symbol_name, other) AS rn FROM (SELECT to_chunk_id AS chunk_id, from_chunk_id AS other, symbol_name, confidence FROM edges WHERE to_chunk_id IN (SELECT chunk_id FROM seeds) AND from_chunk_id NOT IN (SELECT chunk_id FROM hub))) WHERE rn <= 20"))
def find_usages_no_hubs(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.find_usages(e, _seeds(spark, sf_dir), G.hubs(G.degrees(e)), "incoming", ["calls"], include_hubs=False)


@R.query("impact_1hop", _sql("SELECT chunk_id, 1 AS hop FROM hop1"))
def impact_1hop(spark, sf_dir):
    return G.impact(_edges(spark, sf_dir), _seeds(spark, sf_dir), 1)


@R.query("impact_2hop", _sql("SELECT * FROM reached"))
def impact_2hop(spark, sf_dir):
    return G.impact(_edges(spark, sf_dir), _seeds(spark, sf_dir))


@R.query("impact_edges", _sql("SELECT DISTINCT from_chunk_id, to_chunk_id, symbol_name FROM edges WHERE from_chunk_id IN (SELECT chunk_id FROM seeds UNION SELECT chunk_id FROM start1) OR to_chunk_id IN (SELECT chunk_id FROM seeds UNION SELECT chunk_id FROM start1)"))
def impact_edges(spark, sf_dir):
    return G.impact_edges(_edges(spark, sf_dir), _seeds(spark, sf_dir))


_PLACES = "(SELECT DISTINCT chunk_id, 'f' || chunk_id::BIGINT % 97 AS file, CASE WHEN chunk_id::BIGINT % 3 = 0 THEN NULL ELSE 'svc' || chunk_id::BIGINT % 4 END AS service, CASE WHEN chunk_id::BIGINT % 9 = 0 THEN 'ctx' END AS bounded_context FROM all_defs)"


def _places(spark, sf_dir):
    n = F.col("chunk_id").cast("long")
    service = F.when(n % 3 != 0, F.concat(F.lit("svc"), n % 4))
    return view(spark, sf_dir, "all_defs").select("chunk_id", F.concat(F.lit("f"), n % 97).alias("file"), service.alias("service"), F.when(n % 9 == 0, "ctx").alias("bounded_context")).distinct()


@R.query("impact_by_service", _sql(f"SELECT coalesce(service, bounded_context, 'unknown') AS service, hop, count(*) AS chunks FROM reached JOIN {_PLACES} USING (chunk_id) GROUP BY 1, 2"))
def impact_by_service(spark, sf_dir):
    return G.by_service(G.impact(_edges(spark, sf_dir), _seeds(spark, sf_dir)), _places(spark, sf_dir))


@R.query("edges_by_symbol", _sql("SELECT symbol_name, count(*) AS edges, count(DISTINCT from_chunk_id) AS callers, count(DISTINCT to_chunk_id) AS definitions FROM edges GROUP BY 1"))
def edges_by_symbol(spark, sf_dir):
    return G.by_symbol(_edges(spark, sf_dir))


@R.query("top_called", _sql("SELECT to_chunk_id AS chunk_id, count(*) AS in_degree FROM edges WHERE project = 'p2' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_called(spark, sf_dir):
    return G.top_called(_edges(spark, sf_dir), project="p2")


@R.query(
    "suggest_components",
    _sql(f"""SELECT file, chunk_id, in_degree FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY in_degree DESC, chunk_id) AS rn FROM (
        SELECT t.chunk_id, p.file, t.in_degree FROM (SELECT to_chunk_id AS chunk_id, count(*) AS in_degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) t JOIN {_PLACES} p USING (chunk_id))
        WHERE file NOT IN (SELECT DISTINCT 'f' || s_suppkey % 40 FROM supplier)) WHERE rn = 1 ORDER BY in_degree DESC, file LIMIT 10"""),
)
def suggest_components(spark, sf_dir):
    covered = view(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey") % 40).alias("file"))
    return G.suggest_components(_edges(spark, sf_dir), _places(spark, sf_dir), covered)


_COMMITS = """
    cc AS (SELECT DISTINCT p.chunk_id, c.commit_hash, c.committed_at, c.author_email, c.subject FROM placed p JOIN commits c ON c.file = p.file
        WHERE EXISTS (SELECT 1 FROM hunks h WHERE h.file = p.file AND h.commit_hash = c.commit_hash AND h.start_line <= p.end_line AND h.end_line >= p.start_line)
           OR NOT EXISTS (SELECT 1 FROM hunks h WHERE h.file = c.file AND h.commit_hash = c.commit_hash)),
    tk AS (SELECT DISTINCT commit_hash, key, source FROM (
        SELECT commit_hash, unnest(regexp_extract_all(subject, '\\b([A-Z]{2,}-\\d+)\\b', 1)) AS key, 'jira' AS source FROM commits
        UNION ALL SELECT commit_hash, '#' || unnest(regexp_extract_all(subject, '(?:^|\\s)#(\\d+)\\b', 1)), 'github' FROM commits
        UNION ALL SELECT commit_hash, unnest(regexp_extract_all(subject, '\\b([\\w.-]+/[\\w.-]+#\\d+)\\b', 1)), 'github' FROM commits))
"""


def _chunk_commits(spark, sf_dir):
    return H.chunk_commits(view(spark, sf_dir, "placed"), view(spark, sf_dir, "commits"), view(spark, sf_dir, "hunks"))


@R.query("chunk_commits", oracle(f"WITH {_COMMITS.strip()} SELECT * FROM cc"))
def chunk_commits(spark, sf_dir):
    return _chunk_commits(spark, sf_dir)


@R.query("latest_commit", oracle(f"WITH {_COMMITS.strip()} SELECT * FROM (SELECT chunk_id, commit_hash, committed_at, row_number() OVER (PARTITION BY chunk_id ORDER BY committed_at DESC, commit_hash)::INT AS rank FROM cc) WHERE rank <= 1"))
def latest_commit(spark, sf_dir):
    return H.top_commits(_chunk_commits(spark, sf_dir), 1).select("chunk_id", "commit_hash", "committed_at", "rank")


@R.query("top_commits_by_instant", oracle(f"WITH {_COMMITS.strip()} SELECT * FROM (SELECT chunk_id, commit_hash, row_number() OVER (PARTITION BY chunk_id ORDER BY committed_at::TIMESTAMPTZ DESC, commit_hash)::INT AS rank FROM cc) WHERE rank <= 2"))
def top_commits_by_instant(spark, sf_dir):
    return H.top_commits(_chunk_commits(spark, sf_dir), 2, by_instant=True).select("chunk_id", "commit_hash", "rank")


@R.query("chunk_tickets", oracle(f"WITH {_COMMITS.strip()} SELECT chunk_id, key AS ticket_key, max(source) AS source FROM cc JOIN tk USING (commit_hash) GROUP BY 1, 2"))
def chunk_tickets(spark, sf_dir):
    return H.chunk_tickets(_chunk_commits(spark, sf_dir))


@R.query("changed_since", oracle(f"WITH {_COMMITS.strip()} SELECT chunk_id FROM cc GROUP BY 1 HAVING max(committed_at::TIMESTAMPTZ) >= '2025-01-15T00:00:00Z'::TIMESTAMPTZ"))
def changed_since(spark, sf_dir):
    return H.changed_since(_chunk_commits(spark, sf_dir), "2025-01-15T00:00:00Z")


@R.query(
    "recent_changes",
    oracle(f"""WITH {_COMMITS.strip()} SELECT commit_hash, max(committed_at) AS committed_at, string_split(max(committed_at), 'T')[1] AS day, count(DISTINCT chunk_id) AS chunks,
        coalesce((SELECT string_agg(key, ' ' ORDER BY key) FROM (SELECT DISTINCT key FROM tk WHERE tk.commit_hash = cc.commit_hash)), '') AS tickets FROM cc GROUP BY commit_hash"""),
)
def recent_changes(spark, sf_dir):
    return H.timeline(_chunk_commits(spark, sf_dir))


_LOG = "SELECT commit_hash || '|' || committed_at || '|' || author_email || '|' || subject || '|x' AS line FROM commits UNION ALL SELECT 'broken|' || file FROM commits"


@R.query("parse_git_log", oracle("SELECT DISTINCT commit_hash, committed_at, author_email, subject || '|x' AS subject FROM commits"))
def parse_git_log(spark, sf_dir):
    c = view(spark, sf_dir, "commits")
    lines = c.select(F.concat_ws("|", "commit_hash", "committed_at", "author_email", "subject", F.lit("x")).alias("line")).unionByName(c.select(F.concat(F.lit("broken|"), "file").alias("line")))
    return H.parse_log(lines).distinct()


@R.query("parse_diff_hunks", oracle("SELECT file, md5(commit_hash) || commit_hash[:8] AS commit_hash, n * 10 AS start_line, n * 10 + CASE n WHEN 1 THEN 0 WHEN 2 THEN 24 ELSE 0 END AS end_line FROM commits"))
def parse_diff_hunks(spark, sf_dir):
    c = view(spark, sf_dir, "commits").withColumn("sha", F.concat(F.md5("commit_hash"), F.left("commit_hash", F.lit(8))))
    heads = c.select("file", (F.col("n") * 2).alias("line_no"), F.col("sha").alias("line"))
    size = F.when(F.col("n") == 1, "").when(F.col("n") == 2, ",25").otherwise(",0")
    hunks = c.select("file", (F.col("n") * 2 + 1).alias("line_no"), F.concat(F.lit("@@ -1,2 +"), F.col("n") * 10, size, F.lit(" @@ f()")).alias("line"))
    return H.parse_hunks(heads.unionByName(hunks))


@R.query("remote_heads", "SELECT DISTINCT fingerprint AS sha FROM repo_probes WHERE regexp_matches(fingerprint, '^[0-9a-f]{40}$')")
def remote_heads(spark, sf_dir):
    p = view(spark, sf_dir, "repo_probes").where("fingerprint IS NOT NULL")
    lines = p.select(F.concat("fingerprint", F.lit("\tHEAD")).alias("line")).unionByName(p.select(F.lit("ref: refs/heads/main\tHEAD").alias("line")))
    return H.head_of(lines).distinct()


@R.query("captures_in_chunks", oracle("SELECT DISTINCT p.chunk_id, 'sym' || f.file_id AS symbol, 5 AS {q}row{q} FROM source_files f JOIN placed p ON p.file = f.file WHERE 5 BETWEEN p.start_line AND p.end_line"))
def captures_in_chunks(spark, sf_dir):
    captures = view(spark, sf_dir, "source_files").select("file", F.lit(5).alias("row"), F.concat(F.lit("sym"), "file_id").alias("symbol"))
    return H.captures_in_chunks(captures, view(spark, sf_dir, "placed")).distinct()
