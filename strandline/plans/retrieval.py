"""Queries of vector, full-text and hybrid search, of cards and terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions import vectors as V
from strandline.operators import memory as M
from strandline.operators import retrieval as S
from strandline.plans.registry import Registry
from strandline.plans.text import _list
from strandline.views import oracle, view

R = Registry()

_SIM = "list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[])"


def _top(where: str = "TRUE", k: int = 10) -> str:
    return oracle(f"""SELECT query_id, id, round(s, 6) AS score, rank::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_SIM} AS s,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_SIM}, 9) DESC, b.vec_id) AS rank FROM points a JOIN points b ON {where} WHERE a.vec_id % 100 = 0) WHERE rank <= {k}""")


def _points(spark, sf_dir):
    return view(spark, sf_dir, "points").withColumn("id", F.col("vec_id"))


def _search(spark, sf_dir, keep=None, k: int = 10):
    p = _points(spark, sf_dir)
    return S.top_k(p.where("vec_id % 100 = 0"), p if keep is None else p.where(keep), k)


@R.query("vector_topk", _top())
def vector_topk(spark, sf_dir):
    return _search(spark, sf_dir)


@R.query("vector_topk_filtered", _top("b.grp = 'g1' AND b.project IN ('p1', 'p3')"))
def vector_topk_filtered(spark, sf_dir):
    return _search(spark, sf_dir, (F.col("grp") == "g1") & F.col("project").isin("p1", "p3"))


@R.query("vector_topk_current", _top("coalesce(b.status, '') NOT IN ('superseded', 'deprecated')", 5))
def vector_topk_current(spark, sf_dir):
    return S.top_k(_points(spark, sf_dir).where("vec_id % 100 = 0"), M.current(_points(spark, sf_dir)), 5)


@R.query("cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


_TERMS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_list(fixed.TERM_STOP_WORDS)}, t))"
_BM = f"""
    t AS (SELECT audience AS grp, doc_id AS id, {_TERMS} AS terms FROM doc_parts),
    df AS (SELECT grp, term, count(*) AS df FROM (SELECT grp, unnest(list_distinct(terms)) AS term FROM t) GROUP BY 1, 2),
    totals AS (SELECT grp, count(*) AS n, avg(len(terms)) AS average FROM t GROUP BY 1),
    tf AS (SELECT grp, id, length, term, count(*) AS tf FROM (SELECT grp, id, len(terms) AS length, unnest(terms) AS term FROM t) GROUP BY 1, 2, 3, 4),
    w AS (SELECT tf.grp, tf.id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS weight FROM tf JOIN df ON df.grp = tf.grp AND df.term = tf.term JOIN totals ON totals.grp = tf.grp),
    q AS (SELECT x.query_id, totals.grp, x.term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS weight FROM (SELECT 1 AS query_id, unnest(['restart', 'cache', 'team', 'nosuchterm']) AS term UNION ALL SELECT 2, unnest(['release', 'queue', 'archive'])) x
        CROSS JOIN totals LEFT JOIN df ON df.grp = totals.grp AND df.term = x.term),
    sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, id) AS rank FROM (
        SELECT q.query_id, w.grp, w.id, round(sum(w.weight * q.weight), 6) AS score FROM w JOIN q ON q.grp = w.grp AND q.term = w.term GROUP BY 1, 2, 3)) WHERE rank <= 20)
"""
_QUERIES = [(1, "the restart of the cache team nosuchterm"), (2, "release queue archive, release")]


def _parts(spark, sf_dir):
    return view(spark, sf_dir, "doc_parts").select(F.col("audience").alias("grp"), F.col("doc_id").alias("id"), "text")


def _sparse(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return S.search_text(parts, spark.createDataFrame(_QUERIES, "query_id int, query string"), 20)


@R.query("corpus_stats", oracle(f"WITH {_BM.strip()} SELECT grp, n, round(average, 6) AS average, (SELECT count(*) FROM df WHERE df.grp = totals.grp) AS terms FROM totals"))
def corpus_stats(spark, sf_dir):
    df, totals = S.corpus_stats(_parts(spark, sf_dir))
    return totals.join(df.groupBy("grp").agg(F.count("*").alias("terms")), "grp").select("grp", "n", F.round("average", 6).alias("average"), "terms")


@R.query("document_frequencies", oracle(f"WITH {_BM.strip()} SELECT grp, term, df FROM df"))
def document_frequencies(spark, sf_dir):
    return S.corpus_stats(_parts(spark, sf_dir))[0]


@R.query("bm25_document_vectors", oracle(f"WITH {_BM.strip()} SELECT grp, id, count(*) AS terms, round(sum(weight), 4) AS total, round(max(weight), 6) AS top FROM w GROUP BY 1, 2"))
def bm25_document_vectors(spark, sf_dir):
    w = S.document_vectors(_parts(spark, sf_dir))
    return w.groupBy("grp", "id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 6).alias("top"))


@R.query("bm25_search", oracle(f"WITH {_BM.strip()} SELECT query_id, grp, id, score, rank::INT AS rank FROM sp"))
def bm25_search(spark, sf_dir):
    return _sparse(spark, sf_dir).select("query_id", "grp", "id", "score", "rank")


_PARA = "pp AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS idx, unnest(string_split(text, chr(10) || chr(10))) AS content FROM doc_parts)"


def _paragraphs(spark, sf_dir):
    rows = view(spark, sf_dir, "doc_parts").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("idx", "content"))
    return rows.withColumn("start_line", F.col("idx") * 10).withColumn("end_line", F.col("idx") * 10 + 9)


# every paragraph as a hit
@R.query(
    "neighbour_merge",
    oracle(f"""WITH {_PARA} SELECT h.doc_id, h.idx::INT AS hit, md5(string_agg(p.content, chr(10) || chr(10) ORDER BY p.idx)) AS content, min(p.idx * 10)::INT AS start_line, max(p.idx * 10 + 9)::INT AS end_line
    FROM pp h JOIN pp p ON p.doc_id = h.doc_id AND p.idx BETWEEN h.idx - 1 AND h.idx + 1 GROUP BY 1, 2"""),
)
def neighbour_merge(spark, sf_dir):
    parts = _paragraphs(spark, sf_dir)
    return S.with_neighbours(parts.select("doc_id", "idx"), parts).withColumn("content", F.md5("content"))


@R.query("best_per_document", oracle(f"WITH {_PARA} SELECT doc_id, idx::INT AS idx, length(content)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, idx) AS rn FROM pp) WHERE rn = 1"))
def best_per_document(spark, sf_dir):
    hits = _paragraphs(spark, sf_dir).select("doc_id", "idx", F.length("content").cast("double").alias("score"))
    return S.best_per(hits, "doc_id", "idx")


@R.query("audience_filter", "SELECT doc_id FROM documents WHERE audience IN ('public')")
def audience_filter(spark, sf_dir):
    return S.for_audience(view(spark, sf_dir, "documents"), S.audience_ceiling(["public", " internal "], ["public"])).select("doc_id")


@R.query("list_projects", "SELECT grp, project, count(*) AS chunks, coalesce(string_agg(DISTINCT lower(language), ' ' ORDER BY lower(language)), '') AS languages FROM chunks GROUP BY 1, 2")
def list_projects(spark, sf_dir):
    return S.project_facets(view(spark, sf_dir, "chunks"))


@R.query("group_counts", "SELECT grp, count(*) AS chunks FROM chunks WHERE chunk_id <> '__meta' GROUP BY 1")
def group_counts(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where("chunk_id <> '__meta'").groupBy("grp").agg(F.count("*").alias("chunks"))


@R.query("line_overlap", oracle("SELECT DISTINCT chunk_id FROM placed WHERE start_line <= 40 AND end_line >= 20"))
def line_overlap(spark, sf_dir):
    return S.overlapping(view(spark, sf_dir, "placed"), 20, 40).select("chunk_id").distinct()


@R.query(
    "adjacent_chunks",
    oracle("SELECT DISTINCT a.chunk_id, b.chunk_id AS near, b.start_line FROM placed a JOIN placed b ON a.grp = b.grp AND a.project = b.project AND a.file = b.file WHERE b.start_line <= a.end_line + 20 AND b.end_line >= a.start_line - 20 AND a.chunk_id <> b.chunk_id"),
)
def adjacent_chunks(spark, sf_dir):
    p = view(spark, sf_dir, "placed")
    return S.adjacent(p, p.select("chunk_id").distinct(), 20).distinct()


@R.query("get_chunk_meta", oracle("SELECT chunk_id, min(start_line) AS start_line, max(end_line) AS end_line, min(coalesce(service, project)) AS service FROM placed GROUP BY 1"))
def get_chunk_meta(spark, sf_dir):
    p = view(spark, sf_dir, "placed")
    return p.groupBy("chunk_id").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min(F.coalesce("service", "project")).alias("service"))


# new records: the vectors asked, moved a little towards another; known: all cards
_NEW = "SELECT n.vec_id, n.arch_kind, n.scope_project, list_transform(list_zip(n.vector, o.vector), lambda z: z[1]::DOUBLE * 0.9 + z[2]::DOUBLE * (n.vec_id % 700 // 100) * 0.15) AS vector FROM points n JOIN points o ON o.vec_id = n.vec_id + 3 WHERE n.vec_id % 100 = 0"


@R.query(
    "similarity_gate",
    oracle(f"""WITH nw AS ({_NEW}), s AS (SELECT a.vec_id, b.vec_id::VARCHAR AS nearest, round({_SIM}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_SIM}, 9) DESC) AS r
        FROM nw a JOIN points b ON b.arch_kind = a.arch_kind AND coalesce(b.status, '') NOT IN ('superseded', 'deprecated') AND (b.scope_project IS NULL OR b.scope_project = a.scope_project))
    SELECT nw.vec_id::VARCHAR AS id, nearest, score, CASE WHEN score >= 0.85 THEN 'duplicate' WHEN score >= 0.7 THEN 'similar' ELSE 'created' END AS outcome FROM nw LEFT JOIN s ON s.vec_id = nw.vec_id AND r = 1"""),
)
def similarity_gate(spark, sf_dir):
    p = _points(spark, sf_dir)
    after = p.select((F.col("id") - 3).alias("id"), F.col("vector").alias("next"))
    moved = F.zip_with("vector", "next", lambda x, y: x.cast("double") * 0.9 + y.cast("double") * F.floor(F.col("id") % 700 / 100) * 0.15)
    named = lambda df, v: df.select(F.col("id").cast("string").alias("id"), "arch_kind", "status", F.col("scope_project").alias("project"), v)
    new = p.where("id % 100 = 0").join(after, "id")
    return M.near_new(named(p, F.col("vector")), named(new, moved.alias("vector")))


@R.query("term_search", _top("b.scope_project IS NULL OR b.scope_project = 'p2'", 8))
def term_search(spark, sf_dir):
    p = _points(spark, sf_dir)
    return S.top_k(p.where("vec_id % 100 = 0"), M.visible_terms(p, "p2", "scope_project"), 8)


@R.query("arch_list_page", "SELECT id, arch_kind, updatedAt FROM arch_cards WHERE id > '8' AND coalesce(status, '') NOT IN ('superseded', 'deprecated') ORDER BY id LIMIT 25")
def arch_list_page(spark, sf_dir):
    return M.page(M.current(view(spark, sf_dir, "arch_cards")), "id", "8", 25).select("id", "arch_kind", "updatedAt")


@R.query("arch_visible", "SELECT id FROM arch_cards WHERE CASE WHEN arch_kind = 'component' THEN project = 'search-api' ELSE project IS NULL OR project = 'search-api' END")
def arch_visible(spark, sf_dir):
    return M.visible(view(spark, sf_dir, "arch_cards"), "search-api").select("id")


@R.query(
    "arch_stats",
    """SELECT arch_kind, count(*) AS total, count(*) FILTER (coalesce(status, '') NOT IN ('superseded', 'deprecated')) AS current, count(*) FILTER (coalesce(status, '') IN ('superseded', 'deprecated')) AS retired,
    min(updatedAt) AS first_update, max(updatedAt) AS last_update FROM arch_cards GROUP BY 1""",
)
def arch_stats(spark, sf_dir):
    return M.stats(view(spark, sf_dir, "arch_cards"))


@R.query("arch_supersede", "SELECT c.id, CASE WHEN c.id IN (SELECT supersedes FROM arch_cards WHERE supersedes IS NOT NULL) THEN 'superseded' ELSE c.status END AS status FROM arch_cards c")
def arch_supersede(spark, sf_dir):
    cards = view(spark, sf_dir, "arch_cards")
    return M.supersede(cards, cards).select("id", "status")


@R.query("arch_upsert_components", "SELECT name, project, arg_max(id, (updatedAt, id)) AS id, max(updatedAt) AS updatedAt, min(createdAt) AS createdAt FROM arch_cards WHERE arch_kind = 'component' GROUP BY 1, 2")
def arch_upsert_components(spark, sf_dir):
    return M.upsert_components(view(spark, sf_dir, "arch_cards")).select("name", "project", "id", "updatedAt", "createdAt")


@R.query("term_list", "SELECT term, id FROM glossary_terms WHERE project IS NULL OR project = 'media-lib' ORDER BY term, id LIMIT 200")
def term_list(spark, sf_dir):
    return M.visible_terms(view(spark, sf_dir, "glossary_terms"), "media-lib").select("term", "id").orderBy("term", "id").limit(200)


# rows: case and singular variants of every term
@R.query("glossary_expansion")
def glossary_expansion(spark, sf_dir):
    from strandline.functions import text as T

    match = F.array(F.struct("term", "definition", "aliases"))
    return view(spark, sf_dir, "glossary_terms").select("id", F.array_join(T.expand_with_glossary(F.col("term"), match), " | ").alias("variants"))


# The same searches for the whole query set. A search of several variations asks with the vectors of its id, the next and the one after.
_ASKED = "a.vec_id % 100 = 0"
_ALL_SIM = _SIM.replace("a.vector", "v.vector").replace("b.vector", "p.vector")
_ALL_HITS = f"""hits AS (SELECT v.query_id, v.variation, p.hash, p.vec_id, round({_ALL_SIM}, 6) AS score, round({_ALL_SIM}, 9) AS exact FROM
    (SELECT a.vec_id AS query_id, b.vec_id - a.vec_id AS variation, b.vector FROM points a JOIN points b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + 2 WHERE {_ASKED}) v CROSS JOIN points p),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, variation ORDER BY exact DESC, vec_id) AS rank FROM hits)"""


def _all_hits(spark, sf_dir):
    p = _points(spark, sf_dir)
    hits = S.top_k(p.where("vec_id % 100 < 3"), p, 20).join(p.select("id", "hash"), "id")
    return hits.withColumn("variation", F.col("query_id") % 100).withColumn("query_id", F.col("query_id") - F.col("variation"))


@R.query("expanded_search_merge", oracle(f"WITH {_ALL_HITS} SELECT query_id, hash, score, first_variation FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash) AS rn FROM (SELECT query_id, hash, max(score) AS score, min(variation) AS first_variation FROM ranked WHERE rank <= 20 GROUP BY 1, 2)) WHERE rn <= 10"))
def expanded_search_merge(spark, sf_dir):
    return S.merge_variations(_all_hits(spark, sf_dir), 10, by=("query_id",))


@R.query("cross_group_dedupe", oracle(f"WITH {_ALL_HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, hash ORDER BY variation, rank) AS rn FROM ranked WHERE rank <= 20) SELECT query_id, hash, variation, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash) AS r FROM f WHERE rn = 1) WHERE r <= 10"))
def cross_group_dedupe(spark, sf_dir):
    return S.first_seen(_all_hits(spark, sf_dir), 10, place="variation", by=("query_id",)).select("query_id", "hash", "variation", "score")


@R.query(
    "project_boost",
    oracle(f"""SELECT query_id, id, project, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, b.scope_project AS project, least(1.0, round({_SIM}, 6) + CASE WHEN b.scope_project = 'p3' THEN 0.05 ELSE 0 END) AS score
        FROM points a CROSS JOIN points b WHERE {_ASKED}) WHERE score >= 0.1"""),
)
def project_boost(spark, sf_dir):
    p = _points(spark, sf_dir)
    hits = S.scored(p.where("vec_id % 100 = 0"), p).join(p.select("id", F.col("scope_project").alias("project")), "id").select("query_id", "id", "project", "score")
    return M.boosted(hits, "p3", 0.1).withColumn("score", F.round("score", 6))


@R.query(
    "arch_context",
    oracle(f"""SELECT query_id, arch_kind, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, arch_kind ORDER BY score DESC, id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.arch_kind, b.vec_id AS id, round({_SIM}, 6) AS score FROM points a CROSS JOIN points b WHERE {_ASKED} AND coalesce(b.status, '') NOT IN ('superseded', 'deprecated')
        AND (b.scope_project = 'p3' OR (b.arch_kind <> 'component' AND b.scope_project IS NULL)))) WHERE rank <= CASE arch_kind WHEN 'decision' THEN 3 WHEN 'lesson' THEN 0 ELSE 5 END"""),
)
def arch_context(spark, sf_dir):
    p = _points(spark, sf_dir)
    cards = M.visible(M.current(p), "p3", column="scope_project")
    hits = S.top_k(p.where("vec_id % 100 = 0"), cards.where("arch_kind <> 'lesson'").select("id", "vector", "arch_kind"), 5, by="arch_kind").drop("rank")
    return M.top_by_kind(hits, {"decision": 3, "lesson": 0}, by=("query_id",)).select("query_id", "arch_kind", "id", "score", "rank")


@R.query(
    "overfetch_then_filter",
    oracle(f"""SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS id, b.scope_project, round({_SIM}, 6) AS score FROM points a CROSS JOIN points b WHERE {_ASKED})) WHERE rn <= 30 AND scope_project IS NULL) WHERE r <= 10"""),
)
def overfetch_then_filter(spark, sf_dir):
    p = _points(spark, sf_dir)
    hits = S.top_k(p.where("vec_id % 100 = 0"), p, 30).drop("rank").join(p.select("id", "scope_project"), "id")
    return M.overfetched(hits, F.col("scope_project").isNull(), 10, by=("query_id",)).select("query_id", "id", "score")


# each vector asks together with the first text query
@R.query(
    "hybrid_search",
    oracle(f"""WITH {_BM.strip()},
    de AS (SELECT * FROM (SELECT a.vec_id AS query_id, t.grp, t.id, row_number() OVER (PARTITION BY a.vec_id, t.grp ORDER BY round({_SIM}, 9) DESC, t.id) AS rank FROM points a CROSS JOIN points b JOIN t ON t.id = b.vec_id WHERE {_ASKED}) WHERE rank <= 20),
    f AS (SELECT query_id, grp, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, grp, id, rank FROM de UNION ALL SELECT a.vec_id, sp.grp, sp.id, sp.rank FROM sp CROSS JOIN points a WHERE sp.query_id = 1 AND {_ASKED}) GROUP BY 1, 2, 3)
    SELECT query_id, grp, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 8"""),
)
def hybrid_search(spark, sf_dir):
    p, parts = _points(spark, sf_dir), _parts(spark, sf_dir).select("grp", "id")
    asked = p.where("vec_id % 100 = 0")
    order = Window.partitionBy("query_id", "grp").orderBy(F.col("score").desc(), "id")
    ranked = lambda rows, k: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    dense = S.top_k(asked, p.select("id", "vector").join(parts, "id"), 20, by="grp")
    sparse = _sparse(spark, sf_dir).where("query_id = 1").drop("query_id").join(asked.select(F.col("id").alias("query_id")), F.lit(True))
    return ranked(S.rrf([dense, sparse], ["query_id", "grp", "id"]), 8).select("query_id", "grp", "id", "score", "rank")
