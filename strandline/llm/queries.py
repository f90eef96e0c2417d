"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.llm.encoding import encode_corpus
from strandline.llm.frequent import top_values, top_with_text
from strandline.llm.near_duplicates import groups, similar_pairs
from strandline.llm.non_source import non_source
from strandline.llm.packing import PACKER_ITEMS, fill, mixture, pack, token_sizes
from strandline.llm.reading_level import reading_levels
from strandline.llm.similar_vectors import nearest
from strandline.llm.splitting import soundness, split_oversized
from strandline.plans.registry import Registry
from strandline.session import fresh_dir, table

R = Registry()


def _pieces(spark, sf_dir):
    return split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunker_config"))


@R.query(
    "p1_found",
    "SELECT DISTINCT chunk_id FROM chunks JOIN chunker_config ON project = project_name WHERE length(content) > chunkSize",
)
def p1_found(spark, sf_dir):
    return _pieces(spark, sf_dir).where("n_pieces > 1").select("chunk_id").distinct()


@R.query("p1_pieces")
def p1_pieces(spark, sf_dir):
    return _pieces(spark, sf_dir)


@R.query(
    "p1_sound",
    """SELECT project, 0 AS n_over, 0 AS n_text, 0 AS n_hash, 0 AS n_lines, 0 AS n_gaps FROM chunks JOIN chunker_config ON project = project_name WHERE length(content) > chunkSize GROUP BY project""",
)
def p1_sound(spark, sf_dir):
    return soundness(_pieces(spark, sf_dir), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunker_config")).drop("n_pieces")


_TOP = """
SELECT query_hash, count(DISTINCT id) AS n_searches, max(query_text) AS query_text FROM search_events
WHERE query_hash IS NOT NULL GROUP BY query_hash ORDER BY n_searches DESC, query_hash LIMIT 20
"""


@R.query("p4_found", f"SELECT query_hash FROM ({_TOP})")
def p4_found(spark, sf_dir):
    return top_values(table(spark, sf_dir, "search_events")).select(F.col("value").alias("query_hash"))


@R.query("p4_top", _TOP)
def p4_top(spark, sf_dir):
    return top_with_text(table(spark, sf_dir, "search_events")).toDF("query_hash", "n_searches", "query_text")


@R.query("p8_ids")
def p8_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"))


_RECORDS = """
SELECT 'decision' AS kind, id, decision AS text FROM arch_cards WHERE arch_kind = 'decision'
UNION ALL SELECT 'lesson', id, rule FROM arch_cards WHERE arch_kind = 'lesson'
UNION ALL SELECT 'term', id, definition FROM glossary_terms
"""


def _records(spark, sf_dir):
    cards = table(spark, sf_dir, "arch_cards").where(F.col("arch_kind").isin("decision", "lesson"))
    text = F.when(F.col("arch_kind") == "decision", F.col("decision")).otherwise(F.col("rule"))
    terms = table(spark, sf_dir, "glossary_terms")
    return cards.select(F.col("arch_kind").alias("kind"), "id", text.alias("text")).unionByName(terms.select(F.lit("term").alias("kind"), "id", F.col("definition").alias("text")))


@R.query(
    "p3_found",
    f"""
WITH r AS (SELECT DISTINCT kind, id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS words FROM ({_RECORDS}))
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM r a JOIN r b ON a.kind = b.kind AND a.id < b.id
WHERE len(list_intersect(a.words, b.words)) >= 0.7 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))
""",
)
def p3_found(spark, sf_dir):
    return similar_pairs(_records(spark, sf_dir)).select("id_a", "id_b")


@R.query(
    "p3_groups_links",
    f"""
WITH RECURSIVE r AS (SELECT DISTINCT kind, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) AS words, id FROM ({_RECORDS})),
c AS (SELECT kind, words, min(id) AS least, count(*) AS members FROM r WHERE len(words) > 0 GROUP BY ALL),
e AS (SELECT a.kind, a.least AS x, b.least AS y FROM c a JOIN c b ON a.kind = b.kind AND a.words <> b.words WHERE len(list_intersect(a.words, b.words)) >= 0.7 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))),
w AS (SELECT kind, least AS x, least AS y FROM c UNION SELECT w.kind, w.x, e.y FROM w JOIN e ON e.kind = w.kind AND e.x = w.y),
g AS (SELECT kind, x, min(y) AS first_id FROM w GROUP BY ALL)
SELECT r.kind, r.id, (SELECT count(*) FROM e WHERE e.kind = c.kind AND e.x = c.least) AS n_links, g.first_id FROM r JOIN c ON c.kind = r.kind AND c.words = r.words JOIN g ON g.kind = c.kind AND g.x = c.least
""",
)
def p3_groups_links(spark, sf_dir):
    """Every record with its number of links and the least id of its group."""
    found = groups(_records(spark, sf_dir))
    return found.join(found.groupBy("kind", "group").agg(F.min("id").alias("first_id")), ["kind", "group"]).select("kind", "id", "n_links", "first_id")


@R.query("p3_groups")
def p3_groups(spark, sf_dir):
    return groups(_records(spark, sf_dir))


@R.query(
    "p7_found",
    """
WITH v AS (SELECT DISTINCT model, hash, vector::DOUBLE[] AS vector FROM embedding_cache
           WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.model, a.hash AS x, b.hash AS y, row_number() OVER (PARTITION BY a.model, a.hash ORDER BY list_cosine_similarity(a.vector, b.vector) DESC, b.hash) AS r
      FROM v a JOIN v b ON a.model = b.model AND a.hash <> b.hash)
SELECT DISTINCT model, least(x, y) AS hash_a, greatest(x, y) AS hash_b FROM s WHERE r <= 5
""",
)
def p7_found(spark, sf_dir):
    near = nearest(table(spark, sf_dir, "embedding_cache"))
    return near.select("model", F.least("hash", "other").alias("hash_a"), F.greatest("hash", "other").alias("hash_b")).distinct()


@R.query("p7_nearest")
def p7_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embedding_cache"))


@R.query("p9_packed")
def p9_packed(spark, sf_dir):
    return pack(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "token_windows"))


def _written_packing(spark, sf_dir):
    sizes, windows, path = token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "token_windows"), fresh_dir(spark, "packed")
    sizes.write.parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")
    pack(sizes, windows).write.parquet(f"{path}/packed")
    return spark.read.parquet(f"{path}/packed"), sizes, windows


@R.query(
    "p9_fill",
    """
SELECT window_name, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_over, 0 AS n_divided, 0 AS n_wrong, 0 AS n_apart, true AS tight
FROM token_windows WHERE capacity_tokens > 0
""",
)
def p9_fill(spark, sf_dir):
    # within a hundredth of the least; a packer's last few containers have little left to choose from
    tight = F.col("containers") <= F.ceil(F.col("least") * 1.01) + 5 * (1 + F.floor(F.col("n_docs") / PACKER_ITEMS))
    return fill(*_written_packing(spark, sf_dir)).select("window_name", "n_docs", "n_over", "n_divided", "n_wrong", "n_apart", tight.alias("tight"))


@R.query("p9_mixture")
def p9_mixture(spark, sf_dir):
    packed, sizes, _ = _written_packing(spark, sf_dir)
    return mixture(packed, sizes)


def _levels(spark, sf_dir):
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_levels"))


@R.query("p10_found")
def p10_found(spark, sf_dir):
    return _levels(spark, sf_dir).where("band = 4").select("doc_id")


@R.query("p10_levels")
def p10_levels(spark, sf_dir):
    return _levels(spark, sf_dir)


@R.query("p2_found")
def p2_found(spark, sf_dir):
    return non_source(table(spark, sf_dir, "source_files")).where("isNonSource").select("file_id")


@R.query("p2_verdicts")
def p2_verdicts(spark, sf_dir):
    return non_source(table(spark, sf_dir, "source_files"))
