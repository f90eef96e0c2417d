"""Queries of upkeep: upserts, deletes, orphans, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import maintenance as K
from strandline.plans.registry import Registry
from strandline.views import oracle, view

R = Registry()


@R.query("upsert_latest", "SELECT full_name, arg_max(fingerprint, last_indexed_at::TIMESTAMPTZ) AS fingerprint FROM repo_fingerprints GROUP BY 1")
def upsert_latest(spark, sf_dir):
    rows = view(spark, sf_dir, "repo_fingerprints").select("full_name", "fingerprint", F.to_timestamp("last_indexed_at").alias("at"))
    half = F.pmod(F.xxhash64("full_name", "at"), F.lit(2))
    return K.upsert_latest(rows.where(half == 0), rows.where(half == 1), ["full_name"], "at").select("full_name", "fingerprint")


_OLD, _NEW = "SELECT DISTINCT chunk_id, project, hash FROM chunks WHERE length(content) % 3 <> 0", "SELECT DISTINCT chunk_id, project, hash FROM chunks WHERE length(content) % 2 = 0"


def _old_new(spark, sf_dir):
    c = view(spark, sf_dir, "chunks")
    pick = lambda w: c.where(w).select("chunk_id", "project", "hash").distinct()
    return pick("length(content) % 3 <> 0"), pick("length(content) % 2 = 0")


@R.query("insert_absent", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT chunk_id FROM o UNION ALL SELECT DISTINCT chunk_id FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM o)")
def insert_absent(spark, sf_dir):
    return K.insert_absent(*_old_new(spark, sf_dir), ["chunk_id"]).select("chunk_id")


@R.query("replace_children", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE project NOT IN (SELECT project FROM n)")
def replace_children(spark, sf_dir):
    return K.replace_children(*_old_new(spark, sf_dir), "project")


@R.query("counter_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT project, sum(c)::BIGINT AS c FROM (SELECT project, count(*) AS c FROM o GROUP BY 1 UNION ALL SELECT project, -count(*) FROM n GROUP BY 1) GROUP BY 1 HAVING sum(c) > 0")
def counter_upsert(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return K.add_counts(old.groupBy("project").agg(F.count("*").alias("c")), new.groupBy("project").agg((-F.count("*")).alias("c")), ["project"], "c")


@R.query("delete_project", "SELECT chunk_id FROM chunks WHERE NOT (grp = 'atlas' AND project = 'search-api')")
def delete_project(spark, sf_dir):
    return K.delete_where(view(spark, sf_dir, "chunks"), grp="atlas", project="search-api").select("chunk_id")


@R.query("prefix_delete", "SELECT chunk_id FROM chunks WHERE NOT starts_with(chunk_id, 'atlas//')")
def prefix_delete(spark, sf_dir):
    return K.delete_prefix(view(spark, sf_dir, "chunks"), "atlas//").select("chunk_id")


@R.query("orphan_cleanup", "SELECT DISTINCT project, file FROM chunks WHERE file IS NOT NULL AND (project, file) NOT IN (SELECT project_name, file FROM source_files WHERE total_bytes > 3000)")
def orphan_cleanup(spark, sf_dir):
    present = view(spark, sf_dir, "source_files").where("total_bytes > 3000").select(F.col("project_name").alias("project"), "file")
    return K.orphans(view(spark, sf_dir, "chunks").where("file IS NOT NULL"), present, ["project", "file"])


@R.query("evict_moved", "SELECT chunk_id FROM chunks JOIN (SELECT project_name AS project, min(CASE WHEN group_name = 'atlas' THEN 'harbor' ELSE group_name END) AS home FROM chunker_config GROUP BY 1) USING (project) WHERE grp <> home")
def evict_moved(spark, sf_dir):
    home = F.min(F.when(F.col("group_name") == "atlas", "harbor").otherwise(F.col("group_name"))).alias("home")
    homes = view(spark, sf_dir, "chunker_config").groupBy(F.col("project_name").alias("project")).agg(home)
    return K.elsewhere(view(spark, sf_dir, "chunks"), homes).select("chunk_id")


@R.query("found_and_missing", "SELECT DISTINCT chunk_id, chunk_id IN (SELECT chunk_id FROM chunks) AS found FROM search_results WHERE chunk_id IS NOT NULL")
def found_and_missing(spark, sf_dir):
    return K.found_and_missing(view(spark, sf_dir, "search_results").where("chunk_id IS NOT NULL"), view(spark, sf_dir, "chunks"), "chunk_id")


_BEFORE = "SELECT project_name, chunkSize, overlap FROM chunker_config WHERE chunkSize < 2000"
_AFTER = "SELECT project_name, CASE WHEN overlap = 64 THEN 777 ELSE chunkSize END AS chunkSize, overlap FROM chunker_config WHERE chunkSize > 600"


@R.query("config_changes", f"SELECT project_name, CASE WHEN b.project_name IS NULL THEN 'added' WHEN a.project_name IS NULL THEN 'removed' ELSE 'modified' END AS change FROM ({_BEFORE}) b FULL JOIN ({_AFTER}) a USING (project_name) WHERE (a.chunkSize, a.overlap) IS DISTINCT FROM (b.chunkSize, b.overlap)")
def config_changes(spark, sf_dir):
    c = view(spark, sf_dir, "chunker_config")
    after = c.where("chunkSize > 600").withColumn("chunkSize", F.when(F.col("overlap") == 64, 777).otherwise(F.col("chunkSize")))
    return K.config_changes(c.where("chunkSize < 2000"), after, "project_name", ["chunkSize", "overlap"])


@R.query(
    "reconcile_projects",
    """SELECT grp, project, CASE WHEN max(r) = 1 THEN 'registered' ELSE 'discovered' END AS source FROM (SELECT grp, project, 0 AS r FROM chunks UNION ALL SELECT group_name, project_name, 1 FROM chunker_config WHERE chunkSize = 1024)
    WHERE grp IN (SELECT group_name FROM search_events WHERE cache_hit = 1) GROUP BY 1, 2""",
)
def reconcile_projects(spark, sf_dir):
    registered = view(spark, sf_dir, "chunker_config").where("chunkSize = 1024").select(F.col("group_name").alias("grp"), F.col("project_name").alias("project"))
    live = view(spark, sf_dir, "search_events").where("cache_hit = 1").select(F.col("group_name").alias("grp"))
    return K.reconcile(view(spark, sf_dir, "chunks").select("grp", "project"), registered, live)


_FP = "SELECT project, file, sha256(string_agg(DISTINCT hash, ',' ORDER BY hash)) AS fingerprint FROM {} WHERE file IS NOT NULL GROUP BY 1, 2"


@R.query("file_fingerprints", _FP.format("chunks"))
def file_fingerprints(spark, sf_dir):
    return K.file_fingerprints(view(spark, sf_dir, "chunks").where("file IS NOT NULL"), ["project", "file"])


@R.query("unchanged_files", f"SELECT a.project, a.file FROM ({_FP.format('chunks')}) a JOIN ({_FP.format('(SELECT * FROM chunks WHERE length(content) % 4 <> 0)')}) b ON a.project = b.project AND a.file = b.file AND a.fingerprint = b.fingerprint")
def unchanged_files(spark, sf_dir):
    c = view(spark, sf_dir, "chunks").where("file IS NOT NULL")
    return K.unchanged_files(c, c.where("length(content) % 4 <> 0"), ["project", "file"])


@R.query("folder_fingerprints", "SELECT project_name, sha256(count(*) || chr(10) || string_agg(l, chr(10) ORDER BY l)) AS fingerprint FROM (SELECT project_name, concat_ws(chr(1), file, indexed_at, total_bytes) AS l FROM source_files) GROUP BY 1")
def folder_fingerprints(spark, sf_dir):
    files = view(spark, sf_dir, "source_files")
    # DuckDB has no NUL in texts, so these queries part the fields by another sign
    line = F.concat_ws("\x01", "file", F.col("indexed_at").cast("string"), F.col("total_bytes").cast("string")).alias("file")
    rows = files.select("project_name", line, F.lit(None).cast("string").alias("indexed_at"), F.lit(None).cast("string").alias("total_bytes"))
    return K.folder_fingerprints(rows, ["project_name"])


@R.query("embedding_cache_miss", "SELECT DISTINCT hash FROM chunks WHERE hash NOT IN (SELECT hash[:16] FROM embedding_cache WHERE model = 'code-embed-a')")
def embedding_cache_miss(spark, sf_dir):
    cache = view(spark, sf_dir, "embedding_cache").withColumn("hash", F.left("hash", F.lit(16)))
    return K.cache_misses(view(spark, sf_dir, "chunks"), cache, model="code-embed-a")


@R.query("embedding_cache_evict", "SELECT hash, model FROM (SELECT hash, model, max(created_at) AS made FROM embedding_cache GROUP BY 1, 2) ORDER BY made DESC, hash, model LIMIT 100")
def embedding_cache_evict(spark, sf_dir):
    return K.newest(view(spark, sf_dir, "embedding_cache"), 100).select("hash", "model")


_RANGES = "SELECT project, file, startLine AS start_line, endLine AS end_line, min(chunk_id) AS idx FROM chunks WHERE file IS NOT NULL AND startLine IS NOT NULL GROUP BY 1, 2, 3, 4"


@R.query("dedupe_contained", f"WITH r AS ({_RANGES}) SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.project = b.project AND a.file = b.file AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND (b.start_line, b.end_line) <> (a.start_line, a.end_line))")
def dedupe_contained(spark, sf_dir):
    c = view(spark, sf_dir, "chunks").where("file IS NOT NULL AND startLine IS NOT NULL")
    ranges = c.groupBy("project", "file", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line")).agg(F.min("chunk_id").alias("idx"))
    return K.not_contained(ranges, ["project", "file"])


@R.query("valid_chunks", "SELECT chunk_id FROM chunks WHERE grp IS NOT NULL AND project IS NOT NULL AND file IS NOT NULL AND startLine IS NOT NULL AND endLine IS NOT NULL AND content IS NOT NULL AND hash IS NOT NULL")
def valid_chunks(spark, sf_dir):
    return K.valid_chunks(view(spark, sf_dir, "chunks")).select("chunk_id")


@R.query("scroll_columns", "SELECT chunk_id, hash FROM chunks WHERE grp = 'summit'")
def scroll_columns(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where("grp = 'summit'").select("chunk_id", "hash")


@R.query("file_lines", oracle("SELECT DISTINCT r.search_id, r.{q}rank{q}, coalesce(r.file_total_lines, f.total_lines) AS file_lines FROM search_results r LEFT JOIN (SELECT project_name, file, max(total_lines) AS total_lines FROM source_files GROUP BY 1, 2) f ON f.project_name = r.project AND f.file = r.file"))
def file_lines(spark, sf_dir):
    sizes = view(spark, sf_dir, "source_files").groupBy(F.col("project_name").alias("project"), "file").agg(F.max("total_lines").alias("total_lines"))
    return view(spark, sf_dir, "search_results").join(sizes, ["project", "file"], "left").select("search_id", "rank", F.coalesce("file_total_lines", "total_lines").alias("file_lines")).distinct()


@R.query("reindex_group", "SELECT chunk_id, grp, upper(project) AS project FROM chunks WHERE grp = (SELECT min(grp) FROM chunks) UNION ALL SELECT chunk_id, grp, project FROM chunks WHERE grp IS DISTINCT FROM (SELECT min(grp) FROM chunks)")
def reindex_group(spark, sf_dir):
    c = view(spark, sf_dir, "chunks").select("chunk_id", "grp", "project")
    return K.replace_group(c, c.withColumn("project", F.upper("project")), c.agg(F.min("grp")).first()[0])


@R.query(
    "heal_vectors",
    """SELECT a.hash, a.model, coalesce(a.vector, b.vector) IS NOT NULL AS has_vector FROM embedding_cache a
    LEFT JOIN (SELECT hash, min(vector) AS vector FROM embedding_cache WHERE vector IS NOT NULL GROUP BY 1) b ON a.hash = b.hash""",
)
def heal_vectors(spark, sf_dir):
    e = view(spark, sf_dir, "embedding_cache")
    return K.healed(e, e.select("hash", "vector")).select("hash", "model", F.col("vector").isNotNull().alias("has_vector"))
