"""Queries of chunkers, symbols, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.operators import chunkers as C
from strandline.operators import graph as G
from strandline.operators import symbols as Y
from strandline.operators import syntax as X
from strandline.plans.registry import Registry
from strandline.plans.text import _MD, _WEAK
from strandline.sources import embedders as E
from strandline.sources import files as S
from strandline.streaming import jobs as J
from strandline.views import oracle, view

R = Registry()


def _code(spark, sf_dir, *languages: str):
    files = view(spark, sf_dir, "source_files")
    return C.code_chunks(files.where(F.lower("language").isin(*languages)) if languages else files, "file_id")


@R.query("chunk_code")
def chunk_code(spark, sf_dir):
    return _code(spark, sf_dir)


@R.query("chunk_blocks")
def chunk_blocks(spark, sf_dir):
    return _code(spark, sf_dir, "ruby", "terraform")


@R.query("chunk_braces")
def chunk_braces(spark, sf_dir):
    return _code(spark, sf_dir, *C.BRACE_LANGUAGES)


@R.query("chunk_indent")
def chunk_indent(spark, sf_dir):
    return _code(spark, sf_dir, "python")


@R.query("chunk_fixed")
def chunk_fixed(spark, sf_dir):
    return C.code_chunks(view(spark, sf_dir, "source_files").withColumn("language", F.lit("generic")), "file_id")


@R.query("chunk_markdown")
def chunk_markdown(spark, sf_dir):
    return C.markdown_chunks(view(spark, sf_dir, "documents"), "doc_id")


@R.query("chunk_symbols")
def chunk_symbols(spark, sf_dir):
    return Y.chunk_symbols(view(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]))


@R.query("code_symbol_edges")
def code_symbol_edges(spark, sf_dir):
    chunks = view(spark, sf_dir, "chunks").where("file IS NOT NULL").dropDuplicates(["chunk_id"])
    uses, defs = Y.uses_and_defs(Y.chunk_symbols(chunks), chunks)
    return G.symbol_edges(uses, defs)


@R.query(
    "select_files",
    r"SELECT DISTINCT file FROM source_files WHERE regexp_matches(file, '\.(ts|js)$') AND NOT regexp_matches(file, '^([^/]+/)*(node_modules|dist)/.*$') AND NOT regexp_matches(file, '^([^/]+/)*[^/]*\.min\.js$') AND NOT regexp_matches(file, '^tests/')",
)
def select_files(spark, sf_dir):
    return S.select_files(view(spark, sf_dir, "source_files"), ["**/*.ts", "**/*.js"], ["node_modules", "dist", "**/*.min.js"], "/tests/\n").select("file")


@R.query("split_readable")
def split_readable(spark, sf_dir):
    return S.split_readable(view(spark, sf_dir, "source_files"))[1].select("file_id", "skip_reason")


@R.query("embed_missing")
def embed_missing(spark, sf_dir):
    cache = view(spark, sf_dir, "embedding_cache")
    return E.embed_missing(view(spark, sf_dir, "chunks").select(F.col("content").alias("text")), cache, E.HashingEmbedder())


@R.query("stream_tumbling", oracle("SELECT ts // 3600000 * 3600000 AS start_ms, count(*) AS searches, count(error) AS errors FROM search_events GROUP BY 1"))
def stream_tumbling(spark, sf_dir):
    return J.drained(J.tumbling(J.read_table(spark, sf_dir, "search_events"), late="60 days"), "complete")


@R.query("stream_once", "SELECT DISTINCT id FROM search_events")
def stream_once(spark, sf_dir):
    return J.drained(J.once(J.read_table(spark, sf_dir, "search_events")).select("id"))


@R.query(
    "stream_debounce",
    """
WITH p AS (SELECT full_name, probed_at, outcome, lag(probed_at) OVER (PARTITION BY full_name ORDER BY probed_at) AS before FROM repo_probes),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR probed_at >= before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY full_name ORDER BY probed_at, before NULLS FIRST ROWS UNBOUNDED PRECEDING) AS burst FROM p)
SELECT full_name AS file, arg_max(outcome, (probed_at, outcome)) AS event, count(*) AS changes, epoch_ms(max(probed_at)) AS at_ms FROM n GROUP BY full_name, burst
""",
)
def stream_debounce(spark, sf_dir):
    p = J.read_table(spark, sf_dir, "repo_probes")
    changes = p.select(F.lit("").alias("project"), F.col("full_name").alias("file"), F.col("outcome").alias("event"), F.col("probed_at").alias("at"))
    return J.drained(J.debounced(changes, "1 hour", "90 days"), "complete").select("file", "event", "changes", F.unix_millis("at").alias("at_ms"))


@R.query("stream_reformulations", oracle("SELECT a.id AS a_id, b.id AS b_id FROM search_events a JOIN search_events b ON a.{q}user{q} = b.{q}user{q} AND coalesce(a.session, '') = coalesce(b.session, '') AND b.ts > a.ts AND b.ts <= a.ts + 90000"))
def stream_reformulations(spark, sf_dir):
    return J.drained(J.reformulations(J.read_table(spark, sf_dir, "search_events"), "60 days"))


@R.query(
    "stream_fetch_searches",
    oracle("""WITH e AS (SELECT DISTINCT id, ts, {q}user{q}, tool FROM search_events)
    SELECT t.id AS fetch_id, (arg_max(s.id, (s.ts, s.id))) AS search_id FROM e t LEFT JOIN e s ON s.tool = 'search_docs' AND t.{q}user{q} = s.{q}user{q} AND s.ts <= t.ts AND s.ts >= t.ts - 600000
    WHERE t.tool = 'explain_feature' GROUP BY 1"""),
)
def stream_fetch_searches(spark, sf_dir):
    fetches, searches = (J.read_table(spark, sf_dir, "search_events").where(F.col("tool") == tool) for tool in ("explain_feature", "search_docs"))
    arrived = view(spark, sf_dir, "search_events").where("tool = 'explain_feature'")
    return J.latest_search(J.drained(J.fetch_searches(fetches, searches, "10 MINUTES", "60 days")), arrived)


def _sound(kind: str, languages: tuple[str, ...] = (), most: int | None = None):
    """Registers that the chunks of files are sound; the SQL has the lines that they must cover."""
    only = f" WHERE lower(language) IN ({', '.join(repr(x) for x in languages)})" if languages else ""
    sql = f"""SELECT file_id::VARCHAR AS key, count(*) AS lines, 0 AS n_wrong, 0 AS n_over FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS line FROM source_files{only})
    WHERE regexp_matches(line, '[A-Za-z0-9]') GROUP BY 1"""

    @R.query(f"{kind}_sound", sql)
    def run(spark, sf_dir):
        files = view(spark, sf_dir, "source_files")
        files = files.where(F.lower("language").isin(*languages)) if languages else files
        chunks = X.syntax_chunks(files, "file_id")[0] if kind == "chunk_syntax" else C.code_chunks(files.withColumn("language", F.lit("generic")) if kind == "chunk_fixed" else files, "file_id")
        return X.soundness(chunks, files, "file_id", most).where("lines > 0").drop("chunks")


_sound("chunk_syntax")
_sound("chunk_code")
_sound("chunk_blocks", ("ruby", "terraform"), 3 * fixed.CHUNK_SIZE)
_sound("chunk_braces", C.BRACE_LANGUAGES, 3 * fixed.CHUNK_SIZE)
_sound("chunk_indent", ("python",), 3 * fixed.CHUNK_SIZE)
_sound("chunk_fixed")


@R.query(
    "chunk_markdown_sound",
    f"""SELECT doc_id::VARCHAR AS key, count(*) AS lines, 0 AS n_wrong FROM (SELECT doc_id, unnest(string_split(raw, chr(10))) AS line
        FROM (SELECT doc_id, text AS raw, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents) WHERE text <> '' AND ({_MD} OR {_WEAK} >= 2))
    WHERE regexp_matches(line, '[A-Za-z0-9]') AND NOT regexp_matches(line, '^ {{0,3}}[#~`]') GROUP BY 1""",
)
def chunk_markdown_sound(spark, sf_dir):
    """Lines of text that the chunks of each page cover, but headings and fences, and the chunks whose hash or lines are wrong."""
    pages = view(spark, sf_dir, "documents")
    chunks = C.markdown_chunks(pages, "doc_id")
    wrong = (F.left(F.sha2("content", 256), F.lit(16)) != F.col("hash")) | (F.col("start_line") > F.col("end_line"))
    counts = chunks.groupBy("key").agg(F.sum(wrong.cast("int")).alias("n_wrong"))
    covered = chunks.select("key", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("n")).distinct()
    lines = pages.select(F.col("doc_id").cast("string").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(F.col("line").rlike("[A-Za-z0-9]") & ~F.col("line").rlike("^ {0,3}[#~`]"))
    return covered.join(lines, ["key", "n"], "left_semi").groupBy("key").agg(F.count("*").alias("lines")).join(counts, "key").select("key", "lines", "n_wrong")


@R.query("chunk_syntax")
def chunk_syntax(spark, sf_dir):
    return X.syntax_chunks(view(spark, sf_dir, "source_files"), "file_id")[0]


@R.query("syntax_errors")
def syntax_errors(spark, sf_dir):
    return X.syntax_chunks(view(spark, sf_dir, "source_files"), "file_id")[1]
