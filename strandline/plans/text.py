"""Queries of the text functions, over the texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import fixed, text as T
from strandline.plans.registry import Registry
from strandline.views import oracle, view

R = Registry()


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(expr: str, pairs: dict, default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@R.query("normalize_query", rf"SELECT id, {_TRIM.format('lower(query_text)')} AS normalized, sha1({_TRIM.format('lower(query_text)')}) AS hash FROM search_events WHERE query_text IS NOT NULL")
def normalize_query(spark, sf_dir):
    q = F.col("query_text")
    return view(spark, sf_dir, "search_events").where(q.isNotNull()).select("id", T.normalize_query(q).alias("normalized"), T.hash_query(q).alias("hash"))


@R.query(
    "tokenize_query",
    rf"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex({_TRIM.format('lower(query_text)')}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND NOT list_contains({_list(fixed.QUERY_STOP_WORDS)}, w)))), ' ') AS tokens
    FROM search_events WHERE query_text IS NOT NULL""",
)
def tokenize_query(spark, sf_dir):
    q = F.col("query_text")
    return view(spark, sf_dir, "search_events").where(q.isNotNull()).select("id", F.array_join(T.tokenize_query(q), " ").alias("tokens"))


_TERMS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_list(fixed.TERM_STOP_WORDS)}, t))"


@R.query("document_terms", f"SELECT doc_id, len({_TERMS})::INT AS n_terms, md5(array_to_string({_TERMS}, ' ')) AS terms FROM documents WHERE text IS NOT NULL")
def document_terms(spark, sf_dir):
    terms = T.terms(F.col("text"))
    return view(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(terms).alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms"))


@R.query(
    "term_index",
    """SELECT DISTINCT term, (list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split(term, ''), lambda c: ascii(c)::HUGEINT)),
        lambda h, x: (xor(h, x) * 16777619) % 4294967296) % 2147483648)::BIGINT AS term_index FROM (SELECT unnest(regexp_extract_all(lower(term), '[a-z0-9_]+')) AS term FROM glossary_terms)""",
)
def term_index(spark, sf_dir):
    words = view(spark, sf_dir, "glossary_terms").select(F.explode(F.regexp_extract_all(F.lower("term"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("term")).distinct()
    return words.select("term", T.term_index(F.col("term")).alias("term_index"))


@R.query("estimate_tokens", "SELECT file_id, ceil(length(content) / 4)::BIGINT AS tokens FROM source_files WHERE content IS NOT NULL")
def estimate_tokens(spark, sf_dir):
    return view(spark, sf_dir, "source_files").where("content IS NOT NULL").select("file_id", T.estimate_tokens(F.col("content")).alias("tokens"))


_WORDS = r"string_split_regex({q}, '\s+')".replace("{q}", _TRIM.format("query_text"))
_BOTH = fixed.CONTRACTIONS | fixed.ABBREVIATIONS
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _BOTH.items()) + "}"
_SINGULAR = """CASE WHEN length(w) <= 3 THEN w WHEN lower(w) LIKE '%ies' AND length(w) > 4 THEN w[:-4] || CASE WHEN w[1] = upper(w[1]) THEN 'Y' ELSE 'y' END
    WHEN regexp_matches(lower(w), '[sxz]es$') THEN w[:-3] WHEN lower(w) LIKE '%s' AND NOT regexp_matches(lower(w), '(ss|us)$') THEN w[:-2] ELSE w END"""
_EXPAND = rf"""
WITH q AS (SELECT DISTINCT query_text, {_TRIM.format('query_text')} AS t, {_WORDS} AS ws FROM search_events WHERE query_text IS NOT NULL),
v AS (SELECT query_text, t,
    CASE WHEN len(list_filter(ws, lambda w: list_contains({_list(_BOTH)}, lower(w)))) > 0 THEN array_to_string(list_transform(ws, lambda w: coalesce({_MAP}[lower(w)], w)), ' ') END AS a,
    list_filter(ws, lambda w: NOT list_contains({_list(fixed.FILLER_WORDS)}, lower(w))) AS k, ws,
    CASE WHEN len(ws) >= 2 AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '^[a-zA-Z]+$'))) = 0 THEN lower(ws[1]) || array_to_string(list_transform(ws[2:], lambda w: upper(w[1]) || lower(w[2:])), '')
         WHEN len(ws) = 1 AND regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9]*$') AND contains(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' ')
         THEN lower(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')) END AS c,
    array_to_string(list_transform(ws, lambda w: {_SINGULAR}), ' ') AS p FROM q)
SELECT query_text, CASE WHEN t = '' THEN query_text ELSE array_to_string(list_filter([t, a, CASE WHEN len(k) < len(ws) AND len(k) >= 2 THEN array_to_string(k, ' ') END, c, CASE WHEN p <> array_to_string(ws, ' ') THEN p END],
    lambda x, i: x IS NOT NULL AND list_position([t, a, CASE WHEN len(k) < len(ws) AND len(k) >= 2 THEN array_to_string(k, ' ') END, c, CASE WHEN p <> array_to_string(ws, ' ') THEN p END], x) = i)[:3], ' | ') END AS variants FROM v
"""


@R.query("expand_query", _EXPAND)
def expand_query(spark, sf_dir):
    q = F.col("query_text")
    return view(spark, sf_dir, "search_events").where(q.isNotNull()).select("query_text").distinct().select("query_text", F.array_join(T.expand_query(q), " | ").alias("variants"))


_N = fixed.NON_SOURCE
_REASON = rf"""CASE WHEN length({{c}}) < {_N['least']} THEN '' WHEN list_max(list_transform(string_split({{c}}, chr(10)), lambda l: length(l))) > {_N['line']}
    THEN 'line of ' || list_max(list_transform(string_split({{c}}, chr(10)), lambda l: length(l))) || ' chars (minified/blob)'
    WHEN len(regexp_extract_all({{c}}, '\s')) / length({{c}}) < {_N['white_space']} AND len(regexp_extract_all({{c}}, '[A-Za-z0-9+/=_-]')) / length({{c}}) > {_N['base64']} THEN 'dense base64 blob'
    WHEN length({{c}}) / len(string_split({{c}}, chr(10))) > {_N['average_line']} THEN 'avg line ' || round(length({{c}}) / len(string_split({{c}}, chr(10))))::BIGINT || ' chars (no structure)' ELSE '' END"""


@R.query("detect_non_source", f"SELECT file_id, {_REASON.format(c='content')} AS reason FROM source_files WHERE content IS NOT NULL")
def detect_non_source(spark, sf_dir):
    return view(spark, sf_dir, "source_files").where("content IS NOT NULL").select("file_id", T.non_source_reason(F.col("content")).alias("reason"))


@R.query("drop_non_source_chunks", f"SELECT DISTINCT chunk_id FROM chunks WHERE {_REASON.format(c='content')} = '' AND chunk_id IS NOT NULL")
def drop_non_source_chunks(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where(F.col("chunk_id").isNotNull() & (T.non_source_reason(F.col("content")) == "")).select("chunk_id").distinct()


@R.query("readable_files", rf"SELECT file_id FROM source_files WHERE content IS NOT NULL AND NOT contains(content, chr(65533)) AND {_TRIM.format('content')} NOT IN ('', chr(65279))")
def readable_files(spark, sf_dir):
    return view(spark, sf_dir, "source_files").where(T.readable(F.col("content"))).select("file_id")


_SUFFIX = r"lower(regexp_extract(file, '[^/.][^/]*\.([^./]+)$', 1))"


@R.query("detect_language", f"SELECT file_id, {_case(_SUFFIX, fixed.LANGUAGE_OF_SUFFIX)} AS detected, coalesce(lower(language) <> {_case(_SUFFIX, fixed.LANGUAGE_OF_SUFFIX)}, true) AS differs FROM source_files")
def detect_language(spark, sf_dir):
    found = T.language_of(F.col("file"), F.col("content"))
    return view(spark, sf_dir, "source_files").select("file_id", found.alias("detected"), F.coalesce(F.lower("language") != found, F.lit(True)).alias("differs"))


@R.query(
    "project_language",
    "SELECT project_name, arg_min(language, (n, language)) AS language FROM (SELECT project_name, language, -count(*) AS n FROM (SELECT project_name, "
    + _case(_SUFFIX, fixed.LANGUAGE_OF_SUFFIX)
    + " AS language FROM source_files) WHERE language IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
)
def project_language(spark, sf_dir):
    files = view(spark, sf_dir, "source_files").select("project_name", T.language_of(F.col("file")).alias("language")).where("language IS NOT NULL")
    counts = files.groupBy("project_name", "language").agg((-F.count("*")).alias("n"))
    return counts.groupBy("project_name").agg(F.min(F.struct("n", "language"))["language"].alias("language"))


_PARTS = "string_split(replace(file, chr(92), '/'), '/')"
_TAG = f"list_filter({_PARTS}[:-2], lambda p: p <> '' AND NOT list_contains({_list(fixed.ROOT_FOLDERS)}, p))[1]"


@R.query("resolve_tags", f"SELECT file_id, array_to_string(list_filter(['code', CASE WHEN file LIKE 'tests/%' THEN 'test' END, {_TAG}], lambda t, i: t IS NOT NULL), ' ') AS tags FROM source_files")
def resolve_tags(spark, sf_dir):
    return view(spark, sf_dir, "source_files").select("file_id", F.array_join(T.resolve_tags(F.col("file"), ["code"], {"tests/": ["test"]}), " ").alias("tags"))


_MD = " OR ".join(f"regexp_matches(text, '{p}')" for p in fixed.MARKDOWN_STRONG)
_WEAK = " + ".join(f"regexp_matches(text, '{p}')::INT" for p in fixed.MARKDOWN_WEAK)


# every document: line ends of all kinds are one for DuckDB's patterns, as they are for Spark's
@R.query("detect_markdown", f"SELECT doc_id, coalesce(text <> '' AND ({_MD} OR {_WEAK} >= 2), false) AS markdown FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)")
def detect_markdown(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.is_markdown(F.col("text")).alias("markdown"))


def _type(q: str) -> str:
    code = " OR ".join(f"regexp_matches({q}, '{p}')" for p in fixed.CODE_SIGNS)
    asked = " OR ".join(f"regexp_matches({q}, '{p}')" for p in fixed.QUESTION_SIGNS)
    return f"CASE WHEN {code} THEN 'code2code' WHEN {asked} THEN 'techqa' ELSE 'nl2code' END"


@R.query("query_type", f"SELECT id, {_type(_TRIM.format('query_text'))} AS query_type FROM search_events WHERE query_text IS NOT NULL")
def query_type(spark, sf_dir):
    return view(spark, sf_dir, "search_events").where("query_text IS NOT NULL").select("id", T.query_type(F.col("query_text")).alias("query_type"))


@R.query(
    "prefix_query",
    f"SELECT id, '<instruct>' || {_case('(' + _type(_TRIM.format('query_text')) + ')', fixed.TASKS['bge-code'])} || chr(10) || '<query>' || query_text AS bge, 'Instruct: {fixed.TASKS['qwen']['techqa']}' || chr(10) || 'Query:' || query_text AS qwen FROM search_events WHERE query_text IS NOT NULL",
)
def prefix_query(spark, sf_dir):
    q = F.col("query_text")
    return view(spark, sf_dir, "search_events").where(q.isNotNull()).select("id", T.prefix_query(q, "bge-code").alias("bge"), T.prefix_query(q, "qwen").alias("qwen"))


_TICKETS = r"""SELECT commit_hash, key, source FROM (SELECT commit_hash, key, source, row_number() OVER (PARTITION BY commit_hash, key ORDER BY o) AS rn FROM (
    SELECT DISTINCT commit_hash, unnest(regexp_extract_all(subject, '\b([A-Z]{2,}-\d+)\b', 1)) AS key, 'jira' AS source, 1 AS o FROM commits
    UNION ALL SELECT DISTINCT commit_hash, '#' || unnest(regexp_extract_all(subject, '(?:^|\s)#(\d+)\b', 1)), 'github', 2 FROM commits
    UNION ALL SELECT DISTINCT commit_hash, unnest(regexp_extract_all(subject, '\b([\w.-]+/[\w.-]+#\d+)\b', 1)), 'github', 3 FROM commits)) WHERE rn = 1"""


@R.query("extract_tickets", oracle(_TICKETS))
def extract_tickets(spark, sf_dir):
    commits = view(spark, sf_dir, "commits").select("commit_hash", "subject").distinct()
    return commits.select("commit_hash", F.explode(T.tickets(F.col("subject"))).alias("t")).select("commit_hash", "t.key", "t.source").distinct()


@R.query("content_hash", "SELECT DISTINCT chunk_id, sha256(content)[:16] AS chunk_hash, sha256(content)[:32] AS cache_key FROM chunks WHERE chunk_id IS NOT NULL")
def content_hash(spark, sf_dir):
    c = F.col("content")
    return view(spark, sf_dir, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", T.content_hash(c).alias("chunk_hash"), T.content_hash(c, 32).alias("cache_key")).distinct()


_PID = "string_split(chunk_id, '//')"


@R.query(
    "parse_chunk_id",
    rf"SELECT DISTINCT chunk_id, CASE WHEN ok THEN p[2] END AS project, CASE WHEN ok THEN regexp_extract(p[4], '^(\d+)-', 1)::INT END AS start_line, CASE WHEN ok THEN p[5] END AS hash FROM (SELECT chunk_id, {_PID} AS p, len({_PID}) = 5 AND regexp_matches(coalesce({_PID}[4], ''), '^\d+-\d+$') AS ok FROM chunks)",
)
def parse_chunk_id(spark, sf_dir):
    parsed = T.parse_chunk_id(F.col("chunk_id"))
    return view(spark, sf_dir, "chunks").select("chunk_id", parsed.alias("p")).select("chunk_id", "p.project", F.col("p.startLine").alias("start_line"), "p.hash").distinct()


@R.query("build_chunk_id", "SELECT DISTINCT concat_ws('//', grp, project, file, startLine || '-' || endLine, hash) AS built, chunk_id FROM chunks WHERE file IS NOT NULL AND startLine IS NOT NULL")
def build_chunk_id(spark, sf_dir):
    rows = view(spark, sf_dir, "chunks").where("file IS NOT NULL AND startLine IS NOT NULL")
    return rows.select(T.chunk_id("grp", "project", "file", "startLine", "endLine", "hash").alias("built"), "chunk_id").distinct()


@R.query(
    "card_texts",
    """SELECT id, CASE arch_kind WHEN 'component' THEN concat_ws(chr(10), name, summary, array_to_string(files, ' ')) WHEN 'decision' THEN concat_ws(chr(10), title, context, decision, alternativesRejected, consequences)
    ELSE concat_ws(chr(10), rule, why, when_applies, evidence) END AS text FROM arch_cards""",
)
def card_texts(spark, sf_dir):
    from strandline.operators.memory import card_text

    return view(spark, sf_dir, "arch_cards").select("id", card_text().alias("text"))


@R.query(
    "sanitize_inline",
    r"""SELECT id, CASE WHEN length(t) > 200 THEN t[:200] || chr(8230) ELSE t END AS label FROM (SELECT id, regexp_replace(regexp_replace(definition, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM glossary_terms)""",
)
def sanitize_inline(spark, sf_dir):
    return view(spark, sf_dir, "glossary_terms").select("id", T.inline(F.col("definition")).alias("label"))


NOW = 1_740_000_000_000


@R.query(
    "card_age",
    f"""SELECT id, CASE WHEN m < 1 THEN 'updated just now' WHEN m < 60 THEN 'updated ' || m || 'm ago' WHEN m // 60 < 24 THEN 'updated ' || m // 60 || 'h ago' WHEN m // 1440 < 30 THEN 'updated ' || m // 1440 || 'd ago'
    WHEN m // 43200 < 12 THEN 'updated ' || m // 43200 || 'mo ago' ELSE 'updated ' || m // 518400 || 'y ago' END AS age, {NOW} - updatedAt > 7776000000 AS stale FROM (SELECT *, ({NOW} - updatedAt) // 60000 AS m FROM arch_cards)""",
)
def card_age(spark, sf_dir):
    ms = F.lit(NOW) - F.col("updatedAt")
    return view(spark, sf_dir, "arch_cards").select("id", T.age(ms).alias("age"), T.is_stale(ms).alias("stale"))


@R.query("confidence_bands", "SELECT search_id, CASE WHEN max(score) >= 0.6 THEN 'high' WHEN max(score) >= 0.4 THEN 'partial' ELSE 'low' END AS band, count(*) FILTER (score >= 0.6) AS high, count(*) FILTER (score < 0.4) AS low FROM search_results GROUP BY search_id")
def confidence_bands(spark, sf_dir):
    return view(spark, sf_dir, "search_results").groupBy("search_id").agg(T.confidence(F.max("score")).alias("band"), F.count_if(F.col("score") >= 0.6).alias("high"), F.count_if(F.col("score") < 0.4).alias("low"))


@R.query("privacy_and_limits", "SELECT DISTINCT id, CASE WHEN tool = 'search_docs' THEN NULL ELSE query_text[:1024] END AS query_text, error[:256] AS error, {q}user{q}[:256] AS {q}user{q} FROM search_events".replace("{q}", '"'))
def privacy_and_limits(spark, sf_dir):
    cap = lambda c, k: F.left(F.col(c), F.lit(fixed.TEXT_LIMITS[k])).alias(c)
    rows = view(spark, sf_dir, "search_events").withColumn("query_text", F.when(F.col("tool") != "search_docs", F.col("query_text")))
    return rows.select("id", cap("query_text", "query_text"), cap("error", "error"), cap("user", "identity")).distinct()


@R.query("trigger_filter", "SELECT DISTINCT full_name FROM repo_fingerprints WHERE full_name LIKE 'atlas-%' AND string_split(full_name, '/')[2] IN (SELECT string_split(full_name, '/')[2] FROM repo_probes)")
def trigger_filter(spark, sf_dir):
    short = F.element_at(F.split("full_name", "/"), 2)
    names = view(spark, sf_dir, "repo_probes").select(short.alias("short")).distinct()
    return view(spark, sf_dir, "repo_fingerprints").where(F.startswith("full_name", F.lit("atlas-"))).withColumn("short", short).join(names, "short", "left_semi").select("full_name").distinct()


_LANGS = " UNION ALL ".join(f"SELECT '{k}' AS language, unnest({_list(v)}) AS pattern" for k, v in fixed.LANGUAGE_EXCLUDES.items())


@R.query("exclude_patterns", f"SELECT DISTINCT language, CASE WHEN contains(pattern, '/') OR contains(pattern, '**') THEN pattern ELSE '**/' || pattern || '/**' END AS pattern FROM ({_LANGS})")
def exclude_patterns(spark, sf_dir):
    rows = [(k, p) for k, v in fixed.LANGUAGE_EXCLUDES.items() for p in v]
    return spark.createDataFrame(rows, "language string, pattern string").select("language", T.exclude_pattern(F.col("pattern")).alias("pattern")).distinct()


_PATTERNS = " UNION ALL ".join(f"SELECT '{k}' AS language, unnest({_list(v)}) AS pattern" for k, v in fixed.LANGUAGE_PATTERNS.items())


@R.query("language_profiles", f"SELECT language, count(*) AS n_patterns, string_agg(pattern, ' ' ORDER BY pattern) AS patterns FROM ({_PATTERNS}) GROUP BY language")
def language_profiles(spark, sf_dir):
    rows = [(k, p) for k, v in fixed.LANGUAGE_PATTERNS.items() for p in v]
    return spark.createDataFrame(rows, "language string, pattern string").groupBy("language").agg(F.count("*").alias("n_patterns"), F.array_join(F.array_sort(F.collect_list("pattern")), " ").alias("patterns"))
