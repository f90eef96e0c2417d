import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T


def one(spark, f, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'long' if isinstance(v, int) else 'double'}" for i, v in enumerate(values)))
    return row.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "query, want",
    [
        ("auth middleware", ["auth middleware", "authentication middleware", "authMiddleware"]),
        ("authentication flow", ["authentication flow", "auth flow", "authenticationFlow"]),
        ("how does the login work here", ["how does the login work here", "login here", "howDoesTheLoginWorkHere"]),
        ("getUserById", ["getUserById", "get user by id"]),
        ("queries", ["queries", "query"]),
        ("boxes", ["boxes", "box"]),
        ("class", ["class"]),
        ("status", ["status"]),
        ("  ", ["  "]),
    ],
)
def test_expand_query(spark, query, want):
    assert one(spark, T.expand_query, query) == want


def test_tokenize_query(spark):
    assert one(spark, T.tokenize_query, " How does the Auth_flow, auth_flow a x ÄRGER? ") == ["auth_flow", "ärger"]
    assert one(spark, T.tokenize_query, "") == []


def test_term_index_is_fnv(spark):
    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        return h & 0x7FFFFFFF

    for w in ("a", "cache", "zz_9"):
        assert one(spark, T.term_index, w) == fnv(w)


def test_tickets(spark):
    got = lambda s, **k: [tuple(t) for t in one(spark, lambda c: T.tickets(c, **k), s)]
    assert got("feat: PROJ-12 and PROJ-12, fixes #42 (org/repo#7) colour#fff") == [("PROJ-12", "jira"), ("#42", "github"), ("org/repo#7", "github")]
    assert got("see TASK_9 and T9", custom={r"TASK_(\d+)": "custom", "T9": "custom"}) == [("9", "custom"), ("T9", "custom")]
    assert got("a #1a b#2") == []


def test_non_source(spark):
    reason = lambda s: one(spark, T.non_source_reason, s)
    assert reason("short") == ""
    assert reason("x" * 6000).startswith("line of 6000")
    assert reason(("QUJD" * 20 + "\n") * 30) == "dense base64 blob"
    assert reason(("word " * 300 + "\n") * 3).startswith("avg line")
    assert reason("const a = 1;\n" * 100) == ""


def test_markdown(spark):
    md = lambda s: one(spark, T.is_markdown, s)
    assert md("# Title") and md("```\nx\n```") and md("| a | b |")
    assert not md("- just one bullet") and md("- bullet\n> quote")
    assert not md("") and not md("plain text") and md(None) is False


def test_language_tags_and_paths(spark):
    assert one(spark, lambda p, c: T.language_of(p, c), "a/b.TSX", "") == "typescript"
    assert one(spark, lambda p, c: T.language_of(p, c), "bin/run", "#!/usr/bin/env python3\nx") == "python"
    assert one(spark, lambda p, c: T.language_of(p, c), "README", "hi") is None
    assert one(spark, T.auto_tag, "src/controllers/user.ts") == "controllers"
    assert one(spark, T.auto_tag, "user.ts") is None
    assert one(spark, lambda p: T.resolve_tags(p, ["x"], {"src/api/": ["api"]}), "src/api/a.ts") == ["x", "api"]


def test_chunk_ids(spark):
    p = one(spark, T.parse_chunk_id, "g//p//f1.ts//1-5//h1")
    assert (p["grp"], p["project"], p["file"], p["startLine"], p["endLine"], p["hash"]) == ("g", "p", "f1.ts", 1, 5, "h1")
    for bad in ("g//p//f//1-5", "g//p//f//a-5//h", "g//p//f//1-5//h//x", "", None):
        assert one(spark, T.parse_chunk_id, bad) is None


def test_breadcrumbs_and_labels(spark):
    assert one(spark, T.strip_breadcrumb, "A > B\n\nbody") == "body"
    assert one(spark, T.strip_breadcrumb, "A B\n\nbody") == "A B\n\nbody"
    assert one(spark, T.inline, " a\u200b  b\n c\x1b ") == "a b c"
    assert len(one(spark, T.inline, "y" * 300)) == 201
    assert one(spark, T.age, 59_000) == "updated just now" and one(spark, T.age, 3 * 3_600_000) == "updated 3h ago"


def test_query_types_and_prefixes(spark):
    kind = lambda s: one(spark, T.query_type, s)
    assert kind("const x = 1") == "code2code" and kind("how to sort") == "techqa" and kind("sort a list") == "nl2code" and kind("sorted?") == "techqa"
    assert one(spark, lambda q: T.prefix_query(q, "qwen"), "sort").endswith("\nQuery:sort")
    assert one(spark, lambda q: T.prefix_query(q, "none"), "sort") == "sort"


def test_whole_tables_are_judged_and_expanded(spark, tmp_path):
    from strandline.plans import retrieval, text

    docs = [(1, "# a\r\nb\r\n", True), (2, "a\r# b\r", True), (3, "plain\r\ntext", False), (4, None, False), (5, "", False), (6, "- a\r\n1. b", True)]
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["markdown"] for r in text.R.queries["detect_markdown"](spark, str(tmp_path)).collect()}
    assert got == {d[0]: d[2] for d in docs}
    terms = [("a", "caches", "stores", None), ("b", "Cache Store", "a place", ["cs"]), ("c", "queue", None, [])]
    spark.createDataFrame(terms, "id string, term string, definition string, aliases array<string>").write.parquet(str(tmp_path / "glossary_terms.parquet"))
    got = {r["id"]: r["variants"].split(" | ") for r in retrieval.R.queries["glossary_expansion"](spark, str(tmp_path)).collect()}
    assert got == {"a": ["caches", "cache", "caches stores"], "b": ["Cache Store", "cacheStore", "Cache Store a place cs"], "c": ["queue"]}
