import pytest
from pyspark.sql import functions as F

from strandline.operators import history as H
from strandline.operators import maintenance as K
from strandline.operators import memory as M
from strandline.operators import retrieval as S
from strandline.sources import config, embedders, files


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_top_k_ties_nulls_and_empty(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(9, [3.0, 0.0])], "id long, vector array<float>")
    assert rows(S.top_k(q, c, 2), "id", "rank") == [(1, 1), (2, 2)]
    assert S.top_k(q.limit(0), c, 2).count() == 0 and S.top_k(q, c.limit(0), 2).count() == 0


def test_rrf_and_audience(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    got = S.rrf([a, a.where("id = 2").withColumn("rank", F.lit(1))], ["id"]).orderBy(F.col("score").desc()).first()
    assert got["id"] == 2
    assert S.audience_ceiling(None, None) is None and S.audience_ceiling(["a"], ["b"]) == [] and S.audience_ceiling([" a ", ""], ["a"]) == ["a"]


def test_neighbours(spark):
    parts = spark.createDataFrame([(1, i, f"D > H\n\np{i}", i * 3, i * 3 + 2) for i in range(4)], "doc_id int, idx int, content string, start_line int, end_line int")
    hit = spark.createDataFrame([(1, 1)], "doc_id int, idx int")
    assert rows(S.with_neighbours(hit, parts)) == [(1, 1, "p0\n\np1\n\np2", 0, 8)]


def test_gate_boost_kinds(spark):
    h = spark.createDataFrame([("k", "a", 0.9), ("k", "b", 0.75), ("m", "a", 0.75), ("n", "a", 0.2)], "key string, other string, score double")
    assert rows(M.gated(h, "key", "other"), "key", "outcome") == [("k", "duplicate"), ("m", "similar"), ("n", "created")]
    hits = spark.createDataFrame([("a", "lesson", "p", 0.42), ("b", "lesson", None, 0.44), ("c", "decision", "p", 0.99)], "id string, arch_kind string, project string, score double")
    assert rows(M.boosted(hits, "p"), "id") == [("a",), ("c",)]
    assert M.boosted(hits, "p").agg(F.max("score")).first()[0] == 1.0
    assert rows(M.top_by_kind(hits, {"lesson": 0, "decision": 1}), "id") == [("c",)]


def test_visibility(spark):
    c = spark.createDataFrame([("1", "component", None, None), ("2", "component", "p", "accepted"), ("3", "lesson", None, "superseded"), ("4", "lesson", "q", None)], "id string, arch_kind string, project string, status string")
    assert rows(M.visible(c, "p"), "id") == [("2",), ("3",)]
    assert rows(M.current(c), "id") == [("1",), ("2",), ("4",)]


def test_history(spark):
    log = spark.createDataFrame([("h|2025-01-01T00:00:00Z|e|fix: a | b",), ("broken",)], "line string")
    assert rows(H.parse_log(log)) == [("h", "2025-01-01T00:00:00Z", "e", "fix: a | b")]
    lines = spark.createDataFrame([("f", 1, "a" * 40), ("f", 2, "@@ -1,2 +3 @@"), ("f", 3, "@@ -1 +5,0 @@"), ("f", 4, "@@ -1 +7,3 @@ f")], "file string, line_no int, line string")
    assert rows(H.parse_hunks(lines), "start_line", "end_line") == [(3, 3), (5, 5), (7, 9)]
    places = spark.createDataFrame([("c1", "f", 0, 10), ("c2", "f", 11, 20)], "chunk_id string, file string, start_line int, end_line int")
    commits = spark.createDataFrame([("f", "x", "2025", "e", "PROJ-1"), ("f", "y", "2024", "e", "s")], "file string, commit_hash string, committed_at string, author_email string, subject string")
    hunks = spark.createDataFrame([("f", "x", 12, 13)], "file string, commit_hash string, start_line int, end_line int")
    assert rows(H.chunk_commits(places, commits, hunks), "chunk_id", "commit_hash") == [("c1", "y"), ("c2", "x"), ("c2", "y")]


def test_maintenance(spark):
    t = "k string, v int"
    old, new = spark.createDataFrame([("a", 1), ("b", 5)], t), spark.createDataFrame([("a", 2), ("c", 1), ("b", 4)], t)
    assert rows(K.upsert_latest(old, new, ["k"], "v")) == [("a", 2), ("b", 5), ("c", 1)]
    assert rows(K.insert_absent(old, new, ["k"])) == [("a", 1), ("b", 5), ("c", 1)]
    assert rows(K.config_changes(old, new, "k", ["v"])) == [("a", "modified"), ("b", "modified"), ("c", "added")]
    wild = spark.createDataFrame([("a_b//x",), ("aXb//x",), (None,)], "chunk_id string")
    assert sorted(r[0] or "" for r in K.delete_prefix(wild, "a_b//").collect()) == ["", "aXb//x"]
    with pytest.raises(ValueError):
        K.require_same_model({"model": "a", "dims": 2}, "b", 2)


def test_not_contained_against_brute_force(spark):
    import random

    r = random.Random(1)
    ranges = list({(a, a + r.randrange(6)) for a in (r.randrange(40) for _ in range(60))})
    df = spark.createDataFrame([("f", a, b, i) for i, (a, b) in enumerate(ranges)], "file string, start_line int, end_line int, idx int")
    want = sorted(x for x in ranges if not any(y != x and y[0] <= x[0] and y[1] >= x[1] for y in ranges))
    assert rows(K.not_contained(df, ["file"]), "start_line", "end_line") == want


def test_files(spark, tmp_path):
    for name, body in (("a.ts", b"let x = 1"), ("lib/b.ts", b"let y"), ("node_modules/c.ts", b"no"), ("d.py", b"x"), ("bad.ts", b"\xff\xfe"), ("skip/e.ts", b"z")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = files.scan(spark, str(tmp_path), ["**/*.ts"], ["node_modules"], "skip/\n")
    assert {r["file"]: r["content"] for r in got.collect()} == {"a.ts": "let x = 1", "lib/b.ts": "let y", "bad.ts": None}
    good, bad = files.split_readable(got)
    assert good.count() == 2 and bad.count() == 1
    assert files.inside("/a/b", "c/../d") == "/a/b/d"
    with pytest.raises(ValueError):
        files.inside("/a/b", "../c")


def test_config():
    got = config.settings(config.parse("chunkSize: 2048\nexclude:\n  - dist\n  - 'x y'\nnested:\n  a: true\n"))
    assert got["chunkSize"] == 2048 and got["exclude"] == ["dist", "x y"] and got["overlap"] == 128 and got["nested"] == {"a": True}
    for bad in ({"chunkSize": 0}, {"overlap": 5000}, {"paths": "x"}, {"batchSize": True}):
        with pytest.raises(ValueError):
            config.settings(bad)


def test_embedding_and_cache(spark):
    e = embedders.HashingEmbedder(8)
    assert (e.embed(["a b"]) == e.embed(["a b"])).all()
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    first = embedders.embed_missing(texts, spark.createDataFrame([], "hash string, model string"), e)
    assert first.count() == 2 and embedders.embed_missing(texts, first, e).count() == 0
    now = [0.0]
    c = embedders.QueryCache(5, 2, lambda: now[0])
    for k, g in (("1", "g"), ("2", "h"), ("3", "g")):
        c.put(k, g, k)
    assert c.get("1") is None and c.get("3") == "3"
    c.forget("g")
    assert c.get("3") is None and c.get("2") == "2"
    now[0] = 9
    assert c.get("2") is None


def test_whole_searches_ask_for_every_query(spark, sf):
    from strandline.plans.retrieval import R
    from strandline.views import view

    asked = {r["vec_id"] for r in view(spark, sf, "points").where("vec_id % 100 = 0").collect()}
    assert len(asked) > 3
    for name in ("expanded_search_merge", "cross_group_dedupe", "hybrid_search", "project_boost", "arch_context", "overfetch_then_filter"):
        assert {r["query_id"] for r in R.queries[name](spark, sf).select("query_id").distinct().collect()} == asked, name


def test_every_paragraph_gets_its_neighbours(spark, sf):
    from strandline.plans.retrieval import R, _paragraphs

    hits = R.queries["neighbour_merge"](spark, sf).select("doc_id", "hit").distinct().count()
    assert hits == _paragraphs(spark, sf).select("doc_id", "idx").distinct().count()
