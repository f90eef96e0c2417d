from strandline.operators import analytics as A

S = "id string, ts long, user string, session string, group_name string, anchor_project string, query_text string, query_hash string, query_tokens string, duration_ms long, result_count int, error string"
RES = "search_id string, rank int, project string, language string, chunk_lines int, file_total_lines int, chunk_id string"
FET = "id string, ts long, user string, session string, chunk_id string, preceding_search_id string"


def search(i, ts=0, user="u", session=None, anchor="a", tokens='["x"]', n=4, **k):
    return (i, ts, user, session, "g", anchor, k.get("text", i), k.get("hash", i), tokens, k.get("ms", 10), n, k.get("error"))


def test_off_anchor_share_is_three_quarters(spark):
    s = spark.createDataFrame([search("s1")], S)
    r = spark.createDataFrame([("s1", i, p, "ts", 1, 1, f"c{i}") for i, p in enumerate("abcd")], RES)
    assert A.cross_project_share(s, r).first()["share"] == 0.75


def test_token_report(spark):
    s = spark.createDataFrame([search("s1"), search("none")], S)
    r = spark.createDataFrame([("s1", 0, "a", "ts", 21, 200, "c")], RES)
    f = spark.createDataFrame([("f", 1, "u", None, "c", "s1")], FET)
    got = A.token_savings(s, r, f).first()
    assert (got["searches"], got["search_only"], got["naive_baseline"], got["actually_consumed"]) == (1, 115.5, 1100.0, 115.5)
    twice = A.token_savings(s, r, f.union(f)).first()
    assert twice["naive_baseline"] == 2200.0
    empty = A.token_savings(s.limit(0), r, f).first()
    assert empty["searches"] == 0 and empty["savings_vs_naive"] is None


def test_reformulation_and_fetch_between(spark):
    s = spark.createDataFrame([search("a", 0, tokens='["auth","flow"]'), search("b", 5000, tokens='["auth","flow"]'), search("c", 400_000), search("d", 10, user="w", tokens="[]"), search("e", 20, user="w", tokens="[ ]")], S)
    none = spark.createDataFrame([], FET)
    rate = {r["user"]: r["reformulations"] for r in A.retry_rate(s, none).collect()}
    assert rate == {"u": 1, "w": 0}
    between = spark.createDataFrame([("f", 100, "u", None, "c", "a")], FET)
    assert {r["user"]: r["reformulations"] for r in A.retry_rate(s, between).collect()}["u"] == 0


def test_percentiles_are_nearest_rank(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 101)], "v long")
    got = A.nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert tuple(got) == (51, 96, 100)
    ties = spark.createDataFrame([(5,)] * 9 + [(7,)], "v long")
    assert tuple(A.nearest_rank(ties, "v", {"a": 0.5, "b": 0.9}).first()) == (5, 7)


def test_preceding_search(spark):
    s = spark.createDataFrame([search("s1", 10), search("s2", 20), search("s3", 40), search("o", 25, user="w")], S)
    r = spark.createDataFrame([(x, 0, "a", "ts", 1, 1, "c") for x in ("s1", "s2", "s3", "o")], RES)
    f = spark.createDataFrame([("f1", 30, "u", None, "c", None), ("f2", 5, "u", None, "c", None), ("f3", 20, "u", None, "c", None), ("f4", 30, "u", None, "other", None)], FET)
    assert {x["id"]: x["preceding_search_id"] for x in A.preceding_search(f, s, r).collect()} == {"f1": "s2", "f2": None, "f3": "s2", "f4": None}


def test_gap_filled_buckets(spark):
    s = spark.createDataFrame([search("a", 5), search("b", 25, error="x")], S)
    got = [tuple(r) for r in A.over_time(s, spark.createDataFrame([], FET), 0, 30, 10).orderBy("bucket").collect()]
    assert got == [(0, 1, 0, 0), (10, 0, 0, 0), (20, 1, 0, 1), (30, 0, 0, 0)]


def test_prune_keeps_results_of_kept_searches(spark):
    s = spark.createDataFrame([search("a", 5), search("b", 25)], S)
    r = spark.createDataFrame([("a", 0, "p", "ts", 1, 1, "c"), ("b", 0, "p", "ts", 1, 1, "c")], RES)
    kept = A.prune({"searches": s, "results": r}, 10)
    assert [x["search_id"] for x in kept["results"].collect()] == ["b"]
