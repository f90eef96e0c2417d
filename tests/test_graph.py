from strandline.operators import graph as G

T = "project string, symbol string, chunk_id string, file string"


def edges(spark, uses, defs, most=50):
    u, d = spark.createDataFrame(uses, T), spark.createDataFrame(defs, T)
    e = {(r["from_chunk_id"], r["to_chunk_id"], r["symbol_name"]): r["confidence"] for r in G.symbol_edges(u, d, most).collect()}
    return e, tuple(G.edge_stats(u, d, most).first())


def test_confidence(spark):
    assert edges(spark, [("p", "x", "c1", "f1")], [("p", "x", "c2", "f2")])[0] == {("c1", "c2", "x"): "INFERRED"}
    assert edges(spark, [("p", "x", "c1", "f1")], [("p", "x", "c2", "f1")])[0] == {("c1", "c2", "x"): "EXTRACTED"}
    assert set(edges(spark, [("p", "x", "c1", "f1")], [("p", "x", "c2", "f1"), ("p", "x", "c3", "f3")])[0].values()) == {"AMBIGUOUS"}


def test_no_self_edges_no_repeats_no_other_project(spark):
    assert edges(spark, [("p", "x", "c1", "f1")] * 3, [("p", "x", "c1", "f1"), ("q", "x", "c9", "f9")])[0] == {}


def test_fanout_limit_is_exclusive(spark):
    at = [("p", "x", f"d{i}", "f") for i in range(50)]
    e, stats = edges(spark, [("p", "x", "u", "g")], at)
    assert len(e) == 50 and stats == (0, 0)
    e, stats = edges(spark, [("p", "x", "u", "g"), ("p", "x", "w", "g")], at + [("p", "x", "d50", "f")])
    assert e == {} and stats == (1, 102)


def test_hubs_and_impact(spark):
    rows = [("p", f"u{i}", "hub", "calls", "h", "INFERRED") for i in range(12)] + [("p", "a", "b", "calls", "s", "INFERRED"), ("p", "b", "c", "calls", "s", "INFERRED"), ("p", "c", "d", "calls", "s", "INFERRED")]
    e = spark.createDataFrame(rows, "project string, from_chunk_id string, to_chunk_id string, relation_type string, symbol_name string, confidence string")
    assert [r["chunk_id"] for r in G.hubs(G.degrees(e)).collect()] == ["hub"]
    seeds = spark.createDataFrame([("a",)], "chunk_id string")
    assert {(r["chunk_id"], r["hop"]) for r in G.impact(e, seeds).collect()} == {("b", 1), ("c", 2)}
    usages = G.find_usages(e, spark.createDataFrame([("hub",)], "chunk_id string"), G.hubs(G.degrees(e)), "incoming", limit=5).collect()
    assert len(usages) == 5
    none = e.limit(0)
    assert G.hubs(G.degrees(none)).count() == 0 and G.impact(none, seeds).count() == 0


def test_whole_edges_at_every_size(spark):
    from strandline.plans.graph import R
    from strandline.views import view

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        used = view(spark, sf, "all_uses").select("project", "symbol").distinct().join(view(spark, sf, "all_defs").select("project", "symbol").distinct(), ["project", "symbol"]).count()
        edges = R.queries["symbol_edges"](spark, sf)
        assert edges.select("project", "symbol_name").distinct().count() >= 0.9 * used > 0
