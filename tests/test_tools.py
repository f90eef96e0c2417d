import pytest

from strandline.operators import memory as M
from strandline.operators import tools as L
from strandline.streaming import jobs as J

CARDS = "id string, arch_kind string, project string, name string, status string, supersedes string, createdAt long, updatedAt long, vector array<float>"


class Words:
    """An embedder of three words."""

    def embed(self, texts):
        import numpy as np

        return np.array([[float(w in t) for w in ("cache", "queue", "disk")] + [0.1] for t in texts], np.float32)


def card(i, kind, vector, project=None, status=None, supersedes=None, name=None, at=1):
    return (i, kind, project, name, status, supersedes, at, at, [float(x) for x in vector])


def index(spark, cards):
    chunks = spark.createDataFrame([("c1", "g", "p", "a", 0, 5, "x", "h"), ("c1", "g", "p", "a", 9, 12, "y", "h2"), ("c2", "g", "q", "b", 0, 3, "z", "h3")], "chunk_id string, grp string, project string, file string, start_line int, end_line int, content string, hash string")
    edges = spark.createDataFrame([("c1", "c2"), ("c2", "c2")], "from_chunk_id string, to_chunk_id string")
    commits = spark.createDataFrame([("c1", "k"), ("c2", "k")], "chunk_id string, commit_hash string")
    return L.Index(chunks, edges=edges, commits=commits, cards=spark.createDataFrame(cards, CARDS), embedder=Words())


def test_a_busy_kind_does_not_crowd_out_another(spark):
    cards = [card(f"l{i:03}", "lesson", [1, 0, 0, 0.1]) for i in range(150)] + [card("d1", "decision", [0.9, 0.3, 0, 0.1]), card("c1", "component", [0.8, 0.4, 0, 0.1], "p")]
    got = L.arch_context(index(spark, cards), "the cache", project="p", min_score=0.1, limits={"lesson": 2}).collect()
    assert sorted((r["arch_kind"], r["card_id"]) for r in got if r["arch_kind"] != "lesson") == [("component", "c1"), ("decision", "d1")]
    assert sum(r["arch_kind"] == "lesson" for r in got) == 2


def test_what_becomes_of_new_records(spark):
    old = [card("d1", "decision", [1, 0, 0, 0]), card("d2", "decision", [1, 0, 0, 0], status="superseded"), card("d3", "decision", [0, 1, 0, 0], "p"), card("l1", "lesson", [0, 0, 1, 0], at=5), card("c1", "component", [1, 1, 1, 1], "p", name="store", at=3)]
    new = [
        card("n1", "decision", [1, 0.1, 0, 0], at=9), card("n2", "decision", [0, 1, 0, 0], "q", at=9), card("n3", "decision", [0, 1, 0, 0], "p", at=9), card("n4", "decision", [1, 0, 0, 0], supersedes="d1", at=9),
        card("n5", "lesson", [0, 0, 1, 0.01], at=9), card("n6", "lesson", [1, 0, 0, 0], at=9), card("n7", "component", [0, 0, 0, 1], "p", name="store", at=9), card(None, "lesson", [1, 0, 0, 0], at=9),
    ]
    after, outcome = M.recorded(spark.createDataFrame(old, CARDS), spark.createDataFrame(new, CARDS))
    got = {r["id"]: (r["outcome"], r["nearest"]) for r in outcome.collect()}
    assert got == {"n1": ("duplicate", "d1"), "n2": ("created", None if got["n2"][1] is None else "d1"), "n3": ("duplicate", "d3"), "n4": ("created", None), "n5": ("updated", "l1"), "n6": ("created", "l1"), "n7": ("updated", got["n7"][1])}
    rows = {r["id"]: r for r in after.collect()}
    assert set(rows) == {"d1", "d2", "d3", "l1", "c1", "n2", "n4", "n6"}
    assert rows["d1"]["status"] == "superseded" and rows["l1"]["updatedAt"] == 9 and (rows["c1"]["createdAt"], rows["c1"]["updatedAt"]) == (3, 9)
    assert M.deleted(after, ["d1", "none"]).count() == 7
    nothing = spark.createDataFrame([], CARDS)
    assert M.recorded(nothing, nothing)[0].count() == 0


def test_a_deleted_project_leaves_nothing(spark):
    i = L.delete_project(index(spark, [card("d1", "decision", [1, 0, 0, 0], "p"), card("d2", "decision", [1, 0, 0, 0])]), "g", "p")
    assert [r["chunk_id"] for r in i.chunks.collect()] == ["c2"] and [tuple(r) for r in i.edges.select("from_chunk_id", "to_chunk_id").collect()] == [("c2", "c2")]
    assert i.commits.count() == 1 and [r["id"] for r in i.cards.collect()] == ["d2"]
    assert {r["name"]: r["rows"] for r in L.health_check(i).collect()} == {"chunks": 1, "edges": 1, "commits": 1, "cards": 1}


def test_fetches_leave_events_found_or_not(spark):
    asked = spark.createDataFrame([(1, 5, "u", "c1", 0), (2, 6, "u", "gone", 20)], "id int, ts long, user string, chunk_id string, radius_lines int")
    hits, events = L.fetched(index(spark, [card("d", "decision", [1, 0, 0, 0])]), asked)
    assert [(r["id"], r["content"]) for r in hits.collect()] == [(1, "x")]
    assert sorted((r["id"], r["found"]) for r in events.collect()) == [(1, True), (2, False)]


def test_modes():
    assert "search_code" in L.tools_of("coding")
    with pytest.raises(ValueError):
        L.tools_of("none")


def test_dead_letters_outlive_the_process(spark, tmp_path):
    tries = []

    def work(rows, n):
        tries.append(n)
        if n == 1 or len(tries) == 1:
            raise RuntimeError("no sink")

    run = J.with_retries(work, f"file://{tmp_path}/dead")
    df = spark.createDataFrame([(7,)], "id int")
    run(df, 0)
    run(df, 1)
    run(df, 1)
    assert [tuple(r) for r in J.dead_letters(spark, f"file://{tmp_path}/dead", "id int").collect()] == [(7, 1, "no sink")]


def test_latest_search_of_every_fetch(spark):
    pairs = spark.createDataFrame([("f", "a", 1), ("f", "b", 3), ("f", "c", 3), ("g", None, None)], "fetch_id string, search_id string, asked_ts long")
    assert sorted(tuple(r) for r in J.latest_search(pairs).collect()) == [("f", "c"), ("g", None)]


def test_top_k_by_part_and_in_blocks(spark, monkeypatch):
    import numpy as np

    from strandline.operators import retrieval as S

    r = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(r.normal(size=(300, 8)))] + [(900, "a", None), (901, "a", [0.0] * 8), (902, "b", [1.0])]
    df = spark.createDataFrame(rows, "id long, part_of string, vector array<double>")
    want = {}
    x = np.array([v for _, _, v in rows[:300]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 10):
        for part in range(2):
            own = np.arange(part, 300, 2)
            want[q, "ab"[part]] = [int(own[j]) for j in np.argsort(-(x[own] @ x[q]), kind="stable")[:4]]

    def got():
        out = {}
        for h in S.top_k(df.where("id % 10 = 0 AND id < 300"), df, 4, by="part_of").orderBy("rank").collect():
            out.setdefault((h["query_id"], h["part_of"]), []).append(h["id"])
        return out

    assert got() == want
    monkeypatch.setattr(S, "QUERIES", 5)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert got() == want


def test_a_store_gets_batches_with_retries(spark, tmp_path):
    from strandline.sources.sinks import upsert_batches

    root = str(tmp_path)

    def connect():
        import json
        import os

        class Folder:
            def upsert(self, rows):
                mark = os.path.join(root, f"tried-{rows[0]['id']}")
                if rows[0]["id"] == 4:
                    raise RuntimeError("never")
                if not os.path.exists(mark):
                    open(mark, "w").close()
                    raise RuntimeError("not yet")
                for r in rows:
                    with open(os.path.join(root, f"row-{r['id']}"), "w") as f:
                        json.dump(r, f)

        return Folder()

    df = spark.range(10).coalesce(1).selectExpr("id", "id * 2 AS n_rows")
    got = sorted(tuple(r) for r in upsert_batches(df, "id", connect, size=2, wait=0.01).collect())
    assert got == [("0", 2, 2, None), ("2", 2, 2, None), ("4", 2, 3, "never"), ("6", 2, 2, None), ("8", 2, 2, None)]
    assert sorted(p.name for p in tmp_path.glob("row-*")) == [f"row-{i}" for i in (0, 1, 2, 3, 6, 7, 8, 9)]
    assert upsert_batches(df.limit(0), "id", connect).count() == 0


def test_gauges_rates_and_quantiles_of_odd_rows(spark):
    from strandline.operators import analytics as A

    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 1, 7.0), (None, 3, 50.0), ("b", None, 1.0)], "k string, at long, v double")
    assert {r["k"]: r["value"] for r in A.gauges(df, "at", "v", ["k"]).collect()} == {"a": 7.0, None: 50.0}
    assert {r["k"]: r["quantile"] for r in A.histogram_quantile(df, "v", [2, 10, 20], 0.5, ["k"]).collect()} == {"a": 6.0, None: 20.0, "b": 1.0}
    assert A.rates(df, "at", 1000, ["k"]).count() == 2 and A.gauges(df.limit(0), "at", "v", ["k"]).count() == 0


def test_one_tree_at_many_settings(spark):
    from strandline.operators.sessions import cut_many, cut_sessions, gap_tree

    rows = [("u", t, str(i)) for i, t in enumerate((0, 10, 100, 101, 5000))]
    tree = gap_tree(spark.createDataFrame(rows, "user string, ts long, id string")).cache()
    got = sorted((r["gap_ms"], r["start_ts"], r["n_events"]) for r in cut_many(tree, [20, 200, 10_000]).collect())
    want = sorted((g, r["start_ts"], r["n_events"]) for g in (20, 200, 10_000) for r in cut_sessions(tree, g).collect())
    assert got == want and len(got) == 3 + 2 + 1
