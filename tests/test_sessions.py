import random

import pytest

from strandline.operators.sessions import ROOT, cut_sessions, gap_tree

SCHEMA = "user string, ts long, id string, session string, gap long"


def brute(rows, gap):
    by = {}
    for u, t, i, *_ in rows:
        if t is not None:
            by.setdefault(u, set()).add((t, i))
    out = []
    for u, events in by.items():
        ts = sorted(t for t, _ in events)
        at = 0
        for k in range(1, len(ts) + 1):
            if k == len(ts) or ts[k] - ts[k - 1] > gap:
                out.append((u, ts[at], ts[k - 1], ts[k - 1] - ts[at], k - at))
                at = k
    return sorted(out, key=repr)


def found(spark, rows, gap):
    return sorted((tuple(r) for r in cut_sessions(gap_tree(spark.createDataFrame(rows, SCHEMA)), gap).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("gap", [0, 3, 50])
def test_against_brute_force(spark, seed, gap):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "hot", "hot", "hot", None]), r.randrange(400), f"e{k}", None, 1) for k in range(300)]
    rows += r.sample(rows, 60) + [("a", None, "x", None, 1)]
    assert found(spark, rows, gap) == brute(rows, gap)


def test_one_tree_serves_all_gaps_and_splits_a_user(spark):
    rows = [("u", t * t % 977 * 10, f"e{t}", None, 1) for t in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    tree = gap_tree(df).cache()
    for gap in (0, 10, 25, 100, 10_000):
        assert sorted(map(tuple, cut_sessions(tree, gap).collect()), key=repr) == brute(rows, gap)
    distinct = len({(t, i) for _, t, i, *_ in rows})
    assert tree.count() == 2 * distinct - 1
    assert tree.where(f"parent_gap = {ROOT}").count() == 1


def test_rising_gaps_keep_all_nodes_open(spark):
    rows = [("u", t * (t + 1) // 2, f"e{t}", None, 1) for t in range(200)]
    assert found(spark, rows, 100) == brute(rows, 100)


def test_empty_and_single(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [("u", 7, "i", None, 1)], 5) == [("u", 7, 7, 0, 1)]


def test_rows_without_id_count_once_for_each_time(spark):
    assert found(spark, [("u", 1, None, None, 1), ("u", 1, None, None, 1), ("u", 2, None, None, 1)], 5) == [("u", 1, 2, 1, 2)]
