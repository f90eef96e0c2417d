import random
import re

import pytest

from strandline.llm.near_duplicates import groups, similar_pairs

SCHEMA = "kind string, id string, text string, class string, words int"
WORD = re.compile(r"[^\W_]+")


def brute(rows, t):
    sets = {(k or "", i, frozenset(WORD.findall((x or "").lower()))) for k, i, x, *_ in rows if i is not None}
    sets = sorted((s for s in sets if s[2]), key=lambda s: s[1])
    return {(a[1], b[1]) for n, a in enumerate(sets) for b in sets[n + 1 :] if a[0] == b[0] and a[1] != b[1] and len(a[2] & b[2]) >= t * len(a[2] | b[2])}


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.5:
            s = r.choice(base)[:]
            for _ in range(r.randrange(6)):
                s[r.randrange(len(s))] = r.choice(words)
            r.shuffle(s)
        else:
            s = r.sample(words, 40)
            base.append(s)
        rows.append((r.choice("ab"), f"r{i:03}", ", ".join(s).upper() if r.random() < 0.3 else " ".join(s), None, 1))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_recall_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows, 0.7)
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_dense_region_beyond_the_adaptive_bound(spark, monkeypatch):
    from strandline.llm import near_duplicates as N

    monkeypatch.setattr(N, "REGION", 8)
    base = [f"w{i}" for i in range(60)]
    r = random.Random(5)
    rows = []
    for i in range(120):
        s = base[:]
        s[r.randrange(60)] = f"x{i}"
        rows.append(("k", f"r{i:03}", " ".join(s), None, 1))
    got = {(x["id_a"], x["id_b"]) for x in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) >= 0.99 * 120 * 119 / 2


def test_edges(spark):
    rows = [("k", "a", "One two, three!", None, 1), ("k", "b", "three TWO one", None, 1), ("k", "b", "three TWO one", None, 1), ("m", "c", "one two three", None, 1), ("k", "d", None, None, 1), ("k", "e", " .. ", None, 1), ("k", None, "one two three", None, 1), (None, "f", "one two three", None, 1), (None, "g", "one two three", None, 1), ("k", "h", "long " * 5000 + "text", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["kind"], r["id_a"], r["id_b"]) for r in similar_pairs(df).collect()) == [("", "f", "g"), ("k", "a", "b")]
    assert similar_pairs(df.limit(0)).count() == 0 and groups(df.limit(0)).count() == 0


def test_groups_are_components_with_copies_as_one_class(spark):
    base = [f"w{i}" for i in range(40)]
    chain = [base[k * 4 :] + [f"y{j}" for j in range(k * 4)] for k in range(5)]
    rows = [("k", f"c{k}", " ".join(s), None, 1) for k, s in enumerate(chain)] + [("k", f"copy{i}", " ".join(base), None, 1) for i in range(30)] + [("k", "alone", "quite another text", None, 1)]
    got = {r["id"]: r for r in groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert len({got[f"c{k}"]["group"] for k in range(5)} | {got["copy3"]["group"]}) == 1
    assert got["copy1"]["class"] == got["c0"]["class"] and got["alone"]["n_links"] == 0 and got["alone"]["group"] == got["alone"]["class"]


def test_pairs_at_the_threshold_in_a_dense_region(spark, monkeypatch):
    from strandline.llm import near_duplicates as N

    monkeypatch.setattr(N, "REGION", 8)
    r = random.Random(7)
    template = [f"w{i}" for i in range(50)]
    rows = [("k", f"r{i:03}", " ".join(template + [f"x{j}" for j in r.sample(range(200), 11)]), None, 1) for i in range(250)]
    want = brute(rows, 0.7)
    at = want - brute(rows, 0.75)
    got = {(x["id_a"], x["id_b"]) for x in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= want and len(at) > 5000 and len(want) < 250 * 249 / 2
    assert len(got & at) >= 0.998 * len(at)
    monkeypatch.setattr(N, "MISS", 1.0)  # without further trees these are lost
    few = {(x["id_a"], x["id_b"]) for x in similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(few & at) < 0.95 * len(at)


def test_rows_of_a_place_searched_in_parts_are_searched_alike():
    """Entries of one place in any portions give the pairs and depths of the whole."""
    import numpy as np
    import pyarrow as pa

    from strandline.llm import near_duplicates as N

    r = np.random.default_rng(3)
    n = 3000
    labels = np.where(r.random((n, N.DEPTH)) < 0.75, 7, r.integers(0, 3, (n, N.DEPTH))).astype(">u2")
    labels[: n // 3] = 7  # a third shares a whole key
    rows = np.zeros((n, N._ENTRY), np.uint8)
    rows[:, : N._KEY] = labels.view(np.uint8).reshape(n, N._KEY)
    rows[:, N._KEY : N._KEY + 16] = r.integers(0, 256, (n, 16))
    rows[:, N._KEY + 16 :] = r.integers(0, 256, (n, N._WORDS * 8)) | 0xEF
    rows = rows[np.lexsort(rows[:, : N._KEY + 16].T[::-1])]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(part), 16 + N.SHALLOW)), N._binary(part)], ["place", "entry"]) for part in np.array_split(rows, 60)]

    def found(hold):
        old, N.HOLD = N.HOLD, hold
        try:
            out = set()
            for b in N._search(0.7)(iter(batches)):
                out |= {(p, d) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
            return out
        finally:
            N.HOLD = old

    whole = found(10**9)
    assert len(whole) > 50_000 and found(500) == whole and found(2000) == whole


def test_frequent_prefixes_meet_apart(spark, monkeypatch):
    from strandline.llm import near_duplicates as N

    monkeypatch.setattr(N, "REGION", 8)
    r = random.Random(11)
    rows = []
    for i in range(600):  # a third share a template, so a tree's first labels are often theirs
        words = [f"t{k}" for k in range(30)] + [f"x{r.randrange(300)}" for _ in range(8)] if i % 3 == 0 else [f"y{r.randrange(3000)}" for _ in range(40)]
        rows.append(("k", f"r{i:03}", " ".join(words), None, 1))
    df = spark.createDataFrame(rows, SCHEMA)
    _, sets = N.classes(df)
    hashed = sets.select(N.F.xxhash64("kind").alias("kind"), "class", "words")
    frequent = N._frequent(hashed)
    sizes = lambda f: hashed.mapInArrow(N._plant(f), "place long, entry binary").groupBy("place").count().agg(N.F.max("count")).first()[0]
    assert len(frequent) > 50 and sizes(frequent) < 0.5 * sizes(frequent[:0])
    want = brute(rows, 0.7)
    got = {(x["id_a"], x["id_b"]) for x in similar_pairs(df).collect()}
    assert got <= want and len(want) > 500 and len(got) >= 0.998 * len(want)
