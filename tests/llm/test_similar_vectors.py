import numpy as np

from strandline.llm import similar_vectors as V

SCHEMA = "hash string, model string, vector array<float>, created_at long, rank string, entry string"


def near(rows, k=5):
    by = {}
    for h, m, v, at, *_ in rows:
        if h and m and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by.setdefault(m, {}).setdefault(h, (at or -1, v))
            if (at or -1) > by[m][h][0]:
                by[m][h] = (at, v)
    out = {}
    for m, d in by.items():
        keys = sorted(d)
        x = np.array([d[h][1] for h in keys], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, -9)
        for i, h in enumerate(keys):
            out[m, h] = {keys[j] for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] > -9}
    return out


def clustered(n, seed, model="a"):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, 64))
    return [(f"{model}{i:05}", model, (float(r.uniform(0.1, 9)) * (centres[i % len(centres)] + 0.3 * r.normal(size=64))).tolist(), i, "x", "y") for i in range(n)]


def found(df, **k):
    out = {}
    for r in V.nearest(df, **k).collect():
        out.setdefault((r["model"], r["hash"]), set()).add(r["other"])
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    rows = clustered(1500, 1) + clustered(300, 2, "b")
    got, want = found(spark.createDataFrame(rows, SCHEMA)), near(rows)
    hits = sum(len(want[k] & got.get(k, set())) for k in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())


def test_anisotropic_codes_lessen_the_parallel_error():
    x = V._unit(np.random.default_rng(0).normal(size=(2000, 64)))
    books = V._books(x, x)
    def parallel(codes):
        error = x.reshape(len(x), V.PARTS, -1) - books[np.arange(V.PARTS), codes]
        return ((error.reshape(len(x), -1) * x).sum(axis=1) ** 2).mean()
    plain = np.stack([((x.reshape(len(x), V.PARTS, -1)[:, m, None] - books[m][None]) ** 2).sum(axis=2).argmin(axis=1) for m in range(V.PARTS)], axis=1)
    assert parallel(V.encode(x, x, books)) < 0.5 * parallel(plain)


def test_table_scan_equals_decoded_product():
    r = np.random.default_rng(1)
    books, codes, q = r.normal(size=(V.PARTS, 16, 2)).astype(np.float32), r.integers(0, 16, (30, V.PARTS)), r.normal(size=(4, 64)).astype(np.float32)
    decoded = books[np.arange(V.PARTS), codes].reshape(30, 64)
    packed = (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)
    assert np.allclose(V.scan(V.pair_tables(q, books), packed), decoded @ q.T, atol=1e-4)


def test_unusable_repeats_copies_and_few(spark):
    one, two = [1.0] + [0.0] * 63, [0.9, 0.1] + [0.0] * 62
    rows = [("a", "m", one, 1, "x", "y"), ("a", "m", one, 1, "x", "y"), ("b", "m", two, 1, "x", "y"), ("z", "m", [0.0] * 64, 1, "x", "y"), ("n", "m", None, 1, "x", "y"), ("s", "m", [1.0], 1, "x", "y"), ("i", "m", [float("inf")] * 64, 1, "x", "y"), ("q", "m", [float("nan")] * 64, 1, "x", "y"), (None, "m", one, 1, "x", "y"), ("c", None, one, 1, "x", "y"), ("lone", "w", one, None, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == {("m", "a"): {"b"}, ("m", "b"): {"a"}}
    copies = spark.createDataFrame([(f"k{i}", "m", one, i, "x", "y") for i in range(40)] + [("far", "m", two, 1, "x", "y")], SCHEMA)
    got = found(copies)
    assert len(got) == 41 and all(len(v) == 5 for v in got.values()) and all("far" not in v for k, v in got.items())
    assert V.nearest(df.limit(0)).count() == 0


def unclustered(n, seed):
    """Vectors of some twelve strong directions and much noise."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 12)) @ r.normal(size=(12, 64)) + 0.5 * r.normal(size=(n, 64))
    return [(f"h{i:05}", "m", v.tolist(), i, "x", "y") for i, v in enumerate(x)]


def test_recall_where_cells_are_parted_again_and_groups_cut(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_CELLS", 4)
    monkeypatch.setattr(V, "PER_CELL", 32)
    monkeypatch.setattr(V, "BLOCK", 900)
    rows = unclustered(3000, 5)
    got, want = found(spark.createDataFrame(rows, SCHEMA)), near(rows)
    hits = sum(len(want[k] & got.get(k, set())) for k in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(v) == 5 for v in got.values())


def test_recall_on_vectors_without_clusters(spark):
    rows = unclustered(4000, 6)
    got, want = found(spark.createDataFrame(rows, SCHEMA)), near(rows)
    assert sum(len(want[k] & got.get(k, set())) for k in want) >= 0.93 * sum(map(len, want.values()))
