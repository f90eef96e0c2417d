import random

import pytest

from strandline.llm.landmarks import SPAN, code_points, landmarks
from strandline.llm.splitting import cut_points, split_oversized

CHUNKS = "grp string, project string, file string, language string, startLine int, endLine int, content string, hash string, chunk_id string, piece_no string, chunkSize string"
CONFIG = "project_name string, chunkSize int, overlap int, group_name string"


def text(seed, n=400):
    r = random.Random(seed)
    return "".join(r.choice(["word ", "fn(x);\n", "\n\n", "End. ", "é😀", "\t"]) for _ in range(n))


@pytest.mark.parametrize("limit, overlap", [(40, 0), (64, 16), (100, 50), (7, 3), (1, 0), (50, 49)])
@pytest.mark.parametrize("seed", range(3))
def test_pieces_cover_within_limit_and_overlap(limit, overlap, seed):
    s = text(seed)
    cuts = cut_points(s, limit, overlap)
    o = overlap
    assert cuts[0][0] == 0 and cuts[-1][1] == len(s)
    assert all(0 < b - a <= limit for a, b in cuts)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert c == max(0, b - o) and d > b


def test_natural_ends_where_there_are_any():
    s = "some code here;\n" * 200
    assert all(s[b - 1] == "\n" for _, b in cut_points(s, 100, 20)[:-1])
    assert all(b - a <= 10 for a, b in cut_points("x" * 95, 10, 2))
    assert all(w[b - 1] == " " for w in ["ab " * 100] for _, b in cut_points(w, 50, 0)[:-1])


def test_an_edit_changes_only_neighbouring_pieces():
    r = random.Random(3)
    s = "".join(r.choice("abcdefgh") + ("\n" if r.random() < 0.05 else "") for _ in range(20_000))
    t = s[:5000] + "EDIT" + s[5000:]
    pieces = lambda x: [x[a:b] for a, b in cut_points(x, 400, 0)]
    a, b = pieces(s), pieces(t)
    assert len(set(a) - set(b)) <= 4


def test_landmarks_depend_on_their_span():
    s = text(1, 3000)
    a = landmarks(code_points(s), 16)
    b = landmarks(code_points("zz" + s), 16) - 2
    assert set(a[a > SPAN]) == set(b[b > SPAN])


def test_line_ends_stay_whole():
    s = "a" * 9 + "\r\n" + "b" * 9 + "\r\n"
    assert all(s[b - 1 : b + 1] != "\r\n" for _, b in cut_points(s * 20, 10, 0))


def test_rows(spark):
    long = "line one\nline two\nline three\n" * 10
    rows = [
        ("g", "p", "f", "go", 5, 35, long, "h", "c1", "x", "y"), ("g", "p", "f", "go", 5, 35, long, "h", "c1", "x", "y"), ("g", "p", None, None, None, None, long, "h", "c2", "x", "y"),
        ("g", "p", "f", "go", 0, 0, "short", "h2", "c3", "x", "y"), ("g", "p", "f", "go", 0, 0, None, None, "c4", "x", "y"), ("g", "no config", "f", "go", 0, 0, long, "h", "c5", "x", "y"), ("g", None, "f", "go", 0, 0, "", "h", None, "x", "y"),
    ]
    config = spark.createDataFrame([("p", 60, 10, "g"), ("p", 90, 0, "g"), (None, 1, 0, "g"), ("q", None, None, "g")], CONFIG)
    got = split_oversized(spark.createDataFrame(rows, CHUNKS), config).collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append(r)
    assert {k: len(v) for k, v in by.items() if k not in ("c1", "c2")} == {"c3": 1, "c4": 1, "c5": 1, None: 1}
    one = sorted(by["c2"], key=lambda r: r["piece_no"])
    assert len(by["c1"]) == 2 * len(one) and one[0]["n_pieces"] == len(one) > 1
    assert "".join(p["content"][10 if p["piece_no"] else 0 :] for p in one) == long
    assert all(p["startLine"] is None and p["endLine"] is None for p in one)
    placed = sorted({(r["piece_no"], r["start_char"], r["end_char"], r["startLine"], r["endLine"]) for r in by["c1"]})
    for _, a, b, first, last in placed:
        assert first == 5 + long[:a].count("\n")
        assert last == 5 + long[: b if b == len(long) else b - 1].count("\n")
    assert placed[-1][4] == 35
    assert split_oversized(spark.createDataFrame([], CHUNKS), config).count() == 0
    assert split_oversized(spark.createDataFrame(rows, CHUNKS), config.limit(0)).count() == len(rows)


def test_an_overlap_without_room_is_an_error_and_soundness_sees_faults(spark):
    import pytest
    from pyspark.sql import functions as F

    from strandline.llm.splitting import cut_points, soundness, split_oversized

    with pytest.raises(ValueError):
        cut_points("x" * 100, 20, 20)
    cuts = cut_points("word and more. " * 40, 50, 40)  # more than half
    assert all(b - a <= 50 for a, b in cuts) and all(y[0] == x[1] - 40 or y[0] == 0 for x, y in zip(cuts, cuts[1:]))
    chunks = spark.createDataFrame([("g", "p", "a", "x", 3, 50, "line of text\n" * 40, "h", "c1")], "grp string, project string, file string, language string, startLine int, endLine int, content string, hash string, chunk_id string")
    config = spark.createDataFrame([("p", 100, 20)], "project_name string, chunkSize int, overlap int")
    with pytest.raises(ValueError):
        split_oversized(chunks, config.withColumn("overlap", F.col("chunkSize")))
    pieces = split_oversized(chunks, config)
    good = soundness(pieces, chunks, config).first()
    assert good["n_pieces"] > 5 and sum(good[c] for c in ("n_over", "n_text", "n_hash", "n_lines", "n_gaps")) == 0
    bad = soundness(pieces.withColumn("content", F.upper("content")).withColumn("endLine", F.col("endLine") + F.when(F.col("piece_no") == 2, 1).otherwise(0)).where("piece_no <> 4"), chunks, config).first()
    assert bad["n_text"] == good["n_pieces"] - 1 and bad["n_hash"] == bad["n_text"] and bad["n_lines"] == 1 and bad["n_gaps"] == 1
