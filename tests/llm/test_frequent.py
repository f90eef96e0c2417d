from collections import Counter

from strandline.llm.frequent import top_values, top_with_text

SCHEMA = "query_hash string, id string, query_text string, n_events int, value int"


def test_counts_ties_nulls_and_repeats(spark):
    rows = [(f"h{i % 7}", f"e{i}", None if i % 7 == 2 else f"T{i % 3}", 1, 1) for i in range(70)]
    rows += rows[:30] + [(None, "e1", "x", 1, 1), ("h0", None, "zz", 1, 1), ("h5", "more", None, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for h, i in {(h, i) for h, i, *_ in rows if h and i}:
        want[h] += 1
    order = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in top_values(df, k=4).collect()] == order[:4]
    assert [tuple(r) for r in top_values(df, k=50).collect()] == order
    text = {r["value"]: r["text"] for r in top_with_text(df, k=7).collect()}
    assert text["h2"] is None and text["h0"] == "zz"
    assert top_values(df.limit(0)).count() == 0 and top_with_text(df.limit(0)).count() == 0


def test_one_value_holds_most_rows(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, cast(id as string), 'hot') as query_hash", "cast(id as string) as id")
    assert top_values(df, k=1).first()["n_events"] == 5000 - 1667
