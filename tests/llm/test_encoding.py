import random

import pytest

from strandline.llm.encoding import encode_corpus, encoder, pieces, safe_span

SCHEMA = "doc_id long, text string, lang string, ids string, digest string"


def texts():
    r = random.Random(2)
    parts = ["The cache ", "don't ", "they'll", "\n\n", "  ", "\t", "über ", "日本語", "😀", "x" * 30, "12345 ", "!!! ", "it's'll", "\r\n", " ", "  ", "<|endoftext|>"]
    out = ["", " ", "a", "word", "\n", "y" * 9000, " " * 9000, "ab" * 6000 + " end", "'ll" * 4000]
    for n in (5, 50, 900, 4000):
        out += ["".join(r.choice(parts) for _ in range(n)) for _ in range(4)]
    shared = "".join(r.choice(parts) for _ in range(2000))
    return out + [shared, "intro " + shared, shared + " outro", shared]


def test_pieces_make_up_the_text():
    for t in texts():
        assert "".join(pieces(t)) == t
        span = safe_span(t)
        assert span is None or 0 < span[0] <= span[1] < len(t)


def test_equals_whole_encoding(spark):
    enc = encoder()
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts())]
    got = {r["doc_id"]: list(r["ids"]) for r in encode_corpus(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t, *_ in rows}
    counts = {r["doc_id"]: r["n_tokens"] for r in encode_corpus(spark.createDataFrame(rows, SCHEMA), counts=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_round_trip(spark):
    t = texts()[-2]
    ids = encode_corpus(spark.createDataFrame([(1, t, None, None, None)], SCHEMA)).first()["ids"]
    assert encoder().decode_bytes(list(ids)).decode() == t


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "x", "x", "y"), (2, "", "x", "x", "y"), (3, "a b", "x", "x", "y"), (3, "a b", "x", "x", "y"), (3, "c", "x", "x", "y"), (None, "d", "x", "x", "y"), (None, None, "x", "x", "y")]
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode_corpus(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    e = encoder().encode_ordinary
    assert got == sorted([(1, []), (2, []), (3, e("a b")), (3, e("a b")), (3, e("c")), (None, e("d")), (None, [])], key=repr)
    assert encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k"])
def test_another_tokenizer(spark, name):
    t = texts()[-1]
    got = encode_corpus(spark.createDataFrame([(1, t, None, None, None)], SCHEMA), tokenizer=name).first()["ids"]
    assert list(got) == encoder(name).encode_ordinary(t)


def test_a_piece_met_very_often(spark):
    rows = [(i, "same text for all of them", "x", "x", "y") for i in range(500)]
    got = encode_corpus(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    want = encoder().encode_ordinary("same text for all of them")
    assert len(got) == 500 and all(list(r["ids"]) == want for r in got)
