"""Encoding of a corpus by a public byte-level BPE, each shared piece of text once.

Texts are cut at landmarks of a rolling hash. Equal pieces, in whatever documents, are gathered by
digest and encoded once; a task sends the text of a piece only with its first sight of it. The joins are
repaired: the tokenizer always begins a new word at white space that follows something else, so the
stretch between the last such place of one piece and the first of the next is encoded anew, and if a
piece has no such place the stretch goes on over it. To the left and right of the stretch both encodings
agree, so the result equals the encoding of the whole text.

A piece that a task meets very often is sent under a further key for every REPEATS sights, so that no
key gathers more than REPEATS rows from a task.
"""

from __future__ import annotations

import base64
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.landmarks import code_points, landmarks

TOKENIZERS = "/opt/tokenizers"
#: Sizes of pieces in code points.
LEAST, EVERY, MOST = 512, 1024, 4096
REPEATS = 64
#: Digests that a task remembers having sent.
REMEMBERED = 200_000
#: How the tokenizer's published description splits text into words (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BOUNDARY = re.compile(r"\S[ \n]")
_loaded: dict = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tokenizer of a .tiktoken file of ranks; loaded once per process."""
    if (name, folder) not in _loaded:
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[name, folder] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name, folder]


def pieces(text: str) -> list[str]:
    """The text in pieces of LEAST to MOST code points, cut at landmarks."""
    if len(text) <= LEAST * 2:
        return [text]
    marks = landmarks(code_points(text), EVERY - LEAST).tolist()
    out, at = [], 0
    for m in marks + [len(text)]:
        while m - at > MOST:
            out.append(text[at : at + MOST])
            at += MOST
        if m - at >= LEAST or m == len(text) and m > at:
            out.append(text[at:m])
            at = m
    return out


def safe_span(text: str) -> tuple[int, int] | None:
    """The first and the last place where the tokenizer begins a new word, whatever surrounds the text."""
    found = _BOUNDARY.search(text)
    if not found:
        return None
    end = len(text)
    while True:
        p = max(text.rfind(" ", 0, end), text.rfind("\n", 0, end))
        if p > 0 and not text[p - 1].isspace():
            return found.start() + 1, p
        end = p


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sent: OrderedDict[bytes, int] = OrderedDict()
    rows: list[tuple] = []
    size = 0
    types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    names = ["salt", "digest", "doc_id", "text_key", "seq", "piece"]

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            key = -1 if not text else xxhash.xxh3_64_intdigest(text.encode()) >> 1
            parts = pieces(text) if text else []
            if not parts:
                rows.append((0, xxhash.xxh3_128_digest(str(doc_id).encode()), doc_id, key, 0, ""))
            for i, part in enumerate(parts):
                digest = xxhash.xxh3_128_digest(part.encode())
                seen = sent.pop(digest, 0)
                sent[digest] = seen + 1
                if len(sent) > REMEMBERED:
                    sent.popitem(last=False)
                rows.append((seen // REPEATS, digest, doc_id, key, i, None if seen % REPEATS else part))
                size += 0 if seen % REPEATS else len(part)
            if size > 2_000_000 or len(rows) > 20_000:
                yield flush()
                rows.clear()
                size = 0
    if rows:
        yield flush()


def _encode_pieces(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode_ordinary
        last, head, ids, tail = None, "", None, None
        for batch in batches:
            heads, mids, tails = [], [], []
            for digest, piece in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()):
                if digest != last:
                    last = digest
                    span = safe_span(piece)
                    if span is None:
                        head, ids, tail = piece, None, None
                    else:
                        head, tail = piece[: span[0]], piece[span[1] :]
                        ids = np.array(encode(piece[span[0] : span[1]]), np.uint16).tobytes()
                heads.append(head)
                mids.append(ids)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), batch.column(4), pa.array(heads, pa.string()), pa.array(mids, pa.binary()), pa.array(tails, pa.string())],
                ["doc_id", "text_key", "seq", "head", "ids", "tail"],
            )

    return run


def _join_pieces(name: str, folder: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode_ordinary
        docs, made, size = [], [], 0

        def flush():
            lengths = np.array([len(m) for m in made], np.int64)
            if counts:
                return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lengths)], ["doc_id", "n_tokens"])
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = np.concatenate(made).astype(np.int32) if made else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

        current, parts, carry, seq, copies = None, [], "", -1, 0

        def close():
            nonlocal size
            whole = np.concatenate([*parts, np.array(encode(carry), np.uint16)])
            for _ in range(copies):
                docs.append(current[0])
                made.append(whole)
                size += len(whole)

        for batch in batches:
            for doc_id, key, i, head, ids, tail in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (doc_id, key) != current:
                    if current:
                        close()
                    current, parts, carry, seq, copies = (doc_id, key), [], "", -1, 0
                    if size > 1_000_000 or len(docs) > 10_000:
                        yield flush()
                        docs.clear()
                        made.clear()
                        size = 0
                if i == 0:
                    copies += 1
                if i == seq:  # the same row of documents again
                    continue
                seq = i
                carry += head
                if ids is not None:
                    parts.append(np.array(encode(carry), np.uint16))
                    parts.append(np.frombuffer(ids, np.uint16))
                    carry = tail
        if current:
            close()
        if docs:
            yield flush()

    return run


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row, without special tokens; with counts, doc_id and n_tokens.

    Null and empty texts give an empty list. Equal rows give equal rows, each as often as it came; one
    doc_id with several texts gives a row for each. A null doc_id is kept. Strings of special tokens in a
    text are ordinary text. The vocabulary must have no more than 65,536 ids. Other columns are ignored.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = rows.mapInArrow(_cut, "salt int, digest binary, doc_id long, text_key long, seq int, piece string")
    gathered = cut.repartition("digest", "salt").sortWithinPartitions("digest", "salt", F.col("piece").desc_nulls_last())
    encoded = gathered.mapInArrow(_encode_pieces(tokenizer, folder), "doc_id long, text_key long, seq int, head string, ids binary, tail string")
    ordered = encoded.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "seq")
    return ordered.mapInArrow(_join_pieces(tokenizer, folder, counts), "doc_id long, n_tokens long" if counts else "doc_id long, ids array<int>")
