"""Splitting oversized texts at natural boundaries by content-defined chunking.

Landmarks of a rolling hash are snapped to the nearest natural boundary; a cut is the first snapped
landmark between a least and a greatest size. Where a cut falls depends on the text around it, so after
an edit the cuts fall into step again and only neighbouring pieces change.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.landmarks import code_points, landmarks

#: Boundaries from strongest to weakest: after a blank line, a line, a sentence, white space.
_BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\r?\n", r"\n", r"[.!?;][\"')\]]*(?:\r\n|\s)", r"\r\n|\s")]
PIECES = (
    "grp string, project string, file string, language string, chunk_id string, piece_no int, n_pieces int, "
    "startLine int, endLine int, content string, hash string, start_char int, end_char int, source_hash string"
)


def _near(points: np.ndarray, at: int, reach: int) -> int | None:
    """The point nearest to at, if it is within reach; of two as near, the earlier."""
    i = int(np.searchsorted(points, at))
    best = min((int(p) for p in points[max(0, i - 1) : i + 1]), key=lambda p: abs(p - at), default=None)
    return best if best is not None and abs(best - at) <= reach else None


def _hard(text: str, at: int, least: int) -> int:
    """at, or a little before it, so that no line end and no composed character is cut in two."""
    p = at
    while p > least and (text[p - 1 : p + 1] == "\r\n" or unicodedata.combining(text[p]) or text[p] in "\u200d\ufe0f" or text[p - 1] == "\u200d"):
        p -= 1
    return p if p > least else at


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of a text longer than limit.

    Pieces after the first begin `overlap` characters before the end of the one before; an overlap that leaves no
    room in the limit is an error. No piece is longer than limit. A piece ends at a natural boundary if its range has any.
    """
    overlap = max(0, overlap)
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} leaves no room in pieces of {limit}")
    most = limit - overlap
    least = max(1, most // 3)
    codes = code_points(text)
    marks = [np.array([m.end() for m in b.finditer(text)], np.int64) for b in _BOUNDARIES]
    snapped = set()
    for mark in landmarks(codes, max(2, most // 4)).tolist():
        for points, reach in zip(marks, (most // 8, most // 4, most // 4, most // 4)):
            if (p := _near(points, mark, reach)) is not None:
                snapped.add(p)
                break
    cuts = np.array(sorted(snapped), np.int64)
    pieces, at, n = [], 0, len(text)
    while n - at > (limit if at == 0 else most):
        lo, hi, cut = at + least, at + most, None
        i = int(np.searchsorted(cuts, lo))
        if i < len(cuts) and cuts[i] <= hi:
            cut = int(cuts[i])
        for first in (lo, at + 1):
            for points in marks:
                if cut is None and (i := int(np.searchsorted(points, hi, side="right"))) and points[i - 1] >= first:
                    cut = int(points[i - 1])
        if cut is None:
            cut = _hard(text, hi, at)
        pieces.append((max(0, at - overlap), cut))
        at = cut
    pieces.append((max(0, at - overlap), n))
    return pieces


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in PIECES.split(", ")]
    rows: list[tuple] = []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for grp, project, file, language, chunk_id, start, end, text, old, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None or limit is None or limit <= 0 or len(text) <= limit:
                rows.append((grp, project, file, language, chunk_id, 0, 1, start, end, text, old, 0, len(text or ""), _digest(text or "")))
                size += len(text or "")
            else:
                cuts, source = cut_points(text, limit, overlap or 0), _digest(text)
                lines = np.concatenate(([0], np.cumsum(code_points(text) == 10)))
                for i, (a, b) in enumerate(cuts):
                    piece = text[a:b]
                    first = None if start is None else start + int(lines[a])
                    last = None if start is None else start + int(lines[b if b == len(text) else b - 1])
                    rows.append((grp, project, file, language, chunk_id, i, len(cuts), first, last, piece, _digest(piece), a, b, source))
                    size += b - a
            if size > 4_000_000:
                yield flush()
                rows.clear()
                size = 0
    if rows:
        yield flush()


def split_oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """Every row of chunks, those above their project's chunkSize as pieces. See PIECES for the columns.

    Sizes are code points. startLine and endLine are 0-based and inclusive; a line end belongs to the line
    it ends, and what follows the last line end, be it empty, is a line. start_char and end_char place a
    piece in its row. Rows without content, within the size, or of a project without a (positive) size come
    out whole with piece_no 0 and n_pieces 1; rows without startLine give pieces without lines. Repeated
    rows are split alike. A project with several rows of config takes the one of least chunkSize; an overlap that isn't
    less than the size is an error. source_hash is the digest of the row's content. Other columns are ignored.
    """
    wrong = config.where("chunkSize > 0 AND overlap >= chunkSize").select("project_name").limit(1).collect()
    if wrong:
        raise ValueError(f"the overlap of project {wrong[0][0]} leaves no room in its chunkSize")
    sizes = config.where(F.col("project_name").isNotNull()).groupBy(F.col("project_name").alias("project")).agg(F.min(F.struct("chunkSize", "overlap")).alias("c"))
    rows = chunks.select("grp", "project", "file", "language", "chunk_id", "startLine", "endLine", "content", "hash").join(sizes, "project", "left")
    return rows.select("grp", "project", "file", "language", "chunk_id", "startLine", "endLine", "content", "hash", "c.chunkSize", "c.overlap").mapInArrow(_split, PIECES)


def soundness(pieces: DataFrame, chunks: DataFrame, config: DataFrame) -> DataFrame:
    """One row for each project: project, n_pieces, n_over (longer than chunkSize), n_text (not that stretch of the row's content), n_hash, n_lines (startLine or endLine wrong), n_gaps (not `overlap` characters shared with the piece before, or a row not covered from end to end).

    Pieces are held against the contents of their project by digest; null projects form one.
    """
    named = lambda df: df.withColumn("project", F.coalesce("project", F.lit("")))
    sizes = F.broadcast(config.where("project_name IS NOT NULL").groupBy(F.col("project_name").alias("project")).agg(F.min(F.struct("chunkSize", "overlap")).alias("c")))  # a row a project, as in split_oversized
    texts = named(chunks).groupBy("project", F.left(F.sha2(F.coalesce("content", F.lit("")), 256), F.lit(16)).alias("source_hash")).agg(F.first("content").alias("whole"))
    split = named(pieces).where("n_pieces > 1").distinct()
    # rows of one content differ by where they begin
    order = Window.partitionBy("project", "source_hash", "grp", "file", "language", "chunk_id", "row_start").orderBy("piece_no")
    held = split.join(texts, ["project", "source_hash"]).join(sizes, "project")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before, inside = newlines(F.expr("substring(whole, 1, start_char)")), newlines(F.when(F.col("end_char") == F.length("whole"), F.col("content")).otherwise(F.expr("substring(content, 1, end_char - start_char - 1)")))
    held = held.withColumn("row_start", F.col("startLine") - before)
    share = F.lag("end_char").over(order) - F.col("start_char")
    joined = F.when(F.col("piece_no") == 0, F.col("start_char") == 0).otherwise((share == F.col("c.overlap")) | (F.col("start_char") == 0)) & ((F.col("piece_no") < F.col("n_pieces") - 1) | (F.col("end_char") == F.length("whole")))
    held = held.withColumn("joined", F.coalesce(joined, F.lit(False)))
    wrong = lambda good: F.sum((~F.coalesce(good, F.lit(True))).cast("int"))
    return held.groupBy("project").agg(
        F.count("*").alias("n_pieces"),
        wrong(F.length("content") <= F.col("c.chunkSize")).alias("n_over"),
        wrong(F.expr("substring(whole, start_char + 1, end_char - start_char)") == F.col("content")).alias("n_text"),
        wrong(F.left(F.sha2("content", 256), F.lit(16)) == F.col("hash")).alias("n_hash"),
        wrong(F.col("endLine") - F.col("startLine") == inside).alias("n_lines"),
        wrong(F.col("joined")).alias("n_gaps"),
    )
