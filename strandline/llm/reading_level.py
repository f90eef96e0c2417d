"""Reading level by harmonic propagation over a document-word graph.

The graph joins every document to the words of its running text and to nodes for the length of its
sentences and words; words are hashed to NODES nodes, so the word side has a fixed size whatever the
corpus. Rated documents are clamped to their mean band. A round gives each word the mean of its
documents and each other document the mean, over its sentences, of their words' means; it is one pass
over the documents' tokens that sends at most NODES sums from a task. Rounds go on until the words' values
change by less than TOLERANCE on the mean, each word counted as often as it is met. Words tie the languages' own
vocabularies to the ratings, so no language needs a rule of its own.

Propagation draws all values towards the mean. A last fit on about FIT rated documents, or all if they are fewer, turns the
shares of a document's sentences in BINS ranges of difficulty into the scale of the ratings, and sets the
cuts between bands. A rated document's band is that of the fit too, for raters err.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import fresh_dir

NODES, SHAPES = 1 << 18, 64
#: Weight of a sentence's shape nodes against a word.
SHAPE_WEIGHT = 3.0
TOLERANCE, MOST_ROUNDS = 0.01, 30
FIT, BINS, RIDGE = 20_000, 16, 1.0
#: Running text of fewer characters, or a page with a greater share of code, has no level.
MIN_CHARS, MAX_CODE = 120, 0.9
#: A line of more characters that begins with # is no heading but text whose line ends were lost.
HEADING = 150
_FEATURES = "doc_id long, tokens binary, lengths binary"
_SKIP = re.compile(r"\||>|<|&|!\[|\[[^\]]*\]:")
_ITEM = re.compile(r"(?:[-*+]|\d+[.)])\s+")
_LINES = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n")
_WORD = re.compile(r"[^\W\d_]+")
_NOISE = re.compile(r"`[^`]*`|https?://\S+")


def running_text(text: str) -> tuple[str, float]:
    """Lower-cased paragraphs and list items, a line each, without code, tables, headings, quotes or markup; and the share of code."""
    out, fence, code = [], "", 0
    for line in _LINES.split(text):
        s = line.strip()
        if fence:
            code += len(line)
            if s.startswith(fence):
                fence = ""
        elif s[:3] in ("```", "~~~"):
            fence = s[:3]
        elif line[:4] == "    " or line[:1] == "\t":
            code += len(line)
        elif s and (len(s) > HEADING if s[0] == "#" else not _SKIP.match(s)):
            out.append(_ITEM.sub("", s, count=1))
    return _NOISE.sub(" ", "\n".join(out)).lower(), code / max(1, len(text))


def tokens_of(text: str, known: dict[str, int]) -> tuple[list[int], list[int]] | None:
    """Nodes of the words of all sentences in a row, and how many each sentence has; None without a level. known: words seen."""
    body, code = running_text(text)
    if len(body) < MIN_CHARS or code > MAX_CODE:
        return None
    tokens, lengths = [], []
    for sentence in _SENTENCE.split(body):
        words = _WORD.findall(sentence)
        if len(words) > 1:
            for w in words:
                node = known.get(w)
                if node is None:
                    node = known[w] = SHAPES + zlib.crc32(w.encode()) % (NODES - SHAPES)
                tokens.append(node)
            tokens.append(min(7, len(words) // 6))
            tokens.append(8 + min(SHAPES - 9, 2 * sum(map(len, words)) // len(words)))
            lengths.append(len(words) + 2)
    return (tokens, lengths) if lengths else None


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        ids, tokens, lengths = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and (found := tokens_of(text, known)):
                ids.append(doc_id)
                tokens.append(np.array(found[0], np.uint32).tobytes())
                lengths.append(np.array(found[1], np.uint32).tobytes())
            if len(known) > 500_000:
                known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.binary()), pa.array(lengths, pa.binary())], ["doc_id", "tokens", "lengths"])


def _unpack(tokens: list[bytes], lengths: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, where each sentence starts, and where each document's sentences start."""
    flat = np.frombuffer(b"".join(tokens), np.uint32)
    sizes = np.frombuffer(b"".join(lengths), np.uint32).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = np.array([len(x) // 4 for x in lengths], np.int64)
    return flat, starts, np.concatenate(([0], np.cumsum(counts)[:-1]))


def _weights(flat: np.ndarray) -> np.ndarray:
    return np.where(flat < SHAPES, SHAPE_WEIGHT, 1.0)


def sentence_levels(flat: np.ndarray, starts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each sentence's mean over its words, whose values are given; NaN where none has one."""
    weight = _weights(flat) * ~np.isnan(value)
    total = np.add.reduceat(np.nan_to_num(value) * weight, starts)
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / np.add.reduceat(weight, starts)


def _mean(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    good = ~np.isnan(values)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.add.reduceat(np.nan_to_num(values), starts) / np.add.reduceat(good.astype(float), starts)


def _round(shared):
    """Sums and weights of the documents' values by word. shared: the words' values, None in the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(NODES), np.zeros(NODES)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, lengths, level = (c.to_pylist() for c in batch.columns)
            value = np.array([np.nan if x is None else x for x in level])
            flat, starts, docs = _unpack(tokens, lengths)
            if shared is not None:
                value = np.where(np.isnan(value), _mean(sentence_levels(flat, starts, shared.value[flat]), docs), value)
            ends = np.append(starts[docs[1:]], len(flat))
            each = np.repeat(value, ends - starts[docs])
            good = ~np.isnan(each)
            if not good.all():
                flat, each = flat[good], each[good]
            w = _weights(flat)
            total += np.bincount(flat, each * w, NODES)
            weight += np.bincount(flat, w, NODES)
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(weight[at])], ["node", "total", "weight"])

    return run


def _shares(levels: np.ndarray, docs: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each document the shares of its sentences in the ranges between edges; NaN rows for documents without a value."""
    good = ~np.isnan(levels)
    which = np.searchsorted(edges, np.nan_to_num(levels))
    doc = np.repeat(np.arange(len(docs)), np.diff(np.append(docs, len(levels))))
    counts = np.zeros((len(docs), len(edges) + 1))
    np.add.at(counts, (doc[good], which[good]), 1)
    with np.errstate(invalid="ignore"):
        return counts / counts.sum(axis=1, keepdims=True)


def _cuts(level: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Three cuts, each where a document counts as of the upper bands with the best F1."""
    order = np.argsort(-level, kind="stable")
    cuts = []
    for b in (2, 3, 4):
        true = (np.round(band) >= b)[order]
        f1 = 2 * np.cumsum(true) / (np.arange(1, len(true) + 1) + max(1, true.sum()))
        k = int(f1.argmax())
        after = level[order][min(k + 1, len(order) - 1)]
        cuts.append((level[order][k] + after) / 2)
    return np.maximum.accumulate(cuts)


def _level(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, edges, slope, base, cuts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts, docs = _unpack(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            level = _shares(sentence_levels(flat, starts, words[flat]), docs, edges) @ slope + base
            good = ~np.isnan(level)
            band = 1 + np.searchsorted(cuts, level[good], side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(level[good]), pa.array(band.astype(np.int32))], ["doc_id", "level", "band"])

    return run


def reading_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """doc_id, level (on the scale of the ratings) and band (1 to 4) of every text that has one.

    Null, blank and very short texts, pages that are mostly code and texts that share no word with any
    rated one, even by way of others, have no row. Raters of a document are averaged; null ratings and
    ratings of documents without a level don't count; without ratings there are no rows. Repeated rows of
    documents are rated alike, each once. Other columns are ignored.
    """
    spark = documents.sparkSession
    bands = ratings.where(F.col("doc_id").isNotNull() & F.col("band").isNotNull()).groupBy("doc_id").agg(F.avg("band").alias("rated"))
    path = fresh_dir(spark, "levels")
    rows = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    rows.mapInArrow(_tokenise, _FEATURES).join(bands, "doc_id", "left").write.parquet(path)
    features = spark.read.parquet(path)
    words, total, weight = None, np.zeros(NODES), np.zeros(NODES)
    for _ in range(MOST_ROUNDS):
        known = spark.sparkContext.broadcast(words) if words is not None else None  # NODES numbers
        seen = features if words is not None else features.where(F.col("rated").isNotNull())
        sums = seen.select("tokens", "lengths", "rated").mapInArrow(_round(known), "node int, total double, weight double")
        got = sums.groupBy("node").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).toArrow()  # at most NODES rows
        total[:], weight[:] = 0, 0
        total[got.column("node").to_numpy()], weight[got.column("node").to_numpy()] = got.column("total").to_numpy(), got.column("weight").to_numpy()
        before = words
        with np.errstate(invalid="ignore", divide="ignore"):
            words = total / weight
        if before is not None:
            known.unpersist()
            both = ~np.isnan(words) & ~np.isnan(before)
            if (np.isnan(words) == np.isnan(before)).all() and np.abs(words - before)[both] @ weight[both] < TOLERANCE * weight[both].sum():
                break
    rated = features.where(F.col("rated").isNotNull())
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * FIT / max(FIT, rated.count()))
    few = rated.where(chosen).select("tokens", "lengths", "rated").toArrow()
    if not few.num_rows:
        return spark.createDataFrame([], "doc_id long, level double, band int")
    flat, starts, docs = _unpack(few.column("tokens").to_pylist(), few.column("lengths").to_pylist())
    rated = few.column("rated").to_numpy()
    levels = sentence_levels(flat, starts, words[flat])
    edges = np.quantile(levels[~np.isnan(levels)], np.linspace(0, 1, BINS + 1)[1:-1])
    shares = _shares(levels, docs, edges)
    good = ~np.isnan(shares).any(axis=1)
    shares, rated = shares[good], rated[good]
    base = float(rated.mean())
    slope = np.linalg.solve(shares.T @ shares + RIDGE * np.eye(BINS), shares.T @ (rated - base))
    fitted = spark.sparkContext.broadcast((words, edges, slope, base, _cuts(shares @ slope + base, rated)))
    return features.select("doc_id", "tokens", "lengths").mapInArrow(_level(fitted), "doc_id long, level double, band int").distinct()
