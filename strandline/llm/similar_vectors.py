"""The k most similar vectors of every vector, by score-aware quantisation.

Vectors are scaled to unit length, so that the inner product is the cosine. The index is fitted for each
model on a bounded sample: a coarse partition into cells, and a codebook of 16 codewords for every two
dimensions of what a cell's centre leaves. Codewords are fitted and chosen with the anisotropic loss,
which weighs the part of the error along the vector ETA times as much as the part across it, for that part
disturbs the scores of the best matches. Every vector is indexed. A query scans the four-bit codes of its
PROBES nearest cells through its own table of products, two codes at a time, and reranks the best by exact cosine.

Neighbouring cells form a group, which is searched in one place; a query goes once to each group that holds some of
its cells. Groups of more than BLOCK entries are cut into blocks that are searched apart. Where the sample is too
small to tell more cells apart, a cell outgrows PER_CELL; it is then parted again where it is searched, and a query
scans the PROBES nearest of its parts. So a query's work doesn't grow with the table. Equal vectors are one entry;
their hashes are joined to it at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import fresh_dir

DIM = 64
#: Vectors of each model that the index is fitted on, about.
SAMPLE = 20_000
#: Vectors for each cell, as the number of cells is chosen; at most MAX_CELLS cells are told apart by the sample, larger ones are parted again.
PER_CELL, MAX_CELLS = 128, 4096
#: Cells of a group, at most.
PER_GROUP = 32
PROBES = 12
ETA = 4.0
PARTS = DIM // 2
RERANK = 32
BLOCK = 65_536
#: A cell of so many times PER_CELL is parted again.
PART = 8
#: Queries that are answered together.
BATCH = 512
_INDEXED = "entry binary, vector binary, codes binary, model int, cells array<int>"
_KEY = 16


def _width(probes: int) -> int:
    """Bytes of a row that is sent: entry, vector, and codes with their cell or the cells to scan."""
    return _KEY + DIM * 4 + max(4 + PARTS // 2, 4 * probes)


def usable(cache: DataFrame, dim: int = DIM) -> DataFrame:
    """model, hash, vector (float32) of the rows that take part.

    A vector takes part if it has dim finite numbers, not all zero. Rows without model or hash don't. Of
    several usable rows of a (model, hash) the latest counts.
    """
    good = F.col("vector").isNotNull() & (F.size("vector") == dim) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0)
    rows = cache.select("model", "hash", F.col("vector").cast("array<float>").alias("vector"), "created_at").where(F.col("model").isNotNull() & F.col("hash").isNotNull() & good)
    return rows.groupBy("model", "hash").agg(F.max_by("vector", F.struct(F.coalesce("created_at", F.lit(-(2**63))), "vector")).alias("vector"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    far = (centres**2).sum(axis=1) - 2 * x @ centres.T
    if k >= len(centres):
        return np.argsort(far, axis=1, kind="stable")
    some = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)


def _cells(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of x by k-means; a centre that loses all its points keeps its place."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(np.int64)].astype(np.float32)
    for _ in range(rounds):
        own = _nearest(x, centres, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        met, first = np.unique(own[order], return_index=True)
        centres = centres.copy()
        centres[met] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def _halves(x: np.ndarray, most: int) -> np.ndarray:
    """Groups of at most `most` neighbouring points, by halving along the direction in which they differ most."""
    group = np.zeros(len(x), np.int32)
    waiting, n = [np.arange(len(x))], 0
    while waiting:
        own = waiting.pop()
        if len(own) <= most:
            group[own] = n
            n += 1
        else:
            apart = x[own] - x[own].mean(axis=0)
            order = own[np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable")]
            waiting += [order[: len(own) // 2], order[len(own) // 2 :]]
    return group


def encode(x: np.ndarray, rest: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Four-bit codes of rest, one for each part, by coordinate descent on the anisotropic loss; x: the unit vectors."""
    n = len(x)
    xs, rs = (np.ascontiguousarray(a.reshape(n, PARTS, -1).transpose(1, 0, 2), dtype=np.float32) for a in (x, rest))
    turned = books.astype(np.float32).transpose(0, 2, 1)
    error = (turned**2).sum(axis=1)[:, None] - 2 * np.matmul(rs, turned)  # but for what all codewords share
    along = (rs * xs).sum(axis=2)[:, :, None] - np.matmul(xs, turned)
    codes = error.argmin(axis=2)
    row = np.arange(n)
    own = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
    total = own.sum(axis=0)
    for _ in range(sweeps):
        for m in range(PARTS):
            others = total - own[m]
            codes[m] = (error[m] + (ETA - 1) * (others[:, None] + along[m]) ** 2).argmin(axis=1)
            own[m] = along[m][row, codes[m]]
            total = others + own[m]
    return codes.T.astype(np.uint8)


def _books(x: np.ndarray, rest: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Codebooks (PARTS, 16, 2) that lessen the anisotropic loss: codes and codewords in turn."""
    n = len(x)
    xs, rs = x.reshape(n, PARTS, -1).astype(np.float64), rest.reshape(n, PARTS, -1).astype(np.float64)
    width = rs.shape[2]
    books = rs[np.linspace(0, n - 1, 16).astype(np.int64)].transpose(1, 0, 2) + np.linspace(-1e-4, 1e-4, 16)[None, :, None]
    for _ in range(rounds):
        codes = np.concatenate([encode(x[at : at + 4096], rest[at : at + 4096], books, 1) for at in range(0, n, 4096)])
        along = ((rs - books[np.arange(PARTS), codes]) * xs).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(PARTS):
            others = total - along[:, m]
            v, c = xs[:, m], codes[:, m]
            target = others + (rs[:, m] * v).sum(axis=1)
            sums = lambda w: np.bincount(c, w, 16)
            a = (ETA - 1) * np.stack([[sums(v[:, i] * v[:, j]) for j in range(width)] for i in range(width)]).transpose(2, 0, 1) + sums(None)[:, None, None] * np.eye(width)
            b = np.stack([sums(rs[:, m, i] + (ETA - 1) * v[:, i] * target) for i in range(width)], axis=1)
            met = np.bincount(c, minlength=16) > 0
            books[m][met] = np.linalg.solve(a[met], b[met][:, :, None])[:, :, 0]
            along[:, m] = ((rs[:, m] - books[m][c]) * v).sum(axis=1)
            total = others + along[:, m]
    return books.astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as Arrow binaries."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Arrow binaries of one width as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _raw(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize * x.shape[1])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """model, hash, vector -> the same with a unit vector in bytes and the key of its entry."""
    for batch in batches:
        if batch.num_rows:
            models = batch.column(0).to_pylist()
            given = np.ascontiguousarray(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM), np.float32) + np.float32(0)  # no -0.0
            keys = [xxhash.xxh3_128_digest(m.encode() + b"/" + v.tobytes()) for m, v in zip(models, given)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), _binary(_raw(_unit(given)))], ["model", "hash", "entry", "vector"])


def fit(entries: DataFrame, sample: int = SAMPLE) -> dict[str, tuple]:
    """Number, centres, groups of cells and codebooks of every model, from about `sample` of its vectors, chosen by a hash, or all if they are fewer."""
    sizes = {r["model"]: r["n"] for r in entries.groupBy("model").agg(F.count("*").alias("n")).orderBy("model").collect()}
    if not sizes:
        return {}
    most = F.create_map(*(F.lit(x) for m, n in sizes.items() for x in (m, max(1, 1_000_000 * sample // max(sample, n)))))
    few = entries.where(F.pmod(F.xxhash64("entry"), F.lit(1_000_000)) < most[F.col("model")]).select("model", "vector").toArrow()
    fitted, groups = {}, 0
    names = np.array(few.column("model").to_pylist(), object)
    vectors = _bytes(few.column("vector").combine_chunks(), DIM * 4).view(np.float32) if len(names) else np.zeros((0, DIM), np.float32)
    for no, (model, n) in enumerate(sizes.items()):
        own = names == model
        x = vectors[own] if own.any() else np.eye(1, DIM, dtype=np.float32)
        centres = _cells(x, max(1, min(MAX_CELLS, len(x), n // PER_CELL)))
        rest = x - centres[_nearest(x, centres, 1)[:, 0]]
        group = _halves(centres, max(1, min(PER_GROUP, len(centres) * BLOCK // n))) + groups
        groups = int(group.max()) + 1
        fitted[model] = no, centres, group, _books(x, rest)
    return fitted


def _index(shared, probes: int):
    """model, entry, vector -> index rows: with its packed codes and its nearest cells, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column(0).to_pylist(), object)
            vectors = _bytes(batch.column(2), DIM * 4) if batch.num_rows else None
            for model in dict.fromkeys(models.tolist()):
                no, centres, _, books = shared.value[model]
                for own in np.array_split(np.flatnonzero(models == model), -(-batch.num_rows // 4096)):
                    if len(own):
                        x = np.ascontiguousarray(vectors[own]).view(np.float32)
                        near = _nearest(x, centres, probes)[:, :probes].astype(np.int32)
                        codes = encode(x, x - centres[near[:, 0]], books)
                        packed = (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)
                        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                        rows = pa.array(own)
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(rows).cast(pa.binary()), _binary(vectors[own]), _binary(packed), pa.array(np.full(len(own), no, np.int32)), cells], ["entry", "vector", "codes", "model", "cells"])

    return run


def _send(shared, blocks: np.ndarray, probes: int):
    """Index rows -> an entry's row to its own block, and one as a query to each block of the groups of its cells. blocks: how many each group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_number = {f[0]: (m, f[2]) for m, f in shared.value.items()}
        starts = np.concatenate(([0], np.cumsum(blocks)))
        for batch in batches:
            models = batch.column(3).to_numpy()
            entries, vectors, codes = (_bytes(batch.column(k), w) for k, w in ((0, _KEY), (1, DIM * 4), (2, PARTS // 2))) if batch.num_rows else (None,) * 3
            for no in np.unique(models):
                own = np.flatnonzero(models == no)
                cells = batch.column(4).take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)
                group = by_number[no][1][cells]
                fixed = np.hstack([entries[own], vectors[own]])
                spread = np.ascontiguousarray(entries[own][:, :8]).view(np.uint64)[:, 0]

                def rows(place, part, tail, query):
                    tail = np.hstack([tail, np.full((len(part), _width(probes) - _KEY - DIM * 4 - tail.shape[1]), 255, np.uint8)])  # cells of -1
                    kind = [pa.array(np.full(len(part), query)), pa.array(np.full(len(part), no, np.int32))]
                    return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *kind, _binary(np.hstack([fixed[part], tail]))], ["place", "query", "model", "row"])

                mine = group[:, 0]
                yield rows(starts[mine] + (spread % blocks[mine].astype(np.uint64)).astype(np.int64), np.arange(len(own)), np.hstack([_raw(cells[:, :1]), codes[own]]), False)
                for slot in range(cells.shape[1]):  # a group is asked once, in the slot that meets it first
                    new = np.flatnonzero(~(group[:, :slot] == group[:, slot : slot + 1]).any(axis=1))
                    asked = np.where(group[new] == group[new, slot : slot + 1], cells[new], -1).astype(np.int32)
                    for b in range(int(blocks[group[new, slot]].max(initial=0))):
                        has = blocks[group[new, slot]] > b
                        if has.any():
                            yield rows(starts[group[new[has], slot]] + b, new[has], _raw(asked[has]), True)

    return run


def pair_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Products of queries with the codewords of two parts at a time: PARTS / 2 x 256 x queries."""
    one = np.matmul(books, q.reshape(len(q), PARTS, -1).transpose(1, 2, 0))
    return (one[::2, :, None, :] + one[1::2, None, :, :]).reshape(PARTS // 2, 256, len(q))


def scan(pairs: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Scores of every packed code against every query, by table look-up: a code's row holds its product with all queries."""
    out = pairs[0].take(packed[:, 0], axis=0)
    some = np.empty_like(out)
    for m in range(1, PARTS // 2):
        out += pairs[m].take(packed[:, m], axis=0, out=some, mode="clip")
    return out


class Block:
    """The entries of a block by cell, large cells parted again."""

    def __init__(self, rows: np.ndarray, centres: np.ndarray, books: np.ndarray, probes: int):
        cell = np.ascontiguousarray(rows[:, _KEY + DIM * 4 :][:, :4]).view(np.int32)[:, 0]
        rows = rows[order := np.argsort(cell, kind="stable")]
        self.cell, first = np.unique(cell[order], return_index=True)
        self.entries = np.ascontiguousarray(rows[:, :_KEY]).view(np.uint64)
        self.vectors = np.ascontiguousarray(rows[:, _KEY : _KEY + DIM * 4]).view(np.float32)
        self.codes = np.ascontiguousarray(rows[:, _KEY + DIM * 4 + 4 :][:, : PARTS // 2])
        self.books, self.probes = books, probes
        #: of every cell its centre, its rows, and the centres and rows of its parts
        self.of = []
        for c, a, b in zip(self.cell, first, np.append(first[1:], len(rows))):
            whole, parts = np.arange(a, b), None
            if len(whole) >= PART * PER_CELL:
                x = self.vectors[whole]
                inner = _cells(x[:: -(-len(x) // 8192)], max(2, len(x) // PER_CELL), 4)
                own = _nearest(x, inner, 1)[:, 0]
                parts = inner, [whole[own == i] for i in range(len(inner))]
            self.of.append((centres[c], whole, parts))

    def answer(self, rows: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For queries: the number of the query, the entry and the cosine of the k best others."""
        keys = np.ascontiguousarray(rows[:, :_KEY]).view(np.uint64)
        q = np.ascontiguousarray(rows[:, _KEY : _KEY + DIM * 4]).view(np.float32)
        asked = np.ascontiguousarray(rows[:, _KEY + DIM * 4 :]).view(np.int32)[:, : self.probes]  # -1: none
        pairs = pair_tables(q, self.books)
        query, other, score = [], [], []

        def take(who, those, base):
            c = min(rerank + 1, len(those))
            if not c or not len(who):
                return
            scores = scan(pairs, self.codes[those])[:, who].T + base[:, None]
            some = np.argpartition(-scores, c - 1, axis=1)[:, :c] if c < len(those) else np.broadcast_to(np.arange(c), scores.shape)
            query.append(np.repeat(who, c))
            other.append(those[some].ravel())
            score.append(np.take_along_axis(scores, some, 1).ravel())

        for c, (centre, whole, parts) in zip(self.cell, self.of):
            who = np.flatnonzero((asked == c).any(axis=1))
            base = q[who] @ centre
            if parts is None:
                take(who, whole, base)
            elif len(who):
                near = _nearest(q[who], parts[0], self.probes)[:, : self.probes]
                for i, those in enumerate(parts[1]):
                    mine = (near == i).any(axis=1)
                    take(who[mine], those, base[mine])
        if not query:
            return
        query, other, score = (np.concatenate(v) for v in (query, other, score))
        good = (self.entries[other] != keys[query]).any(axis=1)
        query, other, score = query[good], other[good], score[good]
        first = _best(query, score, rerank)
        query, other = query[first], other[first]
        first = _best(query, np.einsum("nd,nd->n", q[query], self.vectors[other]), 2 * k)
        query, other = query[first], other[first]
        exact = np.einsum("nd,nd->n", q[query], self.vectors[other], dtype=np.float64)
        first = _best(query, exact, k)
        yield query[first], other[first], exact[first]


def _best(query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k greatest scores of each query, best first; scores lie between -2 and 2."""
    order = np.argsort((query.astype(np.int64) << 32) + ((2.0 - score.astype(np.float64)) * 2**30).astype(np.int64))
    arranged = query[order]
    begins = np.flatnonzero(np.append(True, arranged[1:] != arranged[:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def _search(shared, k: int, rerank: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_number = {f[0]: (f[1], f[3]) for f in shared.value.values()}
        place, data, waiting, n, block = None, [], [], 0, None

        def answer():
            nonlocal block, n
            if waiting and data:
                if block is None:
                    block = Block(np.concatenate(data), *by_number[place[1]], probes)
                rows = np.concatenate(waiting)
                asked = np.ascontiguousarray(rows[:, _KEY + DIM * 4 :]).view(np.int32)
                nearest_cell = np.take_along_axis(asked, (asked >= 0).argmax(axis=1)[:, None], 1)[:, 0]
                rows = rows[np.argsort(nearest_cell, kind="stable")]  # those that ask the same cells together
                for at in range(0, len(rows), BATCH):
                    part = rows[at : at + BATCH]
                    for query, other, exact in block.answer(part, k, rerank):
                        yield pa.RecordBatch.from_arrays([_binary(part[query, :_KEY]), _binary(_raw(block.entries[other])), pa.array(exact)], ["entry", "other", "cosine"])
            waiting.clear()
            n = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            places, queries, models = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = _bytes(batch.column(3), _width(probes))
            ends = np.flatnonzero((places[1:] != places[:-1]) | (queries[1:] != queries[:-1])) + 1
            for a, b in zip([0, *ends], [*ends, len(places)]):
                if (int(places[a]), int(models[a])) != place:
                    yield from answer()
                    place, data, block = (int(places[a]), int(models[a])), [], None
                if queries[a]:
                    waiting.append(rows[a:b])
                    n += b - a
                    if n >= 32 * BATCH:
                        yield from answer()
                else:
                    data.append(rows[a:b])
        yield from answer()

    return run


def nearest(cache: DataFrame, k: int = 5, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """For every usable (model, hash), its k most similar others of the model: model, hash, other, cosine, rank.

    See usable for what takes part. Of equal similarity the smaller hash goes first. A model of fewer than
    k + 1 vectors gives what it has. An empty table gives no rows; other columns are ignored.
    """
    spark = cache.sparkSession
    path = fresh_dir(spark, "vectors")
    usable(cache).select("model", "hash", "vector").mapInArrow(_entries, "model string, hash string, entry binary, vector binary").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    entries = rows.groupBy("entry").agg(F.first("model").alias("model"), F.first("vector").alias("vector"))
    shared = spark.sparkContext.broadcast(fit(entries))  # at most MAX_CELLS centres for each model
    if not shared.value:
        return spark.createDataFrame([], "model string, hash string, other string, cosine double, rank int")
    entries.select("model", "entry", "vector").mapInArrow(_index(shared, probes), _INDEXED).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    groups = {f[0]: f[2] for f in shared.value.values()}
    blocks = np.ones(1 + max(int(g.max()) for g in groups.values()), np.int64)
    counted = np.zeros(len(blocks), np.int64)
    for r in index.groupBy("model", F.col("cells")[0].alias("cell")).count().collect():  # one row for each cell
        counted[groups[r["model"]][r["cell"]]] += r["count"]
    blocks = np.maximum(1, -(-counted // BLOCK))
    sent = index.mapInArrow(_send(shared, blocks, probes), "place int, query boolean, model int, row binary")
    hits = sent.repartition(int(min(blocks.sum(), 50_000)), "place").sortWithinPartitions("place", "query").mapInArrow(_search(shared, k, rerank, probes), "entry binary, other binary, cosine double")
    best = hits.groupBy("entry").agg(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("other").alias("o"))).alias("best"))  # at most k of each block asked
    first = Window.partitionBy("entry").orderBy("hash")
    few = rows.select("entry", "hash").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).groupBy("entry").agg(F.collect_list("hash").alias("hashes"))
    found = best.select("entry", F.explode(F.slice(F.array_sort("best"), 1, k)).alias("b")).select("entry", F.col("b.c").alias("c"), F.col("b.o").alias("other"))
    others = found.join(few.select(F.col("entry").alias("other"), "hashes"), "other").select("entry", "c", F.explode("hashes").alias("o"))
    same = few.select("entry", F.lit(-1.0).alias("c"), F.explode("hashes").alias("o"))
    # an entry has at most k + 1 equal and k * (k + 1) other hashes
    listed = same.unionByName(others).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("c", "o"))).alias("listed"))
    mine = F.slice(F.filter("listed", lambda s: s["o"] != F.col("hash")), 1, k)
    out = rows.select("model", "entry", "hash").join(listed, "entry").select("model", "hash", F.posexplode(mine).alias("i", "s"))
    return out.select("model", "hash", F.col("s.o").alias("other"), (-F.col("s.c")).alias("cosine"), (F.col("i") + 1).alias("rank"))
