"""Near-duplicate records by an LSH forest over word sets.

Every distinct word set gets TREES keys of DEPTH min-hash labels. Sorting a tree by its keys puts similar
sets side by side; a set is compared with its neighbours for as long as they share a prefix. The prefix
asked for starts at SHALLOW labels and grows where a region of the tree holds more than REGION sets, so
that sparse regions are searched widely and dense ones closely. A longer prefix is shared more seldom, so
sets in dense regions get further trees, as many as keep the chance to miss a pair at the threshold below
MISS. Sets that share a whole key are all compared, however many they are: nearly every pair of them is a
link. A comparison is of one-bit sketches, over whole columns at once; what passes is checked by its words.

Equal sets are one class from the start, so copies cost one entry however many they are. Entries meet by tree
and prefix. Where a prefix of SHALLOW labels is frequent in a sample of SAMPLE sets, its entries meet by longer
prefixes, down to the depth at which none is; as such a prefix holds more than REGION sets by far, no region is
parted. The sample only places entries. A task reads its entries in order and holds one prefix's at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import cut, fresh_dir

TREES, DEPTH, SHALLOW, REGION = 24, 10, 3, 1024
#: The greatest chance that a pair at the threshold shares no region, however dense these are.
MISS = 0.001
#: Sets that tell which prefixes are frequent, and how many of them a frequent prefix has at least.
SAMPLE, FREQUENT = 4000, 8
#: Entries that a task holds before it searches those whose regions are complete.
HOLD = 200_000
#: Sketch bits that must agree: those expected at the threshold less so many standard deviations.
SLACK = 3.7
_BITS = TREES * DEPTH
_WORDS = -(-_BITS // 64)
_KEY, _CLASS = DEPTH * 2, 16
#: Bytes of an entry: key, class, sketch.
_ENTRY = _KEY + _CLASS + _WORDS * 8


_RUN = re.compile(r"[^\W_]+")


def word_set(text: str) -> list[str]:
    """The sorted distinct lower-cased runs of letters and digits."""
    return sorted(set(_RUN.findall(text.lower())))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, id, text -> kind, id, class, words (hashed); rows without words are left out."""
    known: dict[str, int] = {}
    for batch in batches:
        rows = []
        for kind, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if words := word_set(text):
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w.encode()) >> 1
                rows.append((kind, key, xxhash.xxh3_128_digest("\n".join((kind, *words)).encode()), [known[w] for w in words]))
        if len(known) > 500_000:
            known.clear()
        columns = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())))], ["kind", "id", "class", "words"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(flat: np.ndarray, starts: np.ndarray, trees: range) -> np.ndarray:
    """Min-hash values of the trees, one row for each set; flat: the hashed words of all sets."""
    words, own = np.unique(flat, return_inverse=True)
    seeds = _mix(np.arange(trees.start * DEPTH + 1, trees.stop * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(seeds), len(starts)), np.uint32)
    for j, seed in enumerate(seeds):
        out[j] = np.minimum.reduceat((_mix(words ^ seed) >> np.uint64(32)).astype(np.uint32)[own], starts)
    return _mix(out.T + seeds)


def _labels(values: np.ndarray) -> np.ndarray:
    """Labels of 16 bits, by set and tree."""
    return (values >> np.uint64(1)).astype(">u2").reshape(len(values), -1, DEPTH)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists of longs, and where each list starts."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return flat, (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()).astype(np.int64)


def _places(kinds: np.ndarray, tree: int, labels: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of kind, tree and prefix, for prefixes of SHALLOW labels and more; the last four bits tell how many."""
    at = _mix(kinds.view(np.uint64) + np.uint64(tree))
    for d in range(DEPTH):
        at = _mix(at ^ (labels[:, d].astype(np.uint64) + np.uint64(d << 16 | 1)))
        if d + 1 >= SHALLOW:
            yield at & ~np.uint64(15) | np.uint64(d + 1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as Arrow binaries."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Arrow binaries of one width as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _trees(flat: np.ndarray, starts: np.ndarray, extra: np.ndarray | None, values: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tree, how many of the sets have it, and these sets' labels: of the first TREES trees, or of each set's extra ones; sets come by descending extra."""
    if extra is None:
        labels = _labels(_signatures(flat, starts, range(TREES)) if values is None else values)
        yield from ((t, len(starts), labels[:, t]) for t in range(TREES))
    else:
        ends = np.append(starts, len(flat))
        for t in range(TREES, TREES + int(extra.max(initial=0))):
            n = int((extra > t - TREES).sum())
            yield t, n, _labels(_signatures(flat[: ends[n]], starts[:n], range(t, t + 1)))[:, 0]


def _descending(part: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray | None]:
    if part.num_columns < 4:
        return part, None
    part = part.take(pa.array(np.argsort(-part.column(3).to_numpy(), kind="stable")))
    return part, part.column(3).to_numpy()


def _plant(frequent: np.ndarray):
    """kind (hashed), class, words (hashed) -> an entry of each tree; with a fourth column, of so many trees beyond the first TREES. frequent: sorted places to go beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part, extra = _descending(batch.slice(at, 4000))
                flat, starts = _flat(part.column(2))
                values = _signatures(flat, starts, range(TREES))
                bits = np.zeros((len(starts), _WORDS * 64), np.uint8)
                bits[:, :_BITS] = values & np.uint64(1)
                entry = np.empty((len(starts), _ENTRY), np.uint8)
                entry[:, _KEY : _KEY + _CLASS] = _bytes(part.column(1), _CLASS)
                entry[:, _KEY + _CLASS :] = np.packbits(bits, axis=1)
                kinds = part.column(0).to_numpy()
                for t, n, labels in _trees(flat, starts, extra, values):
                    place = None
                    for longer in _places(kinds[:n], t, labels):
                        place = longer if place is None else np.where(further, longer, place)
                        further = np.isin(place, frequent)
                        if not further.any():
                            break
                    entry[:n, :_KEY] = np.ascontiguousarray(labels).view(np.uint8).reshape(n, _KEY)
                    yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), _binary(entry[:n].copy())], ["place", "entry"])

    return run


def _frequent(planted: DataFrame) -> np.ndarray:
    """Places whose prefix holds more than REGION sets by far, by a sample of about SAMPLE sets chosen by a hash. planted: what _plant gets."""
    total = planted.count()
    few = planted.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / max(SAMPLE, total))).toArrow()
    if not few.num_rows or total <= 4 * REGION:
        return np.zeros(0, np.uint64)
    least = max(FREQUENT, 4 * REGION * few.num_rows / total)
    few, extra = _descending(few.combine_chunks().to_batches()[0])
    kinds, found = few.column(0).to_numpy(), []
    for t, n, labels in _trees(*_flat(few.column(2)), extra, None):
        for places in _places(kinds[:n], t, labels):
            values, counts = np.unique(places, return_counts=True)
            found.append(values[counts >= least])
    return np.unique(np.concatenate(found))


def _runs(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number and run length of each row; changed: whether a row begins a run."""
    run = np.cumsum(changed) - 1
    return run, np.bincount(run)[run]


def _neighbours(places: np.ndarray, labels: np.ndarray, sketches: np.ndarray, least: int, most: int, floors: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of sorted entries to check, and the prefix asked of each row. floors: labels asked at least of the rows that share one label less with the first."""
    n = len(places)
    changed = np.ones(n, bool)
    changed[1:] = places[1:] != places[:-1]
    region = np.zeros(n, np.int64)
    settled = np.zeros(n, bool)
    asked = places & 15
    for floor in floors:
        asked[(places == places[0]) & (labels[:, : floor - 1] == labels[0, : floor - 1]).all(axis=1)] = floor
    for d in range(DEPTH):
        changed[1:] |= labels[1:, d] != labels[:-1, d]
        if d + 1 < SHALLOW:
            continue
        run, size = _runs(changed)
        now = ~settled & ((size <= most) & (d + 1 >= asked) | (d + 1 == DEPTH))
        region[now] = run[now] * DEPTH + d
        settled |= now
    a, b = [], []
    left = np.arange(n - 1)
    step = 1
    while len(left):  # the step-th neighbour, of those rows whose region reaches so far
        left = left[left + step < n]
        left = left[region[left] == region[left + step]]
        for part in np.array_split(left, max(1, len(left) // 500_000)):
            agree = _BITS - np.bitwise_count(sketches[part] ^ sketches[part + step]).sum(axis=1, dtype=np.int64)
            good = part[agree >= least]
            a.append(good)
            b.append(good + step)
        step += 1
    pairs = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
    return *pairs, region % DEPTH + 1


def _complete(places: np.ndarray, labels: np.ndarray, most: int) -> tuple[int, int]:
    """How many of the sorted rows have complete regions, and how many labels the regions of all of them have at least (0: not told): what follows belongs to the same prefix of one label less."""
    same = places == places[-1]
    for d in range(SHALLOW):
        same &= labels[:, d] == labels[-1, d]
    for d in range(SHALLOW, DEPTH + 1):
        start = len(same) - int(same.sum())
        if start:
            return start, d if d > SHALLOW else 0
        if d == DEPTH or len(same) <= most:
            break
        same = same & (labels[:, d] == labels[-1, d])
    return 0, 0


def _search(threshold: float):
    p, most, hold = (1 + threshold) / 2, REGION, HOLD  # read here: executors have the module's own value
    least = int(np.floor(_BITS * p - SLACK * np.sqrt(_BITS * p * (1 - p))))

    def search(places: np.ndarray, rows: np.ndarray, labels: np.ndarray, floors: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        if len(places) < 2:
            return  # alone: nothing is separated from it
        a, b, depth = _neighbours(places, labels, np.ascontiguousarray(rows[:, _KEY + _CLASS :]).view(np.uint64), least, most, floors)
        classes = np.ascontiguousarray(rows[:, _KEY : _KEY + _CLASS])
        order = classes.view(">u8").astype(np.uint64)
        deep = np.nonzero(depth > SHALLOW)[0]
        later = (order[a, 0] > order[b, 0]) | (order[a, 0] == order[b, 0]) & (order[a, 1] > order[b, 1])
        a, b = np.where(later, b, a), np.where(later, a, b)
        a, b, depth = np.concatenate([a, deep]), np.concatenate([b, deep]), np.concatenate([np.zeros(len(a), np.int32), depth[deep].astype(np.int32)])
        for at in range(0, len(a), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([_binary(np.hstack([classes[a[part]], classes[b[part]]])), pa.array(depth[part])], ["pair", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, limit, floor = 0, hold, 0

        def gather():
            places, rows = (np.concatenate(x) for x in zip(*held))
            return places, rows, np.ascontiguousarray(rows[:, :_KEY]).view(">u2").astype(np.uint16)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), _bytes(batch.column(1), _ENTRY)))
            n += batch.num_rows
            if n > limit:
                places, rows, labels = gather()
                whole, after = _complete(places, labels, most)
                if whole:
                    yield from search(places[:whole], rows[:whole], labels[:whole], tuple(sorted({floor, after} - {0})))
                    held, n, limit, floor = [(places[whole:], rows[whole:])], n - whole, hold + n - whole, after
                else:  # one key: all its pairs are compared
                    held, limit = [(places, rows)], 2 * n
        if n:
            yield from search(*gather(), (floor,) if floor else ())

    return run


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From kind, id, text: members (kind, class, id) and the classes of equal word sets of a kind (kind, class, words).

    Null kinds form a kind of their own; rows without id, and texts without any word, take no part;
    repeated rows count once. Words are hashed to 63 bits. Both are written, for they are read several times.
    """
    spark = records.sparkSession
    rows = records.select(F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"), F.col("id").cast("string").alias("id"), F.col("text").cast("string")).where("id IS NOT NULL AND text IS NOT NULL")
    path = fresh_dir(spark, "classes")
    rows.mapInArrow(_sets, "kind string, id string, class binary, words array<long>").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy("class").agg(F.first("kind").alias("kind"), F.first("words").alias("words")).write.parquet(f"{path}/sets")
    return rows.select("kind", "class", "id").distinct(), spark.read.parquet(f"{path}/sets")


def links(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes whose word sets have at least `threshold` of their union in common: kind, class_a, class_b, similarity."""
    hashed = sets.select(F.xxhash64("kind").alias("kind"), "class", "words")

    def search(planted: DataFrame) -> DataFrame:
        """Pairs to check; a class with itself: how deep its regions are."""
        forest = planted.mapInArrow(_plant(_frequent(planted)), "place long, entry binary")
        found = forest.repartition("place").sortWithinPartitions("place", "entry").mapInArrow(_search(threshold), "pair binary, depth int")
        return found.groupBy("pair").agg(F.max("depth").alias("depth"))

    first = cut(search(hashed))
    # as if every tree asked for the longest prefix met, for where a label is rare, so that the prefix stays short, a pair shares it more seldom too; a pair has the trees that both its sets have
    trees = F.ceil(F.lit(float(np.log(MISS))) / F.log(1 - F.pow(F.lit(float(threshold)), "depth")))
    extra = (trees - TREES).cast("int").alias("extra")
    deep = first.where("depth > 0").select(F.substring("pair", 1, _CLASS).alias("class"), extra).where("extra > 0")
    pairs = first.where("depth = 0").select("pair")
    if not deep.isEmpty():
        more = search(hashed.join(deep, "class").select("kind", "class", "words", "extra"))
        pairs = pairs.unionByName(more.where("depth = 0").select("pair")).distinct()
    pairs = pairs.select(F.substring("pair", 1, _CLASS).alias("class_a"), F.substring("pair", _CLASS + 1, _CLASS).alias("class_b"))
    side = lambda x: sets.select(F.col("kind").alias(f"kind_{x}"), F.col("class").alias(f"class_{x}"), F.col("words").alias(f"words_{x}"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    checked = pairs.join(side("a"), "class_a").join(side("b"), "class_b").where("kind_a = kind_b").withColumn("both", both)
    similarity = F.col("both") / (F.size("words_a") + F.size("words_b") - F.col("both"))
    return checked.select(F.col("kind_a").alias("kind"), "class_a", "class_b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All pairs of records of a kind whose word sets are similar: kind, id_a < id_b, similarity.

    See classes for what takes part; an id met with several texts takes its most similar one. Members of a class are pairs of similarity 1; a record's partners have no cap.
    """
    members, sets = classes(records)
    a = members.select("kind", F.col("class").alias("class_a"), F.col("id").alias("x"))
    b = members.select("kind", F.col("class").alias("class_b"), F.col("id").alias("y"))
    within = a.join(b, (a["kind"] == b["kind"]) & (a["class_a"] == b["class_b"]) & (F.col("x") < F.col("y"))).select(a["kind"], "x", "y", F.lit(1.0).alias("similarity"))
    across = links(sets, threshold).join(a, ["kind", "class_a"]).join(b, ["kind", "class_b"]).select("kind", "x", "y", "similarity")
    pairs = within.unionByName(across)
    return pairs.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").where("id_a < id_b").groupBy("kind", "id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def groups(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row for each record: kind, id, class, n_links (similar other classes), group.

    A group is a connected component of classes, named by its least class; copies stay one class, so
    nothing is expanded into pairs. See classes for what takes part.
    """
    members, sets = classes(records)
    edges = cut(links(sets, threshold).select("kind", "class_a", "class_b"))
    both = edges.unionByName(edges.select("kind", F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    labels = cut(both.groupBy("kind", F.col("class_a").alias("class")).agg(F.count("*").alias("n_links"), F.least("class_a", F.min("class_b")).alias("label")))
    while True:
        reach = both.join(labels.select("kind", F.col("class").alias("class_b"), "label"), ["kind", "class_b"]).groupBy("kind", F.col("class_a").alias("class")).agg(F.min("label").alias("seen"))
        jump = labels.select("kind", F.col("class").alias("label"), F.col("label").alias("jumped"))
        moved = labels.join(reach, ["kind", "class"]).join(jump, ["kind", "label"], "left").select("kind", "class", "n_links", F.least("label", "seen", "jumped").alias("label"), F.col("label").alias("old"))
        moved = cut(moved)
        labels = moved.drop("old")
        if moved.where("label <> old").isEmpty():
            break
    named = members.join(labels, ["kind", "class"], "left")
    return named.select("kind", "id", F.lower(F.hex("class")).alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.lower(F.hex(F.coalesce("label", "class"))).alias("group"))
