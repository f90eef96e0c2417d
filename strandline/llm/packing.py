"""Filling containers of fixed capacity by deficit round-robin over sources.

A packer draws each source's items in hashed order. Every container adds to each source's deficit its target
share of the capacity; the source with the greatest deficit gives its next item that fits. Once what is
left is within CLOSE times the mean size of the items, the neediest source with an item that all but fills it
closes the container. Sizes are thus drawn alike from first to last, and what a source lacks or has too much
stays in its deficit for the containers to come. Items are spread over packers by a hash, so each packer has
nearly the corpus's mixture, however large one source is; what a packer's supply departs from its targets is
known beforehand from sums by packer and source, and is carried on as the next packers' opening deficits.

An item larger than its source's share of the capacity puts its container off the targets by the difference,
whatever the packing; `mixture` reports that bound beside what was reached.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.encoding import TOKENIZERS, encoder
from strandline.session import fresh_dir

#: Items of a packer, about.
PACKER_ITEMS = 25_000
#: A container is closed by a fitting item once so many mean items of the packer would fill it, with at most SLACK of it left.
CLOSE, SLACK = 2.0, 0.004
#: Items of a source that are looked at, in order, for the next that fits.
LOOK = 32
#: Containers in a row over which the mixture is reported besides.
RUN = 16
#: Kinds of windows that are filled at once.
MAX_WINDOWS = 100
_PACKED = "window_name string, container string, doc_id long, piece int, token_start long, n_tokens long, position long"


def _count(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    return run


def token_sizes(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, n_tokens of every row; null and empty texts have none."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(_count(tokenizer, folder), "doc_id long, source string, n_tokens long")


class Queue:
    """Items of one source in the order put; gives the next that fits, or the largest."""

    def __init__(self):
        self.sizes = 0  # bit n is set while there is an item of size n
        self.order: list[int] = []  # sizes, 0 once taken
        self.at = 0
        self.items: dict[int, deque] = defaultdict(deque)

    def put(self, size: int, item) -> None:
        self.items[size].append((len(self.order), item))
        self.order.append(size)
        self.sizes |= 1 << size

    def largest(self, room: int) -> int:
        """The largest size that fits, 0 if none."""
        return (self.sizes & ((2 << room) - 1)).bit_length() - 1 if self.sizes & ((2 << room) - 1) else 0

    def next(self, room: int) -> int:
        """The size of the first of the next LOOK items that fits, 0 if none."""
        while self.at < len(self.order) and not self.order[self.at]:
            self.at += 1
        seen = 0
        for k in range(self.at, len(self.order)):
            if size := self.order[k]:
                if size <= room:
                    return size
                seen += 1
                if seen == LOOK:
                    break
        return 0

    def take(self, size: int):
        """The first item of a size."""
        k, item = self.items[size].popleft()
        self.order[k] = 0
        if not self.items[size]:
            self.sizes ^= 1 << size
        return item


def _choose(needy: list[tuple], queues: dict, room: int, closing: bool, slack: float) -> tuple[int, int]:
    """Which of the sources, the neediest first, gives an item of what size; size 0 if none fits."""
    if closing:
        for i, (_, s) in enumerate(needy):
            size = queues[s].largest(room)
            if size and room - size <= slack:
                return i, size
    for i, (_, s) in enumerate(needy):
        if size := queues[s].next(room):
            return i, size
    return max(((i, queues[s].largest(room)) for i, (_, s) in enumerate(needy)), key=lambda c: c[1], default=(0, 0))


def pack_items(queues: dict, shares: dict, deficits: dict, capacity: int) -> Iterator[list]:
    """Containers, each a list of (size, item). Changes its arguments; every item comes out once."""
    live = [s for s, q in queues.items() if q.sizes]
    sizes = [n for q in queues.values() for n in q.order]
    near = CLOSE * sum(sizes) / max(1, len(sizes))
    while live:
        room, held = capacity, []
        for s in deficits:
            deficits[s] += shares.get(s, 0.0) * capacity
        needy = sorted((-deficits[s], s) for s in live)
        while room and needy:
            i, size = _choose(needy, queues, room, room <= near, SLACK * capacity)
            if not size:
                break
            source = needy.pop(i)[1]
            held.append((size, queues[source].take(size)))
            deficits[source] -= size
            room -= size
            if queues[source].sizes:
                insort(needy, (-deficits[source], source))
            else:
                live.remove(source)
        yield held


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, queues, shares, deficits, capacity = None, {}, {}, {}, 0
    rows: list[tuple] = []
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def close():
        for no, held in enumerate(pack_items(queues, shares, deficits, capacity)):
            at = 0
            for size, (doc_id, piece, start) in held:
                rows.append((current[0], f"{current[1]}-{no}", doc_id, piece, start, size, at))
                at += size

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rows.clear()
        return batch

    for batch in batches:
        for window, packer, source, share, deficit, room, doc_id, piece, start, size in zip(*(c.to_pylist() for c in batch.columns)):
            if (window, packer) != current:
                if current:
                    close()
                    if len(rows) > 20_000:
                        yield flush()
                current, queues, shares, deficits, capacity = (window, packer), {}, {}, {}, room
            if share is not None:
                shares[source], deficits[source], queues[source] = share, deficit, Queue()
            else:
                queues[source].put(size, (doc_id, piece, start))
    if current:
        close()
    if rows:
        yield flush()


def pack(sizes: DataFrame, windows: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Containers for every window: window_name, container, doc_id, piece, token_start, n_tokens, position.

    sizes: doc_id, source, n_tokens; windows: window_name, capacity_tokens, a few rows. shares: target
    proportions of tokens by source; without them those of the corpus. A source of no target, or whose
    supply outlasts it, comes out all the same.

    A text of more than the capacity is divided into full containers and a rest; no other is. Texts without
    tokens come out with a null container. Null sources are a source of their own. Repeated rows are packed
    each. Windows without a positive capacity take no part. Other columns are ignored.
    """
    spark = sizes.sparkSession
    path = fresh_dir(spark, "sizes")
    kinds = windows.where(F.col("capacity_tokens") > 0).groupBy("window_name").agg(F.max("capacity_tokens").alias("capacity")).limit(MAX_WINDOWS + 1).collect()
    if len(kinds) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows")
    sizes.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")).write.parquet(path)
    sizes = spark.read.parquet(path)
    packers = max(1, -(-sizes.count() // PACKER_ITEMS))
    each = F.array(*(F.struct(F.lit(k["window_name"]).alias("window_name"), F.lit(k["capacity"]).cast("int").alias("capacity")) for k in kinds))
    if not kinds:
        return spark.createDataFrame([], _PACKED)
    cut = sizes.select("*", F.explode(each).alias("w")).select("doc_id", "source", "n", "w.window_name", "w.capacity")
    empty = cut.where("n = 0").select("window_name", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("position"))
    full = cut.where("n >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.expr("n div capacity") - 1).cast("int"))))
    name = F.format_string("%d-%016x-%d", "doc_id", F.xxhash64(F.monotonically_increasing_id()), "piece")
    full = full.select("window_name", F.concat(F.lit("full-"), name).alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).cast("long").alias("token_start"), F.col("capacity").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("position"))
    rest = F.col("n") % F.col("capacity")
    packer = F.pmod(F.xxhash64("doc_id", "n"), F.lit(packers)).cast("int").alias("packer")
    items = cut.where(rest > 0).select("window_name", packer, "source", F.col("capacity").cast("int"), "doc_id", F.expr("cast(n div capacity as int)").alias("piece"), (F.col("n") - rest).cast("long").alias("token_start"), rest.cast("long").alias("n_tokens"))
    supply = items.groupBy("window_name", "packer", "source").agg(F.sum("n_tokens").alias("supply"), F.first("capacity").alias("capacity"))
    by_source = supply.groupBy("window_name", "source").agg(F.sum("supply").alias("all"))
    by_source = by_source.withColumn("share", F.col("all") / F.sum("all").over(Window.partitionBy("window_name")))
    if shares is not None:
        wanted = spark.createDataFrame([(k, float(v)) for k, v in shares.items()] or [("", 0.0)], "source string, wanted double")
        by_source = by_source.join(F.broadcast(wanted), "source", "left").withColumn("share", F.coalesce("wanted", F.lit(0.0)))
    before = lambda *by: Window.partitionBy(*by).orderBy("packer").rowsBetween(Window.unboundedPreceding, -1)
    totals = supply.groupBy("window_name", "packer").agg(F.sum("supply").alias("total"))  # one row for each packer
    totals = totals.select("window_name", "packer", F.coalesce(F.sum("total").over(before("window_name")), F.lit(0)).alias("placed"))
    had = F.coalesce(F.sum("supply").over(before("window_name", "source")), F.lit(0))
    grid = supply.withColumn("had", had).join(totals, ["window_name", "packer"]).join(by_source.select("window_name", "source", "share"), ["window_name", "source"])
    carried = F.col("share") * F.col("placed") - F.col("had")
    none = lambda kind: F.lit(None).cast(kind)
    opening = grid.select("window_name", "packer", "source", "share", carried.alias("deficit"), F.col("capacity").cast("int"), none("long").alias("doc_id"), none("int").alias("piece"), none("long").alias("token_start"), none("long").alias("n_tokens"))
    given = items.select("window_name", "packer", "source", none("double").alias("share"), none("double").alias("deficit"), "capacity", "doc_id", "piece", "token_start", "n_tokens")
    place = ["window_name", "packer"]
    ordered = opening.unionByName(given).repartition(*place).sortWithinPartitions(*place, F.col("share").isNull(), F.xxhash64(F.lit("order"), "doc_id", "piece"), "doc_id", "token_start")
    return ordered.mapInArrow(_pack, _PACKED).unionByName(full).unionByName(empty)


def fill(packed: DataFrame, sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """One row for each window: what a packing holds and whether it is sound.

    n_docs: rows of sizes placed; n_over: containers above the capacity; n_divided: texts in more pieces than
    their size needs; n_wrong: texts whose pieces don't make up their size; n_apart: containers with an item that
    doesn't begin where the one before ends; containers, filled (share of their room that is used), least
    (containers that the tokens need at least). doc_id has to be unique and not null.
    """
    kinds = F.broadcast(windows.where(F.col("capacity_tokens") > 0).groupBy("window_name").agg(F.max("capacity_tokens").alias("capacity")))  # the bound is pack's
    before = F.lag(F.col("position") + F.col("n_tokens"), 1, 0).over(Window.partitionBy("window_name", "container").orderBy("position"))
    inside = packed.where(F.col("container").isNotNull()).withColumn("apart", (F.col("position") != before).cast("int"))
    boxes = inside.groupBy("window_name", "container").agg(F.sum("n_tokens").alias("used"), F.max("apart").alias("apart")).join(kinds, "window_name")
    boxes = boxes.groupBy("window_name").agg(
        F.sum((F.col("used") > F.col("capacity")).cast("int")).alias("n_over"), F.sum("apart").alias("n_apart"), F.count("*").alias("containers"), (F.sum("used") / F.sum("capacity")).alias("filled")
    )
    docs = packed.groupBy("window_name", "doc_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces")).join(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n")), "doc_id").join(kinds, "window_name")
    docs = docs.groupBy("window_name").agg(
        F.count("*").alias("n_docs"),
        F.sum((F.col("used") != F.col("n")).cast("int")).alias("n_wrong"),
        F.sum((F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity")))).cast("int")).alias("n_divided"),
        F.ceil(F.sum("n") / F.first("capacity")).alias("least"),
    )
    return docs.join(boxes, "window_name").select("window_name", "n_docs", "n_over", "n_divided", "n_wrong", "n_apart", "containers", "filled", "least")


def mixture(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """How far containers of divided texts' rests and whole texts lie from the corpus's proportions, one row for each window.

    distance: mean total-variation distance of a container; bound: what no packing of these items can go below;
    first, last: distance of the first and last tenth of each packer's containers; items_first, items_last: items
    in these; run_distance: distance of RUN containers in a row. Other columns are ignored; doc_id has to be unique.
    """
    rows = packed.where(F.col("container").isNotNull() & ~F.col("container").startswith("full-")).join(sizes.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    rows = rows.select("window_name", "source", F.col("n_tokens").alias("n"), *(F.split_part("container", F.lit("-"), F.lit(i)).cast("long").alias(c) for i, c in ((1, "packer"), (2, "no"))))
    total = rows.groupBy("window_name", "source").agg(F.sum("n").alias("all"))
    shares = F.broadcast(total.withColumn("share", F.col("all") / F.sum("all").over(Window.partitionBy("window_name"))).drop("all"))  # sources by windows, as in pack

    def distances(*place: str) -> DataFrame:
        """Half the sum of the differences: of sources met, their excess."""
        by = rows.groupBy("window_name", *place, "source").agg(F.sum("n").alias("n"), F.count("*").alias("items")).join(shares, ["window_name", "source"])
        excess = F.col("n") / F.sum("n").over(Window.partitionBy("window_name", *place)) - F.col("share")
        return by.withColumn("excess", F.greatest(excess, F.lit(0.0))).groupBy("window_name", *place).agg(F.sum("excess").alias("distance"), F.sum("items").alias("items"), F.sum("n").alias("used"))

    one = distances("packer", "no").withColumn("at", F.percent_rank().over(Window.partitionBy("window_name", "packer").orderBy("no")))
    at = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    first, last = F.col("at") < 0.1, F.col("at") > 0.9
    ones = one.groupBy("window_name").agg(F.avg("distance").alias("distance"), at("distance", first).alias("first"), at("distance", last).alias("last"), at("items", first).alias("items_first"), at("items", last).alias("items_last"), F.sum("used").alias("used"), F.max("used").alias("largest"))
    rows = rows.withColumn("run", F.floor(F.col("no") / RUN))
    runs = distances("packer", "run").groupBy("window_name").agg(F.avg("distance").alias("run_distance"))
    beyond = rows.join(shares, ["window_name", "source"]).join(F.broadcast(ones.select("window_name", "largest")), "window_name")
    beyond = beyond.groupBy("window_name").agg((F.sum(F.greatest(F.lit(0.0), F.col("n") - F.col("share") * F.col("largest"))) / F.sum("n")).alias("bound"))
    return ones.join(runs, "window_name").join(beyond, "window_name").select("window_name", "distance", "bound", "first", "last", "items_first", "items_last", "run_distance")
