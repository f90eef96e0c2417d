"""Sessions of activity from a Cartesian tree over the gaps between events.

The tree is the dendrogram of a user's timeline: the largest gap is the root, and every node spans the
events between the next larger gaps on either side. A cut at any threshold is then a filter
(``gap <= t < parent_gap``), so one tree serves every gap setting.

Built in two passes. Events are range-partitioned by (user, ts), which splits a user of any size over
tasks. Each task folds its stretch of a user with a stack and finishes every node whose larger
neighbours both lie in the stretch. What stays open is only the running maxima seen from either end of
the stretch; these few rows are gathered by user and folded by the same stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import fresh_dir

#: parent_gap of a tree's root.
ROOT = 2**63 - 1
_NODE = "user string, gap long, parent_gap long, start_ts long, end_ts long, n_events long"
_OPEN = ", right_ts long, right_idx long, stretch_ts long, stretch_n long"
_BATCH = 1 << 15


class _Rows:
    """Collects rows and hands them on as Arrow batches."""

    def __init__(self, names: list[str]):
        self.names, self.rows = names, []

    def batches(self, least: int = _BATCH) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            columns = list(zip(*self.rows))
            types = [pa.string()] + [pa.int64()] * (len(self.names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], self.names)
            self.rows = []


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds each user's stretch in this partition; open nodes carry right_ts, right_idx and the stretch."""
    out = _Rows(["user", "gap", "parent_gap", "start_ts", "end_ts", "n_events", "right_ts", "right_idx", "stretch_ts", "stretch_n"])
    emit = out.rows
    user, count, first, last, last_gap = None, 0, 0, 0, None
    stack: list[tuple] = []  # gap, ts and index of the event right of it, and the same of the previous larger gap
    waiting: list[tuple] = []  # gaps without a larger one to their left

    def close():
        if count:
            emit.append((user, -1, None, first, first, 1, first, 0, first, count))
            for g, r, i in sorted(waiting + [s[:3] for s in stack], key=lambda x: x[2]):
                emit.append((user, g, None, None, None, None, r, i, first, count))
            if count > 1:
                emit.append((user, -1, None, last, last, 1, last, count - 1, first, count))

    for batch in batches:
        for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if count and u == user:
                g = t - last
                if last_gap is not None:
                    emit.append((user, -1, g if g < last_gap else last_gap, last, last, 1, None, None, None, None))
                while stack and stack[-1][0] < g:
                    v, r, i, pv, pr, pi = stack.pop()
                    if pv is None:
                        waiting.append((v, r, i))
                    else:
                        emit.append((user, v, pv if pv < g else g, pr, last, count - pi, None, None, None, None))
                pv, pr, pi = stack[-1][:3] if stack else (None, None, None)
                stack.append((g, t, count, pv, pr, pi))
                last_gap = g
            else:
                close()
                stack.clear()
                waiting.clear()
                user, count, first, last_gap = u, 0, t, None
            last = t
            count += 1
        yield from out.batches()
        emit = out.rows
    close()
    yield from out.batches(1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the open nodes of each user, in order, over all of the user's stretches."""
    out = _Rows(["user", "gap", "parent_gap", "start_ts", "end_ts", "n_events"])
    emit = out.rows
    user, began, base, size, stretch = None, False, 0, 0, None
    first, last_leaf = 0, None  # last_leaf: ts and index of the latest open leaf
    left_gap = None  # the gap left of that leaf
    stack: list[tuple] = []

    def pop_all():
        while stack:
            v, _, _, pv, pr, pi = stack.pop()
            emit.append((user, v, ROOT if pv is None else pv, first if pv is None else pr, last_leaf[0], base + size - (0 if pv is None else pi)))

    def end():
        if began:
            emit.append((user, -1, ROOT if left_gap is None else left_gap, last_leaf[0], last_leaf[0], 1))
            pop_all()

    def push(g, r, i):
        nonlocal left_gap
        while stack and stack[-1][0] < g:
            v, _, _, pv, pr, pi = stack.pop()
            emit.append((user, v, g if pv is None or g < pv else pv, first if pv is None else pr, r - g, i - (0 if pv is None else pi)))
        pv, pr, pi = stack[-1][:3] if stack else (None, None, None)
        stack.append((g, r, i, pv, pr, pi))

    for batch in batches:
        for u, g, r, i, s, n in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if not began or u != user:
                end()
                stack.clear()
                user, began, base, size, stretch, first, last_leaf, left_gap = u, True, 0, n, s, r, None, None
            elif s != stretch:
                base, size, stretch = base + size, n, s
                join = r - last_leaf[0]
                emit.append((user, -1, join if left_gap is None or join < left_gap else left_gap, last_leaf[0], last_leaf[0], 1))
                push(join, r, base)
                last_leaf, left_gap = None, join
            if g < 0:
                if last_leaf is not None:  # the stretch's first leaf is done: the gap right of it came by
                    emit.append((user, -1, right_of_first if left_gap is None or right_of_first < left_gap else left_gap, last_leaf[0], last_leaf[0], 1))
                    left_gap = latest
                last_leaf = (r, base + i)
            else:
                if i == 1:
                    right_of_first = g
                push(g, r, base + i)
                latest = g
        yield from out.batches()
        emit = out.rows
    end()
    yield from out.batches(1)


def gap_tree(events: DataFrame, user: str = "user", ts: str = "ts", event_id: str = "id") -> DataFrame:
    """The Cartesian tree over the gaps of every user's events.

    Rows are the tree's nodes: an event (gap -1) or a gap with the stretch of time it spans. Columns:
    user, gap, parent_gap (ROOT for a root), start_ts, end_ts, n_events.

    An event delivered more than once (same user, ts and id) counts once; rows without ts are left out,
    for they have no place in time; rows without user form a timeline of their own; rows without id
    count once for each (user, ts). Events at one ts are joined by a gap of 0. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = (
        events.select(F.col(user).cast("string").alias("user"), F.col(ts).cast("long").alias("ts"), F.xxhash64(F.col(event_id)).alias("h"))
        .where(F.col("ts").isNotNull())
        .repartitionByRange("user", "ts")
        .dropDuplicates(["user", "ts", "h"])
        .select("user", "ts")
        .sortWithinPartitions("user", "ts")
    )
    spark, path = events.sparkSession, fresh_dir(events.sparkSession, "gaps")
    # written, for both readers below must see the same stretches: a second range partitioning may differ
    rows.mapInArrow(_stretches, _NODE + _OPEN).write.parquet(path)
    folded = spark.read.parquet(path)
    done = folded.where(F.col("right_ts").isNull()).drop("right_ts", "right_idx", "stretch_ts", "stretch_n")
    opened = (
        folded.where(F.col("right_ts").isNotNull())
        .select("user", "gap", "right_ts", "right_idx", "stretch_ts", "stretch_n")
        .repartition("user")
        .sortWithinPartitions("user", "stretch_ts", "right_idx", F.col("gap").desc())
    )
    return done.unionByName(opened.mapInArrow(_merge, _NODE))


def cut_sessions(tree: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions at a gap setting: a gap of more than gap_ms parts two sessions.

    Columns: user, start_ts, end_ts, duration_ms, n_events.
    """
    return tree.where((F.col("gap") <= gap_ms) & (F.col("parent_gap") > gap_ms)).select(
        "user", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_ms"), "n_events"
    )


def cut_many(tree: DataFrame, gaps_ms: list[int]) -> DataFrame:
    """Sessions at several settings in one pass over a tree: gap_ms, and the columns of cut_sessions."""
    asked = tree.select("*", F.explode(F.array(*(F.lit(g).cast("long") for g in gaps_ms))).alias("gap_ms"))
    return asked.where((F.col("gap") <= F.col("gap_ms")) & (F.col("parent_gap") > F.col("gap_ms"))).select("gap_ms", "user", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_ms"), "n_events")
