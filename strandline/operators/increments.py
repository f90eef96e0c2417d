"""Processing only new or changed records: log-based change capture with replayable batches.

A run goes through four steps, each of which leaves a durable trace in a folder that all executors share:

1. plan: the range of offsets to read from every partition of the log, written ahead of any work;
2. latest: of the partitions that the plan touches, the newest usable record of every key, merged from the snapshot
   before and the batch, with the offset that was last given out;
3. sink: the keys that have to be processed, with the offset that made them so;
4. commit: a small file made in one step, which says in which batch every partition's snapshot lies.

A run that finds a plan without a commit replays that very plan, and its writes replace what the failed run left. The
plan and the commit are made only if there are none, so of two runs at once one fails. Readers of the sink see
committed batches only and keep one row for each key and offset.

What a run reads follows from its plan: the log from the least offset on, as bounds that reach the scan, and the
snapshots of the partitions touched. Past sinks aren't read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import Files

_SINK = "full_name string, fingerprint string, kind string, offset long, batch long"
_LATEST = "full_name string, probed_at timestamp, offset long, fingerprint string, kind string, given long, due boolean"
_START = -(2**63)


def repo_state(fingerprints: DataFrame) -> DataFrame:
    """The state of each repo: the row of its log with the latest instant.

    Offsets of the ISO texts are honoured; a text that is no instant counts as the earliest. Rows
    without full_name are left out; of equal instants the greater fingerprint wins. Other columns are ignored.
    """
    at = F.expr("try_to_timestamp(last_indexed_at)")
    rank = F.struct(F.coalesce(at, F.expr("timestamp_millis(-62135596800000L)")), F.coalesce("fingerprint", F.lit("")))
    return fingerprints.where(F.col("full_name").isNotNull()).groupBy("full_name").agg(F.max_by("fingerprint", rank).alias("state_fingerprint"), F.max(at).alias("last_indexed"))


def latest_usable(probes: DataFrame) -> DataFrame:
    """The newest usable probe of each repo by probed_at, then probe_id.

    Usable is a probe with outcome ok, a name, a fingerprint, a time and an offset (probe_id).
    """
    usable = probes.where((F.col("outcome") == "ok") & F.col("full_name").isNotNull() & F.col("fingerprint").isNotNull() & F.col("probed_at").isNotNull() & F.col("probe_id").isNotNull())
    top = F.max(F.struct("probed_at", F.col("probe_id").alias("offset"), "fingerprint", "kind")).alias("top")
    return usable.groupBy("full_name").agg(top).select("full_name", "top.probed_at", "top.offset", "top.fingerprint", "top.kind")


def to_index(latest: DataFrame, state: DataFrame) -> DataFrame:
    """Repos whose newest probe differs from their state, or that have none. One row each."""
    joined = latest.join(state.select("full_name", "state_fingerprint", F.lit(True).alias("known")), "full_name", "left")
    return joined.where(F.col("known").isNull() | ~F.col("fingerprint").eqNullSafe(F.col("state_fingerprint"))).select("full_name", "fingerprint", "kind", "offset")


class StopHere(RuntimeError):
    """Raised after a step, to stand for a failure in tests."""


@dataclass
class ChangeCapture:
    """Incremental runs over a log of probes, with their bookkeeping below root.

    partitions: the log's partitions by key; a plan and a commit have one entry for each, whatever the log's size.
    """

    spark: SparkSession
    root: str
    partitions: int = 16

    def _files(self) -> Files:
        return Files(self.spark, self.root)

    def committed(self) -> int:
        """The last committed batch, -1 before the first."""
        return max([-1, *(int(n) for n in self._files().names(f"{self.root}/commits"))])

    def _partition(self):
        return F.pmod(F.xxhash64("full_name"), F.lit(self.partitions)).cast("int").alias("part")

    def _read(self, kind: str, batch: int) -> dict[int, list[int]]:
        """What a plan (part: from and to offset) or a commit (part: the batch of its snapshot) holds."""
        return {int(k): v for k, v in json.loads(self._files().text(f"{self.root}/{kind}/{batch}")).items()}

    def plan(self, probes: DataFrame) -> int:
        """Writes the next batch's plan, or leaves the one that a failed run wrote. Gives its number."""
        batch = self.committed() + 1
        path = f"{self.root}/plans/{batch}"
        if self._files().exists(path):
            return batch
        before = {k: v[1] for k, v in self._read("plans", batch - 1).items()} if batch else dict.fromkeys(range(self.partitions), _START)
        new = probes.where(F.col("full_name").isNotNull() & F.col("probe_id").isNotNull())
        if (least := min(before.values())) > _START:
            new = new.where(F.col("probe_id") > least)
        ends = {r["part"]: r["end"] for r in new.groupBy(self._partition()).agg(F.max("probe_id").alias("end")).collect()}  # a row a partition
        self._files().write_new(path, json.dumps({k: [v, max(v, ends.get(k, v))] for k, v in before.items()}))
        return batch

    def records(self, probes: DataFrame, batch: int) -> DataFrame:
        """The records of a batch, as its plan has them; the bounds of all partitions reach the scan."""
        ranges = {k: v for k, v in self._read("plans", batch).items() if v[0] < v[1]}
        rows = probes.select("full_name", "fingerprint", "kind", "outcome", "probed_at", "probe_id")
        if not ranges:
            return rows.where(F.lit(False)).withColumn("part", F.lit(0))
        least, most = min(v[0] for v in ranges.values()), max(v[1] for v in ranges.values())
        bounds = lambda i: F.create_map(*(F.lit(x) for k, v in ranges.items() for x in (k, v[i])))[F.col("part")]
        rows = rows.where(F.col("probe_id") <= most) if least == _START else rows.where((F.col("probe_id") > least) & (F.col("probe_id") <= most))
        return rows.withColumn("part", self._partition()).where((F.col("probe_id") > bounds(0)) & (F.col("probe_id") <= bounds(1)))

    def run(self, probes: DataFrame, fingerprints: DataFrame, stop_after: str | None = None) -> int:
        """One run; gives the batch's number. stop_after: a step after which to fail, for tests.

        The repos probed in the batch are held against their state as it is now. A repo is given out once for each
        probe that makes it due, and again only by a newer one. Probes that arrive late with an earlier probed_at
        change nothing. Null names and offsets take no part. fingerprints has no offsets, so all of it is read, for
        the repos of the batch.
        """
        files, batch = self._files(), self.plan(probes)
        self._stop("plan", stop_after)
        where = self._read("commits", batch - 1) if batch else {}
        touched = [k for k, v in self._read("plans", batch).items() if v[0] < v[1]]
        found = latest_usable(self.records(probes, batch)).withColumn("probed", F.lit(True)).withColumn("given", F.lit(None).cast("long"))
        kept = [f"{self.root}/latest/{where[k]}/part={k}" for k in touched if where.get(k) is not None]
        kept = [p for p in kept if files.exists(p)]  # a partition whose records weren't usable has none
        merged = found
        if kept:
            merged = found.unionByName(self.spark.read.schema(_LATEST).parquet(*kept).drop("due").withColumn("probed", F.lit(False)))
        top = F.max(F.struct("probed_at", "offset", "fingerprint", "kind")).alias("top")
        merged = merged.groupBy("full_name").agg(top, F.max("given").alias("given"), F.max("probed").alias("probed")).select("full_name", "top.*", "given", "probed")
        state = repo_state(fingerprints.join(found.select("full_name"), "full_name", "left_semi")).select("full_name", "state_fingerprint", F.lit(True).alias("known"))
        held = merged.join(state, "full_name", "left")
        differs = F.col("known").isNull() | ~F.col("fingerprint").eqNullSafe(F.col("state_fingerprint"))
        due = F.col("probed") & differs & ~F.col("offset").eqNullSafe(F.col("given"))
        held = held.withColumn("due", due).withColumn("given", F.when(F.col("due"), F.col("offset")).otherwise(F.col("given")))
        path = f"{self.root}/latest/{batch}"
        held.select("full_name", "probed_at", "offset", "fingerprint", "kind", "given", "due", self._partition()).write.mode("overwrite").partitionBy("part").parquet(path)
        self._stop("latest", stop_after)
        given = self.spark.read.schema(_LATEST).parquet(path).where("due").select("full_name", "fingerprint", "kind", "offset", F.lit(batch).cast("long").alias("batch"))
        given.write.mode("overwrite").parquet(f"{self.root}/sink/{batch}")
        self._stop("sink", stop_after)
        files.write_new(f"{self.root}/commits/{batch}", json.dumps({k: batch if k in touched else where.get(k) for k in range(self.partitions)}))
        return batch

    @staticmethod
    def _stop(step: str, stop_after: str | None) -> None:
        if step == stop_after:
            raise StopHere(step)

    def changes(self, after: int = -1) -> DataFrame:
        """What committed batches beyond `after` gave out: full_name, fingerprint, kind, offset, batch; one row for each key and offset."""
        paths = [f"{self.root}/sink/{n}" for n in range(after + 1, self.committed() + 1)]
        return self.spark.read.schema(_SINK).parquet(*paths).dropDuplicates(["full_name", "offset"]) if paths else self.spark.createDataFrame([], _SINK)
