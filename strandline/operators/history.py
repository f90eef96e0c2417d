"""Commits, hunks and tickets attached to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as T


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Commits from lines hash|date|email|subject, whose subject may have bars; other lines are left out."""
    parts = F.split(F.col(line), r"\|", 4)
    rows = lines.where(F.size(parts) == 4).select("*", parts.alias("p")).where((F.trim(F.col("p")[0]) != "") & (F.trim(F.col("p")[1]) != ""))
    return rows.select(*[c for c in lines.columns if c != line], F.col("p")[0].alias("commit_hash"), F.col("p")[1].alias("committed_at"), F.col("p")[2].alias("author_email"), F.col("p")[3].alias("subject"))


def parse_hunks(lines: DataFrame, by: str = "file", no: str = "line_no", line: str = "line") -> DataFrame:
    """New-side line ranges of the hunks after each commit's line (40 hex digits): by, commit_hash, start_line, end_line.

    Without a count a hunk has one line; with 0 it ends where it starts.
    """
    upto = Window.partitionBy(by).orderBy(no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    commit = F.last(F.when(F.col(line).rlike("^[0-9a-f]{40}$"), F.col(line)), ignorenulls=True).over(upto)
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.select(by, F.col(line).alias("l"), commit.alias("commit_hash")).where(F.col("commit_hash").isNotNull() & F.col("l").rlike(hunk))
    start = F.regexp_extract("l", hunk, 1).cast("int")
    count = F.coalesce(F.regexp_extract("l", hunk, 2).try_cast("int"), F.lit(1))
    return rows.select(by, "commit_hash", start.alias("start_line"), (start + F.greatest(count, F.lit(1)) - 1).alias("end_line"))


def head_of(lines: DataFrame, line: str = "line") -> DataFrame:
    """The commit that HEAD stands for in lines of a remote's references."""
    return lines.where(~F.startswith(line, F.lit("ref:"))).select(F.regexp_extract(line, r"^([0-9a-f]{40})\s+HEAD$", 1).alias("sha")).where("sha <> ''")


def chunk_commits(places: DataFrame, commits: DataFrame, hunks: DataFrame, shift: int = 0) -> DataFrame:
    """Commits of each chunk: those with a hunk that meets its lines, and those of its file that have no hunks.

    shift is added to hunk lines; 0 compares them as they are. A hunk's join is on the file; of a file's
    rows only overlapping ones come out.
    """
    p = places.select("chunk_id", "file", "start_line", "end_line")
    h = hunks.select("file", "commit_hash", (F.col("start_line") + shift).alias("a"), (F.col("end_line") + shift).alias("b"))
    met = p.join(h, "file").where((F.col("a") <= F.col("end_line")) & (F.col("b") >= F.col("start_line"))).select("chunk_id", "file", "commit_hash").distinct()
    bare = commits.select("file", "commit_hash").join(h.select("file", "commit_hash").distinct(), ["file", "commit_hash"], "left_anti")
    every = p.join(bare, "file").select("chunk_id", "file", "commit_hash")
    return met.unionByName(every).distinct().join(commits, ["file", "commit_hash"]).select("chunk_id", "commit_hash", "committed_at", "author_email", "subject")


def top_commits(chunk_commits: DataFrame, n: int = 10, by_instant: bool = False) -> DataFrame:
    """The n latest commits of each chunk by the text of their dates, or by_instant, with their rank."""
    when = F.to_timestamp("committed_at") if by_instant else F.col("committed_at")
    order = Window.partitionBy("chunk_id").orderBy(when.desc(), "commit_hash")
    return chunk_commits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def chunk_tickets(chunk_commits: DataFrame) -> DataFrame:
    """Distinct tickets in the subjects of a chunk's commits: chunk_id, ticket_key, source."""
    found = chunk_commits.select("chunk_id", F.explode(T.tickets(F.col("subject"))).alias("t"))
    return found.groupBy("chunk_id", F.col("t.key").alias("ticket_key")).agg(F.max("t.source").alias("source"))


def changed_since(chunk_commits: DataFrame, since: str) -> DataFrame:
    """Chunks whose latest commit is at or after an instant; without commits they aren't."""
    last = chunk_commits.groupBy("chunk_id").agg(F.max(F.to_timestamp("committed_at")).alias("at"))
    return last.where(F.col("at") >= F.to_timestamp(F.lit(since))).select("chunk_id")


def timeline(chunk_commits: DataFrame, limit: int | None = None) -> DataFrame:
    """Commits once each, with their day (as written), chunks and tickets, the latest first."""
    rows = chunk_commits.groupBy("commit_hash").agg(F.max("committed_at").alias("committed_at"), F.max("subject").alias("subject"), F.countDistinct("chunk_id").alias("chunks"))
    keys = F.array_join(F.array_sort(F.transform(T.tickets(F.col("subject")), lambda t: t["key"])), " ")
    rows = rows.select("commit_hash", "committed_at", F.substring_index("committed_at", "T", 1).alias("day"), "chunks", keys.alias("tickets"))
    return rows if limit is None else rows.orderBy(F.col("committed_at").desc(), "commit_hash").limit(limit)


def captures_in_chunks(captures: DataFrame, places: DataFrame) -> DataFrame:
    """The chunks whose lines hold a capture (file, row, symbol)."""
    return captures.join(places.select("chunk_id", "file", "start_line", "end_line"), "file").where(F.col("row").between(F.col("start_line"), F.col("end_line"))).select("chunk_id", "symbol", "row")
