"""Files as a table: patterns, ignore rules, content."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.functions import text as T

_META = set(".^$+{}()|\\")


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over whole relative paths: ** spans folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in _META else c), i + 1
    return f"^{out}$"


def normalize_exclude(pattern: str) -> str:
    return pattern if "/" in pattern or "**" in pattern else f"**/{pattern}/**"


def excludes_for(languages: list[str]) -> list[str]:
    """Excluded patterns of these languages; an unknown one takes those of typescript."""
    every = [".git"]
    for g in languages:
        every += fixed.LANGUAGE_EXCLUDES.get(g, fixed.LANGUAGE_EXCLUDES["typescript"])
    return [normalize_exclude(p) for p in dict.fromkeys(every)]


def ignore_rules(text: str | None) -> list[tuple[bool, str]]:
    """Rules of an ignore file, in order: whether a path is ignored that meets a regular expression."""
    rules = []
    for line in (text or "").splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        body = line.lstrip("!") if not ignored else line
        folder, body = body.endswith("/"), body.rstrip("/")
        anchored, body = "/" in body, body.lstrip("/")
        start = "" if anchored else "(?:.*/)?"
        rules.append((ignored, "^" + start + glob_regex(body)[1:-1] + ("/.*$" if folder else "(?:/.*)?$")))
    return rules


def is_ignored(path, rules: list[tuple[bool, str]]):
    """Whether the last rule that a relative path meets ignores it."""
    out = F.lit(False)
    for ignored, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(ignored)).otherwise(out)
    return out


def any_of(path, patterns: list[str]):
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def select_files(files: DataFrame, include: list[str], exclude: list[str], ignore: str | None = None, path: str = "file") -> DataFrame:
    """Files that meet a pattern, no excluded one and no ignore rule, each once."""
    p = F.col(path)
    return files.where(any_of(p, include) & ~any_of(p, [normalize_exclude(e) for e in exclude]) & ~is_ignored(p, ignore_rules(ignore))).dropDuplicates([path])


def scan(spark: SparkSession, root: str, include: list[str], exclude: list[str] = (), ignore: str | None = None) -> DataFrame:
    """Files below a folder: file, content (null if not UTF-8), total_bytes, indexed_at. Files are read by the tasks."""
    base = "file:" + root.rstrip("/") if root.startswith("/") else root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    file = F.regexp_replace("path", "^" + re.escape(base) + "/*(//)?", "")
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    rows = rows.select(F.regexp_replace(file, r"^.*?" + re.escape(root.rstrip("/")) + "/", "").alias("file"), text.alias("content"), F.col("length").alias("total_bytes"), F.unix_millis("modificationTime").alias("indexed_at"))
    return select_files(rows, include, list(exclude), ignore)


def split_readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that can be indexed, and the others with why: binary, blank, or no source by their layout."""
    why = F.when(F.col("content").isNull() | ~T.readable(F.col("content")), "unreadable").otherwise(T.non_source_reason(F.col("content")))
    rows = files.withColumn("skip_reason", why)
    return rows.where("skip_reason = ''").drop("skip_reason"), rows.where("skip_reason <> ''")


def inside(root: str, path: str) -> str:
    """The normal form of a path below root; raises where it leaves it."""
    import os

    full = os.path.normpath(os.path.join(root, path))
    if "\x00" in path or os.path.commonpath([os.path.normpath(root), full]) != os.path.normpath(root):
        raise ValueError("the path leads out of the folder")
    return full
