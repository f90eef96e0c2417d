"""Chunks along syntax, with what could not be parsed as rows.

Python is parsed by its own parser. Languages of braces, and of keywords and `end`, are read by one scanner that knows
strings and comments; it tells the statements that stand beside one another, and those inside each. Statements are
grouped up to the size and cut where they exceed three times it, down to DEPTH levels; nothing between them is lost.
A file that can't be parsed is chunked by the rules for lines instead, and an error row says so.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.operators import chunkers as C

DEPTH = 3
RESULT = C.CHUNKS + ", parser string, error_class string, message string"
HASH_COMMENTS = ("ruby", "terraform")
LANGUAGES = (*C.BRACE_LANGUAGES, *HASH_COMMENTS, "python")
_OPEN, _CLOSE = "([{", ")]}"
_RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo(?:\s*\|[^|]*\|)?\s*$")
_RUBY_CLOSE = re.compile(r"^\s*end\b")
_HERE = re.compile(r"<<[-~]?[\"']?([A-Z_]\w*)")


@dataclass
class Node:
    """Lines first to last (exclusive) of a statement, whether it is a comment, and the statements in it."""

    first: int
    end: int
    comment: bool = False
    inner: list[Node] = field(default_factory=list)


class Unparsed(ValueError):
    """The text isn't well-formed in its language."""


def stripped(lines: list[str], language: str) -> tuple[list[str], list[bool]]:
    """The lines without comments and what stands in strings, and which of them hold nothing but comments."""
    hashes = language in HASH_COMMENTS
    quotes = "\"'`" if language in ("typescript", "javascript", "tsx") else "\"`" if language == "go" else '"' if language in ("rust", "terraform") else "\"'"
    out, only = [], []
    quote, block, here = "", False, ""
    for line in lines:
        kept, i, had = [], 0, block
        if here:
            here = "" if line.strip() == here else here
            out.append("")
            only.append(False)
            continue
        while i < len(line):
            c, two = line[i], line[i : i + 2]
            if block:
                block = two != "*/"
                i += 1 if block else 2
            elif quote:
                if c == "\\" and quote != "`" or c == "\\" and language != "go":
                    i += 2
                    continue
                quote = "" if c == quote else quote
                i += 1
            elif c == "#" and hashes or two == "//" and language != "ruby":
                had = True
                break
            elif two == "/*" and language != "ruby":
                block = had = True
                i += 2
            elif c in quotes:
                quote = c
                kept.append('"')
                i += 1
            elif language == "rust" and c == "'" and (m := re.match(r"'(?:\\.[^']*|[^\\'])'", line[i:])):
                i += m.end()
            else:
                kept.append(c)
                i += 1
        if quote and quote != "`" and not line.endswith("\\"):
            quote = ""  # these strings end with their line
        text = "".join(kept)
        if hashes and (m := _HERE.search(text.replace('"', ""))):
            here = m.group(1)
        out.append(text)
        only.append(had and not text.strip())
    if quote or block or here:
        raise Unparsed("a string, comment or document without end")
    return out, only


def _levels(code: list[str], language: str) -> list[tuple[int, int]]:
    """How many brackets and blocks are open before and after each line, and never less than none."""
    found, depth = [], 0
    for line in code:
        before = depth
        for c in line:
            depth += (c in _OPEN) - (c in _CLOSE)
        if language == "ruby":
            depth += bool(_RUBY_OPEN.search(line)) - bool(_RUBY_CLOSE.search(line))
        if depth < 0:
            raise Unparsed("a bracket without beginning")
        found.append((before, depth))
    if depth:
        raise Unparsed("a bracket without end")
    return found


def _nodes(first: int, end: int, level: int, levels: list[tuple[int, int]], lines: list[str], only: list[bool], down: int = 0) -> list[Node]:
    """Statements at a level: each begins with a line that isn't blank and ends when the level is met again."""
    nodes, at = [], first
    while at < end:
        if not lines[at].strip():
            at += 1
            continue
        stop = at
        while stop < end - 1 and levels[stop][1] > level:
            stop += 1
        inner = _nodes(at + 1, stop, levels[at][1], levels, lines, only, down + 1) if stop > at + 1 and down < DEPTH and levels[at][1] > level else []
        nodes.append(Node(at, stop + 1, only[at], inner))
        at = stop + 1
    return nodes


def _python(body: list[ast.stmt], down: int = 0) -> list[Node]:
    nodes = []
    for s in body:
        first = min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", ()))])
        nodes.append(Node(first - 1, s.end_lineno, False, _python(getattr(s, "body", ()) if down < DEPTH and isinstance(getattr(s, "body", ()), list) else (), down + 1)))
    return nodes


def parse(text: str, language: str) -> list[Node]:
    """The statements of a file beside one another; Unparsed if it isn't well-formed."""
    lines = text.split("\n")
    if language == "python":
        try:
            return _python(ast.parse(text.replace("\r", " ").lstrip("﻿")).body)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            raise Unparsed(type(e).__name__) from e
    code, only = stripped(lines, language)
    return _nodes(0, len(lines), 0, _levels(code, language), lines, only)


def _weigh(lines: list[str], first: int, end: int) -> int:
    return sum(map(len, lines[first:end])) + max(0, end - first - 1)


def _by_lines(lines: list[str], first: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    at, weight = first, 0
    for i in range(first, end):
        if weight + len(lines[i]) + 1 > most and i > at:
            yield at, i
            at, weight = i, 0
        weight += len(lines[i]) + 1
    if at < end:
        yield at, end


def _parts(lines: list[str], node: Node, most: int, depth: int = 0) -> Iterator[tuple[int, int]]:
    """A statement whole if it fits, else by those in it, and by lines where there are none."""
    if _weigh(lines, node.first, node.end) <= most:
        yield node.first, node.end
    elif depth >= DEPTH or not node.inner:
        yield from _by_lines(lines, node.first, node.end, most)
    else:
        at = node.first
        for inner in node.inner:
            if inner.first > at:
                yield from _by_lines(lines, at, inner.first, most)
            yield from _parts(lines, inner, most, depth + 1)
            at = max(at, inner.end)
        if at < node.end:
            yield from _by_lines(lines, at, node.end, most)


def spans(lines: list[str], nodes: list[Node], size: int) -> Iterator[tuple[int, int]]:
    """First and last line (exclusive) of the chunks. Comments stay with what stands before them in a chunk that has room."""
    most, start, end = 3 * size, 0, 0
    for n in nodes:
        reach = _weigh(lines, min(end, n.first), n.end)
        if reach > most and not n.comment:
            if max(end, n.first) > start:
                yield start, max(end, n.first)
            yield from _parts(lines, n, most)
            start = end = n.end
            continue
        if end > start and not n.comment and _weigh(lines, start, end) + reach > size:
            yield start, end
            start = end
        end = max(end, n.end)
    if start < len(lines):
        yield start, len(lines)


def chunk_syntax(text: str, language: str, size: int = fixed.CHUNK_SIZE) -> list[C.Piece]:
    """Chunks of a file: content, first and last line from 0. One that lies within another is left out."""
    lines = text.split("\n")
    found = [(a, b) for a, b in dict.fromkeys(spans(lines, parse(text, language), size)) if any(x.strip() for x in lines[a:b])]
    kept, reach = [], -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if b > reach:
            kept.append(("\n".join(lines[a:b]), a, b - 1))
            reach = b
    return kept


def chunk_or_fall_back(text: str | None, language: str | None, size: int = fixed.CHUNK_SIZE) -> tuple[list[C.Piece], str, str | None, str | None]:
    """Chunks, the parser (syntax or lines), and the class and message of an error if the syntax failed."""
    text, language = text or "", (language or "").lower()
    if not text.strip() or language not in LANGUAGES:
        return C.chunk_code(text, language, size), "lines", None, None
    try:
        found = chunk_syntax(text, language, size)
    except Unparsed as e:
        return C.chunk_code(text, language, size), "lines", "ast_parse_failed", str(e)
    except RecursionError as e:
        return C.chunk_code(text, language, size), "lines", "regex_fallback", str(e)
    return (found, "syntax", None, None) if found else (C.chunk_code(text, language, size), "lines", "ast_chunk_zero", None)


def _run(size: int):
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for key, language, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    found, parser, error, message = chunk_or_fall_back(text, language, size)
                    if error:
                        rows.append((key, language, None, None, None, None, None, parser, error, message))
                    rows += [(key, language, i, c, a, b, C._digest(c), parser, None, None) for i, (c, a, b) in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def syntax_chunks(files: DataFrame, key: str, size: int = fixed.CHUNK_SIZE) -> tuple[DataFrame, DataFrame]:
    """Chunks of all files (key, language, content) along their syntax (see CHUNKS, and parser), and the errors: key, language, error_class, message.

    Null and blank contents have neither; a language without a parser is chunked by lines and is no error. Repeated rows
    are chunked each. One pass gives both; a caller that wants both writes them once.
    """
    rows = files.select(F.col(key).cast("string").alias("key"), F.lower("language").alias("language"), "content").mapInArrow(_run(size), RESULT)
    return rows.where("error_class IS NULL").drop("error_class", "message"), rows.where("error_class IS NOT NULL").select("key", "language", "error_class", "message")


def soundness(chunks: DataFrame, files: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """One row for each file with chunks: key, chunks, lines (those with an ASCII letter or digit that a chunk covers), n_wrong, n_over.

    n_wrong: chunks whose content isn't the file's lines or part of a single one, whose hash isn't the content's or whose
    lines are out of order; n_over: chunks of more than `most` characters. key has to be unique in files.
    """
    texts = files.select(F.col(key).cast("string").alias("key"), F.split("content", "\n", -1).alias("lines"))
    held = chunks.join(texts, "key").withColumn("own", F.array_join(F.slice("lines", F.col("start_line") + 1, F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n"))
    same = (F.col("own") == F.col("content")) | ((F.col("start_line") == F.col("end_line")) & F.contains("own", F.col("content")))
    good = same & (F.left(F.sha2("content", 256), F.lit(16)) == F.col("hash")) & (F.col("start_line") <= F.col("end_line"))
    over = F.length("content") > most if most else F.lit(False)
    counts = held.groupBy("key").agg(F.count("*").alias("chunks"), F.sum((~good).cast("int")).alias("n_wrong"), F.sum(over.cast("int")).alias("n_over"))
    covered = held.select("key", F.explode(F.sequence("start_line", "end_line")).alias("n")).distinct()
    named = texts.select("key", F.posexplode("lines").alias("n", "line")).where(F.col("line").rlike("[A-Za-z0-9]"))
    return counts.join(covered.join(named, ["key", "n"], "left_semi").groupBy("key").agg(F.count("*").alias("lines")), "key", "left").select("key", "chunks", F.coalesce("lines", F.lit(0)).alias("lines"), "n_wrong", "n_over")
