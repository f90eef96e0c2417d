"""Cutting code and markdown into chunks.

A chunker is told by rules where a block begins and where it ends; one routine does the cutting. Text
runs through Python here because each rule is a state machine over lines; a file's chunks come from that
file alone, so any partitioning of files serves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import fixed

CHUNKS = "key string, language string, idx int, content string, start_line int, end_line int, hash string"
Piece = tuple[str, int, int]

# What begins and ends a block in a language.
BLOCK_SIGNS = {"ruby": (r"^\s*(def|class|module)\s", r"^\s*end\s*$"), "terraform": (r"^\s*(resource|data|module|variable|output|locals)\s", r"^\s*}\s*$")}
BRACE_SIGNS = (r"^\s*(export\s+)?(default\s+)?(async\s+)?(function|class|const|let|var|interface|type|enum)\s", r"=\s*(async\s*)?\(")
PYTHON_SIGN = r"^(def |class |async def )"
BRACE_LANGUAGES = ("typescript", "javascript", "tsx", "go", "rust", "java", "c", "cpp", "csharp")


class Keywords:
    """A keyword begins a block; an end word not deeper than it closes it."""

    def __init__(self, begin: str, end: str):
        self.begin, self.end, self.depth = re.compile(begin), re.compile(end), None

    @staticmethod
    def indent(line: str) -> int:
        return len(line) - len(line.lstrip()) if line.strip() else 0

    def begins(self, line: str) -> bool:
        if self.depth is None and self.begin.search(line):
            self.depth = self.indent(line)
            return True
        return False

    def ends(self, line: str) -> bool:
        if self.depth is not None and self.end.search(line) and self.indent(line) <= self.depth:
            self.depth = None
            return True
        return False

    def overflow(self) -> None:
        self.depth = None


class Braces:
    """A declaration outside of all braces begins a block; the brace that closes them all ends it."""

    begin = [re.compile(p) for p in BRACE_SIGNS]
    quiet = re.compile(r"/\*[\s\S]*?\*/|//.*$"), re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`")

    def __init__(self):
        self.depth, self.open = 0, False

    def begins(self, line: str) -> bool:
        if self.depth == 0 and any(p.search(line) for p in self.begin):
            self.open = True
            return True
        return False

    def ends(self, line: str) -> bool:
        for p in self.quiet:
            line = p.sub("", line)
        self.depth = max(0, self.depth + line.count("{") - line.count("}"))
        if self.open and self.depth == 0 and "}" in line:
            self.open = False
            return True
        return False

    def overflow(self) -> None:
        self.depth, self.open = 0, False


class Headings:
    """Each top-level definition begins a block, which ends with the next."""

    sign = re.compile(PYTHON_SIGN)

    def begins(self, line: str) -> bool:
        return bool(self.sign.search(line))

    def ends(self, line: str) -> bool:
        return False

    def overflow(self) -> None:
        pass


def spans(lines: list[str], rules, size: int) -> Iterator[tuple[int, int]]:
    """First and last line of each block; blank lines ahead of a block belong to none. A block of more than twice the size is cut there."""
    at, weight = 0, 0
    for i, line in enumerate(lines):
        if rules.begins(line):
            if any(x.strip() for x in lines[at:i]):
                yield at, i - 1
            at, weight = i, 0
        weight += len(line) + 1
        closed = rules.ends(line)
        if closed or weight > 2 * size:
            yield at, i
            at, weight = i + 1, 0
            if not closed:
                rules.overflow()
    if at < len(lines):
        yield at, len(lines) - 1


def fitted(lines: list[str], first: int, last: int, size: int) -> Iterator[Piece]:
    """A block whole, or while it exceeds three times the size its first half and then the rest; one long line by characters."""
    most = 3 * size
    while first <= last:
        text = "\n".join(lines[first : last + 1])
        if not text.strip():
            return
        if len(text) <= most:
            yield text, first, last
            return
        if first == last:
            yield from ((text[p : p + most], first, first) for p in range(0, len(text), most) if text[p : p + most].strip())
            return
        middle = first + (last - first + 1) // 2
        half = "\n".join(lines[first:middle])
        if half.strip():
            yield half, first, middle - 1
        first = middle


def fixed_size(lines: list[str], size: int, overlap: int) -> Iterator[Piece]:
    """Whole lines up to the size, each chunk going back by lines worth the overlap; the last lines come out ever shorter."""
    start = 0
    while start < len(lines):
        end, weight = start, 0
        while end < len(lines) and weight < size:
            weight += len(lines[end]) + 1
            end += 1
        text = "\n".join(lines[start:end])
        if text.strip():
            yield text, start, end - 1
        back, weight = end, 0
        while weight < overlap and back > start:
            back -= 1
            weight += len(lines[back]) + 1
        start = max(start + 1, back)


def chunk_code(text: str, language: str | None, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> list[Piece]:
    """Chunks of a file: content, first and last line from 0. A size or overlap of 0 stands for the usual one."""
    size, overlap, language = size or fixed.CHUNK_SIZE, overlap or fixed.CHUNK_OVERLAP, (language or "").lower()
    if not text.strip():
        return []
    lines = text.split("\n")
    rules = Keywords(*BLOCK_SIGNS[language]) if language in BLOCK_SIGNS else Braces() if language in BRACE_LANGUAGES else Headings() if language == "python" else None
    if rules is None:
        return list(fixed_size(lines, size, overlap))
    return [p for a, b in spans(lines, rules, size) for p in fitted(lines, a, b, size)]


_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")


def _blocks(text: str) -> Iterator[tuple[list[str], str, int, int, int]]:
    """Paragraphs and fenced code of a markdown text: heading path, text, first and last line, and the number of the section."""
    path: list[tuple[int, str]] = []
    held: list[str] = []
    first, section, fence = 0, 0, ""

    def close(last: int):
        whole = "\n".join(held).strip()
        held.clear()
        if whole:
            yield [t for _, t in path], whole, first, last, section

    n = -1
    for n, line in enumerate(text.split("\n")):
        mark = _FENCE.match(line)
        if mark:
            fence = mark[1][0] if not fence else "" if mark[1][0] == fence else fence
        head = None if fence or mark else _HEADING.match(line)
        if head:
            yield from close(n - 1)
            level = len(head[1])
            path = [p for p in path if p[0] < level] + [(level, head[2].strip())]
            section += 1
        elif not fence and not mark and not line.strip():
            yield from close(n - 1)
        else:
            if not held:
                first = n
            held.append(line)
    yield from close(n)


def chunk_markdown(text: str, title: str | None = None, target: int = 320, most: int | None = None) -> list[tuple[str, list[str], int, int]]:
    """Chunks of a markdown page: content under its breadcrumb, heading path, first and last line from 0.

    Blocks of a section are packed up to `target` tokens (a quarter of the characters); a block of more
    than `most` is cut by lines.
    """
    most = most or -(-target * 3 // 2)
    tokens = lambda s: -(-len(s) // 4)
    out, held, weight, where = [], [], 0, None

    def put(path, body, first, last):
        crumb = " > ".join(p for p in [title, *path] if p)
        out.append((f"{crumb}\n\n{body}" if crumb else body, path, first, last))

    def close():
        nonlocal weight
        if held:
            put(held[0][0], "\n\n".join(h[1] for h in held), held[0][2], held[-1][3])
        held.clear()
        weight = 0

    for path, body, first, last, section in _blocks(text):
        n = tokens(body)
        if section != where or n > most or weight + n > target:
            close()
        where = section
        if n <= most:
            held.append((path, body, first, last))
            weight += n
            continue
        lines, at = body.split("\n"), 0
        for i in range(len(lines)):
            if tokens("\n".join(lines[at : i + 1])) >= most or i == len(lines) - 1:
                if part := "\n".join(lines[at : i + 1]).strip():
                    put(path, part, first + at, first + i)
                at = i + 1
    close()
    return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _run(size: int, overlap: int):
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for key, language, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    rows += [(key, language, i, c, a, b, _digest(c)) for i, (c, a, b) in enumerate(chunk_code(text or "", language, size, overlap))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def code_chunks(files: DataFrame, key: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of all files (key, language, content); see CHUNKS. Null and blank contents have none."""
    return files.select(F.col(key).cast("string").alias("key"), F.lower("language").alias("language"), "content").mapInArrow(_run(size, overlap), CHUNKS)


def markdown_chunks(pages: DataFrame, key: str, target: int = 320) -> DataFrame:
    """Chunks of the pages (key, text, doc_title) that are markdown: key, idx, heading_path, content, start_line, end_line, hash."""
    from strandline.functions.text import is_markdown

    schema = "key string, idx int, heading_path array<string>, content string, start_line int, end_line int, hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for k, text, title in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    rows += [(k, i, p, c, a, b, _digest(c)) for i, (c, p, a, b) in enumerate(chunk_markdown(text, title, target))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

    return pages.where(is_markdown(F.col("text"))).select(F.col(key).cast("string").alias("key"), "text", "doc_title").mapInArrow(run, schema)
