"""Symbols that chunks define and use. Python is parsed; other languages are read by their look, without strings and comments, which is approximate."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import fixed
from strandline.operators import syntax

SYMBOLS = "chunk_id string, defines array<string>, uses array<string>, kind string"
_NAME = r"[A-Za-z_$][\w$]*"
_DEFINE = re.compile(rf"(?m)^(?:export\s+|default\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|pub\s+|async\s+|override\s+)*(function|class|interface|enum|struct|trait|type|const|let|var|def|fn|func|module)\s+(?:\([^)]*\)\s*)?(?:self\.)?({_NAME})")
_CALL = re.compile(rf"({_NAME})\s*\(")
_KIND = {"function": "function", "def": "function", "fn": "function", "func": "function", "class": "class", "struct": "class", "interface": "interface", "trait": "interface", "enum": "enum", "type": "type", "const": "variable", "let": "variable", "var": "variable", "module": "module"}
_BLOCK = re.compile(r'(?m)^\s*(resource|data|module|variable|output|provider)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{')
_REFERENCE = re.compile(r"\b(var|local|module|data)\.([A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)?)|\b([a-z][a-z0-9]*_[a-z0-9_]+\.[A-Za-z_][\w-]*)")


def _python(text: str) -> tuple[list[str], list[str], str | None] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    defines, kind = [], None
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            defines.append(node.name)
            kind = kind or ("class" if isinstance(node, ast.ClassDef) else "function")
        elif isinstance(node, ast.Assign):
            defines += [t.id for t in node.targets if isinstance(t, ast.Name)]
            kind = kind or "variable"
    uses = [f.id if isinstance(f, ast.Name) else f.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(f := n.func, (ast.Name, ast.Attribute))]
    return defines, uses, kind


def _terraform(text: str) -> tuple[list[str], list[str], str | None]:
    defines = []
    for kind, a, b in _BLOCK.findall(text):
        before = {"variable": "var.", "module": "module.", "output": "output.", "provider": "provider."}.get(kind, "")
        defines.append(before + a if before else f"{a}.{b}")
    uses = [f"{p}.{n}" if p in ("var", "module", "local") else n or whole for p, n, whole in _REFERENCE.findall(text)]
    return defines, uses, "resource" if defines else None


def symbols_of(text: str | None, language: str | None) -> tuple[list[str], list[str], str | None]:
    """Symbols that a chunk defines and that it uses besides, without noise, and the kind of the first definition."""
    text, language = text or "", (language or "").lower()
    found = _python(text) if language == "python" else _terraform(text) if language == "terraform" else None
    if found is None:
        if language in syntax.LANGUAGES and language != "python":
            try:
                text = "\n".join(syntax.stripped(text.split("\n"), language)[0])
            except syntax.Unparsed:  # a piece of a file may begin or end within a string
                pass
        pairs = _DEFINE.findall(text)
        found = [n for _, n in pairs], _CALL.findall(text), _KIND[pairs[0][0]] if pairs else None
    keep = lambda names: list(dict.fromkeys(n for n in names if len(n) > 1 and n not in _NOISE))
    defines = keep(found[0])
    return defines, [u for u in keep(found[1]) if u not in defines], found[2]


_NOISE = frozenset(fixed.NOISE_SYMBOLS)


def chunk_symbols(chunks: DataFrame) -> DataFrame:
    """Symbols of every chunk (chunk_id, language, content); see SYMBOLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [symbols_of(t, g) for g, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], lists), pa.array([f[1] for f in found], lists), pa.array([f[2] for f in found], pa.string())], ["chunk_id", "defines", "uses", "kind"])

    return chunks.select("chunk_id", "language", "content").mapInArrow(run, SYMBOLS)


def uses_and_defs(symbols: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables that graph.symbol_edges takes, from symbols and places (chunk_id, project, file)."""
    rows = symbols.join(places.select("chunk_id", "project", "file").distinct(), "chunk_id")
    one = lambda c: rows.select("project", F.explode(c).alias("symbol"), "chunk_id", "file")
    return one("uses"), one("defines")
