"""Files that nobody wrote by hand: generated, minified, copied from a third party, data kept as code.

Each file is lexed and re-emitted in a canonical layout, one statement a line. How the original departs
from that tells its kind: a file that expands extremely was minified, one whose lines are all made by the
same few templates was generated, one that is nearly all literals is data. A copy is known by its canonical
statements: runs of RUN of them, thinned by winnowing, that also stand in another project's files. Layout, names
of files and comments don't enter there, and a local change alters only the runs across it.

What a tool or a third party says of a file, in a comment line anywhere in it or by the folder it lies in, counts
besides; it is all there is to tell of generated files of varied code and of copies met only once. Only comments
count, so code that writes or mentions such a notice doesn't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import fresh_dir

#: Canonical lines for each original line, and characters of an original line, from which a file is minified.
EXPANSION, LONG = 8.0, 250.0
#: Share of lines made by a template used REPEATS times or more, from which a file is generated.
UNIFORM, REPEATS = 0.6, 4
#: Share of literals in the code, from which a file is data.
LITERAL = 0.65
#: Little code tells little: so many characters and lines of ordinary code are reckoned in with every file's.
PRIOR, PRIOR_LINES = 40, 4
#: Statements of a run; of WINDOW runs on end the least is kept, so RUN + WINDOW - 1 shared statements are always met.
RUN, WINDOW = 8, 4
#: Share of a file's runs met in other projects, from which it is a copy.
COPIED = 0.5

GENERATED = re.compile(
    r"(?i)^(?!note\b)(?:.*\bauto-?generated\b|.*@generated\b|(?:the |this )?(?:code|file|source)s?(?: was| is)? generated\b|generated (?:by|from|with|using)\b|machine[- ]generated\b"
    r"|.*\b(?:automatically|mechanically) (?:produced|generated|created|written)\b|.*\b(?:produit|généré|créé|écrit)e?s? automatiquement\b|.*\bdo not (?:edit|modify|change) (?:by hand|manually)\b|.*\bdo not edit\b.*\b(?:generated|regenerate)|.*\bgenerated\b.*\bdo not edit\b"
    r"|.*\bautomatisch (?:erzeugt|generiert|erstellt)\b|.*\b(?:generado|creado) automáticamente\b)"
)
THIRD_PARTY = re.compile(
    r"(?i)^(?!note\b)(?:.*\b(?:re)?distributed under\b|.*\blicen[cs]ed under\b|upstream\s*:|.*\bupstream licen[cs]e\b|.*\bspdx-license-identifier\b|copyright .*\bcontributors\b|permission is hereby granted\b|\S+ v?\d+(?:\.\d+)+ \| .*\| *https?://)"
)
THIRD_PARTY_FOLDERS = re.compile(r"(?:^|/)(?:vendor|vendored|node_modules|bower_components|third_party|thirdparty|site-packages)/")
HASH_COMMENTS = ("python", "ruby", "terraform", "shell", "bash", "yaml", "perl", "r")
HASH_SUFFIXES = ("py", "rb", "tf", "sh", "bash", "yml", "yaml", "pl", "r")

_STRING = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_LEXERS = {
    # a string that stands by itself at the start of a line is a docstring, that is, a comment
    True: re.compile(r'(?P<c>#[^\n]*|(?m:^)[ \t]*(?:"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'))|"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|' + _STRING),
    False: re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|" + _STRING),
}
_NUMBER = re.compile(r"(?<![\w$])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\w*")
_BREAK = re.compile(r"[;{}\n]")
_DIGITS = re.compile(r"\d+")
_HERE = re.compile(r"<<[-~]?[ \t]*['\"]?([A-Z_]\w*)")
_LINE = re.compile(r"\r\n|\r|\n")
_BARE = re.compile(r"^[/#*\-\s!<;]+|[\s*/>]+$")
VERDICTS = (
    "file_id long, group_name string, project_name string, file string, layout string, notice string, expansion double, uniformity double, literal_share double, code_key long, owner long, runs array<long>"
)


def lex(text: str, hashes: bool) -> tuple[list[str], str, int]:
    """The comments, the code with strings emptied, and the characters taken out of strings. hashes: whether # begins a comment."""
    comments: list[str] = []
    literal = 0  # beyond the two quotes that stay

    def one(m: re.Match) -> str:
        nonlocal literal
        if m.lastgroup == "c":
            comments.append(m.group())
            return " "
        literal += m.end() - m.start() - 2
        return '""'

    return comments, _LEXERS[hashes].sub(one, text), literal


def canonical(code: str) -> list[str]:
    """The code re-emitted: a statement or brace a line, single spaces, no indentation."""
    return [line for part in _BREAK.split(code) if (line := " ".join(part.split()))]


def comment_lines(text: str, hashes: bool) -> list[str]:
    """The comment lines of the whole file, without their marks. Lines within strings and here-documents are none."""
    text = _LEXERS[hashes].sub(lambda m: m.group() if "\n" not in m.group() or m.group().startswith("/*") else '""', text)
    lines = [line.strip() for line in _LINE.split(text)]
    last = {s: i for i, s in enumerate(lines)} if hashes and "<<" in text else {}
    found, inside, tag = [], False, None
    for i, s in enumerate(lines):
        if tag is not None:  # in a here-document
            tag = None if s == tag else tag
            continue
        if inside or s.startswith(("/*", "//", "<!--")) or hashes and s.startswith("#"):
            found.append(_BARE.sub("", s))
        elif last and (m := _HERE.search(s)) and last.get(m.group(1), -1) > i:
            tag = m.group(1)
        if not hashes:
            inside = (inside or s.startswith("/*")) and "*/" not in s
    return found


def runs_of(statements: list[str]) -> list[int]:
    """Hashes of the winnowed runs of RUN canonical statements; of fewer statements the one run they make."""
    one = [xxhash.xxh3_64_intdigest(s.encode()) for s in statements]
    every = [xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little") for h in one[i : i + RUN])) >> 1 for i in range(max(1, len(one) - RUN + 1))] if one else []
    return sorted({min(every[i : i + WINDOW]) for i in range(max(1, len(every) - WINDOW + 1))} if every else ())


def judge(text: str | None, file: str | None, language: str | None) -> tuple[str | None, str | None, float, float, float, list[str]]:
    """What the layout of a file tells (None: source), what it says of itself, its expansion, uniformity and share of literals, and its canonical statements.

    Layout: minified, data or generated; of itself: third_party or generated.
    """
    text = (text or "").lstrip("\ufeff")
    file = file or ""
    hashes = file.rpartition(".")[2].lower() in HASH_SUFFIXES or (language or "").lower() in HASH_COMMENTS
    _, code, strings = lex(text, hashes)
    originals = [s for line in _LINE.split(text) if (s := line.strip())]
    statements = canonical(code)
    numbers = sum(len(n) for n in _NUMBER.findall(code))
    quoted = strings + 2 * code.count('""')
    literal = (quoted + numbers) / (len(re.sub(r"\s+", "", code)) + strings + PRIOR)
    expansion = len(statements) / max(1, len(originals))
    templates = [_DIGITS.sub("0", s) for s in originals if len(s) >= 12]
    counts = Counter(templates)
    uniformity = sum(n for n in counts.values() if n >= REPEATS) / (len(templates) + PRIOR_LINES)
    layout = None
    if expansion >= EXPANSION and len(text) / max(1, len(originals)) >= LONG:
        layout = "minified"
    elif literal >= LITERAL:
        layout = "data"
    elif uniformity >= UNIFORM:
        layout = "generated"
    notices = comment_lines(text, hashes)
    notice = None
    if THIRD_PARTY_FOLDERS.search(file) or any(THIRD_PARTY.search(c) for c in notices):
        notice = "third_party"
    elif any(GENERATED.search(c) for c in notices):
        notice = "generated"
    return layout, notice, expansion, uniformity, literal, statements


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in VERDICTS.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            group, project, file, language, text = (part.column(k).to_pylist() for k in range(1, 6))
            layout, notice, expansion, uniformity, literal, statements = zip(*map(judge, text, file, language))
            owners = [xxhash.xxh3_64_intdigest(repr(x).encode()) >> 1 for x in zip(group, project)]
            keys = [xxhash.xxh3_64_intdigest("\n".join(x).encode()) >> 1 for x in statements]
            columns = [pa.array(layout, pa.string()), pa.array(notice, pa.string()), pa.array(expansion), pa.array(uniformity), pa.array(literal), pa.array(keys), pa.array(owners), pa.array([runs_of(x) for x in statements], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names)


def non_source(files: DataFrame, notices: bool = True) -> DataFrame:
    """A verdict for every row: file_id, group_name, project_name, file, isNonSource, reason, expansion, uniformity, literal_share, copied_share.

    reason: minified, data, generated or third_party, by layout first, then by copies, then by what the file says of
    itself (left out without notices). Null and empty contents are source, for there is nothing to tell. Null paths
    and languages count as unknown, null projects as one project. Repeated rows are judged alike. A file shared with
    another project by RUN + WINDOW - 1 statements and by COPIED of its runs is a copy in both. Other columns are ignored.
    """
    spark = files.sparkSession
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "group_name", "project_name", "file", "language", "content")
    path = fresh_dir(spark, "verdicts")
    rows.mapInArrow(_judge, VERDICTS).write.parquet(path)  # without contents: read for the runs and for the verdicts
    verdicts = spark.read.parquet(path)
    owned = verdicts.select("owner", F.explode("runs").alias("run")).groupBy("run").agg(F.min("owner").alias("a"), F.max("owner").alias("b"))
    shared = owned.where("a <> b").select("run")  # one row a run: a popular file's rows stream past it
    codes = verdicts.where(F.size("runs") > 0).groupBy("code_key").agg(F.first("runs").alias("runs"))
    met = codes.select("code_key", F.explode("runs").alias("run")).join(shared, "run").groupBy("code_key").agg(F.count("*").alias("met"))
    judged = verdicts.join(met, "code_key", "left").withColumn("copied_share", F.coalesce(F.col("met") / F.size("runs"), F.lit(0.0)))
    copy = F.when(F.col("copied_share") >= COPIED, F.lit("third_party"))
    reason = F.coalesce("layout", copy, "notice") if notices else F.coalesce("layout", copy)
    return judged.select("file_id", "group_name", "project_name", "file", reason.isNotNull().alias("isNonSource"), reason.alias("reason"), "expansion", "uniformity", "literal_share", "copied_share")
