"""Text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import fixed

_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def mapping(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def trimmed(c) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def words(c) -> Column:
    """The parts of a trimmed text between white space."""
    return F.split(trimmed(c), rf"{_SPACE}+")


def normalize_query(c) -> Column:
    return trimmed(F.lower(c))


def hash_query(c) -> Column:
    """sha1 of the normalised query, in hex."""
    return F.sha1(normalize_query(c))


def tokenize_query(c) -> Column:
    """Sorted distinct words of two or more characters that are no stop words."""
    clean = F.regexp_replace(F.regexp_replace(normalize_query(c), r"[\x00-\x1f\x7f]", " "), r"[^\p{L}\p{N}_]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(clean, " "), lambda w: (F.length(w) >= 2) & ~w.isin(fixed.QUERY_STOP_WORDS))))


def terms(c) -> Column:
    """Full-text terms in order, repeated ones kept."""
    return F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda t: (F.length(t) > 1) & ~t.isin(fixed.TERM_STOP_WORDS))


def term_index(c) -> Column:
    """A term's number in a sparse vector: its 32-bit FNV-1a hash without the top bit."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    mixed = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295)))
    return mixed.bitwiseAND(F.lit(2147483647))


def estimate_tokens(c) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def _variant(c, changed) -> Column:
    return F.when(F.concat_ws(" ", changed) != F.concat_ws(" ", c), F.concat_ws(" ", changed))


def abbreviation_variant(query) -> Column:
    """Known abbreviations written out and known words abbreviated; null if there are none."""
    both = mapping(fixed.CONTRACTIONS | fixed.ABBREVIATIONS)
    parts = words(query)
    found = F.exists(parts, lambda w: both[F.lower(w)].isNotNull())
    return F.when(found, F.concat_ws(" ", F.transform(parts, lambda w: F.coalesce(both[F.lower(w)], w))))


def keyword_variant(query) -> Column:
    """Without filler words, if that takes something and leaves two words or more."""
    kept = F.filter(words(query), lambda w: ~F.lower(w).isin(fixed.FILLER_WORDS))
    return F.when((F.size(kept) < F.size(words(query))) & (F.size(kept) >= 2), F.concat_ws(" ", kept))


def case_variant(query) -> Column:
    """Words as one camel-case word, or a camel-case word as words."""
    q, parts = trimmed(query), words(query)
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    camel = F.concat(F.lower(parts[0]), F.concat_ws("", F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), capital)))
    spaced = F.regexp_replace(F.regexp_replace(q, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.when((F.size(parts) >= 2) & F.forall(parts, lambda w: w.rlike("^[a-zA-Z]+$")), camel).when(
        (F.size(parts) == 1) & q.rlike("^[a-zA-Z][a-zA-Z0-9]*$") & (F.instr(spaced, " ") > 0), F.lower(spaced)
    )


def singular(w) -> Column:
    low = F.lower(w)
    y = F.when(F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)), "Y").otherwise("y")
    less = lambda n: F.left(w, F.length(w) - n)
    return (
        F.when(F.length(w) <= 3, w)
        .when(low.endswith("ies") & (F.length(w) > 4), F.concat(less(3), y))
        .when(low.rlike("[sxz]es$"), less(2))
        .when(low.endswith("s") & ~low.rlike("(ss|us)$"), less(1))
        .otherwise(w)
    )


def plural_variant(query) -> Column:
    return _variant(words(query), F.transform(words(query), singular))


def expand_query(query) -> Column:
    """The query and up to two variants: abbreviations, keywords, case, singular, in this order."""
    q = trimmed(query)
    variants = F.array(q, abbreviation_variant(query), keyword_variant(query), case_variant(query), plural_variant(query))
    return F.when(q == "", F.array(query)).otherwise(F.slice(F.array_distinct(F.array_compact(variants)), 1, 3))


def expand_with_glossary(query, matches, most: int = 2) -> Column:
    """expand_query and a variant for each of the first matches (array of struct term, definition, aliases)."""
    extra = lambda m: F.trim(F.concat_ws(" ", F.filter(F.concat(F.array(m["definition"]), F.coalesce(m["aliases"], F.array().cast("array<string>"))), lambda s: s.isNotNull() & (s != ""))))
    texts = F.filter(F.transform(F.slice(F.coalesce(matches, F.array().cast("array<struct<term:string,definition:string,aliases:array<string>>>")), 1, most), extra), lambda s: s != "")
    return F.array_distinct(F.concat(expand_query(query), F.transform(texts, lambda s: F.concat(trimmed(query), F.lit(" "), s))))


def non_source_reason(c) -> Column:
    """Why a text is no source by its layout ('' if it is): the longest line, density, or the average line."""
    n = fixed.NON_SOURCE
    size = F.length(c)
    longest = F.array_max(F.transform(F.split(c, "\n"), lambda x: F.length(x)))
    count = lambda p: F.regexp_count(c, F.lit(p))
    white, base = count(_SPACE) / size, count(r"[A-Za-z0-9+/=_-]") / size
    average = size / F.size(F.split(c, "\n"))
    return (
        F.when(size < n["least"], "")
        .when(longest > n["line"], F.concat(F.lit("line of "), longest, F.lit(" chars (minified/blob)")))
        .when((white < n["white_space"]) & (base > n["base64"]), "dense base64 blob")
        .when(average > n["average_line"], F.concat(F.lit("avg line "), F.round(average).cast("long"), F.lit(" chars (no structure)")))
        .otherwise("")
    )


def readable(c) -> Column:
    """Neither binary (a NUL), nor badly decoded (U+FFFD), nor blank."""
    return c.isNotNull() & (F.instr(c, "\x00") == 0) & (F.instr(c, "\ufffd") == 0) & (trimmed(c) != "")


def language_of(path, content=None) -> Column:
    """The language by suffix, else by the first line's shebang, else null."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    found = mapping(fixed.LANGUAGE_OF_SUFFIX)[suffix]
    if content is None:
        return found
    line = F.when(F.instr(content, "\n") > 0, F.substring_index(content, "\n", 1)).otherwise(F.left(content, F.lit(200)))
    shebang = reduce(lambda w, x: w.when(line.rlike(x[1]), x[0]), fixed.LANGUAGE_OF_SHEBANG, F.when(F.lit(False), F.lit(None).cast("string")))
    return F.coalesce(found, shebang)


def auto_tag(path) -> Column:
    """The first folder of a path that is no root folder, null if there is none."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.get(F.filter(folders, lambda p: ~p.isin(fixed.ROOT_FOLDERS)), 0)


def resolve_tags(path, tags=(), folder_tags: dict[str, list[str]] | None = None) -> Column:
    """Given tags, those of the folders a path lies in, and its auto_tag."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    none = F.array().cast("array<string>")
    found = [_strings(tags) if tags else none]
    for folder, more in (folder_tags or {}).items():
        folder = folder.replace("\\", "/").removesuffix("/")
        found.append(F.when(slashed.startswith(folder + "/") | (slashed == folder), _strings(more)).otherwise(none))
    tag = auto_tag(path)
    return F.array_distinct(F.concat(*found, F.when(tag.isNotNull(), F.array(tag)).otherwise(none)))


def is_markdown(c) -> Column:
    strong = reduce(lambda a, p: a | c.rlike(p), fixed.MARKDOWN_STRONG, F.lit(False))
    weak = reduce(lambda a, p: a + c.rlike(p).cast("int"), fixed.MARKDOWN_WEAK, F.lit(0))
    return F.coalesce((c != "") & (F.instr(c, "\x00") == 0) & (strong | (weak >= 2)), F.lit(False))


def query_type(query) -> Column:
    """code2code, techqa or nl2code."""
    q = trimmed(query)
    code = reduce(lambda a, p: a | q.rlike(p), fixed.CODE_SIGNS, F.lit(False))
    question = reduce(lambda a, p: a | q.rlike(p), fixed.QUESTION_SIGNS, F.lit(False))
    return F.when(code, "code2code").when(question, "techqa").otherwise("nl2code")


def model_family(model: str) -> str:
    return next((f for f in ("bge-code", "qwen") if f in model.lower()), "none")


def prefix_query(query, family: str = "none") -> Column:
    """The query in its model family's instruction."""
    if family == "none":
        return F.col(query) if isinstance(query, str) else query
    before, after = fixed.TASK_FORMATS[family].format(task="\x00", query="\x01").split("\x00")
    return F.concat(F.lit(before), mapping(fixed.TASKS[family])[query_type(query)], F.lit(after.removesuffix("\x01")), query)


def tickets(message, custom: dict[str, str] | None = None) -> Column:
    """Distinct tickets of a message as array of struct key, source; the first source of a key counts. custom: pattern -> source, of group 1 if there is one."""
    def from_pattern(pattern: str, group: int, source: str, before: str = "") -> Column:
        return F.transform(F.regexp_extract_all(message, F.lit(pattern), F.lit(group)), lambda k: F.struct(F.concat(F.lit(before), k).alias("key"), F.lit(source).alias("source")))

    found = [from_pattern(p, 1, s, b) for s, p, b in fixed.TICKETS]
    found += [from_pattern(p, min(1, re.compile(p).groups), s) for p, s in (custom or {}).items()]
    every = F.concat(*found)
    return F.filter(every, lambda t, i: F.array_position(F.transform(every, lambda u: u["key"]), t["key"]) == i + 1)


def content_hash(c, size: int = 16) -> Column:
    return F.left(F.sha2(c, 256), F.lit(size))


def chunk_id(grp, project, file, start, end, digest) -> Column:
    return F.concat_ws("//", grp, project, file, F.concat_ws("-", start, end), digest)


def parse_chunk_id(c) -> Column:
    """A struct of the parts of a chunk_id, null if it is malformed."""
    parts = F.split(c, "//")
    lines = F.regexp_extract(parts[3], r"^(\d+)-(\d+)$", 0)
    good = (F.size(parts) == 5) & (lines != "")
    part = lambda i: F.get(parts, F.lit(i))
    line = lambda i: F.regexp_extract(part(3), r"^(\d+)-(\d+)$", i).try_cast("int")
    return F.when(good, F.struct(part(0).alias("grp"), part(1).alias("project"), part(2).alias("file"), line(1).alias("startLine"), line(2).alias("endLine"), part(4).alias("hash")))


def breadcrumb(title, path) -> Column:
    return F.concat_ws(" > ", F.filter(F.concat(F.array(title), path), lambda p: p.isNotNull() & (p != "")))


def strip_breadcrumb(c) -> Column:
    """Without the line before the first blank line, if that is a breadcrumb."""
    at = F.instr(c, "\n\n")
    head = F.left(c, at - 1)
    return F.when((at > 0) & (F.instr(head, " > ") > 0) & (F.instr(head, "\n") == 0), F.substr(c, at + 2)).otherwise(c)


def sanitize(c) -> Column:
    """Without control, zero-width and direction characters."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b-\u200f\u202a-\u202e\u2060\u2066-\u2069\ufeff]", "")


def inline(c, most: int = 200) -> Column:
    """On one line and of no more than most characters, with an ellipsis where cut."""
    one = trimmed(F.regexp_replace(sanitize(c), rf"{_SPACE}+", " "))
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit("\u2026"))).otherwise(one)


def age(ms) -> Column:
    """An age in milliseconds in words, as coarse as its unit; 'updated ?' for null."""
    minutes = F.floor(ms / 60_000).cast("long")
    steps = ((1, 60, "m"), (60, 24, "h"), (24 * 60, 30, "d"), (30 * 24 * 60, 12, "mo"))
    out = F.when(ms.isNull(), "updated ?").when(minutes < 1, "updated just now")
    for unit, most, sign in steps:
        n = F.floor(minutes / unit).cast("long")
        out = out.when(n < most, F.concat(F.lit("updated "), n.cast("string"), F.lit(f"{sign} ago")))
    return out.otherwise(F.concat(F.lit("updated "), F.floor(minutes / (12 * 30 * 24 * 60)).cast("string"), F.lit("y ago")))


def is_stale(ms, days: int = 90) -> Column:
    return F.coalesce(ms > days * 86_400_000, F.lit(False))


def confidence(score) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.4, "partial").otherwise("low")


def exclude_pattern(c) -> Column:
    """A bare name as a pattern for all that lies below it."""
    return F.when(F.contains(c, F.lit("/")), c).otherwise(F.when(F.contains(c, F.lit("**")), c).otherwise(F.concat(F.lit("**/"), c, F.lit("/**"))))
