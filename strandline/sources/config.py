"""Project settings: reading, defaults, checks. Settings are small and stay on the driver."""

from __future__ import annotations

import re

from strandline.functions import fixed

DEFAULTS = {"paths": [], "exclude": [], "respectGitignore": True, "extensions": [], "chunkSize": fixed.CHUNK_SIZE, "overlap": fixed.CHUNK_OVERLAP, "concurrency": 2, "batchSize": 50}
RANGES = {"chunkSize": (1, 1_000_000), "overlap": (0, 1_000_000), "concurrency": (1, 1000), "batchSize": (1, 100_000)}


def _value(s: str):
    s = s.strip()
    if s.startswith("[") and s.endswith("]"):
        return [_value(x) for x in s[1:-1].split(",") if x.strip()]
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1]
    if s in ("true", "false"):
        return s == "true"
    if s in ("", "null", "~"):
        return None
    return int(s) if re.fullmatch(r"-?\d+", s) else float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s


def parse(text: str):
    """Nested maps, lists and scalars of a YAML text, without anchors, tags and block scalars."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, depth: int):
        out = [] if lines[i][1].startswith("- ") or lines[i][1] == "-" else {}
        while i < len(lines) and lines[i][0] == depth:
            line = lines[i][1]
            if isinstance(out, list):
                out.append(_value(line[1:]))
                i += 1
                continue
            key, sign, rest = line.partition(":")
            if not sign:
                raise ValueError(f"no key in: {line}")
            if rest.strip() or i + 1 >= len(lines) or lines[i + 1][0] < depth or lines[i + 1][0] == depth and not lines[i + 1][1].startswith("-"):
                out[key.strip().strip("'\"")] = _value(re.sub(r"\s+#.*$", "", rest))
                i += 1
            else:
                out[key.strip().strip("'\"")], i = block(i + 1, lines[i + 1][0])
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def settings(given: dict | None) -> dict:
    """Settings with the defaults for what is missing; raises where one is out of range or of another kind."""
    out = DEFAULTS | {k: v for k, v in (given or {}).items() if v is not None}
    for name, (lo, hi) in RANGES.items():
        v = out[name]
        if isinstance(v, bool) or not isinstance(v, int) or not lo <= v <= hi:
            raise ValueError(f"{name} must be a whole number from {lo} to {hi}")
    if out["overlap"] >= out["chunkSize"]:
        raise ValueError("overlap must be less than chunkSize")
    for name in ("paths", "exclude", "extensions"):
        if not isinstance(out[name], list) or not all(isinstance(x, str) for x in out[name]):
            raise ValueError(f"{name} must be a list of texts")
    return out
