import random

import pytest

from strandline.operators.chunkers import chunk_code, chunk_markdown
from strandline.operators.symbols import symbols_of


def test_fixed_tail_cascade():
    text = "\n".join("x" * 30 for _ in range(60))
    assert [(a, b) for _, a, b in chunk_code(text, "text")] == [(0, 33), (29, 59), (55, 59), (56, 59), (57, 59), (58, 59), (59, 59)]


def test_blocks():
    code = "def a\n  1\nend\n\n\ndef b\n  2\nend\n"
    assert [(a, b) for _, a, b in chunk_code(code, "ruby")] == [(0, 2), (5, 7)]


def test_braces_and_indent():
    js = "import x from 'y'\n\nfunction a() {\n  if (q) { return '}' }\n}\nconst b = 1\n"
    assert [(a, b) for _, a, b in chunk_code(js, "javascript")] == [(0, 1), (2, 4), (5, 6)]
    py = "import x\n\ndef a():\n  pass\n\nclass B:\n  pass\n"
    assert [(a, b) for _, a, b in chunk_code(py, "python")] == [(0, 1), (2, 4), (5, 7)]


def test_long_line_and_halves():
    assert [len(c) for c, _, _ in chunk_code("y" * 7000, "go")] == [3072, 3072, 856]
    assert chunk_code(" \n ", "go") == []


@pytest.mark.parametrize("language", ["ruby", "go", "python", "terraform"])
def test_no_line_with_text_is_lost(language):
    r = random.Random(language)
    lines = [r.choice(["def f", "end", "function a() {", "}", "", "x = '{'", "resource \"a\" {", "  y" * r.randrange(60), "class K:"]) for _ in range(400)]
    got = chunk_code("\n".join(lines), language, 200)
    assert all(any(a <= i <= b for _, a, b in got) for i, x in enumerate(lines) if x.strip())
    assert all(p[2] < q[1] or p[1] == p[2] == q[1] for p, q in zip(got, got[1:]))


def test_markdown():
    text = "# Runbook\n\nintro\n\n## Deploy\n\nstep one\n\n```\n# no heading\n\ncode\n```\n\n### Rollback\nback\n"
    got = chunk_markdown(text, "Doc")
    assert [p for _, p, _, _ in got] == [["Runbook"], ["Runbook", "Deploy"], ["Runbook", "Deploy", "Rollback"]]
    assert got[1][0] == "Doc > Runbook > Deploy\n\nstep one\n\n```\n# no heading\n\ncode\n```"
    assert got[1][2:] == (6, 12)
    long = chunk_markdown("# T\n\n" + "\n".join("w" * 99 for _ in range(100)))
    assert len(long) > 1 and all(len(c) < 2200 for c, *_ in long)


def test_symbols():
    assert symbols_of("def alpha(x):\n  return helper(x)\nLIMIT = 3\n", "python") == (["alpha", "LIMIT"], ["helper"], "function")
    d, u, k = symbols_of('resource "aws_x" "y" {\n  a = var.size\n}\n', "terraform")
    assert d == ["aws_x.y"] and "var.size" in u
    d, u, k = symbols_of("export function go(a) { run(a); go(a); if (x) {} }", "typescript")
    assert d == ["go"] and u == ["run"] and k == "function"
    assert symbols_of(None, None) == ([], [], None)
