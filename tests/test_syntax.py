import pytest

from strandline.operators import syntax as X

PY = "import a\n\n# what\nclass C:\n    x = 1\n\n    def f(self):\n        return 1\n\n\ndef g():\n    return 2\n"
TS = "// head\nimport x from './y';\n\nexport class C {\n  a() {\n    return '}';\n  }\n\n  b() { /* { */\n    return `\n{`;\n  }\n}\nconst z = [\n  1,\n];\n"


def covered(text, language, size):
    found = X.chunk_syntax(text, language, size)
    lines = text.split("\n")
    seen = [i for _, a, b in found for i in range(a, b + 1)]
    assert len(seen) == len(set(seen)) and {i for i, x in enumerate(lines) if x.strip()} <= set(seen)
    assert all(c == "\n".join(lines[a : b + 1]) for c, a, b in found)
    return found


@pytest.mark.parametrize("language,text", [("python", PY), ("typescript", TS)])
@pytest.mark.parametrize("size", [5, 20, 60, 1000])
def test_nothing_is_lost_or_given_twice(language, text, size):
    found = covered(text * 3, language, size)
    assert len(found) == 1 if size == 1000 else len(found) > 1


def test_statements_stay_whole():
    nodes = X.parse(TS, "typescript")
    assert [(n.first, n.end, n.comment) for n in nodes] == [(0, 1, True), (1, 2, False), (3, 13, False), (13, 16, False)]
    assert [(n.first, n.end) for n in nodes[2].inner] == [(4, 7), (8, 12)]
    assert [(n.first, n.end) for n in X.parse(PY, "python")] == [(0, 1), (3, 8), (10, 12)]
    ruby = "module M\n  def f(a)\n    b.each do |x|\n      puts '# {' # }\n    end\n  end\nend\nx = <<~TXT\n  end {\nTXT\n"
    assert [(n.first, n.end) for n in X.parse(ruby, "ruby")][0] == (0, 7)
    assert [(n.first, n.end) for n in X.parse('resource "a" "b" {\n  x = "${y}" # }\n}\n', "terraform")] == [(0, 3)]
    assert len(X.parse("fn f<'a>(x: &'a str) -> char { '{' }\nfn g() {}\n", "rust")) == 2


def test_what_cannot_be_parsed_falls_back_with_a_reason():
    for text, language in (("def f(:\n", "python"), ("function f() {\n", "typescript"), ("}\n", "go"), ("x = `\n", "javascript")):
        found, parser, error, message = X.chunk_or_fall_back(text, language)
        assert found and (parser, error) == ("lines", "ast_parse_failed") and message
    assert X.chunk_or_fall_back("plain", "generic")[1:3] == ("lines", None)
    assert X.chunk_or_fall_back(None, None)[0] == [] and X.chunk_or_fall_back(" \n", "python")[0] == []


def test_rows(spark):
    schema = "id int, language string, content string, key string, parser string"
    rows = [(1, "Python", PY, "k", "p"), (2, "python", "def f(:\n", "k", "p"), (3, None, None, "k", "p"), (4, "go", "", "k", "p"), (5, "generic", "a\nb", "k", "p")]
    df = spark.createDataFrame(rows, schema)
    chunks, errors = X.syntax_chunks(df, "id", 40)
    assert {r["key"] for r in chunks.collect()} == {"1", "2", "5"} and [tuple(r) for r in errors.collect()] == [("2", "python", "ast_parse_failed", "SyntaxError")]
    sound = {r["key"]: r for r in X.soundness(chunks, df, "id").collect()}
    assert all(r["n_wrong"] == 0 for r in sound.values()) and sound["1"]["lines"] == sum(any(c.isalnum() for c in x) for x in PY.split("\n"))
    assert X.syntax_chunks(df.limit(0), "id")[0].count() == 0
