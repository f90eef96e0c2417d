import random

from strandline.llm.non_source import RUN, WINDOW, judge, non_source, runs_of

FILES = "file_id long, group_name string, project_name string, file string, language string, content string, reason string, code_key string"
HAND = "import x from './y.js';\n\n" + "\n".join(f"export function f{w}(a) {{\n  // keeps {w}\n  return run{w}(a, '{w}');\n}}\n" for w in "alpha beta gamma delta epsilon zeta".split())
LIB = "// libby 1.2.3 | Open License | https://libby.example/dist\n" + "\n".join(f"function lib{w}(q) {{\n  if (!q) {{ return null; }}\n  return q.{w};\n}}" for w in "one two three four".split())


def reason(text, file="src/a.ts", language="typescript"):
    layout, notice, *_ = judge(text, file, language)
    return layout or notice


def test_hand_written():
    assert reason(HAND) is None
    assert reason("// NOTE: do not edit the order of these steps\n" + HAND) is None
    assert reason("// NOTE: replaces the generated client\n" + HAND) is None
    assert reason(HAND + 'out.write("Code generated by x. DO NOT EDIT.");\n') is None
    assert reason("// Copyright (c) Our Works. Internal source.\n" + HAND) is None
    assert reason("// ids: " + ", ".join("word%d" % i for i in range(300)) + "\n" + HAND) is None
    assert reason('"""Long words on what this does.\n' + "prose " * 200 + '\n"""\ndef f(a):\n    return a\n', "a.py", "python") is None


def test_made_by_a_tool():
    assert reason("\n".join(f"  public getField{i}() {{ return this.f{i}; }}" for i in range(40))) == "generated"
    assert reason("// AUTO-GENERATED FILE - changes will be lost\n" + HAND) == "generated"
    assert reason("/*\n * Code generated by x-gen. DO NOT EDIT.\n */\n" + HAND) == "generated"


def test_minified_data_and_copies():
    assert reason("/*! lib 8 */\n" + "for(var i=0;i<9;i++){a[i]=b(i);c(a)}" * 60) == "minified"
    assert reason("export const rows = [\n" + "\n".join(f'  {{"id":{i},"k":"{i * 7919 % 10007}"}},' for i in range(50)) + "\n];\n") == "data"
    assert reason('BLOB = """\n' + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo\n" * 30 + '"""\n', "b.py", "python") == "data"
    assert reason(HAND, "web/node_modules/q/index.ts") == "third_party"
    assert reason(LIB) == "third_party"


def test_rows(spark):
    bare = LIB.split("\n", 1)[1].replace("  ", "\t")
    rows = [(1, "g", "p", "a.ts", "typescript", HAND, "x", "y"), (2, "g", "p", "b.ts", None, LIB, "x", "y"), (3, "g", "q", "c.ts", "TYPESCRIPT", bare, "x", "y"), (4, "g", "p", None, None, None, "x", "y"), (5, "g", "p", "e.ts", "typescript", "", "x", "y"), (1, "g", "p", "a.ts", "typescript", HAND, "x", "y")]
    got = [(r["file_id"], r["isNonSource"], r["reason"]) for r in non_source(spark.createDataFrame(rows, FILES)).collect()]
    assert sorted(got, key=repr) == [(1, False, None), (1, False, None), (2, True, "third_party"), (3, True, "third_party"), (4, False, None), (5, False, None)]
    assert non_source(spark.createDataFrame([], FILES)).count() == 0


def test_notices_beyond_the_head():
    foot = "\n// Code generated by x-gen. DO NOT EDIT.\n"
    assert reason(HAND + foot) == "generated" and reason(HAND * 20 + foot) == "generated"
    assert reason("/*\n" + " * what this file is for\n" * 500 + " * @generated by x\n */\n" + HAND) == "generated"
    assert reason(HAND + "\n// Licensed under the Open License\n") == "third_party"
    script = "import os\n\n" + "\n".join(f"def {w}(a):\n    return a.{w}\n" for w in "alpha beta gamma delta epsilon zeta".split())
    assert reason(script + "# generated from a.proto on build 7\n", "a.py", "python") == "generated"


def test_code_that_writes_a_notice_is_source():
    assert reason(HAND + "const head = `\n// Code generated by x-gen. DO NOT EDIT.\n`;\n") is None
    assert reason('def f():\n    x = """\n# Code generated by x. DO NOT EDIT.\n"""\n    return x\n', "a.py", "python") is None
    assert reason("set -e\ncat > out.go <<EOF\n# Code generated by x. DO NOT EDIT.\nEOF\necho done\n", "a.sh", "shell") is None


def varied(seed, n):
    """Functions of varied statements."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    return [f"function {word()}({word()}) {{\n  const {word()} = {word()}({word()});\n  if (!{word()}) return {word()};\n  {word()}.{word()}('{word()}');\n}}" for _ in range(n)]


def test_runs_meet_what_is_shared():
    a, b = [f"s{i}" for i in range(100)], [f"t{i}" for i in range(40)]
    shared = RUN + WINDOW - 1
    assert set(runs_of(b[:10] + a[20 : 20 + shared] + b[10:])) & set(runs_of(a))
    assert not set(runs_of(a)) & set(runs_of(b)) and runs_of([]) == [] and len(runs_of(["one"])) == 1
    changed = a[:50] + ["new"] + a[51:]
    assert len(set(runs_of(a)) & set(runs_of(changed))) >= 0.75 * len(runs_of(a))


def test_copies_without_notices_or_folders(spark):
    """With notices and folders switched off, copies with local changes are still found, and own code with later versions stays."""
    lib, rows = [varied(k, 20) for k in range(6)], []
    for k, parts in enumerate(lib):
        for p in range(3):
            mine = parts[:]
            mine[3 * p] = varied(900 + 10 * k + p, 1)[0]  # a local change
            text = "\n\n".join(mine)
            rows.append((len(rows), "g", f"p{p}", f"src/util/m{k}{p}.ts", "typescript", text.replace("  ", "\t") if p else text, "x", "y"))
    copies = {r[0] for r in rows}
    for k in range(30):
        own = varied(100 + k, 15)
        for version in range(2):
            rows.append((len(rows), "g", f"p{k % 3}", f"src/own{k}.ts", "typescript", "\n\n".join(own[: 15 - version]), "x", "y"))
    made = ["\n".join(f"  public getField{i}() {{ return this.f{i}; }}" for i in range(40)), "for(var i=0;i<9;i++){a[i]=b(i);c(a)}" * 60]
    layout = {len(rows) + i for i in range(2)}
    rows += [(len(rows) + i, "g", "p0", f"src/x{i}.ts", "typescript", t, "x", "y") for i, t in enumerate(made)]
    got = {r["file_id"]: r["reason"] for r in non_source(spark.createDataFrame(rows, FILES), notices=False).collect() if r["isNonSource"]}
    assert {k for k, v in got.items() if v == "third_party"} == copies and set(got) == copies | layout
