"""Small fixtures with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.llm import bpe, contamination, documentation, foreign, js_grammar, markup, parsing, quality, splitting

WORDS = "harbour lantern gauge ledger silo beacon turbine frame pallet orchard sextant mill anvil quarry lane copper walnut river candle basket meadow window bridge garden marble".split()


# p2
VALID_JS = ["x => x", "const {a, b: [c = 2], ...r} = o", "/ab[/]c/gi.test(s)", "a = b\nc = d", "({a = 1} = {})", "`a${b}c${`d${e}`}`", "class A { #p = 1; static { this.x = 2 } async *g() { yield* 1 } }", "for await (const x of y) { await x }", "if (a) b; else c", "import x, { y as z } from 'm'", "label: for (;;) { break label }", ""]
BAD_JS = ["let x = ;", "const a;", "a b", "}", "(a", "return 1", "({a = 1})", "1 = 2", "<<<<<<< HEAD", "try { }", "`abc", "def f():", "foo(1 2)", "import os", "a?.b = 1"]


@pytest.mark.parametrize("text", VALID_JS)
def test_valid_scripts(text):
    assert js_grammar.valid(js_grammar.lex(text))


@pytest.mark.parametrize("text", BAD_JS)
def test_invalid_scripts(text):
    assert not js_grammar.valid(js_grammar.lex(text))


FILES = [
    ("ok.py", "def f(a, *, b=1):\n    return [x for x in a if x]\n", True), ("cut.py", "def f(a:\n", False), ("indent.py", "def f():\nreturn 1\n", False), ("old.py", "print 'x'\n", False),
    ("else.py", "x = 1\nelse:\n    y = 2\n", False), ("match.py", "match x:\n    case [1, *_] if y:\n        pass\n", True), ("fs.py", "a = f'{b!r:>{w}}'\n", True), ("quote.py", "s = 'abc\n", False),
    ("deco.py", "@a.b(1)\n@c\nclass D[T](E, metaclass=F): ...\n", True), ("empty.py", "", True), ("try.py", "try:\n    x\nfinally:\n    y\n", True), ("tryless.py", "try:\n    x\ny = 1\n", False),
    ("ok.js", "const a = {b: [1, 2]};\nfunction f() { return a }\n", True), ("cut.js", "function f() {\n  if (x", False), ("ts.js", "interface A { b: string }\n", False), ("mix.js", "f(]\n", False),
    ("ok.json", '{"a": [1, -2.5e3, null, "\\u00e9"], "b": {}}', True), ("trail.json", '{"a": 1,}', False), ("comment.json", '{"a": 1} // x', False), ("two.json", "{} {}", False), ("nan.json", "[NaN]", False), ("empty.json", "", False), ("key.json", '{"a", "b": 1}', False), ("top.json", "1, 2", False), ("nest.json", '{"a": [1}', False),
    ("ok.toml", "[a.b]\nc = 'd'\ne = [1,\n 2,]\nf = {g = 1, h.i = 2}\n[[x]]\ny = 1979-05-27T07:32:00Z\n[[x]]\ny = 2\n", True), ("twice.toml", "a = 1\na = 2\n", False), ("table.toml", "[a]\n[a]\n", False), ("noval.toml", "a =\n", False), ("html.toml", "<html>\n", False), ("none.txt", "((((", True),
]


def files_frame(spark, rows):
    return spark.createDataFrame(rows, "file_key string, repo_name string, path string, content string, lang string, unit int")


def test_unparsable_files(spark):
    rows = [(n, "r", "src/" + n, t, "wrong", 1) for n, t, _ in FILES] + [("cut.py", "r", "src/cut.py", "def f(a:\n", None, 2), ("null", "r", "a.py", None, None, 3), ("pathless", "r", None, "((", None, 4)]
    df = files_frame(spark, rows)
    found = parsing.unparsable(df).cache()
    assert {r.file_key for r in found.collect()} == {n for n, _, ok in FILES if not ok}
    rates = {r.lang: (r.files, r.invalid) for r in parsing.rates(df, found).collect()}
    assert rates["python"] == (12, 6) and rates["javascript"] == (4, 3)
    assert parsing.unparsable(df.limit(0)).count() == 0


# invalid only inside a literal, or by two names that clash; and their valid neighbours
LITERALS = {
    "py": (
        ["a = '\\x1'", "a = '\\u12'", "a = '\\N{NOPE}'", "a = b'é'", "a = 0777", "f(x, b'\\x1')", "a = ('b'\n  '\\U00110000')", "\x0c\na = f'{b!q}'", "a = 1\rb = '\\x1'"],
        ["a = '\\x41\\u1234\\N{EM DASH}'", "a = r'\\x1'", "a = rb'\\x1'", "a = 'é'", "a = 00", "a = 0o17 + 0x1F + 0.5 + 0j", "a = '\\d'", "\x0c\na = f'{b!r}'", "a = 'a\\\nb'"],
    ),
    "toml": (
        ["a = 2021-13-45", "a = 25:61:00", 'a = "\\uD800"', "a = {x=1,x=2}", "a.b=1\na=2", "a=2\na.b=1", "[a]\n[[a]]", "[[a]]\n[a]", "[a.b]\n[[a]]", "a={}\n[a.b]", "a={b=1}\na.c=2", "[a]\nb.c=1\n[a.b]", "[a.b]\n[a]\nb.c=1", '"a"=1\na=2', '"\\u0061"=1\na=2', "a=[]\n[[a]]", "a={x=1, x.y=2}", 'a="""\\uD800"""', "a=[{b=1,b=2}]", "[[a]]\n[[a.b]]\n[[a]]\n[a.b.c]\n[[a.b]]", '"[a"=1\n"[a"=2', "a=[1, # \x01\n2]", "[a]\nb=1\n[c]\n[a.b.d]"],
        ["a = 2020-02-29", "a = 23:59:59", 'a = "\\u00e9"', "a = {x=1,y=2}", "a.b=1\na.c=2", "[a.b]\n[a]\nc=1", "[[a]]\n[a.b]\n[[a]]\n[a.b]", "[[a]]\nb=1\n[[a]]\nb=2", '"a.b"=1\na.b=2', "[a]\nb.c=1\nb.d=1", "[a]\nb=1\n[c]\nb=1", "a=[{b=1},{b=2}]", "a={b.c=1,b.d=2}", '""=1\na=1', "[[a]]\nb=1\n[[a]]\nb.c=1"],
    ),
    "js": (
        ["'\\x1'", "'\\u{zz}'", '"\\u12"', "'\\u{110000}'", "`\\x1`", "`a${b}\\u1`", "`\\01`", "/(/", "/a**/", "/[b-a]/", "/a{2,1}/", "/(?<a>x)(?<a>y)/", "/\\p{L/u", "/(?<a>x)\\k<b>/", "/)/", "/+/", "/\\-/u", "/a/uv", "/]/u", "0_7", "07_7", "07.5", "5.toString()", "let ٣a", "\\u0030a", "/[😀-😎]/"],
        ["'\\x41\\u0041\\u{1F600}\\0\\q'", "a`\\x1`", "f()`\\u`", "`\\x41\\0`", "`a${b`\\u`}c`", "/a{2/", "/a{1,2}?[\\w-a]/", "/(?<a>x)\\k<a>/", "/\\p{Script=Greek}/u", "/[^]*/", "/]/", "/(?=a)*/", "/(?<!a)b|c/", "/\\u{61}/u", "/\\-[\\-a]/", "/[\\-a]/u", "0777", "08.5", "5..toString()", "5.5.toFixed()", "1n", "let é٣", "\\u0061b", "'a\\\nb'", "/[😀-😎]/u", "/\\//", "/(a)\\1\\2/", "/[[a-z]--[b]]/v"],
    ),
}


def test_literals_and_clashes(spark):
    rows = [(f"{e}{ok}{k}", "r", f"src/{e}{ok}{k}.{e}", t + "\n", "x", 1) for e, both in LITERALS.items() for ok, texts in enumerate(both) for k, t in enumerate(texts)]
    for _, _, path, t, *_ in rows:
        assert parsing.exact(parsing.language(path), t) == path.startswith(f"src/{path.rsplit('.')[1]}1"), t
    found = {r.file_key for r in parsing.unparsable(files_frame(spark, rows)).collect()}
    texts = {r[0]: r[3] for r in rows}
    assert {texts[k] for k in texts if (k in found) != (k.lstrip("pytomljs")[0] == "0")} == set()
    # a valid row of the same key hides nothing
    both = files_frame(spark, [("k", "r", "a.toml", "[[a]]\nb=1\n[c]\n", "x", 1), ("k", "r", "a.toml", "x=1\n[a.b]\nc=1\n[[a]]\n", "x", 1)])
    assert [r.file_key for r in parsing.unparsable(both).collect()] == ["k"]


def test_deep_files(spark):
    n = 5000
    good = {"json": "[" * n + "]" * n, "toml": "a = " + "[" * n + "]" * n, "js": "x = " + "(" * n + "1" + ")" * n, "py": "x = 1" + " + 1" * n}
    bad = {"json": ["[" * 50_000, "[" * n + "1 1" + "]" * n, "[" * n + "]" * (n + 1)], "toml": ["a = " + "[" * n, "a = " + "[" * n + "]" * n + "\na = 1"], "js": ["x = " + "(" * n, "x = " + "(" * n + "1 1" + ")" * n, "x = " + "(" * n + ")" * n]}
    rows = [(f"{ok}{e}{k}", "r", f"a.{e}", t + "\n", "x", 1) for ok, texts in ((1, {e: [t] for e, t in good.items()}), (0, bad)) for e, ts in texts.items() for k, t in enumerate(ts)]
    assert {r.file_key for r in parsing.unparsable(files_frame(spark, rows)).collect()} == {r[0] for r in rows if r[0][0] == "0"}


# p3
def library_file(k):
    rng = random.Random(k)
    return "\n".join(f"def {rng.choice(WORDS)}_{rng.choice(WORDS)}(a):\n    {rng.choice(WORDS)} = {rng.choice(WORDS)}(a, {rng.choice(WORDS)})\n    return {rng.choice(WORDS)}\n" for _ in range(25))


def test_foreign_files(spark):
    head = "# This file is part of {} 1.4.2.\n"
    lib = library_file(1)
    edited = lib.replace("return mill", "return None")
    rows = [
        ("home", "kiln", "kiln/x.py", head.format("kiln") + lib), ("copy", "app", "app/x.py", edited), ("own", "app", "app/y.py", library_file(2)), ("own2", "web", "web/y.py", library_file(3)),
        ("dir", "app", "app/node_modules/q/i.js", "let a = 1;\n"), ("talk", "app", "app/gen_notes.py", 'BANNER = "# Code generated by {tool}. DO NOT EDIT."\n' + library_file(4)), ("made", "app", "app/z.py", "# Code generated by t. DO NOT EDIT.\nx = 1\n"),
        ("min", "app", "app/m.js", "!function(){" + "var a=1;function b(c){return c>1?[c]:a}" * 30 + "}()"), ("data", "app", "app/d.py", "X = [\n" + "".join(f"    {k}, {k + 1}, {k + 2},\n" for k in range(80)) + "]\n"),
        ("lock", "app", "app/package-lock.json", "{}"), ("conf", "app", "app/c.json", '{"a": 1, "b": ["x"]}'), ("num", "app", "app/n.py", "class A:\n" + "".join(f"    def col_{k:03}(self):\n        return self.r[{k}]\n" for k in range(9))),
        ("null", "app", "app/q.py", None), ("void", "app", None, "x"), ("blank", "app", "app/b.py", ""), ("norepo", None, "w.py", library_file(5)), ("own", "app", "app/y.py", library_file(2)),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_key string, repo_name string, path string, content string, library string")
    got = {r.file_key: r.reason for r in foreign.foreign_files(df).collect()}
    assert got == {"copy": "vendored", "dir": "vendored", "made": "generated", "min": "minified", "data": "data", "lock": "generated", "num": "generated"}
    assert foreign.foreign_files(df.limit(0)).count() == 0


def seen_frame(spark, rows):
    return spark.createDataFrame([(k, r, None, list(h)) for k, r, h in rows], "file_key string, repo_name string, library string, hashes array<long>")


def test_copies_whose_partner_fails(spark):
    low, own, middle, high = [r.repo for r in spark.createDataFrame([(f"r{k}",) for k in range(4)], "repo string").orderBy(F.xxhash64("repo")).collect()]
    rows = [("a", low, range(1, 46)), ("f", own, range(1, 101)), ("m", middle, range(1, 101)), ("z", high, range(56, 101)), ("a2", low, range(1000, 1300)), ("twin", own, range(1, 101))]
    got = {r.file_key: (r.partner, r.contained) for r in foreign.copies(seen_frame(spark, rows)).collect()}
    assert got["f"] == ("m", 1.0) and got["twin"] == ("m", 1.0) and "a2" not in got


def test_copies_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(f"f{k}", f"r{rng.randrange(6)}", sorted({rng.choice(pool) for _ in range(rng.randrange(4, 30))})) for pool in (range(20), range(100, 160)) for k in range(pool[0], pool[0] + 60)]
    expected = set()
    for k, r, h in rows:
        other = [set(g) for _, q, g in rows if q != r]
        if len(h) >= foreign.LEAST_HASHES and len(set(h) & set().union(*other)) >= foreign.SHARED * len(h) and any(len(set(h) & g) >= foreign.CONTAINED * len(h) for g in other):
            expected.add(k)
    got = foreign.copies(seen_frame(spark, rows)).collect()
    held, repo = {k: set(h) for k, _, h in rows}, {k: r for k, r, _ in rows}
    assert sorted(r.file_key for r in got) == sorted(expected)
    assert all(repo[r.file_key] != repo[r.partner] and r.contained == len(held[r.file_key] & held[r.partner]) / len(held[r.file_key]) for r in got)


def test_marks_far_from_the_start(spark):
    licence = "".join(f"# Line {k} of a licence.\n" for k in range(60))
    far = '{"name": "n", "deps": {"x": "' + "y" * 500 + '"}, "lockfileVersion"'
    rows = [
        ("a/x.py", licence + "# Code generated by t. DO NOT EDIT.\nx = 1\n", "generated"), ("a/y.py", licence + "x = 1\n# Code generated by t. DO NOT EDIT.\n", None),
        ("a/p.json", far + ": 3}", "generated"), ("a/q.json", far + ": 3, ", "generated"), ("a/r.json", '{"a": {"lockfileVersion": 1}}', None), ("a/s.json", '{"a": "lockfileVersion"}', None),
        ("a/love.py", "# This module is generated with love\nx = 1\n", None), ("a/tool.py", "# Generated by protoc-gen 3.1.2 from the api\nx = 1\n", "generated"), ("a/few.py", "X = [" + "12345," * 45 + "]\n", "data"),
    ]
    df = spark.createDataFrame([(p, "a", p, t) for p, t, _ in rows], "file_key string, repo_name string, path string, content string")
    got = {r.file_key: r.reason for r in foreign.foreign_files(df).collect()}
    assert got == {p: r for p, _, r in rows if r}


def test_copies_without_any_mark(spark):
    """The index alone finds them: no banner, no directory of third-party code."""
    rows = [("home", "kiln", "kiln/x.py", library_file(1)), ("copy", "app", "app/util/z.py", library_file(1).replace("return mill", "return None")), ("own", "app", "app/y.py", library_file(2)), ("own2", "web", "web/y.py", library_file(3))]
    df = spark.createDataFrame(rows, "file_key string, repo_name string, path string, content string")
    assert {r.file_key: r.reason for r in foreign.foreign_files(df).collect()} == {"home": "vendored", "copy": "vendored"}


# p4
def test_split_frame(spark):
    text = "# Head\n" + "word " * 700 + "\n\ntail"
    rows = [("a", 0, "H", 10, 20, text, 1), ("b", 1, None, None, None, text, 2), ("c", 2, "H", 1, 1, "short", 3), ("d", 3, "H", 1, 1, None, 4), ("e", 4, "H", 1, 1, "", 5)]
    df = spark.createDataFrame(rows, "chunk_key string, chunk_index int, heading_path string, start_line int, end_line int, text string, pieces int")
    got = splitting.split_oversized(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_key, []).append(r)
    assert len(by["a"]) > 1 and all(len(r.text) <= splitting.LIMIT for r in by["a"]) and by["a"][0].start_line == 10 and by["a"][-1].end_line == 13
    assert all(r.start_line is None for r in by["b"]) and [len(by[k]) for k in "cde"] == [1, 1, 1] and by["d"][0].text is None
    assert splitting.split_oversized(df.limit(0)).count() == 0


# p5
SAYS = ["Returns None for a internal account.", "Drop paths older than the reader.", "Returns None for a local crane.", "没有记录的话,迟到的符号就不能被拆分。", "TODO: check the limits.\nEs dauert sechs Läufe, bis der Index schreibt.", ":param pointer: valid digest to compare\n:param timer: hot parser", "Never call this before the frame locks."]
SILENT = ["", "  ", None, "TODO", "FIXME docs", "...", "See above.", "N/A", "----------", "noqa", "Docstring.", "Description goes here.", "The pack account function.", "Pack account.", "Packs accounts", "pack_account", ":param pointer:\n:return:", "Args:\n    pointer: pointer", "# return cache.get(key)", "# ---- helpers ----", "# pylint: disable=invalid-name", "/* eslint-disable */\n// @generated by x", "- `a.b.pack_account`", "See `a.b`.", "TODO: describe a.b.pack_account"]


def test_says():
    for t in SAYS:
        assert documentation.says(t, "pack_account", ("pointer", "timer")), t
    for t in SILENT:
        assert not documentation.says(t, "pack_account", ("pointer", "timer")), t


def test_documented_symbols_and_pairs(spark):
    py = 'class A:\n    # Keeps the ledger closed until noon.\n    @staticmethod\n    def one(x: int = 3, *y):\n        return x\n\n    def two(self):\n        """TODO"""\n\ndef two(self):\n    """Opens both harbours at the same hour."""\n\n# TODO\ndef three():\n    pass\n'
    js = "/**\n * Counts lanterns that burn after dusk.\n */\nexport async function four(a, {b}) {\n  return a;\n}\n\n// eslint-disable-next-line no-unused-vars\nfunction five() {}\n"
    files = spark.createDataFrame([("f1", "a.py", py, "r", None), ("f2", "b.js", js, "r", None), ("f3", "c.py", None, "r", None), ("f1", "a.py", py, "r", None)], "file_key string, path string, content string, sig string, module_qname string")
    sym = [("s1", "f1", "method", "A.one", "def one(x, *y)", 4, None), ("s2", "f1", "method", "A.two", "def two(self)", 7, "TODO"), ("s3", "f1", "function", "two", "def two(self)", 10, None), ("s4", "f1", "function", "three", "def three()", 14, None), ("s5", "f2", "function", "four", "function four(a, {b})", 4, None), ("s6", "f2", "function", "five", "function five()", 9, None), ("s7", "f3", "function", "six", "def six()", 1, "Sorts pallets by weight first."), ("s8", "f1", "type", "A", "class A", 1, "Holds every quarry of the region."), ("s9", "f9", "function", "nine", None, None, None), ("s1", "f1", "method", "A.one", "def one(x, *y)", 4, None)]
    symbols = spark.createDataFrame(sym, "symbol_key string, file_key string, kind string, qname string, signature string, start_line int, docstring string")
    docs = spark.createDataFrame([("s4", "def three()", "three\nthree\nthree\ndef three()\nSee `x.y`."), ("s6", "function five()", "five\nfive\nfive\nfunction five()\nThis keeps the gauge remote until morning."), ("s9", "def nine()", None), ("zz", "def zz()", "zz\nzz\nzz\ndef zz()\nThis keeps the gauge remote until morning.")], "symbol_key string, signature string, text string")
    assert {r.symbol_key for r in documentation.documented(symbols, files, docs).collect()} == {"s1", "s3", "s5", "s6", "s7"}
    got = {r.symbol_key: (r.source, r.code) for r in documentation.pairs(symbols, files, docs).collect()}
    assert set(got) == {"s1", "s3", "s5", "s6", "s7"} and got["s1"][0] == "comment" and got["s1"][1].startswith("    def one") and got["s5"][1].endswith("}")
    assert documentation.documented(symbols.limit(0), files, docs).count() == 0


def test_declarations_elsewhere_and_wrapped(spark):
    stub = 'class A:\n    def run(self, x: int) -> None:\n        """Opens both harbours at the same hour."""\n'
    py = 'class A:\n    def run(self, x):\n        pass\n\nclass B:\n    def run(self, x):\n        """Counts lanterns that burn after dusk."""\n'
    js = "class C {\n  // Keeps the ledger closed until noon.\n  put(\n    a,\n    b\n  ) {\n  }\n}\n// Moves every pallet before winter.\nconst go = (\n  x\n) => x;\nput(\n  1\n);\n"
    files = spark.createDataFrame([("r@1:a.py", "a.py", py, "a"), ("r@1:a.pyi", "a.pyi", stub, "a"), ("r@2:a.py", "a.py", py, "a"), ("r@1:c.js", "c.js", js, "c")], "file_key string, path string, content string, module_qname string")
    sym = [(f"{f}:{q}", f, "method", q, sig, line) for f, q, sig, line in [
        ("r@1:a.py", "a.A.run", "def run(self, x)", 7), ("r@1:a.py", "a.B.run", "def run(self, x)", None), ("r@2:a.py", "a.A.run", "def run(self, x)", 7), ("r@2:a.py", "a.B.run", "def run(self, x)", 1), ("r@1:c.js", "c.C.put", "put(a, b)", 3), ("r@1:c.js", "c.go", "go(x)", 9)]]
    symbols = spark.createDataFrame([(*x, None) for x in sym], "symbol_key string, file_key string, kind string, qname string, signature string, start_line int, docstring string")
    docs = spark.createDataFrame([], "symbol_key string, signature string, text string")
    assert {r.symbol_key for r in documentation.documented(symbols, files, docs).collect()} == {x[0] for x in sym} - {"r@2:a.py:a.A.run"}


# p7
KINDS = [
    ("A <b>x</b> &amp; y", {"html"}), ("# Head\n- item", {"markdown"}), ("[[Page|label]] and ''it''", {"wiki"}), ("$x_i^2$ and \\textbf{b}", {"latex"}), ("```\n<b>x</b> $a_1$ [[P]]\n```", {"markdown"}), ("{| class=\"w\"\n|-\n| a || b\n|}", {"wiki"}), ("| a |\n|---|:--:|\n| b |", {"markdown"}),
    ("Here 3 < n and n > 1; it costs $5 or $6; C:\\temp\\new; List<String>; <v2.1>; part_*.py; 2 * 3 * 4; a == b; {name}; #42; R&D; $HOME; [0]", set()), ("", set()), (None, set()), ("<!-- c -->", {"html"}), ("It&#8217;s", {"html"}),
]


def test_markup_kinds():
    for text, want in KINDS:
        assert markup.kinds(text) == want, text
    assert markup.all_kinds("plain", "A > [[B c]]") == {"wiki"}


def test_render():
    t = markup.render("<ul><li>one<li>two</ul><table><tr><td>a<td>bb<tr><td>ccc<td>d</table><p style='display:none'>no</p><pre>x  y</pre>&lt;ok&gt; <script>bad()</script>")
    assert "- one" in t and "- two" in t and "a    bb\nccc  d" in t and "no" not in t and "x  y" in t and "<ok>" in t and "bad" not in t
    assert markup.render("## Head ##\n**b** and [t](http://u) `co_de`\n```\n*raw*\n```") == "Head\nb and t co_de\n```\n*raw*\n```"
    assert markup.render("\\section{S} \\textbf{b} $a_1$ [[P|q]] {{N|z}}") == "S b a_1 q z"
    assert markup.render(None) is None and markup.render("") == ""
    assert len(markup.render("<b>" * 20_000)) >= 0 and len(markup.render("[" * 20_000)) > 0


def test_kinds_come_from_the_parse():
    # what a construct has shown is no markup: entities, formulas, list marks of other notations
    assert markup.kinds("&#42;a&#42; and &lt;b&gt;") == {"html"} and markup.render("&#42;a&#42; and &lt;b&gt;") == "*a* and <b>"
    assert markup.kinds("$a*b*c$ x_1") == {"latex"} and markup.kinds("<ul><li>a<li>b</ul><hr>") == {"html"}
    deep = "\\emph{" * 9 + "x" + "}" * 9
    assert markup.render(deep) == "x" and markup.render("a $" + "x+" * 400 + "y$ b").startswith("a x+") and markup.kinds("a\x00b") == set()


def test_render_all_visible_text():
    t = markup.render("<table><caption>Cap</caption><tr>loose<td>a</td>between<td>b</td></tr>direct<tr><td>c<td><table><caption>In</caption><tr><td>d</table></table>after")
    assert all(w in t for w in ("Cap", "loose", "a  b", "between", "direct", "In", "c", "d", "after")) and t.index("Cap") < t.index("a  b") < t.index("after")
    for attrs in ('style="overflow:hidden"', 'class="hidden-print"', 'aria-hidden="true"', 'title="a hidden place"', "hidden=until-found", "data-x='display:none'"):
        assert markup.render(f"<p {attrs}>seen</p>").strip() == "seen", attrs
    for attrs in ("hidden", 'hidden=""', "class=a HIDDEN", "style='color:red; Display : none'", 'style="visibility:hidden"'):
        assert markup.render(f"<p>x</p><p {attrs}>unseen</p>").strip() == "x", attrs
    assert markup.render("<html><head><title>no</title><body><p>yes</p></body></html>").strip() == "yes"
    for t in ("<head><title>no</title><p>yes</p>", "<head><noscript><img alt='no'></noscript>\nyes", "<head><meta a=b><main>yes</main>"):
        assert markup.render(t).strip() == "yes", t


def test_markup_frames(spark):
    rows = [("k", "H > <i>x</i>", "**b**", 1, "m"), ("k", "H > <i>x</i>", "**b**", 2, "m"), ("n", None, None, 1, "m"), ("p", "H", "plain", 1, "m")]
    df = spark.createDataFrame(rows, "chunk_key string, heading_path string, text string, arrived_at int, markup string")
    assert sorted(tuple(r) for r in markup.markup_kinds(df).collect()) == [("k", "html"), ("k", "markdown")]
    clean = {r.chunk_key: (r.heading_path, r.text) for r in markup.clean_chunks(df).collect()}
    assert clean == {"k": ("H > x", "b"), "n": (None, None), "p": ("H", "plain")}
    assert markup.markup_kinds(df.limit(0)).count() == 0


# p8
def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    lib.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["", None, "Hello's  world\n\n 123", "aaaaaaaaaaaa", "<|endoftext|> x", "你好,世界。Ünïcödé 🚀👩‍💻", " \t \r\n", "x" * 5000, "a" * 3001 + " b"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x4E00, 0x4F00), 10, 0x301])) for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, "", "x")], "doc_id long, text string, ids string")
    for table_words in (bpe.TABLE_WORDS, 3, 0):
        got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df, table_words=table_words).collect()}
        for k, t in enumerate(texts):
            assert got[k] == (lib.encode(t, add_special_tokens=False).ids if t else []), repr(t)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# p9
def test_leaks(spark):
    rng = random.Random(5)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    closing = "answer with the qualified name of the symbol and nothing else".split()
    items = {k: say(70) + closing for k in range(4)}
    filler = lambda n: " ".join(say(n))
    half = items[0][10:50]
    half[7] = half[19] = half[33] = "replaced"
    two = items[1][2:22], items[1][40:62]
    docs = [
        (1, filler(50) + " " + " ".join(half).upper() + ". " + filler(40)), (2, "> " + ", ".join(two[0]) + "\n> " + filler(30) + "\n\n* " + "\n* ".join(" ".join(two[1][k : k + 6]) for k in range(0, 22, 6))), (3, filler(80) + " " + " ".join(closing)), (4, " ".join(items[2][5:17]) + " " + filler(60)),
        (5, filler(90)), (6, ""), (7, None), (8, " ".join(items[3])), (9, " ".join(items[1][40:62]) + " " + filler(20) + " " + " ".join(closing)),
    ]
    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, share double")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(9, None), (10, "two words")], "item_id long, text string")
    got = contamination.leaks(d, i)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 0), (2, 1), (8, 3), (9, 1)}
    assert {r.doc_id for r in contamination.without_leaks(d, got).collect()} == {3, 4, 5, 6, 7}
    assert contamination.leaks(d.limit(0), i).count() == 0 and contamination.leaks(d, i.limit(0)).count() == 0


def test_leaks_of_repetitive_texts(spark):
    rng = random.Random(6)
    item = [f"w{k}" for k in range(100)]
    filler = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    often = " ".join((" ".join(item[10:40]) + " " + filler(20) + " ") for _ in range(30))
    same = " ".join(f"a b c d x{k} y{k}" for k in range(150))
    part = " ".join("replaced" if k % 13 == 5 else w for k, w in enumerate(same.split()[100:550]))
    d = spark.createDataFrame([(1, often + " ".join(item[60:75])), (2, " ".join(item[60:75]) + " " + filler(20) + " " + often), (3, filler(30) + " " + part + " " + filler(30))], "doc_id long, text string")
    i = spark.createDataFrame([(0, " ".join(item)), (1, same)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, round(r.share, 2)) for r in contamination.leaks(d, i).collect()} == {(1, 0, 0.45), (3, 1, 0.5)}


def test_coverage_is_that_of_all_pairs():
    rng = random.Random(7)
    n = 40
    index = contamination.ItemIndex([(0, " ".join(f"w{k}" for k in range(n)))])
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(1, 60)):
            i, j = rng.randrange(200), rng.randrange(n)
            found.append((i, i + rng.randrange(12), j, min(n - 1, j + rng.randrange(15)), 1))
        one = max(p[3] - p[2] + 1 for p in found)
        two = [a[3] - a[2] + 1 + b[3] - max(b[2], a[3] + 1) + 1 for a in found for b in found if a[1] < b[0] and a[2] < b[2] and a[3] < b[3]]
        share, used = index.coverage(0, found)
        assert share == max([one, *two]) / n and set(used) <= set(found)


def test_short_items_and_many_words(spark):
    d = spark.createDataFrame([(1, "Then the keeper sold four grey mills, and left."), (2, "grey mills"), (3, "<p " + "x" * 400 + ">the keeper sold</p> four grey mills")], "doc_id long, text string")
    i = spark.createDataFrame([(0, "sold four grey mills"), (1, "the keeper sold"), (2, "four mills")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination.leaks(d, i).collect()} == {(1, 0), (1, 1), (3, 0), (3, 1)}


def test_item_codes_do_not_overflow():
    index = contamination.ItemIndex([(0, " ".join(f"w{k}" for k in range(50)))])
    index.n = 1 << 31  # as many words as two billion items would have
    index.pairs = np.unique(index.items[0][:-1] * index.n + index.items[0][1:])
    codes = index.codes(index.items[0])
    assert (codes > 0).all() and len(set(codes.tolist())) == 48


def test_too_many_item_bytes(spark, monkeypatch):
    monkeypatch.setattr(contamination, "MAX_ITEM_BYTES", 10)
    with pytest.raises(ValueError):
        contamination.build_index(spark.createDataFrame([(0, "a text of more bytes")], "item_id long, text string"))


# p10
PROSE = "The keeper of the mill says that all of the ledgers are kept there, and nobody has ever asked for more than one of them. It was a long way to the water. "
FORMS = [
    (PROSE * 3, "prose"), ("- fix the frame\n- cold gauge\n- ledger silo\n- drop lanes\n", "list"), ("a | b | c\n--- | --- | ---\n" + "".join(f"{k} | x{k} | {k * k}\n" for k in range(8)), "table"), ("x,y,z\n" + "".join(f"{k},beacon,{k * 7}\n" for k in range(9)), "table"), ("yl1SEHmX6aDcqr6Uf9JwERCqxVjcApBejQWRxyVtKKSkp869gJ2/uojjgLp/3eDG2ux8nt3rdhMU\n" * 4, "junk"),
    ("Up | Help | Login | Search\n" * 12, "junk"), (PROSE * 2 + "\n\n- one\n- two\n\n" + PROSE, "prose"), ("", None), (None, None), (" \n ", None), ("9134 22 8 71 443 90 1 7 55 0 2 8 1 " * 6, "junk"), ("Der Speicher ist die Quelle für den Zähler, bevor er auch eine Datei hat. Das ist nicht mehr so.", "prose"),
    ("pkg.mod.one\npkg.mod.two\npkg.other.three\npkg.last.four\n", "list"), ("harbour harbour gauge! " * 40, "junk"), (PROSE * 400, "prose"),
]
COMMON = [("en", w) for w in "the of and a to in is it that was for on are with as all be has there than one them".split()] + [("de", w) for w in "der die und in den das ist nicht ein eine mehr auch so hat er bevor für".split()]


def test_forms(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(FORMS)], "doc_id long, text string, form string")
    common = spark.createDataFrame(COMMON + [(None, "x"), ("en", None)], "lang string, word string")
    got = {r.doc_id: r.form for r in quality.quality(docs, common).collect()}
    for k, (text, form) in enumerate(FORMS[:14]):
        assert got[k] == form, (text or "")[:60]
    assert quality.quality(docs.limit(0), common).count() == 0


def test_tail_probabilities_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice(["s", "t"]), float(rng.choice([0, 0, 0, 1, 2, 3, 5, 8]))) for _ in range(500)]
    got = {(r.lang, r.stat, r.value): r.tail for r in quality.tail_probabilities(spark.createDataFrame(rows, "lang string, stat string, value double"), 5).collect()}
    for key in set(rows):
        same = [v for a, b, v in rows if (a, b) == key[:2]]
        plain = quality.PLAIN
        assert abs(got[key] - (sum(v >= key[2] for v in same) + plain * (key[2] <= 0)) / (len(same) + plain)) < 1e-12
        pooled = [v for _, b, v in rows if b == key[1]]
        assert abs(got[quality.EVERY, *key[1:]] - (sum(v >= key[2] for v in pooled) + plain * (key[2] <= 0)) / (len(pooled) + plain)) < 1e-12


def test_quoted_prose_is_no_list():
    words = (PROSE * 3).split()
    lines, cur = [], ""
    for w in words:
        if len(cur) + len(w) > 44:
            lines.append(cur.strip())
            cur = ""
        cur += w + " "
    for mark in ("> ", "* ", "# ", ""):
        assert quality.line_forms("\n".join(mark + x for x in lines))[0] < 0.1, mark
    assert quality.line_forms("* one cold frame\n* two ledgers of the silo\n* three drops\n* four long lanes")[0] > 0.9


def test_score_and_structure_decide_together(spark):
    rows = [(1, 1.0, 0.0), (2, 1.0, 9.0), (3, 0.2, 9.0), (4, 0.6, 5.5)]
    df = spark.createDataFrame([(k, 3, e, 0.0, 0.0, o) for k, e, o in rows], "doc_id long, n_words long, list_share double, table_share double, junk_share double, outlier double")
    assert {r.doc_id: r.form for r in quality.forms(df).collect()} == {1: "prose", 2: "list", 3: "prose", 4: "list"}
