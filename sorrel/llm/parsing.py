"""Source files that do not parse.

1. Each file is lexed into rows: one row per top-level statement with its token classes, exploded to tokens where a step
   needs them. A token's class says nothing of its text, so literals are judged here: a wrong one is an ``ERR``. The language is that of the path's extension, whatever the language column says.
   Equal statements are one shape, and each distinct shape is looked at once.
2. Adjacent token pairs are anti-joined with the pairs that the language's grammar permits (a fixed table, broadcast).
3. Nesting is validated by windows over the bracket tokens of a shape.
4. Statement productions: shapes that no production makes are flagged by a recogniser (the host's parser on a text of the
   shape, or the JavaScript grammar here), because productions nest beyond what windows reduce. TOML keys and tables that clash with another one of the same name, or
   with one that stands above it, are flagged by grouped counts over the prefixes of their names.
5. An exact check of the flagged files follows, with whole texts; it only removes false alarms.

Null contents and paths, and other extensions, give no case. An empty text is valid, except as JSON. Repeated rows count
once per file key: a key is found if any of its rows is invalid.
"""

from __future__ import annotations

import ast
import io
import json
import keyword
import re
import sys
import token as T
import tokenize
import tomllib
import warnings
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

try:
    import _tokenize  # the same tokenizer without a named tuple for each token
except ImportError:
    _tokenize = None

from sorrel.llm import grammar as G
from sorrel.llm import js_grammar as js
from sorrel.plans.runtime import cut, spread, width

EXTENSIONS = {"py": "python", "js": "javascript", "json": "json", "toml": "toml"}
OPENERS, CLOSERS = {"(": 1, "[": 2, "{": 3, "TPLH": 3}, {")": 1, "]": 2, "}": 3, "TPLT": 3}
FRAMES = 1_000_000  # Python frames for texts nested deep
MID = re.compile(r"^(?:else|elif|except|finally)$")


def language(path: str | None) -> str | None:
    return EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower()) if path and "." in path else None


_WORDS = {w: w for w in (*keyword.kwlist, *G.SOFT)}
_DEPTH = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


def _tokens(text: str) -> Iterator[tuple]:
    """(kind, text, start, end, ...) of Python's own tokenizer, as plain tuples where it gives them."""
    read = io.StringIO(text).readline
    return _tokenize.TokenizerIter(read, extra_tokens=True) if _tokenize else tokenize.generate_tokens(read)


# lexers: (unit of token classes, key name or None)
def python_units(text: str) -> list[list[str]]:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    unit: list[str] = []
    units = [unit]
    depth = level = 0
    if "\0" in text:
        return [["ERR"]]
    rows: list[str] = []
    fstart: list[tuple[int, int]] = []
    fresh, decorated = True, False
    try:
        for kind, s, start, end, *_ in _tokens(text):
            if kind == T.COMMENT or kind == T.NL:
                continue
            if fstart:
                if kind == T.FSTRING_START:
                    fstart.append(start)
                    continue
                if kind != T.FSTRING_END:
                    continue
                start = fstart.pop()
                if fstart:
                    continue
                rows = rows or list(io.StringIO(text))
                cls = "FSTR" if _expression(_slice(rows, start, end)) else "ERR"
            elif kind == T.NAME:
                cls = _WORDS.get(s, "NAME")
            elif kind == T.OP:
                cls = s
            elif kind == T.NEWLINE:
                unit.append("NEWLINE")
                fresh = level == 0 and depth == 0
                continue
            elif kind == T.STRING:
                cls = "BSTR" if "b" in s[: s.find(s[-1])].lower() else "STR"
                if ("\\" in s or cls == "BSTR" and not s.isascii()) and not _expression(s):
                    cls = "ERR"
            elif kind == T.NUMBER:
                cls = "NUM" if s[0] != "0" and len(s) < 4000 or len(s) == 1 or _expression(s) else "ERR"
            elif kind == T.INDENT:
                unit.append("INDENT")
                level += 1
                continue
            elif kind == T.DEDENT:
                level -= 1
                unit.append("DEDENT")
                fresh = level == 0 and depth == 0
                continue
            elif kind == T.FSTRING_START:
                fstart.append(start)
                continue
            elif kind == T.ENDMARKER:
                break
            else:
                cls = "ERR"
            if fresh and level == 0 and depth == 0:
                if unit and not MID.match(cls) and not decorated:
                    unit = []
                    units.append(unit)
                decorated = cls == "@"
                fresh = False
            unit.append(cls)
            if cls in _DEPTH:
                depth += _DEPTH[cls]
    except (tokenize.TokenError, SyntaxError, IndexError, ValueError):
        units[-1].append("ERR")
    return [u for u in units if u]


def _slice(rows: list[str], start: tuple[int, int], end: tuple[int, int]) -> str:
    if start[0] == end[0]:
        return rows[start[0] - 1][start[1] : end[1]]
    return rows[start[0] - 1][start[1] :] + "".join(rows[start[0] : end[0] - 1]) + rows[end[0] - 1][: end[1]]


@lru_cache(4096)
def _expression(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text, mode="eval")
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def javascript_units(text: str) -> list[list[str]]:
    units: list[list[str]] = [[]]
    depth, last = 0, ""
    for t in js.lex(text.removeprefix("﻿")):
        cls = t.lstrip(js.NL)
        if depth == 0 and units[-1] and (last == ";" or last == "}" and t[0] == js.NL) and (cls in ("NAME", "function", "const", "let", "var", "class", "export", "import", "if", "for", "throw", "return", "try", "switch", "async", "do")):
            units.append([])
        units[-1].append(t)
        depth += (cls in ("(", "[", "{", "TPLH")) - (cls in (")", "]", "}", "TPLT"))
        last = cls
    return [u for u in units if u]


_JSON = re.compile(r"[ \t\n\r]+|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>(?:true|false|null)(?![\w$]))|(?P<p>[{}\[\]:,])", re.A)
_COLON = re.compile(r"[ \t\n\r]*:")


def json_units(text: str) -> list[list[str]]:
    out: list[str] = []
    at, stack = 0, []
    text = text.removeprefix("﻿")
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            out.append("ERR")
            break
        at = m.end()
        kind, s = m.lastgroup, m.group(0)
        if kind == "str":
            out.append("KEY" if _COLON.match(text, at) else "STR")
        elif kind == "num":
            out.append("NUM")
        elif kind == "word":
            out.append("WORD")
        elif kind == "p":
            if s == ",":
                s = ",0" if not stack else ",o" if stack[-1] == "{" else ",a"
            elif s in "{[":
                stack.append(s)
            elif s in "}]" and stack:
                stack.pop()
            out.append(s)
    return [out]


_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
_TKEY = re.compile(r"[ \t]*(?:(?P<bare>[A-Za-z0-9_-]+)|(?P<q>\"(?:[^\"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'[^'\x00-\x08\x0a-\x1f\x7f]*'))[ \t]*")
_TVALUE = re.compile(
    r"(?P<ml>\"\"\"(?:[^\"\\]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n)|\"{1,2}(?!\"))*\"{3,5}|'''(?:[^']|'{1,2}(?!'))*'{3,5})"
    r"|(?P<str>\"(?:[^\"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'[^'\x00-\x08\x0a-\x1f\x7f]*')"
    r"|(?P<date>\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?)(?![\w:.-])"
    r"|(?P<float>[+-]?(?:(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?|[eE][+-]?\d(?:_?\d)*)|inf|nan))(?![\w.])"
    r"|(?P<int>[+-]?(?:0|[1-9](?:_?\d)*)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*)(?![\w.])|(?P<bool>(?:true|false)(?!\w))")


@lru_cache(4096)
def _toml_literal(text: str) -> str | None:
    """The JSON text of a TOML literal's value; None if it is none."""
    try:
        return json.dumps(tomllib.loads("k=" + text)["k"], default=str)
    except (ValueError, RecursionError):
        return None


def _clash(keys: list[str]) -> bool:
    """Whether one of the names is, or stands above, another one."""
    keys = sorted(keys)
    return any(b.startswith(a) for a, b in zip(keys, keys[1:]))


def toml_units(text: str) -> list[tuple[list[str], str | None]]:
    """Statements with the name they define: kind (k: key, t: table, a: array of tables), number and name of the table around it,
    own name, split by \\x1e; each part of a name is JSON text and a closing \\x1f."""
    units: list[tuple[list[str], str | None]] = []
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    at, n = 0, len(text)

    def key(at: int, out: list[str]) -> tuple[int, str]:
        parts = []
        while True:
            m = _TKEY.match(text, at)
            if not m:
                out.append("ERR")
                return -1, ""
            q = m.group("q")
            part = json.dumps(m.group("bare")) if q is None else _toml_literal(q) if "\\" in q else json.dumps(q[1:-1])
            out.append("ERR" if part is None else "KEY")
            parts.append(f"{part}\x1f")
            at = m.end()
            if text[at : at + 1] == ".":
                out.append(".")
                at += 1
                continue
            return at, "".join(parts)

    def value(at: int, out: list[str]) -> int:
        stack: list[str] = []
        tables: list[list[str]] = []  # names in the open inline tables
        while True:
            while at < n and (text[at] in " \t" or stack and stack[-1] == "[" and text[at] in "\n#"):
                if text[at] == "#":
                    e = text.find("\n", at)
                    e = n if e < 0 else e
                    if _CONTROL.search(text, at, e):
                        out.append("ERR")
                        return -1
                    at = e
                else:
                    at += 1
            c = text[at : at + 1]
            if c == "[":
                stack.append(c)
                out.append(c)
                at += 1
            elif c == "{":
                stack.append(c)
                out.append(c)
                at += 1
                tables.append([])
                m = re.compile(r"[ \t]*\}").match(text, at)
                if not m:
                    at, name = key(at, out)
                    tables[-1].append(name)
                    if at < 0 or text[at : at + 1] != "=":
                        out.append("ERR")
                        return -1
                    out.append("=")
                    at += 1
            elif c and c in "]}":
                out.append(c)
                at += 1
                if not stack or (stack.pop() == "[") != (c == "]") or c == "}" and _clash(tables.pop()):
                    out.append("ERR")
                    return -1
                if not stack:
                    return at
            elif c == "," and stack:
                out.append(",a" if stack[-1] == "[" else ",i")
                at += 1
                if stack[-1] == "{":
                    at, name = key(at, out)
                    tables[-1].append(name)
                    if at < 0 or text[at : at + 1] != "=":
                        out.append("ERR")
                        return -1
                    out.append("=")
                    at += 1
            else:
                m = _TVALUE.match(text, at)
                if not m or (m.lastgroup in ("ml", "date") or "\\" in m.group(0) or len(m.group(0)) > 4000) and _toml_literal(m.group(0)) is None:
                    out.append("ERR")
                    return -1
                out.append({"ml": "MLSTR", "str": "STR", "date": "DATE", "float": "FLOAT", "int": "INT", "bool": "BOOL"}[m.lastgroup])
                at = m.end()
                if not stack:
                    return at

    table = "0\x1e"
    while at < n:
        m = re.compile(r"[ \t]*(?:#[^\n\x00-\x08\x0b-\x1f\x7f]*)?(?:\n|$)").match(text, at)
        if m and m.end() > at:
            at = m.end()
            continue
        out: list[str] = []
        at = re.compile(r"[ \t]*").match(text, at).end()
        if text[at] == "[":
            double = text.startswith("[[", at)
            out.append("TT[" if double else "T[")
            at, name = key(at + 1 + double, out)
            close = "]]" if double else "]"
            if at >= 0 and text.startswith(close, at):
                out.append("TT]" if double else "T]")
                at += len(close)
                table = f"{len(units) + 1}\x1e{name}"
                name = f"{'a' if double else 't'}\x1e0\x1e\x1e{name}"
            else:
                at = -1
        else:
            at, name = key(at, out)
            if at >= 0 and text[at : at + 1] == "=":
                out.append("=")
                at, name = value(at + 1, out), f"k\x1e{table}\x1e{name}"
            else:
                at = -1
        if at >= 0:
            m = re.compile(r"[ \t]*(?:#[^\n\x00-\x08\x0b-\x1f\x7f]*)?(?:\n|$)").match(text, at)
            if m:
                out.append("NEWLINE")
                units.append((out, name))
                at = m.end()
                continue
        out.append("ERR")
        units.append((out, None))
        break
    return units


def units_of(lang: str, text: str) -> list[tuple[list[str], str | None]]:
    if lang == "python":
        return [(u, None) for u in python_units(text)]
    if lang == "javascript":
        return [(u, None) for u in javascript_units(text)]
    if lang == "json":
        return [(u, None) for u in json_units(text)]
    return toml_units(text)


# recognisers of statement shapes
_PY_TEXT = {"NAME": "a", "NUM": "1", "STR": "''", "BSTR": "b''", "FSTR": "f''"}
_TOML_TEXT = {"STR": "''", "MLSTR": "''''''", "INT": "1", "FLOAT": "1.0", "BOOL": "true", "DATE": "1979-05-27", ",a": ",", ",i": ",", "T[": "[", "T]": "]", "TT[": "[[", "TT]": "]]", "NEWLINE": "\n"}


def production(lang: str, tokens: list[str]) -> bool:
    """Whether a production of the language makes the statement."""
    if "ERR" in tokens or js.NL + "ERR" in tokens:
        return False
    if lang == "javascript":
        try:
            return js.valid(tokens)
        except RecursionError:
            return False  # the exact check judges it
    if lang == "json":
        return True  # pairs and nesting are complete
    if lang == "toml":
        k, out = 0, []
        for t in tokens:
            k += t == "KEY"
            out.append(f"k{k}" if t == "KEY" else _TOML_TEXT.get(t, t))
        try:
            tomllib.loads("".join(f" {x} " if x not in ("\n", "[[", "]]", "[", "]", ".") else x for x in out))
            return True
        except (tomllib.TOMLDecodeError, RecursionError):
            return False
    lines, cur, level = [], [], 0
    for t in tokens:
        if t == "NEWLINE":
            lines.append(" " * level + " ".join(cur))
            cur = []
        elif t == "INDENT":
            level += 1
        elif t == "DEDENT":
            level -= 1
        else:
            cur.append(_PY_TEXT.get(t, t))
    lines.append(" " * level + " ".join(cur))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse("\n".join(lines) + "\n")
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def exact(lang: str, text: str) -> bool:
    """Whether the whole text is valid."""
    text = text.removeprefix("﻿")
    try:
        return _valid(lang, text)
    except RecursionError:
        return lang == "python" or _deep(lang, text)  # Python's parser has made what is too deep for its tree


def _valid(lang: str, text: str, decoder: type[json.JSONDecoder] = json.JSONDecoder) -> bool:
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif lang == "json":
            json.loads(text, cls=decoder, parse_constant=_no_constant)
        elif lang == "toml":
            tomllib.loads(text)
        else:
            return js.valid(js.lex(text))
        return True
    except (SyntaxError, ValueError, MemoryError):
        return False


class _Deep(json.JSONDecoder):
    """The decoder in Python, whose depth only the recursion limit bounds."""

    def __init__(self, **kw):
        super().__init__(**kw)
        self.parse_array, self.parse_object = json.decoder.JSONArray, json.decoder.JSONObject
        self.scan_once = json.scanner.py_make_scanner(self)


def _deep(lang: str, text: str) -> bool:
    """exact() for texts nested deeper than the usual frames: their brackets by a stack, then with up to FRAMES frames; beyond those, only brackets and lexer judge."""
    stack: list[int] = []
    for t in (t.lstrip(js.NL) for tokens, _ in units_of(lang, text) for t in tokens):
        t = {"T[": "[", "TT[": "[", "T]": "]", "TT]": "]"}.get(t, t)
        if t == "ERR" or t in CLOSERS and (not stack or stack.pop() != CLOSERS[t]):
            return False
        if t in OPENERS:
            stack.append(OPENERS[t])
    if stack:
        return False
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(FRAMES)
    try:
        return _valid(lang, text, _Deep)
    except RecursionError:
        return True
    finally:
        sys.setrecursionlimit(limit)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def lexed(files: DataFrame) -> DataFrame:
    """file_key, lang, unit, tokens (codes, with BOF and EOF at the ends of the file), name."""
    schema = "file_key string, lang string, unit int, tokens array<short>, name string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        code = G.codes()
        err = code["ERR"]
        kind = pa.list_(pa.int16())
        for batch in batches:
            rows: list[tuple] = []
            seen = 0
            for key, path, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lang = language(path)
                if lang is None:
                    continue
                found = units_of(lang, text) or [([], None)]
                for k, (tokens, name) in enumerate(found):
                    t = [code.get(x, err) for x in tokens]
                    seen += len(t)
                    if k == 0:
                        t.insert(0, code["BOF"])
                    if k == len(found) - 1:
                        t.append(code["EOF"])
                    rows.append((key, lang, k, t, name))
                if seen > 400_000:
                    yield _rows(pa, rows, kind)
                    rows, seen = [], 0
            yield _rows(pa, rows, kind)

    return spread(files.where("content is not null and path is not null").select("file_key", "path", "content")).mapInArrow(run, schema)


def _rows(pa, rows: list[tuple], kind):
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = (pa.string(), pa.string(), pa.int32(), kind, pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["file_key", "lang", "unit", "tokens", "name"])


def shapes_of(units: DataFrame) -> DataFrame:
    """shape, lang, tokens of each distinct statement: what follows looks at every shape once, however many files hold it."""
    # combined in each task first: a common statement may be a third of all rows. Then a fixed number of partitions: the
    # shapes are few bytes and much work, which size-based coalescing would put into one task
    return cut(units.select("lang", "tokens").distinct().repartition(width(units.sparkSession)).withColumn("shape", F.monotonically_increasing_id()))


def bad_pairs(shapes: DataFrame) -> DataFrame:
    """Shapes with a token pair that no grammar rule makes. The ends of a file are tokens, too."""
    spark = shapes.sparkSession
    allowed = spark.createDataFrame(G.permitted(), "lang string, pair int")
    ints = F.transform("tokens", lambda x: x.cast("int"))
    inside = shapes.select("shape", "lang", ints.alias("t")).where("size(t) > 1").select("shape", "lang", F.explode(F.array_distinct(F.zip_with(F.expr("slice(t, 1, size(t) - 1)"), F.expr("slice(t, 2, size(t) - 1)"), lambda a, b: a * 2048 + b))).alias("pair"))
    return inside.join(F.broadcast(allowed), ["lang", "pair"], "left_anti").select("shape")


def bad_nesting(shapes: DataFrame) -> DataFrame:
    """Shapes with brackets that do not match, by windows over the bracket tokens of each."""
    code = G.codes()
    kinds = {code[m + b]: (k if b in OPENERS else -k) for b, k in (OPENERS | CLOSERS).items() for m in ("", js.NL)}
    lookup = F.create_map(*[F.lit(x) for c, k in kinds.items() for x in (c, k)])
    brackets = shapes.select("shape", F.posexplode("tokens").alias("pos", "tok")).where(F.col("tok").isin(*kinds)).withColumn("k", F.element_at(lookup, F.col("tok").cast("int")))
    of = W.partitionBy("shape")
    level = F.sum(F.signum("k")).over(of.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) + F.when(F.col("k") < 0, 1).otherwise(0)
    leveled = brackets.withColumn("level", level)
    at = W.partitionBy("shape", "level").orderBy("pos")
    checked = leveled.withColumn("prev", F.lag("k").over(at)).withColumn("next", F.lead("k").over(at))
    wrong = (F.col("level") < 1) | ((F.col("k") < 0) & (F.coalesce(F.col("prev"), F.lit(0)) != -F.col("k"))) | ((F.col("k") > 0) & (F.coalesce(F.col("next"), F.lit(0)) != -F.col("k")))
    return checked.where(wrong).select("shape")


def bad_productions(shapes: DataFrame) -> DataFrame:
    """Shapes that no production makes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = G.classes()
        edge = {G.codes()["BOF"], G.codes()["EOF"]}
        for batch in batches:
            keep = []
            for lang, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tokens = [js.NL + names[c - G.NLS] if c >= G.NLS else names[c] for c in t if c not in edge]
                keep.append(not production(lang, tokens))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["shape"])

    return shapes.where("lang <> 'json'").select("shape", "lang", "tokens").mapInArrow(run, "shape long")


def bad_statements(units: DataFrame) -> DataFrame:
    """file_key of files with a statement of a wrong shape: by its token pairs, its nesting, or its production."""
    shapes = shapes_of(units)
    bad = bad_pairs(shapes).unionAll(bad_nesting(shapes)).unionAll(bad_productions(shapes)).distinct()
    wrong = cut(shapes.join(bad, "shape", "left_semi").select("lang", "tokens"))
    return units.join(wrong, ["lang", "tokens"], "left_semi").select("file_key")


def repeated_keys(units: DataFrame) -> DataFrame:
    """file_key of TOML files that define a key or table twice, or as a value and as a table, by counts over all prefixes of their names.

    Every condition holds for more rows if it holds for fewer, so rows of one file key hide nothing from each other."""
    p = F.split("name", "\x1e")
    named = units.where("name is not null").select("file_key", "unit", p[0].alias("kind"), p[1].alias("table"), p[2].alias("above"), F.concat(p[2], p[3]).alias("full"))
    twice = named.where("kind <> 'a'").groupBy("file_key", "kind", "table", "full").count().where("count > 1").select("file_key")
    parts = named.withColumn("parts", F.split("full", "\x1f")).withColumn("n", F.size("parts") - 1).withColumn("outer", F.size(F.split("above", "\x1f")) - 1)
    levels = parts.select("file_key", "unit", "kind", "n", "outer", F.posexplode(F.transform(F.sequence(F.lit(1), "n"), lambda k: F.array_join(F.slice("parts", 1, k), "\x1f"))).alias("k", "path"))
    last = F.col("k") == F.col("n") - 1
    dotted = ~last & (F.col("kind") == "k") & (F.col("k") >= F.col("outer"))
    has = lambda c: F.max(F.when(c, 1).otherwise(0)) > 0
    value, table, array = has(last & (F.col("kind") == "k")), has(last & (F.col("kind") == "t")), has(last & (F.col("kind") == "a"))
    early = F.min(F.when(~last, F.col("unit"))) < F.max(F.when(last & (F.col("kind") == "a"), F.col("unit")))
    clash = (value & (has(~last) | table | array)) | (has(dotted) & (table | array)) | (table & array) | F.coalesce(early, F.lit(False))
    clashing = levels.groupBy("file_key", "path").agg(clash.alias("clash")).where("clash").select("file_key")
    return twice.unionAll(clashing).distinct()


def unparsable(files: DataFrame) -> DataFrame:
    """file_key, lang of each file whose content is not valid in the language of its extension."""
    units = cut(lexed(files))
    flagged = cut(bad_statements(units).unionAll(repeated_keys(units)).distinct())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(k, language(p)) for k, p, t in zip(*(batch.column(i).to_pylist() for i in range(3))) if not exact(language(p), t)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["file_key", "lang"])

    texts = files.where("content is not null and path is not null").select("file_key", "path", "content").join(flagged, "file_key", "left_semi")
    return texts.mapInArrow(run, "file_key string, lang string").distinct()


def rates(files: DataFrame, found: DataFrame) -> DataFrame:
    """repo_name, lang, files, invalid, rate: of distinct file keys."""
    lang = F.coalesce(*[F.when(F.lower("path").endswith("." + e), v) for e, v in EXTENSIONS.items()])
    known = files.where("path is not null and content is not null").select("file_key", "repo_name", lang.alias("lang")).where("lang is not null").distinct()
    hit = found.select("file_key").distinct().withColumn("bad", F.lit(1))
    return known.join(hit, "file_key", "left").groupBy("repo_name", "lang").agg(F.count("*").alias("files"), F.count("bad").alias("invalid"), F.round(F.count("bad") / F.count("*"), 6).alias("rate"))
