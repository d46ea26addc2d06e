"""Functions paired with their documentation.

A qualified symbol table (symbols) is joined with the declarations found in the files' text by normalised signature (name
and parameter names, without annotations, defaults and separators): with those of its own file, where the declaration of
the symbol's qualified name wins and among overloads the one whose line is nearest to the symbol's line; and, by snapshot
and qualified name, with those of other files (stubs, re-declarations). Documentation is the docstring, the comment
directly above the definition (decorators included), or the Markdown description at the end of the symbol document.
Documentation that says nothing is dropped: placeholders, rulers, tool directives, commented-out code, the bare or
reworded name, parameter names without explanation, and mere pointers elsewhere.

Null contents, docstrings and texts have no documentation; files that do not parse are read all the same, by line.
Repeated rows count once per key; the distinct rows of a key are joined each, and one that is documented documents it.
Ties in line distance take the longer documentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.plans.runtime import cut, is_empty, spread

KINDS = ("function", "method")
SOURCES = r"\.(py|pyi|js|mjs|cjs|jsx|ts)$"

# fixed values: words that carry no description by themselves
EMPTY_WORDS = set(
    "a an the this that these those it its of for to in on at by with from and or is are be does do did will can function functions method methods func def procedure routine "
    "class object helper helpers util utility utilities here there goes docstring docstrings documentation doc docs description describe describes comment comments "
    "return returns returned result results value values param params parameter parameters arg args argument arguments none null void todo fixme xxx tbd tba wip hack note "
    "see above below also other elsewhere same placeholder missing added add later write me please fill na n stub generated auto autogenerated implementation implements call calls "
    "async main code private public internal section block module self cls int str string bool boolean list dict float any type types number array".split()
)
DIRECTIVE = re.compile(
    r"^\W*(?:noqa\b|type:\s*ignore|pylint\b|flake8\b|fmt:|yapf\b|isort\b|mypy\b|ruff\b|pragma\b|nosec\b|pyright\b|coverage:|eslint\b|eslint-|prettier-|jshint\b|jslint\b|tslint|istanbul\b|c8\b|@ts-|ts-ignore|"
    r"@generated\b|@flow\b|@license\b|@preserve\b|sourceMappingURL|sourceURL|-\*-|vim?:|coding[:=]|!/|global\b|globals\b|@(?:private|public|protected|internal|override|static|abstract|async|deprecated|ignore|hidden|inheritdoc)\b\W*$|region\b|endregion\b|\w+-disable|\w+-enable)",
    re.I)
TODO = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|tba|wip|hack)\b", re.I)
POINTER = re.compile(
    r"^\W*(?:(?:@|:)?see(?:also)?\b|cf\.|refer to\b|defined (?:in|at)\b|documented (?:in|at|elsewhere)\b|inherit(?:ed|s)?\b|overrides?\b|\{@(?:link|inheritdoc)|as above|same as (?:above|below|before)|ditto|moved to\b|check the docs|read the docs)", re.I)
SECTION = re.compile(r"^\W*(?:args|arguments|params?|parameters|returns?|raises|yields?|examples?|attributes|notes?)\s*:?\W*$", re.I)
PARAM = re.compile(r"^\s*(?:[:@](?:param|arg|argument|parameter|type|key|keyword)\b\s*(?:\{[^}]*\}\s*)?(?:\w+\s+(?=\w+\s*:))?\[?([\w$*.]+)\]?\s*:?\s*-?|([\w$*]+)\s*(?:\([^)]*\))?\s*:|[:@](?:returns?|rtype|raises|throws|yields)\b\s*(?:\{[^}]*\}|\w+(?=:))?\s*:?)\s*(.*)$")
CODE_LINE = re.compile(
    r"^(?:return\b[^.]*[(\[.;=]|return\s+\w+;?$|(?:if|for|while|elif|else|try|except|with|def|class|switch|catch)\b.*[:{]\s*$|(?:const|let|var)\s+\w+\s*=|import\s+[\w.{*]+|from\s+[\w.]+\s+import\b|"
    r"[\w.\[\]'\"]+\s*(?:[-+*/|&]?=)(?!=)\s*\S+|[\w.]+\([^()]*(?:\([^()]*\)[^()]*)*\);?$|print\s*\(|console\.\w+\(|await\s+\w+[\w.]*\(|raise\s+\w+|assert\s+\w|del\s+\w|pass$|break;?$|continue;?$|[{}()\[\];]+$|.*;\s*$|@\w+\(.*\)$)")
# what comes back in which case
RESULT = re.compile(r"^\W*returns?\s+[\w.]+\s+(?:for|if|when|unless|on)\s+\w+\s+\w+", re.I)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
WORD = re.compile(r"[^\W\d_]+")
CJK = re.compile(r"[一-鿿぀-ヿ가-힯]")


def name_words(name: str) -> set[str]:
    return {w.lower() for w in CAMEL.findall(name or "")}


def _same(word: str, known: set[str]) -> bool:
    """Equal up to an inflected ending."""
    if word in known:
        return True
    for k in known:
        n = 0
        for a, b in zip(word, k):
            if a != b:
                break
            n += 1
        if n >= 3 and n >= min(len(word), len(k)) - 1 and max(len(word), len(k)) - n <= 4:
            return True
    return False


def says(text: str | None, name: str = "", params: tuple[str, ...] = ()) -> bool:
    """Whether a documentation text says more than the definition itself."""
    if not text or not text.strip():
        return False
    known = name_words(name)
    for p in params:
        known |= name_words(p)
    skip_result = False
    for raw in text.replace("\r", "\n").split("\n"):
        line = re.sub(r"^\s*(?:/\*+|\*+/|\*(?!\*)|//+!?|#+!?|<!--|--)\s?", "", raw)
        line = re.sub(r"\s*(?:\*+/|-->)\s*$", "", line).strip()
        if not line:
            continue
        if line.startswith((">>>", "...")):
            skip_result = line.startswith(">>>")
            continue
        if skip_result:
            skip_result = False
            if re.fullmatch(r"[\w.'\"\[\](){}:, -]*", line) and line.count(" ") <= 2:
                continue
        if DIRECTIVE.match(line) or TODO.match(line) or SECTION.match(line) or not re.search(r"\w", line):
            continue
        if re.match(r"([-=~*#_.])\1{2,}.*\1{2,}$", line):
            continue  # a ruler with a title
        if POINTER.match(line) and len(WORD.findall(line)) <= 14:
            continue
        if CODE_LINE.match(line):
            continue
        if RESULT.match(line):
            return True
        own = known
        m = PARAM.match(line)
        if m and (m.group(1) or not m.group(2) or m.group(2).lstrip("*") in params or m.group(2).isidentifier()):
            named = m.group(1) or m.group(2)
            if named:
                own = known | name_words(named)
            line = m.group(3) or ""
        line = re.sub(r"`[^`]*`|\{@\w+[^}]*\}|https?://\S+|\b\w+(?:[./]\w+){1,}\b(?:\(\))?", " ", line)
        if len(CJK.findall(line)) >= 4:
            return True
        words = [w.lower() for w in WORD.findall(line) if len(w) > 1]
        left = [w for w in words if w not in EMPTY_WORDS and not _same(w, own)]
        if len(left) >= 2 or (len(left) == 1 and len(words) >= 4):
            return True
    return False


def parameters(signature: str | None) -> tuple[str, ...]:
    """Parameter names of a signature, stars removed."""
    if not signature or "(" not in signature:
        return ()
    return tuple(p.lstrip("*.") for p in split_parameters(signature.split("(", 1)[1].rsplit(")", 1)[0]))


def split_parameters(inner: str) -> list[str]:
    """Top-level parameters of a parameter list as bare names; separators (/, *) dropped."""
    out, depth, cur, quote = [], 0, [], ""
    for c in inner + ",":
        if quote:
            if c == quote:
                quote = ""
            cur.append(c)
        elif c in "\"'`":
            quote = c
            cur.append(c)
        elif c == "," and depth == 0:
            p = re.split(r"[:=]", "".join(cur), maxsplit=1)[0].strip().replace("...", "*")
            cur = []
            if p and p not in ("/", "*"):
                out.append(re.sub(r"\s+", " ", p))
        else:
            depth += (c in "([{") - (c in ")]}")
            cur.append(c)
    return out


def norm(name: str, params: list[str]) -> str:
    return f"{name}({','.join(params)})"


CLASS = re.compile(r"^([ \t]*)class[ \t]+(\w+)", re.M)
JS_CLASS = re.compile(r"\bclass[ \t]+([\w$]+)[^{;\n]*\{")
ARROW, BRACE = re.compile(r"\s*=>"), re.compile(r"\s*\{")
DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]]*\])?\(", re.M)
# the parameter list may go on over lines: what follows its closing bracket is looked at then
JS_DEF = re.compile(
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<function>[\w$]+)[ \t]*\(|(?:const|let|var)[ \t]+(?P<bound>[\w$]+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:function[ \t]*\*?[ \t]*[\w$]*[ \t]*)?\((?=[^\n]*(?:=>|\{)|[^;\n)]*$)"
    r"|(?:static[ \t]+)?(?:async[ \t]+)?\*?[ \t]*(?:[gs]et[ \t]+)?(?!(?:if|for|while|switch|catch|return|with|function)\b)(?P<method>[\w$#]+)[ \t]*\((?=[^;\n]*\)[ \t]*\{|[^;\n)]*$))", re.M)
STRING = re.compile(r"\s*(?:[rRuU]{0,2})(\"\"\"|'''|\"|')")


STOP = re.compile(r"[\\\"'`()\[\]{}]")


def _close(text: str, at: int) -> int:
    """Place after the bracket that closes the one before ``at``; -1 if there is none."""
    depth, quote = 1, ""
    while m := STOP.search(text, at):
        c, at = m.group(0), m.end()
        if c == "\\":
            at += bool(quote)
        elif quote:
            if c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        else:
            depth -= 1
            if not depth:
                return at
    return -1


def _python_scopes(content: str) -> list[tuple[int, int, str, str]]:
    """(place, indent, name, mark that stands between it and what it holds) of classes and functions, in order."""
    found = [(m.start(), len(m.group(1).expandtabs()), m.group(2), ".") for m in CLASS.finditer(content)]
    return sorted(found + [(m.start(), len(m.group(1).expandtabs()), m.group(2), ".<locals>.") for m in DEF.finditer(content)])


def _python_names(content: str) -> dict[int, str]:
    """place of a definition -> its name with those around it."""
    out: dict[int, str] = {}
    around: list[tuple[int, str]] = []
    for at, indent, name, mark in _python_scopes(content):
        while around and around[-1][0] >= indent:
            around.pop()
        out[at] = (around[-1][1] if around else "") + name
        around.append((indent, out[at] + mark))
    return out


def _js_classes(content: str) -> list[tuple[int, int, str]]:
    """(start of the body, its end, name) of each class, in order."""
    return [(m.end(), end if (end := _close(content, m.end())) >= 0 else len(content), m.group(1)) for m in JS_CLASS.finditer(content)]


def declarations(path: str, content: str) -> list[tuple[str, str, int, str, str, str]]:
    """(normalised signature, name, line, docstring, comment above, name with those around it) of each definition, in order."""
    out = []
    lines = content.split("\n")
    python = path.endswith((".py", ".pyi"))
    if not python and not path.endswith((".js", ".mjs", ".cjs", ".jsx", ".ts")):
        return out
    nested, classes = (_python_names(content), []) if python else ({}, _js_classes(content))
    line, seen = 1, 0
    for m in (DEF if python else JS_DEF).finditer(content):
        line += content.count("\n", seen, m.end())
        seen = m.end()
        name = m.group(2) if python else m[m.lastgroup]
        end = _close(content, m.end())
        if end < 0:
            continue
        if not python and m.lastgroup != "function" and not (BRACE.match(content, end) or m.lastgroup == "bound" and ARROW.match(content, end)):
            continue
        if python:
            full = nested.get(m.start(), name)
        else:
            holder = [c for a, e, c in classes if a <= m.start() < e] if m.lastgroup == "method" else []
            full = f"{holder[-1]}.{name}" if holder else name
        params = split_parameters(content[m.end() : end - 1])
        doc = ""
        if python:
            colon = re.compile(r"[^:\n]*(?:\[[^\]]*\][^:\n]*)?:[ \t]*(?:#[^\n]*)?").match(content, end)
            s = STRING.match(content, colon.end()) if colon else None
            if s:
                stop = content.find(s.group(1), s.end())
                doc = content[s.end() : stop] if stop >= 0 else ""
        k = line - 2 - content.count("\n", m.start(), m.end())
        above: list[str] = []
        if python:
            while k >= 0 and re.match(r"\s*@\w", lines[k]):
                k -= 1
            while k >= 0 and re.match(r"[ \t]*#", lines[k]):
                above.append(lines[k])
                k -= 1
        elif k >= 0 and lines[k].rstrip().endswith("*/"):
            while k >= 0:
                above.append(lines[k])
                if "/*" in lines[k]:
                    break
                k -= 1
            else:
                above = []
        else:
            while k >= 0 and re.match(r"[ \t]*//", lines[k]):
                above.append(lines[k])
                k -= 1
        out.append((norm(name, params), name, line, doc, "\n".join(reversed(above)), full))
    return out


def body(path: str, lines: list[str], line: int) -> str:
    """The lines of a definition that starts on ``line`` (1-based): by indentation, or by braces."""
    first = lines[line - 1]
    indent = len(first) - len(first.lstrip())
    end = line
    if path.endswith((".py", ".pyi")):
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent or lines[end].lstrip()[:1] in ")]}"):
            end += 1
    else:
        depth, begun = 0, False
        for end in range(line, len(lines) + 1):
            row = lines[end - 1]
            depth += row.count("{") - row.count("}")
            begun = begun or "{" in row
            if begun and depth <= 0:
                break
    return "\n".join(lines[line - 1 : end]).rstrip()


def documented_declarations(files: DataFrame, with_code: bool = False) -> DataFrame:
    """file_key, module_qname, sig, found: array of (full, line, doc, source, code), for signatures of which a declaration is documented."""
    schema = "file_key string, module_qname string, sig string, found array<struct<full:string,line:int,doc:string,source:string,code:string>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("full", pa.string()), ("line", pa.int32()), ("doc", pa.string()), ("source", pa.string()), ("code", pa.string())]))
        for batch in batches:
            keys, modules, sigs, founds = [], [], [], []
            for key, path, content, module in zip(*(batch.column(k).to_pylist() for k in range(4))):
                by: dict[str, list] = {}
                lines = content.split("\n") if with_code else []
                for sig, name, line, doc, above, full in declarations(path, content):
                    params = tuple(p.lstrip("*") for p in sig.split("(", 1)[1][:-1].split(",") if p)
                    text, source = (doc, "docstring") if says(doc, name, params) else (above, "comment") if says(above, name, params) else (None, None)
                    by.setdefault(sig, []).append({"full": full, "line": line, "doc": text, "source": source, "code": body(path, lines, line) if with_code else None})
                for sig, rows in by.items():
                    if with_code or any(r["doc"] for r in rows):
                        keys.append(key)
                        modules.append(module)
                        sigs.append(sig)
                        founds.append(rows)
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(modules, pa.string()), pa.array(sigs, pa.string()), pa.array(founds, kind)], names=["file_key", "module_qname", "sig", "found"])

    source = files.where("content is not null and path is not null").select("file_key", "path", "content", "module_qname")
    return spread(source.where(F.col("path").rlike(SOURCES))).mapInArrow(run, schema)


def signature_key(signature="signature"):
    """The normalised signature of a symbol row."""
    return F.regexp_replace(F.regexp_replace(signature, r"^\s*(async\s+)?(def|function\s*\*?)\s+", ""), r"\s+", "")


def judged(rows: DataFrame) -> DataFrame:
    """Rows (symbol_key, signature, doc, source) whose documentation says something."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for sig, doc in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                head = (sig or "").split("(", 1)[0].split()
                keep.append(says(doc, head[-1] if head else "", parameters(sig)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.select("symbol_key", "signature", "doc", "source").mapInArrow(run, "symbol_key string, signature string, doc string, source string")


def _callables(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*KINDS))


def _own_texts(symbols: DataFrame, symbol_docs: DataFrame) -> DataFrame:
    """Judged docstrings, and judged Markdown descriptions after the four heading lines of a symbol document."""
    # two words, or four signs of a script without spaces, are longer than three characters
    doc = _callables(symbols).where("length(trim(docstring)) > 3").select("symbol_key", "signature", F.col("docstring").alias("doc"), F.lit("docstring").alias("source"))
    head = "substring_index(text, '\\n', 4)"
    tail = F.expr(f"CASE WHEN endswith({head}, signature) THEN substring(text, length({head}) + 2) ELSE text END")
    md = symbol_docs.where("text is not null").select("symbol_key", "signature", tail.alias("doc"), F.lit("markdown").alias("source")).where("length(trim(doc)) > 3")
    return judged(doc.unionAll(md))


def _snapshot(key: str = "file_key"):
    return F.substring_index(key, ":", 1)


def _declared(symbols: DataFrame, files: DataFrame, with_code: bool = False) -> DataFrame:
    """symbol_key, signature, doc, source, code of the declaration that each distinct row of a symbol means."""
    sym = _callables(symbols).where("signature is not null and file_key is not null").groupBy("symbol_key", "file_key", "qname", "signature").agg(F.min("start_line").alias("start_line")).withColumn("sig", signature_key())
    # only a module that stands in several files of a snapshot is declared elsewhere
    code = files.where(F.col("path").rlike(SOURCES) & F.col("module_qname").isNotNull())
    several = cut(code.groupBy(_snapshot().alias("snap"), "module_qname").agg((F.min("file_key") != F.max("file_key")).alias("several")).where("several").select("snap", "module_qname"))
    elsewhere = not is_empty(several)
    decl = documented_declarations(files, with_code)
    decl = cut(decl) if elsewhere else decl
    rank = lambda x: F.struct(
        F.when(F.concat_ws(".", "module_qname", x["full"]) == F.coalesce("qname", F.lit("")), 0).otherwise(1).alias("q"), F.abs(x["line"] - F.coalesce("start_line", F.lit(0))).alias("d"), (-F.coalesce(F.length(x["doc"]), F.lit(0))).alias("n"),
        x["doc"].alias("doc"), x["source"].alias("source"), x["code"].alias("code"))
    near = sym.join(decl, ["file_key", "sig"]).withColumn("near", F.array_min(F.transform("found", rank)))
    own = near.select("symbol_key", "signature", "near.doc", "near.source", "near.code")
    if not elsewhere:
        return own
    other = decl.withColumn("snap", _snapshot()).join(several, ["snap", "module_qname"], "left_semi").select("snap", F.col("file_key").alias("other"), "sig", "module_qname", F.explode("found").alias("x"))
    other = other.where("x.doc is not null").select("snap", "other", "sig", F.concat_ws(".", "module_qname", "x.full").alias("qname"), "x.doc", "x.source", F.lit(None).cast("string").alias("code"))
    far = sym.withColumn("snap", _snapshot()).join(other, ["snap", "qname", "sig"]).where("file_key <> other").select("symbol_key", "signature", "doc", "source", "code")
    return own.unionAll(far)


def documented(symbols: DataFrame, files: DataFrame, symbol_docs: DataFrame) -> DataFrame:
    """symbol_key of each function or method with documentation that says something."""
    own = _own_texts(symbols, symbol_docs).select("symbol_key")
    known = _callables(symbols).select("symbol_key")
    declared = _declared(symbols, files).where("doc is not null").select("symbol_key")
    return own.unionAll(declared).distinct().join(known, "symbol_key", "left_semi")


def pairs(symbols: DataFrame, files: DataFrame, symbol_docs: DataFrame) -> DataFrame:
    """symbol_key, qname, signature, source, description, code: docstring first, then comment, then Markdown."""
    own = _own_texts(symbols, symbol_docs).select("symbol_key", "source", "doc")
    declared = _declared(symbols, files, True).select("symbol_key", "source", "doc", "code")
    order = F.when(F.col("source") == "docstring", 0).when(F.col("source") == "comment", 1).otherwise(2)
    texts = own.withColumn("code", F.lit(None).cast("string")).unionByName(declared)
    best = texts.groupBy("symbol_key").agg(F.min(F.when(F.col("doc").isNotNull(), F.struct(order.alias("o"), F.col("doc"), F.col("source")))).alias("b"), F.max("code").alias("code"))
    names = _callables(symbols).groupBy("symbol_key").agg(F.max("qname").alias("qname"), F.max("signature").alias("signature"))
    return best.where("b is not null").join(names, "symbol_key").select("symbol_key", "qname", "signature", F.col("b.source").alias("source"), F.col("b.doc").alias("description"), "code")
