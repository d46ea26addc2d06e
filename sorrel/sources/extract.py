"""Python sources to typed rows: one nested row per file, exploded into tables.

The walker carries its lexical position (class or function names around) and its owner (the callable that runs the code)
as arguments; files are independent, so the step is one ``mapInPandas`` without a shuffle.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.plans.runtime import spread

SYMBOL = "struct<kind:string,name:string,qname:string,signature:string,start_line:int,end_line:int,cyclomatic:int,parent_qname:string,docstring:string>"
CALL = "struct<owner_qname:string,raw_callee:string,callee_name:string,callee_qname_hint:string,receiver_kind:string,start_line:int,start_column:int,end_line:int,end_column:int,ordinal:int>"
FILE_SCHEMA = (
    "repo_name string, commit_sha string, path string, language string, loc int, module_qname string, parse_status string, "
    "diagnostics array<struct<category:string,severity:string,line_no:int,column_no:int,message:string>>, imports array<struct<module:string,name:string,alias:string>>, "
    f"symbols array<{SYMBOL}>, inheritance array<struct<type_qname:string,base_name:string,base_qname:string>>, calls array<{CALL}>"
)
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.Try, ast.Match)
NESTED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)


def module_name(path: str, repo: str) -> str:
    """Dotted module of a path; a package's ``__init__`` names the package, at the root the repository."""
    parts = path.removesuffix(".py").split("/")
    if parts[-1] == "__init__":
        parts = parts[:-1]
    return ".".join(parts) or repo


def signature_of(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    names = [x.arg for x in a.posonlyargs + a.args]
    names += [f"*{a.vararg.arg}"] if a.vararg else []
    names += [x.arg for x in a.kwonlyargs]
    names += [f"**{a.kwarg.arg}"] if a.kwarg else []
    return ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + f"def {node.name}({', '.join(names)})"


def complexity(body: list[ast.stmt]) -> int:
    """1 + decisions, nested definitions and lambdas left out."""
    n, todo = 1, list(body)
    while todo:
        x = todo.pop()
        n += isinstance(x, BRANCHES)
        if not isinstance(x, NESTED):
            todo += ast.iter_child_nodes(x)
    return n


def chain_of(node: ast.expr) -> list[str]:
    """Names of a dotted chain, or an empty list if its root is no plain name."""
    out = []
    while isinstance(node, ast.Attribute):
        out.append(node.attr)
        node = node.value
    return [node.id, *reversed(out)] if isinstance(node, ast.Name) else []


@dataclass
class Facts:
    path: str
    module: str
    source: str
    imports: list[dict] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    inheritance: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    bound: set[str] = field(default_factory=set)  # names imported so far

    def __post_init__(self) -> None:
        # cut once for all segments; columns count bytes
        self.lines = [x.encode("utf-8", "surrogatepass") for x in LINE.findall(self.source)]

    def segment(self, node: ast.expr) -> str:
        """The text of an expression."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            part = self.lines[first][node.col_offset : node.end_col_offset]
        else:
            part = b"".join([self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]])
        return part.decode("utf-8", "surrogatepass")

    def read(self, tree: ast.Module) -> "Facts":
        # a stack of its own: expressions may be nested deeper than Python's frames. A definition around is (is function, qualified name)
        todo = [(node, (), f"{self.module}.__module__") for node in reversed(tree.body)]
        while todo:
            node, around, owner = todo.pop()
            todo += [(n, a, o) for n, a, o in reversed(list(self.visit(node, around, owner)))]
        # the order on the page, then the order of the visit; numbered from 1
        self.calls.sort(key=lambda c: (c["start_line"], c["start_column"]))
        for k, c in enumerate(self.calls, 1):
            c["ordinal"] = k
        return self

    def visit(self, node: ast.AST, around: tuple[tuple[bool, str], ...], owner: str) -> Iterator[tuple[ast.AST, tuple, str]]:
        """Record a node; gives the nodes below it with what stands around them (outermost first) and their owner."""
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            qname = self.child(node.name, around)
            inside = around[-1] if around else None
            method = not is_class and inside is not None and not inside[0]
            self.symbols.append({
                "kind": "type" if is_class else "method" if method else "function", "name": node.name, "qname": qname,
                "signature": f"class {node.name}" if is_class else signature_of(node), "start_line": node.lineno, "end_line": node.end_lineno,
                "cyclomatic": 1 if is_class else complexity(node.body), "parent_qname": inside[1] if method else None, "docstring": ast.get_docstring(node),
            })
            if is_class:
                self.inheritance += [{"type_qname": qname, "base_name": n, "base_qname": q} for n, q in map(self.base, node.bases) if n]
            # what runs at definition time belongs to the callable around
            heads = [*node.bases, *(k.value for k in node.keywords)] if is_class else [node.args, *([node.returns] if node.returns else [])]
            yield from ((n, around, owner) for n in (*node.decorator_list, *heads, *node.type_params))
            yield from ((n, (*around, (not is_class, qname)), owner if is_class else qname) for n in node.body)
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                self.bind(a.name, a.name, a.asname)
        elif isinstance(node, ast.ImportFrom):
            module = self.from_module(node)
            if module is not None:
                for a in node.names:
                    self.bind(module, a.name, a.asname)
        elif isinstance(node, ast.Call):
            self.call(node, around, owner)
        yield from ((n, around, owner) for n in ast.iter_child_nodes(node))

    def child(self, name: str, around: tuple[tuple[bool, str], ...]) -> str:
        if not around:
            return f"{self.module}.{name}"
        is_function, qname = around[-1]
        return f"{qname}.<locals>.{name}" if is_function else f"{qname}.{name}"

    def bind(self, module: str, name: str, alias: str | None) -> None:
        self.imports.append({"module": module, "name": name, "alias": alias})
        self.bound |= {alias} if alias else {name, module.split(".", 1)[0]}

    def from_module(self, node: ast.ImportFrom) -> str | None:
        if not node.level:
            return node.module
        parts = self.module.split(".")
        if not self.path.endswith("__init__.py"):
            parts = parts[:-1]
        if node.level > 1:
            parts = parts[: 1 - node.level]
        parts += node.module.split(".") if node.module else []
        return ".".join(parts) or node.module

    def base(self, node: ast.expr) -> tuple[str | None, str | None]:
        while isinstance(node, (ast.Subscript, ast.Call)):
            node = node.value if isinstance(node, ast.Subscript) else node.func
        if isinstance(node, ast.Name):
            return node.id, f"{self.module}.{node.id}"
        if isinstance(node, ast.Attribute):
            return node.attr, ".".join(chain_of(node)) or None
        return None, None

    def call(self, node: ast.Call, around: tuple[tuple[bool, str], ...], owner: str) -> None:
        f = node.func
        name, hint, kind = None, None, "dynamic"
        if isinstance(f, ast.Name):
            name, hint, kind = f.id, f"{self.module}.{f.id}", "none"
        elif isinstance(f, ast.Attribute):
            name, chain = f.attr, chain_of(f)
            if chain and chain[0] in ("self", "cls"):
                cls = next((q for is_function, q in reversed(around) if not is_function), None)
                hint, kind = f"{cls}.{name}" if cls else None, chain[0]
            elif chain:
                hint, kind = ".".join(chain), "name" if len(chain) == 2 and chain[0] in self.bound else "attribute"
            elif isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super":
                kind = "super"
        raw = self.segment(f)
        self.calls.append({
            "owner_qname": owner, "raw_callee": raw or ast.unparse(f), "callee_name": name, "callee_qname_hint": hint, "receiver_kind": kind,
            "start_line": node.lineno, "start_column": node.col_offset, "end_line": node.end_lineno, "end_column": node.end_col_offset, "ordinal": 0,
        })


def file_facts(path: str, repo: str, text: str, module: str | None = None) -> dict:
    """The nested row of one Python file; a file that does not parse keeps its row, with one diagnostic."""
    module = module or module_name(path, repo)
    row = {"language": "python", "loc": len(text.splitlines()), "module_qname": module, "parse_status": "ok", "diagnostics": [], "imports": [], "symbols": [], "inheritance": [], "calls": []}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text, filename=path)
    except SyntaxError as e:
        return row | {"parse_status": "error", "diagnostics": [{"category": "syntax_error", "severity": "error", "line_no": e.lineno, "column_no": e.offset, "message": e.msg}]}
    except (RecursionError, MemoryError) as e:
        return row | {"parse_status": "error", "diagnostics": [{"category": "too_deep", "severity": "error", "line_no": None, "column_no": None, "message": str(e)[:200]}]}
    facts = Facts(path, module, text).read(tree)
    return row | {"imports": facts.imports, "symbols": facts.symbols, "inheritance": facts.inheritance, "calls": facts.calls}


def extract(files: DataFrame) -> DataFrame:
    """``files``: repo_name, commit_sha, path, content. One nested row per Python file with content.

    A column module_qname, where there is one, names the modules; else, and where it is null, their paths do."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.strip().split(" ")[0] for x in ("repo_name", "commit_sha", "path", "language", "loc", "module_qname", "parse_status", "diagnostics", "imports", "symbols", "inheritance", "calls")]
        for pdf in batches:
            rows = [{"repo_name": r, "commit_sha": c, "path": p} | file_facts(p, r or "", t, m) for r, c, p, t, m in zip(pdf["repo_name"], pdf["commit_sha"], pdf["path"], pdf["content"], pdf["module_qname"])]
            yield pd.DataFrame(rows, columns=names)

    source = files.where(F.lower("path").endswith(".py") & F.col("content").isNotNull()).select("repo_name", "commit_sha", "path", "content", F.col("module_qname") if "module_qname" in files.columns else F.lit(None).cast("string").alias("module_qname"))
    return spread(source).mapInPandas(run, FILE_SCHEMA)


def snapshot():
    return F.concat_ws("@", "repo_name", "commit_sha")


def key(*parts):
    return F.concat(snapshot(), F.lit(":"), F.concat_ws(":", *parts))


def exploded(facts: DataFrame, column: str, position: str = "ord") -> DataFrame:
    """One row per element of a nested column, with its place in the file."""
    base = facts.select("repo_name", "commit_sha", "path", "module_qname", F.posexplode(column).alias(position, "x"))
    return base.select("repo_name", "commit_sha", "path", "module_qname", position, "x.*")


def symbol_rows(facts: DataFrame) -> DataFrame:
    return exploded(facts, "symbols").withColumn("key", key("path", "qname", F.col("start_line").cast("string"))).withColumn("snap", snapshot())


def init_rows(facts: DataFrame) -> DataFrame:
    """The pseudo callable of each module, which owns its top-level calls."""
    return facts.select("repo_name", "commit_sha", "path", "module_qname", F.concat("module_qname", F.lit(".__module__")).alias("qname"), F.lit("<module>").alias("name"), F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.col("loc")).alias("end_line")).withColumn(
        "key", key("path", F.lit("module-init"))).withColumn("snap", snapshot())


def import_rows(facts: DataFrame) -> DataFrame:
    return exploded(facts, "imports").withColumn("snap", snapshot())


def inheritance_rows(facts: DataFrame) -> DataFrame:
    return exploded(facts, "inheritance").withColumn("snap", snapshot())


def call_rows(facts: DataFrame) -> DataFrame:
    return exploded(facts, "calls").withColumn("snap", snapshot())


def diagnostic_rows(facts: DataFrame) -> DataFrame:
    d = exploded(facts, "diagnostics")
    return d.withColumn("ordinal", F.col("ord") + 1).withColumn("key", key("path", F.lit("diagnostic"), F.col("ordinal").cast("string"))).drop("ord")
