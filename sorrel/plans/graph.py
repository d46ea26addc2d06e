"""The code knowledge graph as DataFrames, and the ten read-only queries over it.

``Graph`` holds narrow tables of current rows: ``repositories`` (repo_name, commit_sha, root_path, indexed_at), ``files`` (file_key,
repo_name, path), ``symbols`` (key, repo_name, commit_sha, path, kind, name, qname, signature, start_line, end_line, cyclomatic,
parent_qname), ``sites`` (site_key, repo_name, commit_sha, owner_key, target_key, resolution), ``inherits`` (child_key, parent_key),
``imports`` (repo_name, commit_sha, path, module, imported_name, alias), ``docs`` (key, repo_name, kind, text), ``inits`` (the pseudo
callables of modules: key, repo_name, commit_sha, path, name, qname, start_line, end_line), ``diagnostics`` (diagnostic_key, file_key,
repo_name, category, severity, line_no, column_no, message) and ``constructs`` (edge_key, src_key, type_key, resolution, repo_name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions.scalars import clamp_depth, clamp_paths, clamp_rows, looks_like_key, snippet
from sorrel.operators import resolve as R
from sorrel.operators import textsearch as S
from sorrel.operators import traverse as T
from sorrel.plans.runtime import table
from sorrel.sources import extract as X
from sorrel.sources import markdown as M

CALLABLES = ("function", "method")
LABELS = {"definition": ("function", "method", "type"), "call": CALLABLES, "hierarchy": ("type",)}
DEFAULT_TOP = 25
MAX_REPOSITORIES = 100


class SymbolResolutionError(ValueError):
    """An identifier that names no symbol, or several."""


def current(df: DataFrame, key: str) -> DataFrame:
    """The row with the greatest arrived_at of each key, deleted keys left out."""
    cols = [c for c in df.columns if c not in (key, "arrived_at")]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*cols), "arrived_at").alias("r")).select(key, "r.*")
    return newest.where("deleted_at is null").drop("deleted_at") if "deleted_at" in cols else newest


def commit_of(key: str):
    return F.regexp_extract(key, r"^[^@]*@([^:]*):", 1)


def path_of(key: str = "file_key"):
    return F.regexp_extract(key, r"^[^@]*@[^:]*:(.*)$", 1)


@dataclass
class Graph:
    repositories: DataFrame
    files: DataFrame
    symbols: DataFrame
    sites: DataFrame
    inherits: DataFrame
    imports: DataFrame
    docs: DataFrame
    inits: DataFrame
    diagnostics: DataFrame
    constructs: DataFrame
    resolved: DataFrame | None = None  # the call sites with all their columns, of a graph from sources

    @property
    def edges(self) -> DataFrame:
        """EXACT_CALLS between functions and methods: one edge per resolved call site."""
        keys = self.symbols.where(F.col("kind").isin(*CALLABLES)).select("key")
        e = self.sites.where("owner_key is not null and target_key is not null").select(F.col("site_key").alias("edge_key"), F.col("owner_key").alias("src"), F.col("target_key").alias("dst"), "resolution", "repo_name", "commit_sha")
        return e.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")


def from_tables(spark: SparkSession, d: str) -> Graph:
    """The graph of the stored tables."""
    sym = current(table(spark, d, "symbols"), "symbol_key").withColumn("key", F.col("symbol_key")).withColumn("commit_sha", commit_of("symbol_key")).withColumn("path", path_of())
    cs = current(table(spark, d, "call_sites"), "site_key").select("site_key", "repo_name", commit_of("site_key").alias("commit_sha"), "owner_key", "target_key", F.col("status").alias("resolution"))
    types = sym.where("kind = 'type'").groupBy("repo_name", "commit_sha", "qname").agg(F.count("*").alias("n"), F.max("key").alias("k")).where("n = 1")
    inh = current(table(spark, d, "inheritance"), "inherit_key").where("base_qname is not null").withColumn("commit_sha", commit_of("inherit_key"))
    child = types.select("repo_name", "commit_sha", F.col("qname").alias("type_qname"), F.col("k").alias("child_key"))
    parent = types.select("repo_name", "commit_sha", F.col("qname").alias("base_qname"), F.col("k").alias("parent_key"))
    inherits = inh.join(child, ["repo_name", "commit_sha", "type_qname"]).join(parent, ["repo_name", "commit_sha", "base_qname"]).where("child_key <> parent_key").select("child_key", "parent_key").distinct()
    files = current(table(spark, d, "files"), "file_key")
    facts = X.extract(files.where(F.col("content").isNotNull()))
    imports = X.import_rows(facts).select("repo_name", "commit_sha", "path", "module", F.col("name").alias("imported_name"), "alias")
    docs = table(spark, d, "symbol_docs").select(F.col("symbol_key").alias("key"), "repo_name", "kind", "text")
    inits = sym.where("kind = 'module_init'")
    owner = files.select("file_key", "repo_name")
    diagnostics = current(table(spark, d, "parse_diagnostics"), "diagnostic_key").join(owner, "file_key")
    built = cs.where("owner_key is not null and target_key is not null").where(F.col("resolution").startswith("constructor_exact"))
    constructs = built.select(F.col("site_key").alias("edge_key"), F.explode(F.array("site_key", "owner_key")).alias("src_key"), F.col("target_key").alias("type_key"), "resolution", "repo_name")
    return Graph(table(spark, d, "repositories").distinct(), files, sym, cs, inherits, imports, docs, inits, diagnostics, constructs)


def from_sources(files: DataFrame, notes: DataFrame | None = None) -> Graph:
    """The graph of source rows (repo_name, commit_sha, path, content)."""
    from sorrel.functions.scalars import symbol_text
    from sorrel.plans.runtime import cut

    facts = cut(X.extract(files))
    sym = cut(X.symbol_rows(facts))
    res = cut(R.resolve(facts))
    proj = R.projections(res).select(F.col("edge_key").alias("site_key"), F.col("target_key").alias("t"), F.col("resolution").alias("how"))
    sites = res.select("site_key", "repo_name", "commit_sha", "owner_key", "status").join(proj, "site_key", "left").select("site_key", "repo_name", "commit_sha", "owner_key", F.col("t").alias("target_key"), F.coalesce("how", "status").alias("resolution"))
    repos = files.select("repo_name", "commit_sha").distinct().withColumn("root_path", F.lit(None).cast("string")).withColumn("indexed_at", F.current_timestamp())
    flat = facts.select(X.key("path").alias("file_key"), "repo_name", "commit_sha", "path", "language", "loc", "parse_status", "module_qname")
    inits = X.init_rows(facts)
    diagnostics = X.diagnostic_rows(facts).withColumn("file_key", X.key("path")).withColumnRenamed("key", "diagnostic_key")
    constructs = R.constructions(res).withColumn("repo_name", F.substring_index("snap", "@", 1))
    docs = sym.where(F.col("kind").isin(*CALLABLES))
    if notes is not None:
        docs = docs.join(M.descriptions(M.chunk_notes(notes), sym), ["repo_name", "commit_sha", "qname"], "left")
    docs = docs.select("key", "repo_name", "kind", symbol_text("name", "qname", "signature", "docstring", "texts" if notes is not None else None).alias("text"))
    imports = X.import_rows(facts).select("repo_name", "commit_sha", "path", "module", F.col("name").alias("imported_name"), "alias")
    inherits = R.inherits_edges(X.inheritance_rows(facts), X.import_rows(facts), sym).select("child_key", "parent_key")
    return Graph(repos, flat, sym, sites, inherits, imports, docs, inits, diagnostics, constructs, res)


def _scope(df: DataFrame, repo: str | None, commit: str | None) -> DataFrame:
    if repo is not None:
        df = df.where(F.col("repo_name") == repo)
    return df if commit is None else df.where(F.col("commit_sha") == commit)


def select_symbol(g: Graph, identifier: str, repo: str | None = None, commit: str | None = None, labels: tuple[str, ...] = LABELS["definition"]):
    """The one row an identifier names: an exact key first, then a qualified name inside a repository."""
    pool = g.symbols.where(F.col("kind").isin(*labels))
    hit = pool.where(F.col("key") == identifier).take(1)
    if hit:
        if (repo is not None and hit[0].repo_name != repo) or (commit is not None and hit[0].commit_sha != commit):
            raise SymbolResolutionError(f"{identifier} does not belong to the requested repository or commit")
        return hit[0]
    if looks_like_key(identifier):
        raise SymbolResolutionError(f"no indexed symbol has the key {identifier}")
    if repo is None:
        raise SymbolResolutionError("a qualified name needs a repository")
    rows = _scope(pool.where(F.col("qname") == identifier), repo, commit).orderBy("commit_sha", "path", "start_line", "key").take(501)
    if not rows:
        raise SymbolResolutionError(f"no symbol {identifier} in {repo}")
    if len(rows) > 1:
        raise SymbolResolutionError(f"{identifier} is ambiguous: " + ", ".join(r.key for r in rows))
    return rows[0]


def list_repositories(g: Graph) -> DataFrame:
    """Repositories with their number of files, by name, at most 100."""
    n = g.files.groupBy("repo_name").agg(F.count("file_key").alias("files"))
    newest = g.repositories.groupBy("repo_name").agg(F.max_by(F.struct("commit_sha", "root_path"), F.struct("indexed_at", "commit_sha")).alias("r"))
    return newest.join(n, "repo_name", "left").select("repo_name", "r.commit_sha", "r.root_path", F.coalesce("files", F.lit(0)).alias("files")).orderBy("repo_name").limit(MAX_REPOSITORIES)


SYMBOL_COLUMNS = ("key", "repo_name", "commit_sha", "path", "kind", "name", "qname", "signature", "start_line", "end_line")


def search_symbols(g: Graph, q: str, kind: str | None = None, repo: str | None = None, commit: str | None = None, limit: int = 25, mode: str = "graph") -> DataFrame:
    """graph: token match over names; lexical: BM25 over descriptions (the commit filter comes after the top rows, types have none)."""
    if mode == "graph":
        pool = _scope(g.symbols, repo, commit)
        pool = pool if kind is None else pool.where(F.col("kind") == kind)
        return S.search_names(pool, q).select(*SYMBOL_COLUMNS, "score").orderBy(F.desc("score"), "qname", "key").limit(clamp_rows(limit))
    if mode != "lexical":
        raise ValueError(f"unknown mode {mode}")
    docs = _scope(g.docs, repo, None)
    docs = docs if kind is None else docs.where(F.col("kind") == kind)
    best = S.top_documents(docs, q, limit)
    live = g.symbols.where(F.col("kind").isin(*CALLABLES)).join(F.broadcast(best), "key")  # at most 500 rows
    live = live.join(docs.select("key", snippet("text").alias("snippet")), "key", "left")
    return _scope(live, None, commit).select(*SYMBOL_COLUMNS, "snippet", "score", "rank").orderBy("rank")


def get_definition(g: Graph, identifier: str, repo: str | None = None, commit: str | None = None) -> DataFrame:
    row = select_symbol(g, identifier, repo, commit)
    return g.symbols.where(F.col("key") == row.key).select(*SYMBOL_COLUMNS)


def find_importers(g: Graph, module: str, repo: str | None = None, commit: str | None = None, limit: int = 100) -> DataFrame:
    """Files that import a module; an unknown module gives no rows."""
    if looks_like_key(module):
        place, _, name = module.partition(":external-module:")
        rows = g.imports.where((F.concat_ws("@", "repo_name", "commit_sha") == place) & (F.col("module") == name)) if name else g.imports.limit(0)
    else:
        if repo is None:
            raise SymbolResolutionError("a module name needs a repository")
        rows = g.imports.where(F.col("module") == module)
    return _scope(rows, repo, commit).select("repo_name", "path", "imported_name", "alias", "module").distinct().orderBy("repo_name", "path", "imported_name", "alias").limit(clamp_rows(limit))


def _neighbours(g: Graph, identifier: str, repo, commit, depth: int, limit: int, inward: bool) -> DataFrame:
    row = select_symbol(g, identifier, repo, commit, LABELS["call"])
    edges = g.edges.where((F.col("repo_name") == row.repo_name) & (F.col("commit_sha") == row.commit_sha))
    near, far = ("dst", "src") if inward else ("src", "dst")
    names = g.symbols.select("key", "qname", "signature")
    if clamp_depth(depth) == 1:
        hit = edges.where(F.col(near) == row.key).select(F.col(far).alias("key"), "resolution").distinct()
        return hit.join(names, "key").select("key", "qname", "signature", "resolution").orderBy("qname", "key", "resolution").limit(clamp_rows(limit))
    starts = g.symbols.where(F.col("key") == row.key).select(F.col("key").alias("start"))
    walk = T.trails(edges.select("edge_key", F.col(near).alias("src"), F.col(far).alias("dst")), starts, depth)
    return walk.join(names.withColumnRenamed("key", "node"), "node").select(F.col("node").alias("key"), "qname", "signature", "depth").distinct().orderBy("depth", "qname", "key").limit(clamp_rows(limit))


def find_callers(g: Graph, identifier: str, repo=None, commit=None, depth: int = 1, limit: int = 50) -> DataFrame:
    return _neighbours(g, identifier, repo, commit, depth, limit, True)


def find_callees(g: Graph, identifier: str, repo=None, commit=None, depth: int = 1, limit: int = 50) -> DataFrame:
    return _neighbours(g, identifier, repo, commit, depth, limit, False)


def trace_call_path(g: Graph, source: str, target: str, repo=None, commit=None, max_depth: int = 8, limit: int = 5) -> DataFrame:
    """path (array of key and qname) and depth of a shortest path; equal ends have none."""
    a, b = (select_symbol(g, x, repo, commit, LABELS["call"]) for x in (source, target))
    if (a.repo_name, a.commit_sha) != (b.repo_name, b.commit_sha):
        raise SymbolResolutionError("both ends must lie in one repository and commit")
    pairs = g.symbols.sparkSession.createDataFrame([(a.key, b.key)], "start string, node string")
    edges = g.edges.where((F.col("repo_name") == a.repo_name) & (F.col("commit_sha") == a.commit_sha))
    found = T.shortest_paths(edges, pairs, max_depth)
    steps = found.select("depth", F.posexplode("path").alias("pos", "key")).join(g.symbols.select("key", "qname"), "key")
    return steps.groupBy("depth").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key", "qname"))), lambda s: F.struct(s["key"].alias("key"), s["qname"].alias("qname"))).alias("path")).select("path", "depth").limit(clamp_paths(limit))


def get_class_hierarchy(g: Graph, identifier: str, repo=None, commit=None, direction: str = "ancestors", depth: int = 5, limit: int = 50) -> DataFrame:
    if direction not in ("ancestors", "descendants"):
        raise ValueError(f"unknown direction {direction}")
    row = select_symbol(g, identifier, repo, commit, LABELS["hierarchy"])
    a, b = ("child_key", "parent_key") if direction == "ancestors" else ("parent_key", "child_key")
    edges = g.inherits.select(F.concat_ws("\x1f", "child_key", "parent_key").alias("edge_key"), F.col(a).alias("src"), F.col(b).alias("dst"))
    starts = g.symbols.where(F.col("key") == row.key).select(F.col("key").alias("start"))
    walk = T.trails(edges, starts, depth)
    return walk.join(g.symbols.withColumnRenamed("key", "node"), "node").select(F.col("node").alias("key"), "qname", "path", "depth").distinct().orderBy("depth", "qname", "key").limit(clamp_rows(limit))


def find_dead_code(g: Graph, repo: str | None = None, commit: str | None = None, limit: int | None = 100) -> DataFrame:
    """Functions and methods that no resolved call site names, a self call included."""
    pool = _scope(g.symbols.where(F.col("kind").isin(*CALLABLES)), repo, commit)
    dead = T.unreferenced(pool, g.sites.where("target_key is not null"))
    out = dead.select("key", "repo_name", "qname", "path", "start_line", F.lit("unreferenced_candidate").alias("confidence")).orderBy("qname", "key")
    return out if limit is None else out.limit(clamp_rows(limit))


def get_complexity(g: Graph, identifier: str | None = None, repo=None, commit=None, top_n: int | None = None) -> DataFrame:
    if identifier is not None:
        row = select_symbol(g, identifier, repo, commit, LABELS["call"])
        return g.symbols.where(F.col("key") == row.key).select("key", "qname", "signature", "cyclomatic")
    pool = _scope(g.symbols.where(F.col("kind").isin(*CALLABLES)), repo, commit)
    return pool.select("key", "qname", "signature", "cyclomatic").orderBy(F.desc("cyclomatic"), "qname", "key").limit(clamp_rows(top_n or DEFAULT_TOP))
