"""The graph as labelled nodes and typed edges: nine labels, twelve edge types, each a DataFrame over the narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.operators import resolve as R

SYMBOL_LABELS = {"type": "Type", "function": "Function", "method": "Method"}
NODE_LABELS = ("Repository", "File", "Module", "ParseDiagnostic", "ModuleInit", "Type", "Function", "Method", "CallSite")
EDGE_TYPES = ("CONTAINS", "DEFINES", "HAS_DIAGNOSTIC", "INITIALIZES", "HAS_METHOD", "IMPORTS", "INHERITS", "HAS_CALLSITE", "RESOLVES_TO", "CALLS", "EXACT_CALLS", "CONSTRUCTS")


def snap():
    return F.concat_ws("@", "repo_name", "commit_sha")


def _under(*parts):
    return F.concat(snap(), F.lit(":"), F.concat_ws(":", *parts))


def _has(df: DataFrame, *cols: str) -> list:
    """The columns, null where the table lacks them."""
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols]


def nodes(g) -> dict[str, DataFrame]:
    """label -> key, repo_name and the label's properties. A module that several files define is one node."""
    files = g.files.withColumn("module_key", _under(F.lit("module"), "module_qname"))
    defined = files.where("module_qname is not null").select(F.col("module_key").alias("key"), "repo_name", F.substring_index("module_qname", ".", -1).alias("name"), F.col("module_qname").alias("qname"))
    imported = g.imports.where("module is not null").select(_under(F.lit("external-module"), "module").alias("key"), "repo_name", F.col("module").alias("name"), F.col("module").alias("qname"))
    out = {
        "Repository": g.repositories.groupBy("repo_name").agg(F.max_by(F.struct("commit_sha", "root_path"), F.struct("indexed_at", "commit_sha")).alias("r")).select(F.col("repo_name").alias("key"), "repo_name", "r.commit_sha", "r.root_path"),
        "File": g.files.select(F.col("file_key").alias("key"), "repo_name", *_has(g.files, "commit_sha", "path", "language", "loc", "parse_status")),
        "Module": defined.unionAll(imported).dropDuplicates(["key"]),
        "ParseDiagnostic": g.diagnostics.select(F.col("diagnostic_key").alias("key"), "repo_name", "category", "severity", "line_no", "column_no", "message"),
        "ModuleInit": g.inits.select("key", "repo_name", *_has(g.inits, "commit_sha", "path", "name", "qname", "start_line", "end_line")),
        "CallSite": g.sites.select(F.col("site_key").alias("key"), "repo_name", "commit_sha", "owner_key", F.col("resolution").alias("status")),
    }
    for kind, label in SYMBOL_LABELS.items():
        rows = g.symbols.where(F.col("kind") == kind)
        out[label] = rows.select("key", "repo_name", *_has(rows, "commit_sha", "path", "name", "qname", "signature", "start_line", "end_line", "cyclomatic"))
    return {label: out[label] for label in NODE_LABELS}


def edges(g) -> dict[str, DataFrame]:
    """type -> src, dst, repo_name and the type's properties; edges of a type with ``edge_key`` may repeat their ends."""
    plain = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"), "repo_name").where("src is not null and dst is not null").distinct()
    files = g.files.withColumn("module_key", F.when(F.col("module_qname").isNotNull(), _under(F.lit("module"), "module_qname")))
    held = g.symbols.where(F.col("kind").isin(*SYMBOL_LABELS)).select("key", "repo_name", "commit_sha", "path").unionAll(g.inits.select("key", "repo_name", "commit_sha", "path"))
    contains = plain(files, F.col("repo_name"), F.col("file_key")).unionAll(plain(held, _under("path"), F.col("key")))
    known = g.symbols.where("kind <> 'module_init'").select("key").unionAll(g.inits.select("key"))
    target = g.sites.where("target_key is not null")
    line = _has(g.sites, "line_no", "column_no")
    calls = target.where("owner_key is not null").select(F.col("owner_key").alias("src"), F.col("target_key").alias("dst"), "repo_name", F.col("site_key").alias("edge_key"), "resolution", *line)
    calls = calls.join(known.withColumnRenamed("key", "src"), "src", "left_semi").join(known.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "dst", "repo_name", "edge_key", "resolution", *_has(calls, "line_no", "column_no"))
    methods = R.has_method_edges(g.symbols.withColumn("snap", snap())).select(F.col("type_key").alias("src"), F.col("method_key").alias("dst"), F.substring_index("snap", "@", 1).alias("repo_name"))
    imports = g.imports.where("module is not null").select(_under("path").alias("src"), _under(F.lit("external-module"), "module").alias("dst"), "repo_name", F.concat_ws("|", _under("path"), "module", "imported_name", F.coalesce("alias", F.lit(""))).alias("edge_key"), F.col("imported_name").alias("name"), "alias").distinct()
    out = {
        "CONTAINS": contains, "DEFINES": plain(files, F.col("file_key"), F.col("module_key")),
        "HAS_DIAGNOSTIC": plain(g.diagnostics, F.col("file_key"), F.col("diagnostic_key")),
        "INITIALIZES": plain(files.join(g.inits.select(F.concat(snap(), F.lit(":"), "path").alias("file_key"), F.col("key").alias("init_key")), "file_key"), F.col("module_key"), F.col("init_key")),
        "HAS_METHOD": methods, "IMPORTS": imports,
        "INHERITS": g.inherits.select(F.col("child_key").alias("src"), F.col("parent_key").alias("dst"), F.substring_index("child_key", "@", 1).alias("repo_name")).distinct(),
        "HAS_CALLSITE": plain(g.sites.join(known.withColumnRenamed("key", "owner_key"), "owner_key", "left_semi"), F.col("owner_key"), F.col("site_key")),
        "RESOLVES_TO": plain(target.join(known.withColumnRenamed("key", "target_key"), "target_key", "left_semi"), F.col("site_key"), F.col("target_key")),
        "CALLS": calls,
        "EXACT_CALLS": g.edges.select("src", "dst", "repo_name", "edge_key", "resolution"),
        "CONSTRUCTS": g.constructs.select(F.col("src_key").alias("src"), F.col("type_key").alias("dst"), "repo_name", "edge_key", "resolution"),
    }
    return {kind: out[kind] for kind in EDGE_TYPES}


def edge_rows(g) -> DataFrame:
    """All edges in one table: type, src, dst, repo_name, edge_key, resolution, name, alias."""
    out = None
    for kind, df in edges(g).items():
        part = df.select(F.lit(kind).alias("type"), "src", "dst", "repo_name", *_has(df, "edge_key", "resolution", "name", "alias"))
        out = part if out is None else out.unionByName(part)
    return out


def node_rows(g) -> DataFrame:
    """All nodes in one table: label, key, repo_name."""
    out = None
    for label, df in nodes(g).items():
        part = df.select(F.lit(label).alias("label"), "key", "repo_name")
        out = part if out is None else out.unionByName(part)
    return out
