"""Registered queries of the labelled graph: the keys of every label and the ends of every edge type, over the stored tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.plans import graph as G
from sorrel.plans import labelled, source_queries
from sorrel.plans.reference_queries import _EDGES, _INH, ORACLES as _REFERENCE
from sorrel.plans.runtime import table


def _nodes(label: str):
    def query(spark, d):
        df = labelled.nodes(G.from_tables(spark, d))[label].select("key")
        # imported modules are read from the sources: edges_IMPORTS has them
        return df.where(~F.col("key").contains(":external-module:")) if label == "Module" else df

    query.__name__ = f"nodes_{label}"
    return query


def _edges(kind: str):
    def query(spark, d):
        df = labelled.edges(G.from_tables(spark, d))[kind]
        if kind == "IMPORTS":  # of the files that parse, as the symbol table knows them
            known = table(spark, d, "symbols").where("kind <> 'module_init'").select(F.col("file_key").alias("src")).distinct()
            return df.join(known, "src", "left_semi").select("src", "dst", "name", "alias")
        return df.select("src", "dst", *(c for c in ("edge_key", "resolution") if c in df.columns))

    query.__name__ = f"edges_{kind}"
    return query


# no stored call site is a construction: CONSTRUCTS is tested on sources of our own
QUERIES = {f.__name__: f for f in (*map(_nodes, labelled.NODE_LABELS), *(_edges(k) for k in labelled.EDGE_TYPES if k != "CONSTRUCTS"))}

_F = """f AS (SELECT file_key, r.*, concat_ws('@', r.repo_name, r.commit_sha) AS snap FROM (
  SELECT file_key, arg_max(struct_pack(repo_name := repo_name, commit_sha := commit_sha, path := path, module_qname := module_qname), arrived_at) AS r FROM files GROUP BY 1))"""
_S = r"""s AS (SELECT symbol_key AS key, r.*, concat_ws('@', r.repo_name, regexp_extract(symbol_key, '^[^@]*@([^:]*):', 1)) || ':' || regexp_extract(r.file_key, '^[^@]*@[^:]*:(.*)$', 1) AS held FROM (
  SELECT symbol_key, arg_max(struct_pack(repo_name := repo_name, file_key := file_key, kind := kind, deleted_at := deleted_at), arrived_at) AS r FROM symbols GROUP BY 1) WHERE r.deleted_at IS NULL)"""
_C = """c AS (SELECT site_key, r.* FROM (SELECT site_key, arg_max(struct_pack(owner_key := owner_key, target_key := target_key, status := status), arrived_at) AS r FROM call_sites GROUP BY 1))"""
_D = """g AS (SELECT diagnostic_key, r.* FROM (SELECT diagnostic_key, arg_max(struct_pack(file_key := file_key), arrived_at) AS r FROM parse_diagnostics GROUP BY 1))"""
_KNOWN = "IN (SELECT key FROM s)"

ORACLES = {
    "nodes_Repository": "SELECT DISTINCT repo_name AS key FROM repositories",
    "nodes_File": "SELECT DISTINCT file_key AS key FROM files",
    "nodes_Module": f"WITH {_F} SELECT DISTINCT snap || ':module:' || module_qname AS key FROM f WHERE module_qname IS NOT NULL",
    "nodes_ParseDiagnostic": "SELECT DISTINCT diagnostic_key AS key FROM parse_diagnostics WHERE file_key IN (SELECT file_key FROM files)",
    **{f"nodes_{label}": f"WITH {_S} SELECT key FROM s WHERE kind = '{kind}'" for kind, label in {**labelled.SYMBOL_LABELS, "module_init": "ModuleInit"}.items()},
    "nodes_CallSite": "SELECT DISTINCT site_key AS key FROM call_sites",
    "edges_CONTAINS": f"WITH {_F}, {_S} SELECT repo_name AS src, file_key AS dst FROM f WHERE repo_name IS NOT NULL UNION ALL SELECT held, key FROM s",
    "edges_DEFINES": f"WITH {_F} SELECT file_key AS src, snap || ':module:' || module_qname AS dst FROM f WHERE module_qname IS NOT NULL",
    "edges_HAS_DIAGNOSTIC": f"WITH {_D} SELECT file_key AS src, diagnostic_key AS dst FROM g WHERE file_key IN (SELECT file_key FROM files)",
    "edges_INITIALIZES": f"WITH {_F}, {_S} SELECT DISTINCT f.snap || ':module:' || f.module_qname AS src, s.key AS dst FROM s JOIN f ON f.file_key = s.held WHERE s.kind = 'module_init' AND f.module_qname IS NOT NULL",
    "edges_HAS_METHOD": _REFERENCE["has_method"].replace("SELECT DISTINCT type_key, key AS method_key", "SELECT DISTINCT type_key AS src, key AS dst"),
    "edges_IMPORTS": source_queries.ORACLES["imported_names"].replace("SELECT DISTINCT file_key, coalesce", "SELECT DISTINCT file_key AS src, split_part(file_key, ':', 1) || ':external-module:' || coalesce").replace("AS module, regexp_extract(part", "AS dst, regexp_extract(part"),
    "edges_INHERITS": f"WITH {_INH} SELECT child_key AS src, parent_key AS dst FROM inherits",
    "edges_HAS_CALLSITE": f"WITH {_S}, {_C} SELECT owner_key AS src, site_key AS dst FROM c WHERE owner_key {_KNOWN}",
    "edges_RESOLVES_TO": f"WITH {_S}, {_C} SELECT site_key AS src, target_key AS dst FROM c WHERE target_key {_KNOWN}",
    "edges_CALLS": f"WITH {_S}, {_C} SELECT owner_key AS src, target_key AS dst, site_key AS edge_key, status AS resolution FROM c WHERE owner_key {_KNOWN} AND target_key {_KNOWN}",
    "edges_EXACT_CALLS": f"WITH {_EDGES} SELECT src, dst, edge_key, resolution FROM edges",
}
