"""Queries of the general data problems (hierarchies, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.operators import hierarchy as H
from sorrel.operators import orphans as O
from sorrel.plans.runtime import table

SEP = "\x1f"


def _links(spark: SparkSession, d: str) -> DataFrame:
    group = lambda name: F.concat_ws(SEP, F.lit(name), F.coalesce("repo_name", F.lit("")))
    inh = H.clean_links(table(spark, d, "inheritance"), group("inheritance"), "type_qname", "base_qname")
    con = H.clean_links(table(spark, d, "symbols"), group("containment"), "qname", "parent_qname")
    return inh.unionAll(con)


def _ungroup(df: DataFrame, *cols) -> DataFrame:
    parts = F.split("grp", SEP)
    return df.select(parts[0].alias("hierarchy"), parts[1].alias("repo_name"), *cols)


def p1_found(spark, d):
    return _ungroup(H.cycle_nodes(_links(spark, d)), F.col("node").alias("qname"))


def p1_paths(spark, d):
    return _ungroup(H.paths(_links(spark, d)), F.col("node").alias("qname"), F.array_join("path", " > ").alias("path"), "depth", "root", "root_on_cycle", "on_cycle")


def p1_descendants(spark, d):
    return _ungroup(H.descendants(_links(spark, d)), F.col("node").alias("qname"), "descendant", "distance")


def p1_contracted(spark, d):
    """The nodes of p1_found with contraction to the end: no reduced graph is solved in one step."""
    return _ungroup(H.cycle_nodes(_links(spark, d), 0), F.col("node").alias("qname"))


def _orphans(spark, d):
    return O.orphan_references(table(spark, d, "call_sites"), table(spark, d, "inheritance"), table(spark, d, "symbols"))


def p6_found(spark, d):
    return _orphans(spark, d).select("ref_field", "row_key", "kind")


def p6_report(spark, d):
    return O.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_contracted, p1_paths, p1_descendants, p6_found, p6_report)}

_LINKS = """links AS (
  SELECT DISTINCT 'inheritance' AS hierarchy, repo_name, type_qname AS child, base_qname AS parent FROM inheritance WHERE type_qname IS NOT NULL AND base_qname IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'containment', repo_name, qname, parent_qname FROM symbols WHERE qname IS NOT NULL AND parent_qname IS NOT NULL
), reach AS (
  SELECT hierarchy, repo_name, child, parent FROM links
  UNION
  SELECT r.hierarchy, r.repo_name, r.child, l.parent FROM reach r JOIN links l ON l.hierarchy = r.hierarchy AND l.repo_name = r.repo_name AND l.child = r.parent
), cyc AS (SELECT DISTINCT hierarchy, repo_name, child AS qname FROM reach WHERE child = parent)"""

_CHAINS = f"""WITH RECURSIVE {_LINKS}, dag AS (
  SELECT l.* FROM links l LEFT JOIN cyc c ON c.hierarchy = l.hierarchy AND c.repo_name = l.repo_name AND c.qname = l.child WHERE c.qname IS NULL
), nodes AS (SELECT hierarchy, repo_name, child AS qname FROM links UNION SELECT hierarchy, repo_name, parent FROM links
), up AS (
  SELECT hierarchy, repo_name, qname, qname AS root, qname AS path, 0 AS depth, [qname] AS ns FROM nodes
  UNION ALL
  SELECT u.hierarchy, u.repo_name, u.qname, d.parent, d.parent || ' > ' || u.path, u.depth + 1, list_prepend(d.parent, u.ns) FROM up u JOIN dag d ON d.hierarchy = u.hierarchy AND d.repo_name = u.repo_name AND d.child = u.root
), whole AS (
  SELECT u.* FROM up u LEFT JOIN (SELECT DISTINCT hierarchy, repo_name, child FROM dag) d ON d.hierarchy = u.hierarchy AND d.repo_name = u.repo_name AND d.child = u.root WHERE d.child IS NULL
)"""

_P6 = """WITH refs AS (
  SELECT 'call_sites.owner_key' AS ref_field, site_key AS row_key, owner_key AS target, arrived_at FROM call_sites WHERE owner_key IS NOT NULL
  UNION ALL SELECT 'call_sites.target_key', site_key, target_key, arrived_at FROM call_sites WHERE target_key IS NOT NULL
  UNION ALL SELECT 'inheritance.base_qname', inherit_key, 'type' || chr(31) || repo_name || chr(31) || base_qname, arrived_at FROM inheritance WHERE base_qname IS NOT NULL
), r AS (SELECT ref_field, row_key, target, min(arrived_at) AS ref_at FROM refs GROUP BY 1, 2, 3
), keys AS (
  SELECT symbol_key, min(arrived_at) AS first_at, arg_max(deleted_at IS NOT NULL, arrived_at) AS deleted FROM symbols GROUP BY 1
), targets AS (
  SELECT symbol_key AS target, first_at, deleted FROM keys
  UNION ALL
  SELECT t.target, k.first_at, k.deleted FROM (SELECT DISTINCT symbol_key, 'type' || chr(31) || repo_name || chr(31) || qname AS target FROM symbols WHERE kind = 'type') t JOIN keys k USING (symbol_key)
), st AS (SELECT target, bool_and(deleted) AS deleted, min(first_at) FILTER (WHERE NOT deleted) AS alive_at FROM targets WHERE target IS NOT NULL GROUP BY 1
), o AS (
  SELECT ref_field, row_key, ref_at, CASE WHEN st.target IS NULL THEN 'missing' WHEN st.deleted THEN 'deleted' WHEN st.alive_at > ref_at THEN 'late' END AS kind FROM r LEFT JOIN st ON r.target = st.target
)"""

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT hierarchy, repo_name, qname FROM cyc",
    "p1_paths": _CHAINS + """ SELECT w.hierarchy, w.repo_name, w.qname, w.path, w.depth, w.root, c.qname IS NOT NULL AS root_on_cycle, (c.qname IS NOT NULL AND w.depth = 0) AS on_cycle
  FROM whole w LEFT JOIN cyc c ON c.hierarchy = w.hierarchy AND c.repo_name = w.repo_name AND c.qname = w.root""",
    "p1_contracted": f"WITH RECURSIVE {_LINKS} SELECT hierarchy, repo_name, qname FROM cyc",
    # simple ways up, and back to their start; the shortest way between two nodes is one of them
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}, ways AS (
  SELECT hierarchy, repo_name, child AS descendant, parent AS qname, 1 AS distance, [child, parent] AS seen FROM links
  UNION ALL
  SELECT w.hierarchy, w.repo_name, w.descendant, l.parent, w.distance + 1, list_append(w.seen, l.parent) FROM ways w JOIN links l ON l.hierarchy = w.hierarchy AND l.repo_name = w.repo_name AND l.child = w.qname
  WHERE w.descendant <> w.qname AND (NOT list_contains(w.seen, l.parent) OR l.parent = w.descendant)
) SELECT hierarchy, repo_name, qname, descendant, min(distance) AS distance FROM ways GROUP BY ALL""",
    "p6_found": _P6 + " SELECT ref_field, row_key, kind FROM o WHERE kind IS NOT NULL",
    "p6_report": _P6 + " SELECT ref_field, strftime(ref_at, '%Y-%m') AS month, kind, count(*) AS n FROM o WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
}
