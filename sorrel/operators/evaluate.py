"""Checks of a graph against its sources, its own rules, and a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.functions.scalars import ratio
from sorrel.operators.resolve import EXACT


def key_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, rows, keys, repeated: one pass per table."""
    out = None
    for name, (df, key) in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).withColumn("repeated", F.col("rows") - F.col("keys"))
        out = row if out is None else out.unionAll(row)
    return out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (edge_key, end) whose end is no node (key)."""
    return edges.join(nodes.select(F.col("key").alias("end")), "end", "left_anti").select("edge_key", "end")


def set_difference(truth: DataFrame, found: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of one side only, with ``difference``: missing or extra."""
    t, n = truth.select(cols).distinct(), found.select(cols).distinct()
    return t.exceptAll(n).withColumn("difference", F.lit("missing")).unionAll(n.exceptAll(t).withColumn("difference", F.lit("extra")))


def call_site_difference(truth: DataFrame, found: DataFrame, identity: list[str]) -> DataFrame:
    """Full outer join by identity: missing, extra, mismatch of status; equal sites leave no row."""
    t = truth.select(*identity, F.col("status").alias("want")).distinct().withColumn("t", F.lit(1))
    n = found.select(*identity, F.col("status").alias("got")).distinct().withColumn("n", F.lit(1))
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("t").isNull(), "extra").when(~F.col("want").eqNullSafe(F.col("got")), "mismatch")
    return t.join(n, identity, "full").withColumn("difference", kind).where("difference is not null").drop("t", "n")


def projection_completeness(sites: DataFrame, edges: DataFrame, strict_reference: bool = True) -> DataFrame:
    """status, n, projected, incomplete. Strict: exactly the exact statuses may be projected; else constructor sites with an initializer, too."""
    j = sites.select("site_key", "status").join(edges.select(F.col("edge_key").alias("site_key")).distinct().withColumn("e", F.lit(True)), "site_key", "left")
    projected = F.coalesce("e", F.lit(False))
    exact = F.col("status").isin(*EXACT)
    wrong = ~exact.eqNullSafe(projected)
    if not strict_reference:
        wrong = wrong & ~(F.col("status").startswith("constructor_exact") & projected)
    return j.groupBy("status").agg(F.count("*").alias("n"), F.sum(projected.cast("int")).alias("projected"), F.sum(wrong.cast("int")).alias("incomplete"))


def lexical_metrics(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """``ranked``: query_id, key, rank; ``truth``: query_id, target. One row: top1, recall5, mrr (six decimals), zero_results (share of queries without rows)."""
    hit = truth.join(ranked, (truth.query_id == ranked.query_id) & (truth.target == ranked.key), "left").select(truth.query_id.alias("q"), "rank")
    any_ = ranked.select(F.col("query_id").alias("q"), F.lit(1).alias("some")).distinct()
    h = hit.join(any_, "q", "left")
    n = F.count("*")
    return h.agg(
        ratio(F.sum((F.coalesce("rank", F.lit(0)) == 1).cast("int")), n).alias("top1"), ratio(F.sum((F.col("rank") <= 5).cast("int")), n).alias("recall5"),
        ratio(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))), n).alias("mrr"), ratio(F.sum(F.col("some").isNull().cast("int")), n).alias("zero_results"))


def structural_metrics(g) -> DataFrame:
    """metric, n: symbols by kind, call sites, resolved sites, calls, inheritance edges, and sites by status."""
    out = g.symbols.groupBy(F.concat(F.lit("symbols_"), "kind").alias("metric")).agg(F.count("*").alias("n"))
    one = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
    for part in (one(g.sites, "call_sites"), one(g.sites.where("target_key is not null"), "resolves_to"), one(g.edges, "exact_calls"), one(g.inherits, "inherits")):
        out = out.unionAll(part)
    return out.unionAll(g.sites.groupBy(F.concat(F.lit("status_"), F.coalesce("resolution", F.lit("none"))).alias("metric")).agg(F.count("*").alias("n")))
