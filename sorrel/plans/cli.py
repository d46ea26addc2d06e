"""Command line: bootstrap, index, reindex, index-all, list, delete, evaluate, bulk-export, bulk-import, bulk-docs, validate-bulk-index."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sorrel.operators.textsearch import consistency
from sorrel.plans import evaluation, labelled
from sorrel.plans import graph as G
from sorrel.plans.runtime import share_code
from sorrel.sources import export, scan
from sorrel.sources.store import DERIVED, SCHEMAS, Store


def load(spark: SparkSession, path: str | Path) -> tuple[str, G.Graph]:
    """Scan a repository tree and build its graph."""
    share_code(spark)
    repo, commit, root = scan.identity(path)
    g = G.from_sources(scan.scan(spark, path), scan.scan(spark, path, ".md"))
    g.repositories = spark.createDataFrame([(repo, commit, root)], "repo_name string, commit_sha string, root_path string").withColumn("indexed_at", F.current_timestamp())
    return repo, g


def rows_of(repo: str, g: G.Graph) -> dict:
    own = {n: getattr(g, n).withColumn("repo_name", F.lit(repo)) for n in SCHEMAS if n not in DERIVED}
    return own | {"nodes": labelled.node_rows(g).withColumn("repo_name", F.lit(repo)), "edges": labelled.edge_rows(g).withColumn("repo_name", F.lit(repo))}


def index(spark: SparkSession, store: Store, path: str | Path, loaded: tuple[str, G.Graph] | None = None) -> dict:
    """Replace a repository by its tree; raises, and leaves the store as it was, when documents and symbols disagree."""
    repo, g = loaded or load(spark, path)
    store.bootstrap()
    before = store.read("docs").where(F.col("repo_name") == repo).select("key")

    def check(read) -> None:
        live = read("symbols").where("kind in ('function', 'method')").select("key")
        bad = consistency(g.docs.select("key"), live, read("docs").select("key"), before).take(1)
        if bad:
            raise ValueError(f"{bad[0]['check']}: {bad[0]['key']}")

    store.replace(repo, rows_of(repo, g), check)
    store.prune()
    return {"repo_name": repo, "symbols": store.read("symbols").where(F.col("repo_name") == repo).count(), "files": store.read("files").where(F.col("repo_name") == repo).count()}


def stored(store: Store) -> G.Graph:
    return G.Graph(**{n: store.read(n) for n in SCHEMAS if n not in DERIVED})


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sorrel", description=__doc__)
    p.add_argument("--store", default="sorrel-store")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("bootstrap")
    sub.add_parser("list")
    for verb in ("index", "reindex"):
        sub.add_parser(verb).add_argument("path")
    sub.add_parser("index-all").add_argument("root")
    sub.add_parser("delete").add_argument("repo")
    e = sub.add_parser("evaluate")
    e.add_argument("--manifest", default="evaluation/corpora.json")
    e.add_argument("--output", default="evaluation/report.json")
    e.add_argument("--project-root", default=".")
    e.add_argument("--require-pins", action="store_true")
    b = sub.add_parser("bulk-export")
    b.add_argument("output")
    b.add_argument("paths")
    sub.add_parser("bulk-import").add_argument("manifest")
    for verb in ("bulk-docs", "validate-bulk-index"):
        sub.add_parser(verb).add_argument("paths")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("sorrel").getOrCreate()
    store = Store(spark, a.store)
    if a.verb == "bootstrap":
        store.bootstrap()
    elif a.verb in ("index", "reindex"):
        print(json.dumps(index(spark, store, a.path)))
    elif a.verb == "index-all":
        for path in scan.discovered(a.root):
            print(json.dumps(index(spark, store, path)))
    elif a.verb == "list":
        for r in G.list_repositories(stored(store)).collect():
            print(json.dumps(r.asDict(), default=str))
    elif a.verb == "delete":
        print(json.dumps({"deleted": store.delete(a.repo)}))
    elif a.verb == "evaluate":
        corpora = evaluation.check_manifest(json.loads(Path(a.manifest).read_text()))
        results = []
        for c in evaluation.preflight(corpora, Path(a.project_root), a.require_pins):
            if c["state"] == "ready":
                try:
                    loaded = load(spark, c["path"])
                    c |= {"state": "passed", "counts": index(spark, store, c["path"], loaded)}
                    c |= evaluation.compared(loaded[1], c.pop("truth", None))
                except Exception as x:  # noqa: BLE001 - a failed corpus is a result
                    c |= {"state": "failed", "error": str(x)[:300]}
            results.append(c)
        evaluation.write_report(results, Path(a.output))
        return int(any(r["state"] == "failed" for r in results))
    elif a.verb == "bulk-export":
        for path in scan.checked_roots(a.paths):
            repo, g = load(spark, path)
            print(export.export(g, Path(a.output) / repo))
    elif a.verb == "bulk-import":
        m = export.read_manifest(a.manifest)
        export.reload(spark, a.manifest)
        print(json.dumps(m["counts"], sort_keys=True))
    else:
        for path in scan.checked_roots(a.paths):
            repo, g = load(spark, path)
            if a.verb == "bulk-docs":
                store.replace(repo, {"docs": g.docs.withColumn("repo_name", F.lit(repo))})
            else:
                # what is indexed against what the sources say: missing documents, and stale ones that are still there
                docs = store.read("docs").where(F.col("repo_name") == repo).select("key")
                live = g.symbols.where(F.col("kind").isin(*G.CALLABLES)).select("key")
                bad = consistency(g.docs.select("key"), live, docs, docs).count()
                print(json.dumps({"repo_name": repo, "inconsistent": bad}))
                if bad:
                    return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
