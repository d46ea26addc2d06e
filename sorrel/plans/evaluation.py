"""Evaluation corpora: manifest rules, pins, and the report."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
import time
from pathlib import Path

from pyspark.sql import functions as F

from sorrel.functions.scalars import stable_json
from sorrel.operators import evaluate as E
from sorrel.plans import labelled
from sorrel.sources.scan import git_head

KINDS = {"synthetic", "dogfood", "external"}
REQUIRED_KINDS = {"synthetic", "dogfood"}
# fixed values: the shapes of pins
PINS = {"git_commit": r"[0-9a-f]{40}", "content_sha256": r"[0-9a-f]{64}", "git_commit_env": r"[A-Z_][A-Z0-9_]*", "working_tree": r"report"}


class EvaluationError(ValueError):
    """A manifest or corpus that must not be evaluated."""


def check_manifest(m: dict) -> list[dict]:
    if m.get("version") != 1:
        raise EvaluationError("version must be 1")
    corpora = m.get("corpora") or []
    ids = [c.get("id") for c in corpora]
    if len(set(ids)) != len(ids) or not all(ids):
        raise EvaluationError("corpus ids must be unique")
    if not REQUIRED_KINDS <= {c.get("kind") for c in corpora}:
        raise EvaluationError(f"kinds {sorted(REQUIRED_KINDS)} are required")
    for c in corpora:
        if c["kind"] not in KINDS:
            raise EvaluationError(f"{c['id']}: unknown kind {c['kind']}")
        if ("path" in c) == ("path_env" in c):
            raise EvaluationError(f"{c['id']}: exactly one of path and path_env")
        pin = c.get("pin") or {}
        if len(pin) != 1 or not all(k in PINS and re.fullmatch(PINS[k], str(v)) for k, v in pin.items()):
            raise EvaluationError(f"{c['id']}: exactly one valid pin")
    return corpora


def tree_digest(root: Path) -> str:
    """SHA-256 over relative paths and bytes of all files, separated by NUL."""
    digest = hashlib.sha256()
    for p in sorted(x for x in root.rglob("*") if x.is_file()):
        digest.update(p.relative_to(root).as_posix().encode() + b"\0" + p.read_bytes() + b"\0")
    return digest.hexdigest()


SITE = ["owner_qname", "start_line", "start_column", "ordinal", "raw_callee"]
EDGES = ("has_method", "inherits", "calls")


def load_truth(path: Path) -> dict:
    """call_sites (rows of SITE and status), all or none of the edge lists (pairs of qualified names), statuses (their counts), lexical (query and target)."""
    try:
        truth = json.loads(path.read_text())
    except (OSError, ValueError) as e:
        raise EvaluationError(f"no truth at {path}: {e}") from e
    if not isinstance(truth, dict) or 0 < sum(k in truth for k in EDGES) < len(EDGES):
        raise EvaluationError(f"{path}: all of {EDGES} or none")
    if not all(set(SITE) | {"status"} <= set(r) for r in truth.get("call_sites", [])):
        raise EvaluationError(f"{path}: a call site lacks a field")
    return truth


def compared(g, truth: dict | None) -> dict:
    """state and the differences of a graph (from sources) from its truth; a corpus without truth passes."""
    if truth is None:
        return {"state": "passed"}
    spark, out = g.symbols.sparkSession, {}
    if "call_sites" in truth:
        want = spark.createDataFrame([tuple(r[c] for c in (*SITE, "status")) for r in truth["call_sites"]], "owner_qname string, start_line int, start_column int, ordinal int, raw_callee string, status string")
        out["call_sites"] = [r.asDict() for r in E.call_site_difference(want, g.resolved, SITE).orderBy(*SITE).take(100)]
    if EDGES[0] in truth:
        names = g.symbols.select("key", "qname").unionAll(g.inits.select("key", "qname"))
        found = labelled.edges(g)
        for kind in EDGES:
            e = found[kind.upper()].join(names.select(F.col("key").alias("src"), F.col("qname").alias("a")), "src").join(names.select(F.col("key").alias("dst"), F.col("qname").alias("b")), "dst")
            want = spark.createDataFrame([tuple(x) for x in truth[kind]], "a string, b string")
            out[kind] = [r.asDict() for r in E.set_difference(want, e, ["a", "b"]).orderBy("a", "b").take(100)]
    if "statuses" in truth:
        got = {r.status: r["count"] for r in g.resolved.groupBy("status").count().collect()}
        out["statuses"] = [] if got == truth["statuses"] else [{"want": truth["statuses"], "got": got}]
    result = {"state": "failed" if any(out.values()) else "passed", "differences": out}
    return result | ({"lexical": lexical(g, truth["lexical"])} if "lexical" in truth else {})


def lexical(g, queries: list[dict], runs: int = 5) -> dict:
    """Rank metrics of the queries, and the times of ``runs`` runs of each (milliseconds, three decimals)."""
    from sorrel.operators.textsearch import top_documents

    spark, ranked, times = g.docs.sparkSession, [], []
    for k, q in enumerate(queries):
        for _ in range(runs):
            t = time.perf_counter()
            rows = top_documents(g.docs, q["query"], 25).collect()
            times.append(1000 * (time.perf_counter() - t))
        ranked += [(k, r.key, r.rank) for r in rows]
    metrics = E.lexical_metrics(spark.createDataFrame(ranked, "query_id int, key string, rank int"), spark.createDataFrame([(k, q["target"]) for k, q in enumerate(queries)], "query_id int, target string")).first().asDict()
    times.sort()
    n = len(times)
    return metrics | ({"p50_ms": round(times[(n - 1) // 2], 3), "p95_ms": round(times[max(0, -(-95 * n // 100) - 1)], 3)} if n else {})


def working_tree(root: Path) -> dict:
    """What a tree without a fixed pin is: commit, whether files differ from it (null without git), digest."""
    try:
        dirty = bool(subprocess.run(["git", "-C", str(root), "status", "--porcelain"], capture_output=True, text=True, check=True).stdout.strip())
    except (OSError, subprocess.CalledProcessError):
        dirty = None
    return {"commit": git_head(root), "dirty": dirty, "digest": tree_digest(root)}


def preflight(corpora: list[dict], project_root: Path, require_pins: bool = False) -> list[dict]:
    """Resolve and pin-check every corpus before anything changes: id, path, state (ready or skipped), pin state, truth."""
    out, names = [], set()
    for c in corpora:
        raw = c.get("path") or os.environ.get(c.get("path_env", ""), "")
        path = (project_root / raw).resolve() if raw else None
        if path is None or not path.is_dir():
            if c.get("required"):
                raise EvaluationError(f"{c['id']}: no directory")
            out.append({"id": c["id"], "state": "skipped"})
            continue
        if path.name in names:
            raise EvaluationError(f"two corpora named {path.name}")
        names.add(path.name)
        (kind, want), state = next(iter(c["pin"].items())), "pinned"
        if kind == "content_sha256":
            ok = tree_digest(path) == want
        elif kind == "working_tree":
            ok, state = True, "reported"
        else:
            want = os.environ.get(want, "") if kind == "git_commit_env" else want
            if not want and not require_pins:
                ok, state = True, "optional_unpinned"
            else:
                ok = bool(want) and (git_head(path) or "").lower() == want.lower()
        if not ok:
            raise EvaluationError(f"{c['id']}: the pin does not hold")
        ready = {"id": c["id"], "state": "ready", "path": str(path), "pin": state}
        if kind == "working_tree":
            ready["tree"] = working_tree(path)
        if "truth" in c:
            ready["truth"] = load_truth(project_root / c["truth"])
        out.append(ready)
    return out


def summary(results: list[dict]) -> dict:
    return {s: sum(r.get("state") == s for r in results) for s in ("passed", "failed", "skipped")}


def write_report(results: list[dict], out: Path) -> None:
    out.write_text(stable_json({"results": results, "summary": summary(results)}))
