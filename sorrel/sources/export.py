"""Deterministic CSV export of a graph with a manifest, its validation, and the way back."""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions.scalars import stable_json
from sorrel.operators.evaluate import dangling, duplicate_keys
from sorrel.plans import labelled
from sorrel.plans.graph import Graph

VERSION = 1
TYPED = {"start_line": "start_line:int", "end_line": "end_line:int", "cyclomatic": "cyclomatic:int", "loc": "loc:int", "line_no": "line:int", "column_no": "column:int", "commit_sha": "commit", "edge_key": "key"}


class ExportError(ValueError):
    """A graph that must not be exported, or an export that cannot be read."""


def nodes(g: Graph) -> dict[str, tuple[tuple[str, ...], DataFrame]]:
    """label -> header and rows (first column: the key)."""
    return {label: (("key:ID", *(TYPED.get(c, c) for c in df.columns[1:])), df) for label, df in labelled.nodes(g).items()}


def edges(g: Graph) -> dict[str, tuple[tuple[str, ...], DataFrame]]:
    """type -> header and rows (start, end first)."""
    out = {}
    for kind, df in labelled.edges(g).items():
        rows = df.drop("repo_name")
        out[kind] = ((":START_ID", ":END_ID", *(TYPED.get(c, c) for c in rows.columns[2:])), rows)
    return out


def validate(g: Graph) -> None:
    """Duplicate node keys, dangling ends and duplicate edge keys, found before any file is written.

    Two files of one module are refused, too. Equal imports are one edge; constructions have one key for two edges."""
    twice = duplicate_keys(labelled.node_rows(g), "key").take(1)
    if twice:
        raise ExportError(f"node key {twice[0].key} is there twice")
    modules = g.files.where("module_qname is not null").groupBy("repo_name", *(["commit_sha"] if "commit_sha" in g.files.columns else []), "module_qname").agg(F.count_distinct("file_key").alias("n")).where("n > 1").take(1)
    if modules:
        raise ExportError(f"module {modules[0].module_qname} has {modules[0].n} files")
    all_edges = labelled.edge_rows(g)
    ends = all_edges.select(F.col("type").alias("edge_key"), F.explode(F.array("src", "dst")).alias("end"))
    lost = dangling(ends, labelled.node_rows(g)).take(1)
    if lost:
        raise ExportError(f"{lost[0].edge_key} ends at {lost[0].end}, which is no node")
    repeated = all_edges.where("edge_key is not null and type <> 'CONSTRUCTS'").groupBy("type", "edge_key").count().where("count > 1").take(1)
    if repeated:
        raise ExportError(f"edge key {repeated[0].edge_key} is there twice")


def _text(v: object) -> str:
    return "" if v is None else ";".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)


def export(g: Graph, out: str | Path) -> Path:
    """One file per label and edge type that has rows, sorted by key, ``\\n`` line ends; returns the manifest's path.

    Sorting is Spark's; rows then stream through the driver one partition at a time, never as a whole.
    """
    validate(g)
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    manifest: dict = {"version": VERSION, "output_dir": ".", "nodes": {}, "relationships": {}, "counts": {}}
    for group, prefix, mark, items in (("nodes", "nodes_", ":LABEL", nodes(g)), ("relationships", "relationships_", ":TYPE", edges(g))):
        for name, (header, df) in items.items():
            n = 0
            path = out / f"{prefix}{name}.csv"
            part = path.with_suffix(".part")
            with part.open("w", newline="", encoding="utf-8") as f:
                w = csv.writer(f, lineterminator="\n")
                w.writerow([*header, mark])
                for row in df.orderBy(*df.columns).toLocalIterator():
                    w.writerow([*map(_text, row), name])
                    n += 1
            if n:
                os.replace(part, path)
                manifest[group][name] = {"file": path.name, "count": n}
            else:
                part.unlink()
        manifest["counts"][group] = sum(x["count"] for x in manifest[group].values())
    target = out / "manifest.json"
    staged = out / ".manifest.json.part"
    staged.write_text(stable_json(manifest))
    os.replace(staged, target)
    return target


def read_manifest(path: str | Path) -> dict:
    """The manifest with absolute paths; files it names must exist."""
    path = Path(path)
    try:
        m = json.loads(path.read_text())
    except (OSError, ValueError) as e:
        raise ExportError(f"no manifest at {path}: {e}") from e
    if m.get("version") != VERSION:
        raise ExportError(f"unknown manifest version {m.get('version')}")
    base = (path.parent / m.get("output_dir", ".")).resolve()
    for group in ("nodes", "relationships"):
        for name, item in m.get(group, {}).items():
            item["path"] = str(base / item["file"])
            if not Path(item["path"]).is_file():
                raise ExportError(f"{name}: {item['path']} is missing")
    return m


def reload(spark: SparkSession, manifest: str | Path) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The nodes by label and the edges by type of an export, numbers as numbers; rows are counted against the manifest."""
    m = read_manifest(manifest)
    out = []
    for group in ("nodes", "relationships"):
        tables = {}
        for name, item in m[group].items():
            df = read_back(spark, manifest, group, name)
            df = df.select(*[F.col(f"`{c}`").cast("int").alias(c[:-4]) if c.endswith(":int") else F.col(f"`{c}`").alias({"key:ID": "key", ":START_ID": "src", ":END_ID": "dst"}.get(c, c)) for c in df.columns])
            n = df.count()
            if n != item["count"]:
                raise ExportError(f"{name}: {n} rows, {item['count']} in the manifest")
            tables[name] = df
        out.append(tables)
    return out[0], out[1]


def read_back(spark: SparkSession, manifest: str | Path, group: str, name: str) -> DataFrame:
    """A file of an export as a DataFrame of strings; empty text is null."""
    item = read_manifest(manifest)[group].get(name)
    if item is None:
        raise ExportError(f"no {name} in the manifest")
    with open(item["path"], encoding="utf-8") as f:
        header = next(csv.reader(f))
    schema = ", ".join(f"`{h}` string" for h in header)
    return spark.read.csv(item["path"], schema=schema, header=True, multiLine=True, escape='"', nullValue="")
