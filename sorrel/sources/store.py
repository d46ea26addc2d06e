"""Parquet tables of the graph, by repository, published by generation.

A generation is what one publication wrote: in each table's folder a folder ``gen=<id>``, and in that one the repository's
folder ``repo_name=<repository>``. ``CURRENT`` maps every table and repository to the folder that readers use; it is replaced
atomically after validation. So a repository is replaced without touching the rows of any other one, a failed publish
leaves everything as it was, and readers of the pointer before still find their files until the next ``prune``. The root
is a folder of a file system that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.functions.scalars import stable_json

S, I, L = T.StringType(), T.IntegerType(), T.LongType()  # noqa: E741
_type = lambda *cols: T.StructType([T.StructField(n, t) for n, t in cols])
SCHEMAS = {
    "repositories": _type(("repo_name", S), ("commit_sha", S), ("root_path", S), ("indexed_at", T.TimestampType())),
    "files": _type(("file_key", S), ("repo_name", S), ("commit_sha", S), ("path", S), ("language", S), ("loc", I), ("parse_status", S), ("module_qname", S)),
    "symbols": _type(("key", S), ("repo_name", S), ("commit_sha", S), ("path", S), ("kind", S), ("name", S), ("qname", S), ("signature", S), ("start_line", I), ("end_line", I), ("cyclomatic", I), ("parent_qname", S)),
    "sites": _type(("site_key", S), ("repo_name", S), ("commit_sha", S), ("owner_key", S), ("target_key", S), ("resolution", S)),
    "inherits": _type(("child_key", S), ("parent_key", S), ("repo_name", S)),
    "imports": _type(("repo_name", S), ("commit_sha", S), ("path", S), ("module", S), ("imported_name", S), ("alias", S)),
    "docs": _type(("key", S), ("repo_name", S), ("kind", S), ("text", S)),
    "inits": _type(("key", S), ("repo_name", S), ("commit_sha", S), ("path", S), ("name", S), ("qname", S), ("start_line", I), ("end_line", I)),
    "diagnostics": _type(("diagnostic_key", S), ("file_key", S), ("repo_name", S), ("category", S), ("severity", S), ("line_no", I), ("column_no", I), ("message", S)),
    "constructs": _type(("edge_key", S), ("src_key", S), ("type_key", S), ("resolution", S), ("repo_name", S)),
    "nodes": _type(("label", S), ("key", S), ("repo_name", S)),
    "edges": _type(("type", S), ("src", S), ("dst", S), ("repo_name", S), ("edge_key", S), ("resolution", S), ("name", S), ("alias", S)),
}
DERIVED = ("nodes", "edges")  # rewritten from the other tables with every publication
KEYS = {"files": "file_key", "symbols": "key", "sites": "site_key", "docs": "key", "inits": "key", "diagnostics": "diagnostic_key", "nodes": "key"}


class StoreError(RuntimeError):
    """A missing table, an inconsistent generation, or a failed publish, with the operation's name."""


class Store:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)

    @property
    def current(self) -> dict | None:
        """table -> repository -> folder below the root."""
        pointer = self.root / "CURRENT"
        return json.loads(pointer.read_text())["tables"] if pointer.exists() else None

    def bootstrap(self) -> None:
        """Create the folder and an empty pointer; does nothing when there is one."""
        if self.current is None:
            self.root.mkdir(parents=True, exist_ok=True)
            self._point({n: {} for n in SCHEMAS})

    def _point(self, tables: dict) -> None:
        before = self.current or {}
        staged = self.root / f".CURRENT.{uuid.uuid4().hex[:12]}"
        staged.write_text(stable_json({"tables": tables, "before": sorted({f.split("/")[1] for t in before.values() for f in t.values()})}))
        os.replace(staged, self.root / "CURRENT")

    def read(self, name: str) -> DataFrame:
        now = self.current
        if now is None or name not in now:
            raise StoreError(f"read {name}: no published table")
        return self._rows(name, [str(self.root / f) for f in now[name].values()])

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        fields = SCHEMAS[name].fieldNames()
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", str(self.root / name)).parquet(*folders).select(fields)

    def replace(self, repo: str, tables: dict[str, DataFrame], validate: Callable[[Callable[[str], DataFrame]], None] | None = None) -> str:
        """All commits of ``repo`` give way to ``tables``, in those tables only; rows of one key are merged.

        ``validate`` gets a function that reads the repository's new rows of a table. Returns the generation's name."""
        self.bootstrap()
        gen = f"gen={uuid.uuid4().hex[:12]}"
        now = {n: dict(t) for n, t in self.current.items()}
        new: dict[str, list[str]] = {}
        try:
            for name, df in tables.items():
                if name in KEYS:
                    df = df.dropDuplicates([KEYS[name]])
                df.select(*SCHEMAS[name].fieldNames()).write.partitionBy("repo_name").parquet(str(self.root / name / gen))
                written = sorted(p.name for p in (self.root / name / gen).glob("repo_name=*"))
                if len(written) > 1:
                    raise ValueError(f"{name}: rows of another repository")
                new[name] = [f"{name}/{gen}/{p}" for p in written]
                now.setdefault(name, {}).pop(repo, None)
                now[name] |= {repo: f for f in new[name]}
            if validate:
                validate(lambda name: self._rows(name, [str(self.root / f) for f in new.get(name, [])]))
        except Exception as e:
            for name in tables:
                shutil.rmtree(self.root / name / gen, ignore_errors=True)
            raise StoreError(f"publish: {e}") from e
        self._point(now)
        return gen

    def prune(self) -> list[str]:
        """Remove generations that neither the pointer nor the one before it names; returns their names."""
        state = json.loads((self.root / "CURRENT").read_text())
        used = {f.split("/")[1] for t in state["tables"].values() for f in t.values()} | set(state["before"])
        gone = [p for p in self.root.glob("*/gen=*") if p.name not in used]
        for p in gone:
            shutil.rmtree(p, ignore_errors=True)
        return sorted({p.name for p in gone})

    def delete(self, repo: str) -> int:
        """Rows deleted of all node tables (the repository counts as one); 0 for an unknown repository."""
        self.bootstrap()
        now = self.current
        n = sum(self.read(t).where(F.col("repo_name") == repo).count() for t in ("files", "symbols", "sites"))
        n += repo in now["repositories"]
        if n:
            self._point({name: {r: f for r, f in t.items() if r != repo} for name, t in now.items()})
        return n
