"""The ten read-only tools with checked bounds, row caps, timeouts and errors that name their operation."""

from __future__ import annotations

import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame

from sorrel.functions.scalars import MAX_DEPTH, MAX_PATHS, MAX_ROWS
from sorrel.plans import graph as G

DEFAULT_TIMEOUT = 30.0
BOUNDS = {"limit": (1, MAX_ROWS), "depth": (1, MAX_DEPTH), "max_depth": (1, MAX_DEPTH), "top_n": (1, MAX_ROWS)}
CHOICES = {"kind": (None, "function", "method", "type"), "mode": ("graph", "lexical"), "direction": ("ancestors", "descendants")}


class ReadError(RuntimeError):
    """A read that failed or ran out of time; the message names the operation."""


def read_rows(df: DataFrame, operation: str, max_rows: int = 1000, timeout: float = DEFAULT_TIMEOUT) -> list[dict[str, Any]]:
    """At most ``max_rows`` rows as dicts; after ``timeout`` seconds the read's jobs are cancelled."""
    sc = df.sparkSession.sparkContext
    group, late = f"sorrel-{uuid.uuid4().hex}", threading.Event()
    sc.setJobGroup(group, operation, interruptOnCancel=True)
    timer = threading.Timer(timeout, lambda: (late.set(), sc.cancelJobGroup(group)))
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.limit(max_rows).collect()]
    except G.SymbolResolutionError:
        raise
    except Exception as e:
        raise ReadError(f"{operation}: {'timed out' if late.is_set() else e}") from e
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


class Tools:
    """Read tools over one graph. Arguments outside their bounds are errors; nothing here writes."""

    names = ("list_repositories", "search_symbols", "get_definition", "find_callers", "find_callees", "trace_call_path", "find_importers", "get_class_hierarchy", "find_dead_code", "get_complexity")

    def __init__(self, graph: G.Graph, timeout: float = DEFAULT_TIMEOUT):
        self.graph, self.timeout = graph, timeout

    def call(self, name: str, *args: Any, **kwargs: Any) -> list[dict[str, Any]]:
        if name not in self.names:
            raise ValueError(f"unknown tool {name}")
        for k, v in kwargs.items():
            low, high = (1, MAX_PATHS) if (name, k) == ("trace_call_path", "limit") else BOUNDS.get(k, (None, None))
            if low is not None and v is not None and not low <= v <= high:
                raise ValueError(f"{k} must lie between {low} and {high}")
            if k in CHOICES and v not in CHOICES[k]:
                raise ValueError(f"{k} must be one of {CHOICES[k]}")
        return read_rows(getattr(G, name)(self.graph, *args, **kwargs), name, MAX_ROWS, self.timeout)
