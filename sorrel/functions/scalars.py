"""Scalar functions as Column expressions (JVM side)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_DEPTH, MAX_PATHS = 500, 10, 10
SNIPPET = 240


def normalize_name(c) -> Column:
    """Last dotted part, cut at case changes and non-word signs, in lower case: ``do_failoverDecision`` gives ``do failover decision``."""
    last = F.substring_index(F.col(c) if isinstance(c, str) else c, ".", -1)
    return F.array_join(F.transform(F.filter(F.split(last, r"(?<=[a-z0-9])(?=[A-Z])|[_\W]+"), lambda x: x != ""), F.lower), " ")


def symbol_text(name, qname, signature, docstring, texts=None) -> Column:
    """Name, normalised name, qualified name, signature, docstring and notes, those that exist, one after the other."""
    parts = F.array(*[F.col(x) for x in (name,)], normalize_name(name), F.col(qname), F.col(signature), F.col(docstring))
    parts = F.concat(parts, F.coalesce(F.col(texts), F.array().cast("array<string>"))) if texts else parts
    return F.trim(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n"))


def snippet(c) -> Column:
    """White space collapsed; beyond 240 characters the first 239 and an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > SNIPPET, F.concat(F.rtrim(F.substring(flat, 1, SNIPPET - 1)), F.lit("..."))).otherwise(flat)


def fulltext_query(text: str) -> str:
    """The words joined by AND; no words match everything."""
    return " AND ".join(re.findall(r"\w+", text)) or "*:*"


def clamp_rows(n: int) -> int:
    return max(1, min(int(n), MAX_ROWS))


def clamp_depth(n: int) -> int:
    return max(1, min(int(n), MAX_DEPTH))


def clamp_paths(n: int) -> int:
    return max(1, min(int(n), MAX_PATHS))


def doc_id(c) -> Column:
    return F.sha2(c, 256)


def looks_like_key(text: str) -> bool:
    return "@" in text and ":" in text


def csv_value(c) -> Column:
    """Null as empty text, lists joined by semicolons."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def csv_list(c) -> Column:
    return F.coalesce(F.array_join(c, ";"), F.lit(""))


def ratio(hit: Column, total: Column) -> Column:
    """Six decimals; an empty total is a full score."""
    return F.when(total == 0, F.lit(1.0)).otherwise(F.round(hit / total, 6))


def percentile_50(c: str) -> Column:
    """The lower middle of the sorted values, by Spark's exact discrete percentile."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")


def percentile_95(c: str) -> Column:
    """Nearest rank."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")


def stable_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, indent=2) + "\n"
