"""Markdown notes as chunks, and the dotted names they mention."""

from __future__ import annotations

import fnmatch
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of headings and of dotted names
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")
MENTION = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)\b")
LONGEST_MENTION = 120
FENCES = ("```", "~~~")


def mentions(text: str) -> list[str]:
    """Dotted names in order of first use."""
    return [m for m in dict.fromkeys(MENTION.findall(text)) if len(m) <= LONGEST_MENTION]


Place = tuple[int, int]  # lines, 0-based and half open


def sections(lines: list[str], name: str) -> list[tuple[str, Place]]:
    """Heading path and place of each section; what stands before the first heading is left out."""
    heads = [(k, m) for k, line in enumerate(lines) if (m := HEADING.match(line))]
    # the titles above a heading are those of lower level that no heading in between has closed
    paths = accumulate(((len(m.group(1)), m.group(2).strip()) for _, m in heads), lambda above, head: [*takewhile(lambda t: t[0] < head[0], above), head], initial=[])
    starts = [k for k, _ in heads] + [len(lines)]
    named = [" > ".join(title for _, title in path) for path in list(paths)[1:]]
    return list(zip(named, zip(starts, starts[1:]))) if heads else [(name, (0, len(lines)))]


def fences(lines: list[str], place: Place) -> list[Place]:
    """Fenced blocks of a section; a fence that nothing closes is a block of one line."""
    at: dict[str, list[int]] = {mark: [k for k in range(*place) if lines[k].lstrip().startswith(mark)] for mark in FENCES}
    out: list[Place] = []
    for k, mark in sorted((k, mark) for mark, ks in at.items() for k in ks):
        if not out or k >= out[-1][1]:
            later = bisect_right(at[mark], k)
            out.append((k, (at[mark][later] if later < len(at[mark]) else k) + 1))
    return out


def ranges(lines: list[str], place: Place) -> list[Place]:
    """Fenced blocks and the prose between them, in order."""
    blocks = fences(lines, place)
    edges = [place[0], *(x for b in blocks for x in b), place[1]]
    prose = [p for p in zip(edges[::2], edges[1::2]) if p[0] < p[1]]
    return sorted(prose + blocks)


def chunks(path: str, text: str) -> list[dict]:
    lines, out = text.splitlines(), []
    for heading, place in sections(lines, path.rsplit("/", 1)[-1]):
        for a, b in ranges(lines, place):
            body = "\n".join(lines[a:b]).strip()
            if body:
                out.append({"chunk_index": len(out), "heading_path": heading, "start_line": a + 1, "end_line": b, "text": body, "mentions": mentions(body)})
    return out


def chunk_notes(notes: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """``notes``: repo_name, commit_sha, path, content. Chunks of the .md files whose path matches a glob (all without globs)."""
    schema = "repo_name string, commit_sha string, path string, chunk_index int, heading_path string, start_line int, end_line int, text string, mentions array<string>"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            rows = [{"repo_name": r, "commit_sha": c, "path": p} | x for r, c, p, t in zip(pdf["repo_name"], pdf["commit_sha"], pdf["path"], pdf["content"]) for x in chunks(p, t)]
            yield pd.DataFrame(rows, columns=names)

    keep = F.lower("path").endswith(".md") & F.col("content").isNotNull()
    if globs:
        keep = keep & F.col("path").rlike("|".join(f"(?:{fnmatch.translate(g)})".replace(r"\Z", "$").replace(r"\z", "$") for g in globs))
    return notes.where(keep).select("repo_name", "commit_sha", "path", "content").mapInPandas(run, schema)


def descriptions(chunked: DataFrame, symbols: DataFrame) -> DataFrame:
    """qname, texts: chunk texts, in order of file and chunk, that mention a function's or method's exact name."""
    known = symbols.where("kind in ('function', 'method')").select("repo_name", "commit_sha", "qname").distinct()
    said = chunked.select("repo_name", "commit_sha", "path", "chunk_index", "text", F.explode("mentions").alias("qname"))
    hit = said.join(known, ["repo_name", "commit_sha", "qname"])
    return hit.groupBy("repo_name", "commit_sha", "qname").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "chunk_index", "text"))), lambda x: x["text"]).alias("texts"))
