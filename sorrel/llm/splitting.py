"""Splitting oversized items at natural boundaries by agglomerative merging.

A text longer than ``limit`` code points is cut into atomic segments (headings, code blocks, paragraphs, lines,
sentences, words; pieces of a word only when it exceeds the limit alone). Each boundary between neighbours has a
strength. A heap holds the adjacent pairs; the weakest boundary whose sides fit together, with the overlap, is merged
first, until nothing fits. Each piece but the first begins with up to ``overlap`` last characters of the piece before,
cut at a word where possible.

A null or short text gives one piece, unchanged (empty and null texts too). Repeated rows give equal pieces: one set per
key and row content. Null or wrong line numbers stay as they are: lines are counted from ``start_line`` when it is given,
else null. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1600
OVERLAP = 160

# boundary strengths: the weakest is merged first
INSIDE, WORD, SENTENCE, LINE, PARAGRAPH, BLOCK, HEADING = range(7)

FENCE = re.compile(r"[ ]{0,3}(?:```|~~~)")
HEAD = re.compile(r"[ ]{0,3}#{1,6}\s|={2,6}\s*[^=\n]+={2,6}\s*$|<h[1-6][\s>]|\\(?:sub)*section\{", re.I)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
SPACE = re.compile(r"(?<=\s)(?=\S)")


def atoms(text: str, room: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before) of segments of at most ``room`` characters, in order, without gaps."""
    out: list[tuple[int, int, int]] = []
    at, fenced, blank = 0, False, True
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        strength = LINE
        if FENCE.match(line):
            strength = LINE if fenced else BLOCK
            fenced = not fenced
        elif fenced:
            strength = WORD  # keep code blocks whole while they fit
        elif HEAD.match(line):
            strength = HEADING
        elif blank:
            strength = PARAGRAPH
        if not line.strip():
            strength = WORD  # blank lines stay with what they follow
        blank = not line.strip()
        out += _within(text, at, end, strength, room)
        at = end
    return out


def _within(text: str, start: int, end: int, strength: int, room: int) -> list[tuple[int, int, int]]:
    if end - start <= room:
        return [(start, end, strength)]
    out: list[tuple[int, int, int]] = []
    for cut, kind in ((SENTENCE_END, SENTENCE), (SPACE, WORD)):
        marks = [start, *(m.end() for m in cut.finditer(text, start, end) if start < m.end() < end), end]
        if len(marks) > 2:
            for k, (a, b) in enumerate(zip(marks, marks[1:])):
                out += _within(text, a, b, strength if k == 0 else kind, room)
            return out
    return [(a, min(a + room, end), strength if a == start else INSIDE) for a in range(start, end, room)]


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with the overlap, start of the new text, end) of each piece; whole texts when they fit."""
    if text is None or len(text) <= limit:
        return [(0, 0, len(text or ""))]
    segs = atoms(text, limit - overlap)
    n = len(segs)
    start, end = [s[0] for s in segs], [s[1] for s in segs]
    prev, nxt, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    # strength first, then the smaller union: sizes stay even
    heap = [(segs[k][2], end[k] - start[k - 1], k) for k in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, size, k = heapq.heappop(heap)
        if not alive[k]:
            continue
        p = prev[k]
        now = end[k] - start[p]
        if now != size:
            if now + (overlap if start[p] else 0) <= limit:
                heapq.heappush(heap, (strength, now, k))
            continue
        if now + (overlap if start[p] else 0) > limit:
            continue
        alive[k] = False
        end[p] = end[k]
        q = nxt[p] = nxt[k]
        if q < n:
            prev[q] = p
    out = []
    for k in range(n):
        if alive[k]:
            s = start[k]
            lap = s
            if s:
                lap = max(s - overlap, out[-1][0])
                m = SPACE.search(text, lap, s)
                if m and lap > 0 and not text[lap - 1].isspace():
                    lap = m.start()
            out.append((lap, s, end[k]))
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_key, chunk_index, heading_path, piece_index, pieces (their number), start_line, end_line, overlap (characters of the piece before), text."""
    schema = "chunk_key string, chunk_index int, heading_path string, piece_index int, pieces int, start_line int, end_line int, overlap int, text string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, index, path, line, last, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                cuts = pieces(text, limit, overlap)
                if len(cuts) == 1:
                    rows.append((key, index, path, 0, 1, line, last, 0, text))
                    continue
                at, passed = 0, 0
                for k, (lap, new, end) in enumerate(cuts):
                    # newlines are counted once, from piece to piece
                    passed += text.count("\n", at, lap) if lap >= at else -text.count("\n", lap, at)
                    at = lap
                    body = text[lap:end]
                    inside = body.count("\n") - body.endswith("\n")
                    rows.append((key, index, path, k, len(cuts), None if line is None else line + passed, None if line is None else line + passed + inside, new - lap, body))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            cols = list(zip(*rows)) if rows else [[]] * 9
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return chunks.select("chunk_key", "chunk_index", "heading_path", "start_line", "end_line", "text").mapInArrow(run, schema)
