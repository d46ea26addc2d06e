"""Evaluation texts that leak into training text.

The test items (a fixed set; at most ``MAX_ITEMS`` rows of ``MAX_ITEM_BYTES`` in all, checked) are normalised to words, and
their word trigrams form a hash set that is broadcast: sorted arrays of codes, items and positions. Training texts are
scanned by window: each text's words become small integers through the items' vocabulary, all its trigrams are looked up
at once, and the hits of each item are verified by aligning the item's words with the text's words in order. Letter case,
punctuation, markup, line prefixes and line breaks are normalised away; a replaced word costs no more than itself.

What a passage is: equal words in the order of the item, at most ``GAP`` other words of the text (line prefixes, replaced
words) and ``ITEM_GAP`` words of the item apart, ``MIN_RUN`` of them (all of a shorter item) and ``DENSE`` of the words it spans.
A document leaks an item when its best one or two passages, in the item's order, span at least ``SHARE`` of the item's
words. Null and empty texts leak nothing; repeated documents are reported each under its own id; an item shorter than
three words has no trigram and never leaks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.plans.runtime import spread

SHARE = 0.4
GRAM = 3
MAX_ITEMS = 100_000
MAX_ITEM_BYTES = 64 << 20
GAP = 14  # text words from one match to the next
ITEM_GAP = 6  # item words from one match to the next
MIN_RUN = 5  # matched words of a passage
STEPS = sorted((i + j + 3 * abs(i - j), i, j) for i in range(1, GAP + 1) for j in range(1, ITEM_GAP + 1))  # cost, text words, item words from one match to the next
DENSE = 0.7  # matched words against the item words a passage spans; one in ten may be replaced
BATCH_CHARS = 8_000_000

TAG = r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\]\([^()\s]*\)"
WORD = r"[^\W_]+"


def _tools():
    import re

    return re.compile(TAG, re.S).sub, re.compile(WORD).findall


class ItemIndex:
    """Trigrams of all items. A pair of words is a number of its own, so that no code outgrows 64 bits."""

    def __init__(self, items: list[tuple[int, str]]):
        strip, words = _tools()
        self.vocab: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        for item, text in items:
            ws = words(strip(" ", text.lower())) if text else []
            if len(ws) >= GRAM:
                self.items[item] = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64)
        self.n = len(self.vocab) + 1
        self.upto = np.arange(1, max(map(len, self.items.values()), default=0) + 1)
        none = [np.zeros(0, np.int64)]
        self.pairs = np.unique(np.concatenate([w[:-1] * self.n + w[1:] for w in self.items.values()] or none))
        code = np.concatenate([self.codes(w) for w in self.items.values()] or none)
        order = np.argsort(code, kind="stable")
        self.known, first = np.unique(code[order], return_index=True)
        self.bounds = np.append(first, len(code))
        self.item_at = np.concatenate([np.full(len(w) - GRAM + 1, k, np.int64) for k, w in self.items.items()] or none)[order]
        self.place_at = np.concatenate([np.arange(len(w) - GRAM + 1) for w in self.items.values()] or none)[order]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the trigrams; -1 where no item has the pair or the word."""
        pair = ids[:-1] * self.n + ids[1:]
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        known = (ids[:-1] > 0) & (ids[1:] > 0) & (self.pairs[at] == pair if len(self.pairs) else False)
        return np.where(known[:-1] & known[1:], at[:-1] * self.n + ids[2:], -1)

    def looked_up(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each trigram of a text: its place among the items' trigrams, and whether it is one of them."""
        if len(ids) < GRAM or not len(self.known):
            n = max(0, len(ids) - GRAM + 1)
            return np.zeros(n, np.int64), np.zeros(n, bool)
        c = self.codes(ids)
        at = np.searchsorted(self.known, c)
        at[at == len(self.known)] = 0
        return at, self.known[at] == c

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item -> (text position, item position) of each shared trigram."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        at, same = self.looked_up(ids)
        for i in np.flatnonzero(same).tolist():
            here = slice(self.bounds[at[i]], self.bounds[at[i] + 1])
            for item, j in zip(self.item_at[here].tolist(), self.place_at[here].tolist()):
                found[item].append((i, j))
        return found

    def passages(self, item: int, ids: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Passages (text start, text end, item start, item end, matched words), by chaining equal words around hits."""
        want = self.items[item]
        pairs = sorted({(i + k, j + k) for i, j in hits for k in range(GRAM)})
        chains: list[list[tuple[int, int]]] = []
        last: dict[tuple[int, int], int] = {}  # chain by its last pair, which no other chain has
        for i, j in pairs:
            cheapest, best = 0, -1  # of equal steps, the chain that began last
            for cost, di, dj in STEPS:
                if best >= 0 and cost > cheapest:
                    break
                k = last.get((i - di, j - dj), -1)
                if k > best:
                    cheapest, best = cost, k
            if best >= 0:
                del last[chains[best][-1]]
                chains[best].append((i, j))
            else:
                best = len(chains)
                chains.append([(i, j)])
            last[i, j] = best
        out = []
        for chain in chains:
            (i0, j0), (i1, j1), m = chain[0], chain[-1], len(chain)
            # single equal words just outside, past at most one replaced word
            for _ in range(3):
                for step in (1, 2):
                    while i0 >= step and j0 >= step and ids[i0 - step] == want[j0 - step] and (step == 1 or j0 >= step):
                        i0, j0, m = i0 - step, j0 - step, m + 1
                        step = 1
                for step in (1, 2):
                    while i1 + step < len(ids) and j1 + step < len(want) and ids[i1 + step] == want[j1 + step]:
                        i1, j1, m = i1 + step, j1 + step, m + 1
                        step = 1
            if m >= min(MIN_RUN, len(want)) and m >= DENSE * (j1 - j0 + 1):
                out.append((i0, i1, j0, j1, m))
        return out

    def coverage(self, item: int, found: list[tuple[int, int, int, int, int]]) -> tuple[float, list]:
        """Share of the item in its best one or two passages in order, and those passages."""
        n = len(self.items[item])
        used = [max(found, key=lambda p: p[3] - p[2])] if found else []
        best = used[0][3] - used[0][2] + 1 if used else 0
        if len(found) < 2:
            return best / n, used
        # a sweep over the text: of the passages that ended before b, only the one that begins first in the item counts for each last item word
        start, firsts = np.arange(1, n + 1), [None] * n
        ended, k = sorted(found, key=lambda p: p[1]), 0
        for b in sorted(found):
            while ended[k][1] < b[0]:
                a = ended[k]
                if a[2] < start[a[3]]:
                    start[a[3]], firsts[a[3]] = a[2], a
                k += 1
            lo, hi = b[2], b[3]
            if not k or not lo:
                continue
            e = int((self.upto[:lo] - start[:lo]).argmax())  # apart in the item
            both, a = e + 1 - int(start[e]) + hi - lo + 1, firsts[e]
            if hi > lo:  # overlapping in the item
                e = lo + int(start[lo:hi].argmin())
                if start[e] < lo and hi + 1 - int(start[e]) > both:
                    both, a = hi + 1 - int(start[e]), firsts[e]
            if a and both > best:
                best, used = both, [a, b]
        return best / n, used

    def ids(self, text: str | None) -> np.ndarray:
        """The text's words as numbers; 0 for words of no item."""
        if not text:
            return np.zeros(0, np.int64)
        strip, words = _tools()
        get = self.vocab.get
        t = text.lower()
        if "<" in t or "&" in t or "](" in t:
            t = strip(" ", t)
        return np.array([get(w, 0) for w in words(t)], np.int64)

    def known_windows(self, text: str | None) -> tuple[int, int]:
        """How many word trigrams the text has, and how many of them stand in an item."""
        _, same = self.looked_up(self.ids(text))
        return len(same), int(same.sum())

    def scan(self, text: str | None) -> list[tuple[int, float, list]]:
        """Items of which the text holds something: item, share, passages as word spans."""
        if not text:
            return []
        ids = self.ids(text)
        out = []
        for item, hits in self.hits(ids).items():
            if (len({j for _, j in hits}) + 2) < 0.15 * len(self.items[item]):
                continue  # two fifths with one word in ten replaced leave more trigrams than that
            share, used = self.coverage(item, self.passages(item, ids, hits))
            if share > 0:
                out.append((item, share, used))
        return out


def build_index(items: DataFrame) -> ItemIndex:
    known = items.select("item_id", "text").where("text is not null")
    rows, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if rows > MAX_ITEMS or size > MAX_ITEM_BYTES:
        raise ValueError(f"more than {MAX_ITEMS} test items or {MAX_ITEM_BYTES} bytes: split them and scan once for each part")
    return ItemIndex([(r.item_id, r.text) for r in known.collect()])


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, share of the item's words, and the spans (first and last word of each passage in the text)."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(build_index(items))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = [(d, item, s, [x for p in used for x in p[:2]]) for d, t in zip(ids, texts) for item, s, used in index.scan(t.as_py()) if s >= share]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.int32()))], names=["doc_id", "item_id", "share", "spans"])

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInArrow(run, "doc_id long, item_id long, share double, spans array<int>")


def windows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, windows, hits: the word trigrams of each document, and those that some item has."""
    shared = documents.sparkSession.sparkContext.broadcast(build_index(items))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            rows = [index.known_windows(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "windows", "hits"])

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInArrow(run, "doc_id long, windows long, hits long")


def without_leaks(documents: DataFrame, leaked: DataFrame) -> DataFrame:
    """The documents that leak no item."""
    return documents.join(leaked.select("doc_id"), "doc_id", "left_anti")
