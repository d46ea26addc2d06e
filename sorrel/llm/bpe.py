"""Encoding a corpus with a public byte-level BPE tokenizer by merge replay over the corpus's words.

1. Texts are cut into pre-tokens; equal pre-tokens are one word. Words are counted over the whole corpus, combined in each
   task before the shuffle.
2. The words of the corpus are replayed once: an inverted index maps each token pair to the positions of the words that
   hold it; merges are applied in rank order, each to all positions of its pair at once, and only the touched neighbours
   get new pairs. The index is cut by word, never by document.
3. The ``TABLE_WORDS`` most frequent words of at most ``TABLE_CHARS`` characters are broadcast with their ids, a table of
   fixed size. The words beyond it, rare or long ones, are replayed where they stand: joining their occurrences would
   move every text. Those of a task are replayed together and stay in a cache of at most ``CACHE_WORDS`` entries.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.plans.runtime import cut, spread, width

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TABLE_WORDS = 200_000
TABLE_CHARS = 32
CACHE_WORDS = 200_000
BATCH_CHARS = 4_000_000
BASE = 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in stand_in:
            stand_in[b] = chr(256 + extra)
            extra += 1
    return [stand_in[b] for b in range(256)]


def load_merges(path: str = VOCABULARY) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Ids of the 256 bytes, and (left id, right id, merged id) in rank order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return [vocab[s] for s in byte_symbols()], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]


class MergeReplay:
    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]], table: dict[str, tuple[int, ...]] | None = None):
        import regex

        self.table = table or {}
        self.byte_ids = byte_ids
        self.rank = {a * BASE + b: r for r, (a, b, _) in enumerate(merges)}
        self.merged = [m for _, _, m in merges]
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: all merges over all words, in rank order."""
        byte_ids, rank = self.byte_ids, self.rank
        tok: list[int] = []
        ends: list[int] = []
        for w in words:
            tok += [byte_ids[b] for b in w.encode("utf-8", "replace")]
            ends.append(len(tok))
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        s = 0
        for e in ends:
            if e > s:
                after[e - 1], before[s] = -1, -1
            s = e
        index: dict[int, list[int]] = {}
        get = rank.get
        for p in range(n):
            q = after[p]
            if q >= 0:
                r = get(tok[p] * BASE + tok[q])
                if r is not None:
                    index.setdefault(r, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at.sort()  # overlapping pairs merge from the left
            new = self.merged[r]
            for p in at:
                if tok[p] < 0:
                    continue
                q = after[p]
                if q < 0 or get(tok[p] * BASE + tok[q]) != r:
                    continue
                tok[p], tok[q] = new, -1
                z = after[p] = after[q]
                if z >= 0:
                    before[z] = p
                    k = get(new * BASE + tok[z])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heapq.heappush(heap, k)
                y = before[p]
                if y >= 0:
                    k = get(tok[y] * BASE + new)
                    if k is not None:
                        if k in index:
                            index[k].append(y)
                        else:
                            index[k] = [y]
                            heapq.heappush(heap, k)
        out, s = [], 0
        for e in ends:
            out.append(tuple([t for t in tok[s:e] if t >= 0]))
            s = e
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        table, cache = self.table, self.cache
        fresh = list({w for ws in split for w in ws if w not in table and w not in cache})
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
            fresh = list({w for ws in split for w in ws if w not in table})
        cache.update(zip(fresh, self.replay(fresh)))
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += table[w] if w in table else cache[w]
            out.append(ids)
        return out


def corpus_words(texts: DataFrame) -> DataFrame:
    """word, n: how often each pre-token of at most TABLE_CHARS characters stands in the corpus (one column of texts)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        find = regex.compile(PATTERN).findall
        counts: Counter = Counter()
        rows = lambda: pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    counts.update([w for w in find(t.as_py()) if len(w) <= TABLE_CHARS])
                if len(counts) > CACHE_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return spread(texts).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def replayed(words: DataFrame, shared) -> DataFrame:
    """word, n, ids: all merges over all words of a partition, in rank order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = MergeReplay(*shared.value)
        for batch in batches:
            ids = coder.replay(batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n long, ids array<int>")


def word_table(texts: DataFrame, shared, table_words: int = TABLE_WORDS) -> dict[str, tuple[int, ...]]:
    """The ids of the corpus's most frequent words, at most ``table_words``."""
    spark = texts.sparkSession
    known = cut(replayed(corpus_words(texts).where("n > 1").repartition(width(spark), "word"), shared))
    return {r.word: tuple(r.ids) for r in known.orderBy(F.desc("n"), "word").limit(table_words).collect()}


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, table_words: int = TABLE_WORDS) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row. The vocabulary (50,000 merges) is read on the driver and broadcast."""
    spark: SparkSession = df.sparkSession
    merges = spark.sparkContext.broadcast(load_merges(vocabulary))
    shared = spark.sparkContext.broadcast((*merges.value, word_table(df.select(text_col), merges, table_words)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = _coder(shared)
        kind = pa.list_(pa.int32())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, size = 0, 0
            for k in range(len(texts)):
                v = texts[k]
                size += len(v.as_buffer()) if v.is_valid else 0
                if size >= BATCH_CHARS or k == len(texts) - 1:
                    lists = coder.encode(texts.slice(start, k + 1 - start).to_pylist())
                    yield pa.record_batch([ids.slice(start, k + 1 - start), pa.array(lists, kind)], names=[id_col, "ids"])
                    start, size = k + 1, 0

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


_KEPT: list = [None, None]


def _coder(shared) -> MergeReplay:
    """One coder for a worker process, so that its cache lives as long as the worker."""
    if _KEPT[0] is not shared.value:
        _KEPT[:] = shared.value, MergeReplay(*shared.value)
    return _KEPT[1]
