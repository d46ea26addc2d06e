"""Token match over symbol names, and BM25 over symbol documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel.functions.scalars import clamp_rows, fulltext_query
from sorrel.plans.runtime import cut, share_code

K1, B = 1.2, 0.75
CELLS = 1 << 20  # scores held at once
WORD = r"[\p{L}\p{M}\p{N}]+"  # letters with their marks, digits


def name_tokens(c) -> Column:
    """Whole dotted or underscored tokens and their parts, in lower case."""
    whole = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_.]+"), F.lit(0))
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.concat(whole, parts))


def search_names(symbols: DataFrame, query: str, fields: tuple[str, ...] = ("name", "qname", "signature")) -> DataFrame:
    """Symbols of which every query word is a token of some field; ``score``: hits over words and fields. No words: all symbols, score 0."""
    wanted = fulltext_query(query)
    words = [] if wanted == "*:*" else wanted.lower().split(" and ")
    tokens = [name_tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    score = F.lit(0)
    found = symbols
    for w in dict.fromkeys(words):
        hits = [F.array_contains(t, w).cast("int") for t in tokens]
        found = found.where(sum(hits[1:], hits[0]) > 0)
        score = score + sum(hits[1:], hits[0])
    return found.withColumn("score", score.cast("int"))


def doc_tokens(c="text") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def postings(docs: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """term, key, tf, dl of every word of every document: the inverted index."""
    t = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), doc_tokens(text).alias("ts")).withColumn("dl", F.size("ts"))
    return t.select("key", "dl", F.explode("ts").alias("term")).groupBy("term", "key", "dl").agg(F.count("*").alias("tf"))


def _query_words(queries: DataFrame) -> tuple:
    """query ids, words, starts, of: word w stands in the queries of[starts[w] : starts[w + 1]]. Gathered on the driver."""
    import numpy as np

    pairs = queries.select("query_id", F.explode(doc_tokens("query")).alias("term")).distinct().toArrow()
    ids, words = (c.combine_chunks().dictionary_encode("encode") for c in pairs.columns)
    at, of = (x.indices.to_numpy(zero_copy_only=False) for x in (words, ids))
    order = np.argsort(at, kind="stable")
    return ids.dictionary, words.dictionary, np.searchsorted(at[order], np.arange(len(words.dictionary) + 1)), of[order]


def _held(docs: DataFrame, shared, key: str, text: str) -> DataFrame:
    """key, docs (n, dl, codes): the documents of each key, their lengths and the codes of their words that stand in a query.

    The documents without such a word only count in the corpus's size: those of a batch are one row, of no key."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = shared.value[1]
        for batch in batches:
            keys, lists = batch.columns
            dl = pc.list_value_length(lists).to_numpy().astype("int64")
            found = pc.index_in(lists.flatten(), value_set=words)
            upto = np.append(0, np.cumsum(found.is_valid().to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(dl))]
            codes = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), found.drop_null().cast(pa.int32()))
            some = np.diff(upto) > 0
            rows = np.flatnonzero(some)
            rest = len(dl) - len(rows)
            cols = keys.take(rows), pa.array(np.ones(len(rows), "int64")), pa.array(dl[rows]), codes.take(rows)
            yield pa.record_batch(list(cols), names=["key", "n", "dl", "codes"])
            if rest:
                cols = pa.nulls(1, keys.type), pa.array([rest], pa.int64()), pa.array([dl[~some].sum()], pa.int64()), pa.array([[]], pa.list_(pa.int32()))
                yield pa.record_batch(list(cols), names=["key", "n", "dl", "codes"])

    words = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), doc_tokens(text).alias("ts"))
    held = words.mapInArrow(run, f"key {kind}, n long, dl long, codes array<int>")
    return held.repartition("key").groupBy("key").agg(F.collect_list(F.struct("n", "dl", "codes")).alias("docs"))


def _counted(lists, words: int) -> tuple:
    """row, code, tf, dl of every word of every key in ``lists``; documents of one key and one length count as one."""
    import numpy as np
    import pyarrow.compute as pc

    docs = lists.flatten()
    size = lambda x: pc.list_value_length(x).to_numpy()
    codes = docs.field("codes")
    doc = np.repeat(np.arange(len(docs)), size(codes))
    lengths, place = np.unique(docs.field("dl").to_numpy(), return_inverse=True)
    held = np.repeat(np.arange(len(lists)), size(lists)) * len(lengths) + place
    one, tf = np.unique(held[doc] * words + codes.flatten().to_numpy(), return_counts=True)
    row, place = np.divmod(one // words, len(lengths))
    return row, one % words, tf, lengths[place]


def _scored(docs: DataFrame, queries: DataFrame, key: str, text: str, emit: Callable, schema: str) -> DataFrame:
    """What ``emit`` makes of the blocks of each task: keys, query ids and their scores (not rounded, 0 without a common word).

    Each document is scored where it stands, against all queries at once: pairs of query and document are neither moved nor kept.
    The corpus is read and cut into words once."""
    spark = docs.sparkSession
    share_code(spark)
    shared = spark.sparkContext.broadcast(_query_words(queries))
    held = cut(_held(docs, shared, key, text))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = len(shared.value[1])
        total = np.zeros(words + 2, "int64")  # documents of each word, all documents, all words
        for batch in batches:
            lists = batch.column(0)
            total[:words] += np.bincount(_counted(lists, words)[1], minlength=words)
            total[words:] += [lists.flatten().field(c).to_numpy().sum() for c in ("n", "dl")]
        yield pa.record_batch([pa.array(np.arange(words + 2, dtype="int64")), pa.array(total)], names=["code", "n"])

    totals = held.select("docs").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code").column("n").to_numpy()
    known = spark.sparkContext.broadcast(totals)

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        ids, terms, starts, of = shared.value
        words, width = len(terms), len(ids)
        if not words or not len(known.value):
            return
        df, n, avgdl = known.value[:words], known.value[words], known.value[words + 1] / max(1, known.value[words])
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

        def blocks() -> Iterator:
            for batch in batches:
                keys, lists = batch.columns
                row, code, tf, dl = _counted(lists, words)
                part = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                step = max(1, CELLS // width)
                for low in range(0, len(keys), step):
                    high = min(low + step, len(keys))
                    a, b = np.searchsorted(row, [low, high])
                    many = starts[code[a:b] + 1] - starts[code[a:b]]
                    hit = np.repeat(np.arange(a, b), many)
                    query = of[np.arange(len(hit)) + np.repeat(starts[code[a:b]] - (np.cumsum(many) - many), many)]
                    score = np.bincount((row[hit] - low) * width + query, weights=part[hit], minlength=(high - low) * width)
                    yield keys.slice(low, high - low), ids, score.reshape(high - low, width)

        yield from emit(blocks())

    return held.mapInArrow(run, schema)


def bm25(docs: DataFrame, queries: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """``queries``: query_id, query. query_id, key, score (six decimals) of every document that shares a word with a query.

    Documents without words count in the size."""

    def emit(blocks: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, ids, score in blocks:
            row, query = score.nonzero()
            yield pa.record_batch([ids.take(query), keys.take(row), pa.array(score[row, query])], names=["query_id", "key", "score"])

    kinds = [queries.schema["query_id"].dataType.simpleString(), docs.schema[key].dataType.simpleString()]
    return _scored(docs, queries, key, text, emit, f"query_id {kinds[0]}, key {kinds[1]}, score double").withColumn("score", F.round("score", 6))


def bm25_best(docs: DataFrame, queries: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """query_id, documents, best: the number of rows that ``bm25`` has of each query, and their best score, summed up in each task."""

    def emit(blocks: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        documents, best = np.zeros(1, "int64"), np.zeros(1)
        for _, ids, score in blocks:
            documents, best = documents + (score > 0).sum(axis=0), np.maximum(best, score.max(axis=0))
        rows = np.flatnonzero(documents)
        if len(rows):
            yield pa.record_batch([ids.take(rows), pa.array(documents[rows]), pa.array(best[rows])], names=["query_id", "documents", "best"])

    kind = queries.schema["query_id"].dataType.simpleString()
    each = _scored(docs, queries, key, text, emit, f"query_id {kind}, documents long, best double")
    return each.groupBy("query_id").agg(F.sum("documents").alias("documents"), F.round(F.max("best"), 6).alias("best"))


def top_documents(docs: DataFrame, query: str, limit: int = 25, key: str = "key", text: str = "text") -> DataFrame:
    """The best documents of one query: key, score, rank; ties by key."""
    spark = docs.sparkSession
    found = bm25(docs, spark.createDataFrame([(1, query)], "query_id int, query string"), key, text)
    best = found.orderBy(F.desc("score"), "key").limit(clamp_rows(limit))
    from pyspark.sql import Window as W

    # at most 500 rows
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "key"))).select("key", "score", "rank")


def consistency(expected: DataFrame, live: DataFrame, indexed: DataFrame, replaced: DataFrame) -> DataFrame:
    """check, key: documents without a live symbol, live symbols without a document, documents not indexed, replaced keys still indexed. Each input has ``key``."""
    e, l, i, r = (x.select("key").distinct() for x in (expected, live, indexed, replaced))
    tag = lambda df, name: df.select(F.lit(name).alias("check"), "key")
    return (
        tag(e.join(l, "key", "left_anti"), "document_without_symbol").unionAll(tag(l.join(e, "key", "left_anti"), "symbol_without_document"))
        .unionAll(tag(e.join(i, "key", "left_anti"), "document_not_indexed")).unionAll(tag(r.join(e, "key", "left_anti").join(i, "key", "left_semi"), "replaced_still_indexed"))
    )


def fetch_documents(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents of the given keys (column ``key``), joined by document id."""
    from sorrel.functions.scalars import doc_id

    wanted = keys.select(doc_id("key").alias("doc_id")).distinct()
    return docs.withColumn("doc_id", doc_id("key")).join(wanted, "doc_id", "left_semi")


def without_documents(docs: DataFrame, keys: DataFrame | None = None, repo: str | None = None) -> DataFrame:
    """The documents that remain when keys, or all of a repository, are deleted."""
    if keys is not None:
        docs = docs.join(keys.select("key"), "key", "left_anti")
    return docs if repo is None else docs.where(~F.col("repo_name").eqNullSafe(repo))
