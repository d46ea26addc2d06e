"""Registered queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sorrel.llm import bpe, contamination, documentation, foreign, markup, parsing, quality, splitting
from sorrel.llm.oracles import ORACLES  # noqa: F401
from sorrel.plans.runtime import cut, table


def p2_found(spark, d):
    return parsing.unparsable(table(spark, d, "files")).select("file_key")


def p2_rates(spark, d):
    files = table(spark, d, "files")
    return parsing.rates(files, parsing.unparsable(files))


def p3_found(spark, d):
    return foreign.foreign_files(table(spark, d, "files")).select("file_key")


def p3_reasons(spark, d):
    return foreign.foreign_files(table(spark, d, "files"))


def p3_shared(spark, d):
    """The index of line hashes: of each file, its hashes and those of other repositories."""
    return foreign.shared_hashes(foreign.examined(table(spark, d, "files"))).where("size > 0").distinct()


def p3_handwritten(spark, d):
    """Keys of the files that remain."""
    files = table(spark, d, "files")
    return files.select("file_key", "repo_name").distinct().join(foreign.foreign_files(files), "file_key", "left_anti")


def p4_pieces(spark, d):
    """All pieces of each chunk's distinct rows."""
    chunks = table(spark, d, "doc_chunks").select("chunk_key", "chunk_index", "heading_path", "start_line", "end_line", "text").distinct()
    return splitting.split_oversized(chunks)


def p4_found(spark, d):
    return p4_pieces_of_long(spark, d).select("chunk_key").distinct()


def p4_pieces_of_long(spark, d):
    """Pieces of the chunks that had to be cut."""
    long = table(spark, d, "doc_chunks").where(F.length("text") > splitting.LIMIT)
    return splitting.split_oversized(long.select("chunk_key", "chunk_index", "heading_path", "start_line", "end_line", "text").distinct()).where("pieces > 1")


def p4_rebuilt(spark, d):
    """Of each distinct text that had to be cut: the text put together again from its pieces, and whether all pieces keep the rules."""
    mark = "\x1f"
    long = table(spark, d, "doc_chunks").where(F.length("text") > splitting.LIMIT).select("chunk_key", "start_line", "text").distinct()
    named = long.select(F.concat_ws(mark, "chunk_key", F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.md5("text")).alias("chunk_key"), F.lit(0).alias("chunk_index"), F.lit("").alias("heading_path"), "start_line", F.lit(None).cast("int").alias("end_line"), "text")
    before = W.partitionBy("chunk_key").orderBy("piece_index")
    pieces = splitting.split_oversized(named).withColumn("prev", F.lag("text").over(before))
    laps = F.col("overlap") <= splitting.OVERLAP
    lapped = F.when(F.col("piece_index") == 0, F.col("overlap") == 0).otherwise(laps & (F.expr("left(text, overlap)") == F.expr("right(prev, overlap)")))
    whole = pieces.groupBy("chunk_key").agg(
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_index", F.expr("substring(text, overlap + 1)").alias("t")))), lambda x: x["t"]), "")).alias("rebuilt"),
        F.min(F.length("text") <= splitting.LIMIT).alias("fits"), F.min(lapped).alias("lapped"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
    part = F.split("chunk_key", mark)
    return whole.select(part[0].alias("chunk_key"), part[2].alias("text_md5"), "rebuilt", "fits", "lapped", "first_line", "last_line")


def p5_found(spark, d):
    return documentation.documented(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "symbol_docs"))


def p5_pairs(spark, d):
    return documentation.pairs(table(spark, d, "symbols"), table(spark, d, "files"), table(spark, d, "symbol_docs"))


def p7_found(spark, d):
    return markup.markup_kinds(table(spark, d, "doc_chunks"))


def p7_clean(spark, d):
    return markup.clean_chunks(table(spark, d, "doc_chunks"))


def p8_ids(spark, d):
    return bpe.encode_corpus(table(spark, d, "documents"))


def p9_found(spark, d):
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_windows(spark, d):
    """The scan of all word trigrams against the set of the items' trigrams."""
    return contamination.windows(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_report(spark, d):
    """Per item: leaking documents, the largest share."""
    found = contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))


def p9_clean(spark, d):
    """Documents without those that leak an item."""
    docs = table(spark, d, "documents")
    return contamination.without_leaks(docs, contamination.leaks(docs, table(spark, d, "eval_items"))).select("doc_id", "lang", "source", "n_chars")


def p10_stats(spark, d):
    return quality.quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_counts(spark, d):
    """Words and their mean length."""
    return quality.document_stats(table(spark, d, "documents"), table(spark, d, "common_words")).where("n_words is not null").select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"))


def p10_ranks(spark, d):
    """The rank operator on stored columns: tails of n_chars per stored language."""
    values = table(spark, d, "documents").where("lang is not null and n_chars is not null").select("lang", F.lit("n_chars").alias("stat"), F.col("n_chars").cast("double").alias("value"))
    return quality.tail_probabilities(values, 8).select("lang", "value", "n", "all", F.round("tail", 9).alias("tail"))


def p10_found(spark, d):
    return p10_stats(spark, d).where("form in ('list', 'table', 'junk')").select("doc_id", "form")


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p3_found, p3_reasons, p3_shared, p3_handwritten, p4_pieces, p4_pieces_of_long, p4_rebuilt, p4_found, p5_found, p5_pairs, p7_found, p7_clean, p8_ids, p9_found, p9_windows, p9_report, p9_clean, p10_stats, p10_counts, p10_ranks, p10_found)}
