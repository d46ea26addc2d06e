"""References to records that do not exist, found through a Bloom filter of the parent keys.

The filter is register-blocked: a key sets four bits in one 64-bit word. Its words are built with bit_or (partial
aggregation before the shuffle), packed into rows of ``BLOCK`` words and broadcast. There are at most ``MAX_WORDS`` of them,
whatever the key count, so the broadcast is at most 64 MB; up to some fifty million keys it denies nearly every orphan,
beyond that ever more references go through to the exact join, and it never gives a wrong answer. References whose bits
are missing are orphans for certain and skip the exact join.

Null references are none. Repeated rows of a reference count once, from their first arrival. Empty parents make
every reference ``missing``. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.plans.runtime import cut

MAX_WORDS = 1 << 23
KEYS_PER_WORD = 4
BLOCK = 512


def _word(key: str, words: int):
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: str):
    h = F.xxhash64(F.col(key), F.lit(7))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def bloom_blocks(keys: DataFrame, key: str, n_keys: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """block, bits (array of BLOCK words): every word of the filter; and their number."""
    words = BLOCK
    while words * KEYS_PER_WORD < n_keys and words < max_words:
        words *= 2
    marked = keys.where(F.col(key).isNotNull()).select(_word(key, words).alias("word"), _mask(key).alias("mask"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    bits = marked.unionAll(every).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    packed = bits.groupBy(F.shiftright("word", BLOCK.bit_length() - 1).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    return packed, words


def might_contain(refs: DataFrame, key: str, bloom: DataFrame, words: int) -> DataFrame:
    """``refs`` with the boolean column ``maybe``."""
    b = F.broadcast(bloom.select(F.col("block").alias("_b"), F.col("bits").alias("_bits")))
    r = refs.withColumn("_w", _word(key, words)).withColumn("_m", _mask(key))
    bits = F.get("_bits", F.pmod("_w", F.lit(BLOCK)).cast("int"))
    return r.join(b, F.shiftright("_w", BLOCK.bit_length() - 1) == F.col("_b")).withColumn("maybe", bits.bitwiseAND(F.col("_m")) == F.col("_m")).drop("_w", "_m", "_b", "_bits")


def reference_rows(call_sites: DataFrame, inheritance: DataFrame) -> DataFrame:
    """ref_field, row_key, target (the symbol key, or repo and qname joined), ref_at, once per key."""
    target_type = F.concat_ws("\x1f", F.lit("type"), "repo_name", "base_qname")
    calls = call_sites.select(
        "site_key", "arrived_at",
        F.explode(F.array(
            F.struct(F.lit("call_sites.owner_key").alias("ref_field"), F.col("owner_key").alias("target")),
            F.struct(F.lit("call_sites.target_key").alias("ref_field"), F.col("target_key").alias("target")),
        )).alias("r"),
    ).select("r.ref_field", F.col("site_key").alias("row_key"), "r.target", "arrived_at")
    inh = inheritance.where("base_qname is not null").select(F.lit("inheritance.base_qname").alias("ref_field"), F.col("inherit_key").alias("row_key"), target_type.alias("target"), "arrived_at")
    return calls.unionAll(inh).where("target is not null").groupBy("ref_field", "row_key", "target").agg(F.min("arrived_at").alias("ref_at"))


def target_states(symbols: DataFrame) -> DataFrame:
    """target, deleted (the current row of every key is deleted), alive_at (first arrival among keys not deleted)."""
    keys = symbols.groupBy("symbol_key").agg(
        F.min("arrived_at").alias("first_at"),
        F.max_by(F.struct(F.col("deleted_at").isNotNull().alias("d")), F.struct("arrived_at", F.col("deleted_at").isNotNull())).alias("cur"),
        F.max(F.when(F.col("kind") == "type", F.struct("repo_name", "qname"))).alias("t"),
    ).select("symbol_key", "first_at", F.col("cur.d").alias("deleted"), "t")
    both = keys.select(
        F.explode(F.array(F.col("symbol_key"), F.when((F.col("t.repo_name").isNotNull()) & F.col("t.qname").isNotNull(), F.concat_ws("\x1f", F.lit("type"), "t.repo_name", "t.qname")))).alias("target"),
        "first_at", "deleted",
    ).where("target is not null")
    return both.groupBy("target").agg(F.min("deleted").alias("deleted"), F.min(F.when(~F.col("deleted"), F.col("first_at"))).alias("alive_at"))


def orphan_references(call_sites: DataFrame, inheritance: DataFrame, symbols: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """ref_field, row_key, target, ref_at, kind (missing, deleted, late)."""
    refs = reference_rows(call_sites, inheritance)
    n = symbols.count()
    keys = symbols.select(F.explode(F.array("symbol_key", F.when(F.col("kind") == "type", F.concat_ws("\x1f", F.lit("type"), "repo_name", "qname")))).alias("target"))
    bloom, words = bloom_blocks(keys, "target", n, max_words)
    tested = cut(might_contain(refs, "target", bloom, words))
    sure = tested.where("not maybe").select("ref_field", "row_key", "target", "ref_at", F.lit("missing").alias("kind"))
    states = target_states(symbols).withColumnRenamed("target", "t2").withColumn("there", F.lit(True))
    probed = tested.where("maybe").join(states, F.col("target") == F.col("t2"), "left")
    kind = F.when(F.col("there").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("alive_at") > F.col("ref_at"), "late")
    return sure.unionAll(probed.withColumn("kind", kind).where("kind is not null").select("ref_field", "row_key", "target", "ref_at", "kind"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per field, month of the reference's first arrival, and kind."""
    return orphans.groupBy("ref_field", F.date_format("ref_at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n"))
