import datetime as dt

from sorrel.operators import orphans as O

T0 = dt.datetime(2024, 1, 1)
at = lambda h: T0 + dt.timedelta(hours=h)
CALLS = "site_key string, owner_key string, target_key string, arrived_at timestamp, kind string"
INH = "inherit_key string, repo_name string, base_qname string, arrived_at timestamp"
SYM = "symbol_key string, repo_name string, kind string, qname string, deleted_at timestamp, arrived_at timestamp"


def tables(spark):
    calls = [("s1", "k1", "gone", at(5), "x"), ("s1", "k1", "gone", at(9), "x"), ("s2", "dead", None, at(5), "x"), ("s3", "late", "k1", at(5), "x"), ("s4", "back", "k1", at(5), "x"), ("s5", None, None, at(5), "x")]
    inh = [("i1", "r", "m.T", at(5)), ("i2", "r", "m.Gone", at(5)), ("i3", "q", "m.T", at(5)), ("i4", "r", "m.Two", at(5)), ("i5", "r", "m.f", at(5)), ("i6", "r", None, at(5))]
    sym = [
        ("k1", "r", "function", "m.f", None, at(1)), ("dead", "r", "function", "m.d", None, at(1)), ("dead", "r", "function", "m.d", at(2), at(2)), ("late", "r", "method", "m.l", None, at(7)),
        ("back", "r", "method", "m.b", at(2), at(2)), ("back", "r", "method", "m.b", None, at(3)), ("t1", "r", "type", "m.T", None, at(1)),
        ("t2", "r", "type", "m.Two", at(2), at(2)), ("t3", "r", "type", "m.Two", None, at(8)),
    ]
    return spark.createDataFrame(calls, CALLS), spark.createDataFrame(inh, INH), spark.createDataFrame(sym, SYM)


WANT = {
    ("call_sites.target_key", "s1", "missing"), ("call_sites.owner_key", "s2", "deleted"), ("call_sites.owner_key", "s3", "late"), ("inheritance.base_qname", "i2", "missing"),
    ("inheritance.base_qname", "i3", "missing"), ("inheritance.base_qname", "i4", "late"), ("inheritance.base_qname", "i5", "missing"),
}


def test_kinds(spark):
    got = O.orphan_references(*tables(spark)).cache()
    assert {(r.ref_field, r.row_key, r.kind) for r in got.collect()} == WANT and got.count() == len(WANT)
    report = {(r.ref_field, r.month, r.kind): r.n for r in O.orphan_report(got).collect()}
    assert report[("inheritance.base_qname", "2024-01", "missing")] == 3


def test_a_saturated_filter_changes_nothing(spark):
    got = O.orphan_references(*tables(spark), max_words=64)
    assert {(r.ref_field, r.row_key, r.kind) for r in got.collect()} == WANT


def test_bloom_filter_never_denies_a_key(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) as k")
    bloom, words = O.bloom_blocks(keys, "k", 3000)
    assert bloom.count() * O.BLOCK == words
    tested = O.might_contain(spark.range(6000).selectExpr("cast(id as string) as k", "id"), "k", bloom, words)
    assert tested.where("id < 3000 and not maybe").count() == 0
    assert tested.where("id >= 3000 and maybe").count() < 900


def test_empty_tables(spark):
    calls, inh, sym = tables(spark)
    none = sym.limit(0)
    assert {r.kind for r in O.orphan_references(calls, inh, none).collect()} == {"missing"}
    assert O.orphan_references(calls.limit(0), inh.limit(0), sym).count() == 0
