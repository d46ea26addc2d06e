from pyspark.sql import functions as F

from sorrel.functions import scalars as C
from sorrel.operators import evaluate as E
from sorrel.operators import textsearch as S
from sorrel.operators import traverse as T
from sorrel.sources import markdown as M


def test_trails_use_an_edge_once(spark):
    edges = spark.createDataFrame([("e1", "a", "a"), ("e2", "a", "a"), ("e3", "b", "c"), ("e4", "c", "b")], "edge_key string, src string, dst string")
    got = {tuple(r) for r in T.trails(edges, None, 4).collect()}
    assert got == {("a", "a", 1), ("a", "a", 2), ("b", "c", 1), ("b", "b", 2), ("c", "b", 1), ("c", "c", 2)}
    one = spark.createDataFrame([("b",)], "start string")
    assert {r.start for r in T.trails(edges, one, 2).collect()} == {"b"}


def test_shortest_paths_take_the_smallest_of_equals(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c"), ("3", "b", "d"), ("4", "c", "d"), ("5", "d", "a"), ("6", "a", "a")], "edge_key string, src string, dst string")
    got = {(r.start, r.node): r.path for r in T.shortest_paths(edges, None, 8).collect()}
    assert got[("a", "d")] == ["a", "b", "d"] and ("a", "a") not in got and len(got) == 12


def test_scalars(spark):
    df = spark.createDataFrame([("pkg.do_failoverDecision",), ("HTTPServer2Go",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(C.normalize_name("q")).collect()] == ["do failover decision", "httpserver2 go", "", None]
    text = spark.createDataFrame([("x" * 300,), (" a \n b ",)], "t string").select(C.snippet("t").alias("s")).collect()
    assert len(text[0].s) == 242 and text[1].s == "a b"
    assert C.fulltext_query("open stream!") == "open AND stream" and C.fulltext_query("?") == "*:*"
    assert (C.clamp_rows(0), C.clamp_rows(9999), C.clamp_depth(99), C.clamp_paths(-1)) == (1, 500, 10, 1)
    v = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2)], "v double").agg(C.percentile_50("v"), C.percentile_95("v")).first()
    assert tuple(v) == (2.0, 5.0)


def test_markdown_chunks():
    text = "dropped\n# A #\nuse pkg.mod.run and pkg.mod.run\n```\ncode\n```\n### C\n~~~\nopen\n## B\nend"
    got = [(c["heading_path"], c["start_line"], c["end_line"], c["mentions"]) for c in M.chunks("x/n.md", text)]
    assert got == [("A", 2, 3, ["pkg.mod.run"]), ("A", 4, 6, []), ("A > C", 7, 7, []), ("A > C", 8, 8, []), ("A > C", 9, 9, []), ("A > B", 10, 11, [])]
    assert M.chunks("x/n.md", "plain")[0]["heading_path"] == "n.md" and M.chunks("n.md", "") == []


def test_bm25_and_consistency(spark):
    docs = spark.createDataFrame([("k1", "alpha beta beta"), ("k2", "alpha gamma"), ("k3", None), ("k4", "")], "key string, text string")
    got = [r.key for r in S.top_documents(docs, "beta alpha").collect()]
    assert got == ["k1", "k2"] and S.top_documents(docs, "!!").count() == 0
    k = lambda *x: spark.createDataFrame([(v,) for v in x], "key string")
    bad = {tuple(r) for r in S.consistency(k("a", "b"), k("b", "c"), k("b", "old"), k("old", "b")).collect()}
    assert bad == {("document_without_symbol", "a"), ("symbol_without_document", "c"), ("document_not_indexed", "a"), ("replaced_still_indexed", "old")}


def test_truth_difference_and_metrics(spark):
    t = spark.createDataFrame([(1, "exact_local"), (2, "dynamic"), (3, "external")], "line int, status string")
    n = spark.createDataFrame([(1, "exact_local"), (2, "unresolved"), (4, "external")], "line int, status string")
    assert {(r.line, r.difference) for r in E.call_site_difference(t, n, ["line"]).collect()} == {(2, "mismatch"), (3, "missing"), (4, "extra")}
    ranked = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "b", 2)], "query_id int, key string, rank int")
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, target string")
    m = E.lexical_metrics(ranked, truth).first()
    assert (m.top1, m.recall5, m.mrr, m.zero_results) == (0.333333, 0.666667, 0.5, 0.333333)
    sites = spark.createDataFrame([("s1", "exact_local"), ("s2", "constructor_exact_local"), ("s3", "dynamic")], "site_key string, status string")
    edges = spark.createDataFrame([("s1",), ("s2",)], "edge_key string")
    strict = {r.status: r.incomplete for r in E.projection_completeness(sites, edges).collect()}
    loose = {r.status: r.incomplete for r in E.projection_completeness(sites, edges, False).collect()}
    assert strict["constructor_exact_local"] == 1 and sum(loose.values()) == 0


def test_entry_has_an_oracle_for_known_queries_only():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert F is not None


def test_search_reads_words_of_all_scripts(spark):
    sym = spark.createDataFrame([("k1", "prüfeGröße", "m.prüfeGröße", "def prüfeGröße(ñandú)"), ("k2", "size", "m.size", "def size()")], "key string, name string, qname string, signature string")
    assert [r.key for r in S.search_names(sym, "größe ñandú").collect()] == ["k1"] and S.search_names(sym, "?!").count() == 2
    docs = spark.createDataFrame([("a", "Die Größe der Datei"), ("b", "索引 的 规则"), ("c", "size")], "key string, text string")
    assert [r.key for r in S.top_documents(docs, "größe").collect()] == ["a"] and [r.key for r in S.top_documents(docs, "索引").collect()] == ["b"]


def test_path_search_stops_when_all_pairs_are_found(spark):
    edges = spark.createDataFrame([(str(k), f"n{k}", f"n{k + 1}") for k in range(9)] + [("x", "n0", "m"), ("y", "m", "n2")], "edge_key string, src string, dst string")
    pairs = spark.createDataFrame([("n0", "n2"), ("n3", "n5"), ("n5", "n3")], "start string, node string")
    assert {(r.start, r.node): r.path for r in T.shortest_paths(edges, pairs, 8).collect()} == {("n0", "n2"): ["n0", "m", "n2"], ("n3", "n5"): ["n3", "n4", "n5"]}


def test_pairs_of_query_and_document_are_not_shuffled(spark, monkeypatch):
    import duckdb

    from sorrel.plans import reference_queries as Q

    # keys that stand twice with one length and with two, a null key, documents without words or text, an item in two rows
    docs = [(f"k{k}", f"the w{k % 7} the of w{k % 3} {'x ' * (k % 5)}") for k in range(300)]
    docs += [("k1", docs[1][1]), ("k2", "the the of w1 and more"), (None, "The w2"), (None, "w2 again"), ("none", None), ("empty", ""), ("other", "nothing known")]
    items = [(k, f"w{k % 11} the of THE") for k in range(60)] + [(0, "the of w3"), (None, "of w2"), (99, "?!"), (100, None)]
    symbol_docs, eval_items = spark.createDataFrame(docs, "key string, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(Q.G, "from_tables", lambda *_: type("Tables", (), {"docs": symbol_docs}))
    monkeypatch.setattr(Q, "table", lambda *_: eval_items)
    sc = spark.sparkContext

    def shuffled() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    got = {tuple(r) for r in Q.lexical_items(spark, "").collect()}
    moved = shuffled() - before

    def sql(name: str) -> set:
        with duckdb.connect() as c:
            c.execute("CREATE TABLE symbol_docs (symbol_key VARCHAR, text VARCHAR)").executemany("INSERT INTO symbol_docs VALUES (?, ?)", docs)
            c.execute("CREATE TABLE eval_items (item_id BIGINT, text VARCHAR)").executemany("INSERT INTO eval_items VALUES (?, ?)", items)
            return set(c.execute(Q.ORACLES[name]).fetchall())

    assert got == sql("lexical_items") and len(got) == 61
    # 18,000 pairs; documents, words of the queries and one row of each query and task are fewer
    assert moved < 3000
    # the same scores when blocks hold few documents, and none over no documents
    monkeypatch.setattr(S, "CELLS", 200)
    queries = eval_items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = S.bm25(symbol_docs, queries).groupBy("query_id").agg(F.count("*"), F.max("score"))
    assert {tuple(r) for r in pairs.collect()} == got
    assert S.bm25(symbol_docs.limit(0), queries).count() == 0 and S.bm25(symbol_docs, queries.limit(0)).count() == 0
