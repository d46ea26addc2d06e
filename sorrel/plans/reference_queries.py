"""Registered queries for the graph operators, over the whole stored tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.functions import scalars as C
from sorrel.operators import evaluate as E
from sorrel.operators import resolve as R
from sorrel.operators import textsearch as S
from sorrel.operators import traverse as T
from sorrel.plans import graph as G
from sorrel.plans.runtime import table
from sorrel.sources import extract as X
from sorrel.sources import markdown as M

GRAPH_QUERY = "self def table"
LEXICAL_QUERY = "oldest snapshot of the ledger moves the index"


def list_repositories(spark, d):
    return G.list_repositories(G.from_tables(spark, d))


def current_symbols(spark, d):
    """Upsert: the newest row of each key, deleted keys left out."""
    return G.from_tables(spark, d).symbols.groupBy("repo_name", "kind").agg(F.count("*").alias("n"), F.max("end_line").alias("last_line"))


def definition_unique(spark, d):
    """Qualified names that select exactly one symbol of a repository and commit."""
    s = G.from_tables(spark, d).symbols.where("kind <> 'module_init'")
    return s.groupBy("repo_name", "commit_sha", "qname").agg(F.count("*").alias("n"), F.max("key").alias("key")).where("n = 1").select("repo_name", "commit_sha", "qname", "key")


def qname_ambiguity(spark, d):
    """Qualified names that name several symbols, deleted ones too: without a repository no selector accepts them."""
    s = table(spark, d, "symbols").where("kind <> 'module_init'")
    return s.groupBy("qname").agg(F.count_distinct("symbol_key").alias("n")).where("n > 1")


def callers_d1(spark, d):
    e = G.from_tables(spark, d).edges
    return e.select(F.col("dst").alias("key"), F.col("src").alias("caller"), "resolution").distinct()


def callees_d1(spark, d):
    e = G.from_tables(spark, d).edges
    return e.select(F.col("src").alias("key"), F.col("dst").alias("callee"), "resolution").distinct()


def callees_d3(spark, d):
    return T.trails(G.from_tables(spark, d).edges, None, 3)


def callers_d3(spark, d):
    e = G.from_tables(spark, d).edges
    return T.trails(e.select("edge_key", F.col("dst").alias("src"), F.col("src").alias("dst")), None, 3)


def call_path(spark, d):
    """The shortest path of every pair within depth 8; among equals the smallest sequence of keys."""
    return T.shortest_paths(G.from_tables(spark, d).edges, None, 8).select("start", "node", "depth", F.array_join("path", " > ").alias("path"))


def hierarchy_up(spark, d):
    i = G.from_tables(spark, d).inherits
    return T.trails(i.select(F.concat_ws("|", "child_key", "parent_key").alias("edge_key"), F.col("child_key").alias("src"), F.col("parent_key").alias("dst")), None, 5)


def hierarchy_down(spark, d):
    i = G.from_tables(spark, d).inherits
    return T.trails(i.select(F.concat_ws("|", "child_key", "parent_key").alias("edge_key"), F.col("parent_key").alias("src"), F.col("child_key").alias("dst")), None, 5)


def importers(spark, d):
    """Importing files of every module, read from the stored sources."""
    return G.from_tables(spark, d).imports.select("repo_name", "commit_sha", "module", "path", "imported_name", "alias").distinct()


def dead_code(spark, d):
    return G.find_dead_code(G.from_tables(spark, d), limit=None).select("key", "repo_name", "qname", "confidence")


def complexity_topn(spark, d):
    """The 25 most complex callables (a top-k report)."""
    return G.get_complexity(G.from_tables(spark, d), top_n=25)


def complexity_per_repository(spark, d):
    s = G.from_tables(spark, d).symbols.where(F.col("kind").isin(*G.CALLABLES))
    return s.groupBy("repo_name").agg(F.max("cyclomatic").alias("largest"), F.sum("cyclomatic").alias("total"), C.percentile_50("cyclomatic").alias("p50"), C.percentile_95("cyclomatic").alias("p95"))


def search_graph(spark, d):
    return S.search_names(G.from_tables(spark, d).symbols, GRAPH_QUERY).select("key", "qname", "score")


def search_lexical_bm25(spark, d):
    """The 25 best documents (top-k)."""
    return S.top_documents(G.from_tables(spark, d).docs, LEXICAL_QUERY, 25).select("key", "score")


def lexical_items(spark, d):
    """Every evaluation item as a query: its number of matching symbol documents and the best score."""
    docs = G.from_tables(spark, d).docs
    return S.bm25_best(docs, table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def index_terms(spark, d):
    """The inverted index: document and term frequencies of every word."""
    return S.postings(G.from_tables(spark, d).docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def normalize_name(spark, d):
    return table(spark, d, "symbols").select("qname").distinct().select("qname", C.normalize_name("qname").alias("normal"))


def symbol_texts(spark, d):
    s = G.from_tables(spark, d).symbols.where(F.col("kind").isin(*G.CALLABLES))
    return s.select("key", F.sha2(C.symbol_text("name", "qname", "signature", "docstring"), 256).alias("text_hash"))


def snippets(spark, d):
    return table(spark, d, "symbol_docs").where("text is not null").select("symbol_key", C.snippet("text").alias("snippet"))


def doc_ids(spark, d):
    return table(spark, d, "symbol_docs").select("symbol_key", C.doc_id("symbol_key").alias("doc_id"))


def csv_values(spark, d):
    return table(spark, d, "doc_chunks").select("chunk_key", C.csv_value("start_line").alias("start_line"), C.csv_list("mentions").alias("mentions")).distinct()


def mention_symbols(spark, d):
    """Exact join of mentions with the qualified names of callables."""
    m = table(spark, d, "doc_chunks").select("repo_name", "chunk_key", F.explode("mentions").alias("qname")).distinct()
    s = G.from_tables(spark, d).symbols.where(F.col("kind").isin(*G.CALLABLES)).select("repo_name", "qname", "key")
    return m.join(s, ["repo_name", "qname"]).select("chunk_key", "key").distinct()


def status_histogram(spark, d):
    return G.from_tables(spark, d).sites.groupBy(F.col("resolution").alias("status")).agg(F.count("*").alias("n"))


def has_method(spark, d):
    s = G.from_tables(spark, d).symbols.withColumn("snap", F.concat_ws("@", "repo_name", "commit_sha"))
    return R.has_method_edges(s).select("type_key", "method_key")


def inherits(spark, d):
    return G.from_tables(spark, d).inherits


def projection_completeness(spark, d):
    g = G.from_tables(spark, d)
    return E.projection_completeness(g.sites.withColumnRenamed("resolution", "status"), g.edges)


def key_consistency(spark, d):
    g = G.from_tables(spark, d)
    live = g.symbols.where(F.col("kind").isin(*G.CALLABLES)).select("key")
    gone = table(spark, d, "symbols").where("deleted_at is not null").select(F.col("symbol_key").alias("key"))
    indexed = g.docs.where("text is not null").select("key")
    return S.consistency(g.docs.select("key"), live, indexed, gone)


def edge_set_diff(spark, d):
    """Inheritance edges as qualified names, against containment links read as edges: missing and extra."""
    inh = table(spark, d, "inheritance").where("base_qname is not null").select("repo_name", F.col("type_qname").alias("a"), F.col("base_qname").alias("b"))
    sym = table(spark, d, "symbols").where("parent_qname is not null").select("repo_name", F.col("qname").alias("a"), F.col("parent_qname").alias("b"))
    return E.set_difference(inh, sym, ["repo_name", "a", "b"])


def truth_diff(spark, d):
    """Call sites whose owner some symbol row has (truth) against those whose status names an owner: missing, extra, mismatch."""
    cs = G.current(table(spark, d, "call_sites"), "site_key")
    cols = ["repo_name", "owner_qname", "start_line", "start_column", "ordinal", "raw_callee"]
    owners = table(spark, d, "symbols").select(F.col("symbol_key").alias("owner_key")).distinct()
    truth = cs.join(owners, "owner_key", "left_semi").select(*cols, F.when(F.col("target_key").isNull() & F.col("status").startswith("exact"), "unresolved").otherwise(F.col("status")).alias("status"))
    return E.call_site_difference(truth, cs.where("status <> 'owner_unresolved'").select(*cols, "status"), cols).groupBy("difference").agg(F.count("*").alias("n"))


def structural_metrics(spark, d):
    return E.structural_metrics(G.from_tables(spark, d))


def fetched_documents(spark, d):
    """Documents of every symbol that was ever deleted, by document id."""
    gone = table(spark, d, "symbols").where("deleted_at is not null").select(F.col("symbol_key").alias("key"))
    return S.fetch_documents(G.from_tables(spark, d).docs, gone).select("key", "doc_id", "repo_name")


def remaining_documents(spark, d):
    gone = table(spark, d, "symbols").where("deleted_at is not null").select(F.col("symbol_key").alias("key"))
    return S.without_documents(G.from_tables(spark, d).docs, gone).groupBy("repo_name").agg(F.count("*").alias("n"))


def dup_keys(spark, d):
    return E.duplicate_keys(table(spark, d, "symbols"), "symbol_key")


def dangling_edges(spark, d):
    g = G.from_tables(spark, d)
    return E.dangling(g.sites.where("owner_key is not null").select(F.col("site_key").alias("edge_key"), F.col("owner_key").alias("end")), g.symbols.select("key"))


def export_counts(spark, d):
    """Rows of each node and edge file of an export."""
    g = G.from_tables(spark, d)
    count = lambda df, name: df.agg(F.lit(name).alias("file"), F.count("*").alias("rows"))
    parts = [count(g.symbols.where(F.col("kind") == k), f"nodes_{k}") for k in ("type", "function", "method", "module_init")]
    parts += [count(g.sites, "nodes_call_site"), count(g.files, "nodes_file"), count(g.edges, "relationships_EXACT_CALLS"), count(g.inherits, "relationships_INHERITS")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def consistency_counts(spark, d):
    """Source rows against distinct keys, per table."""
    return E.key_counts({t: (table(spark, d, t), k) for t, k in (("files", "file_key"), ("symbols", "symbol_key"), ("call_sites", "site_key"), ("inheritance", "inherit_key"), ("doc_chunks", "chunk_key"))})


def _facts(spark, d):
    files = G.current(table(spark, d, "files"), "file_key")
    return X.extract(files)


def extract_symbols(spark, d):
    return X.symbol_rows(_facts(spark, d)).drop("snap", "ord")


def extract_calls(spark, d):
    return X.call_rows(_facts(spark, d)).drop("snap", "ord")


def extract_diagnostics(spark, d):
    return X.diagnostic_rows(_facts(spark, d))


def resolve_calls(spark, d):
    return R.resolve(_facts(spark, d)).select("site_key", "owner_key", "status", "target_key", "construction_target_key", "initializer_target_key", F.array_join("candidate_keys", ";").alias("candidate_keys"))


def resolved_histogram(spark, d):
    return R.status_histogram(R.resolve(_facts(spark, d)))


def chunk_notes(spark, d):
    """Documents read as Markdown notes."""
    notes = table(spark, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("")).alias("repo_name"), F.lit("").alias("commit_sha"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return M.chunk_notes(notes).select("repo_name", "path", "chunk_index", "heading_path", "start_line", "end_line", "text")


_NAMES = (
    list_repositories, current_symbols, definition_unique, qname_ambiguity, callers_d1, callees_d1, callees_d3, callers_d3, call_path, hierarchy_up, hierarchy_down, importers, dead_code,
    complexity_topn, complexity_per_repository, search_graph, search_lexical_bm25, lexical_items, index_terms, normalize_name, symbol_texts, snippets, doc_ids, csv_values, mention_symbols,
    status_histogram, has_method, inherits, projection_completeness, key_consistency, edge_set_diff, truth_diff, structural_metrics, fetched_documents, remaining_documents, dup_keys, dangling_edges, export_counts, consistency_counts,
    extract_symbols, extract_calls, extract_diagnostics, resolve_calls, resolved_histogram, chunk_notes,
)
QUERIES = {f.__name__: f for f in _NAMES}

_SYM = """sym AS (
  SELECT r.*, symbol_key AS key, regexp_extract(symbol_key, '^[^@]*@([^:]*):', 1) AS commit_sha FROM (
    SELECT symbol_key, arg_max(struct_pack(repo_name := repo_name, kind := kind, name := name, qname := qname, signature := signature, start_line := start_line, end_line := end_line,
      cyclomatic := cyclomatic, parent_qname := parent_qname, docstring := docstring, deleted_at := deleted_at), arrived_at) AS r FROM symbols GROUP BY 1)
  WHERE r.deleted_at IS NULL)"""
_SITES = """sites AS (
  SELECT site_key, r.*, regexp_extract(site_key, '^[^@]*@([^:]*):', 1) AS commit_sha FROM (
    SELECT site_key, arg_max(struct_pack(repo_name := repo_name, owner_key := owner_key, target_key := target_key, status := status), arrived_at) AS r FROM call_sites GROUP BY 1))"""
_EDGES = f"""{_SYM}, {_SITES}, calls AS (SELECT key FROM sym WHERE kind IN ('function', 'method')), edges AS (
  SELECT site_key AS edge_key, owner_key AS src, target_key AS dst, status AS resolution FROM sites WHERE owner_key IN (SELECT key FROM calls) AND target_key IN (SELECT key FROM calls))"""
_INH = f"""{_SYM}, types AS (SELECT repo_name, commit_sha, qname, max(key) AS k FROM sym WHERE kind = 'type' GROUP BY 1, 2, 3 HAVING count(*) = 1), inh AS (
  SELECT inherit_key, r.*, regexp_extract(inherit_key, '^[^@]*@([^:]*):', 1) AS commit_sha FROM (
    SELECT inherit_key, arg_max(struct_pack(repo_name := repo_name, type_qname := type_qname, base_qname := base_qname), arrived_at) AS r FROM inheritance GROUP BY 1)
), inherits AS (
  SELECT DISTINCT c.k AS child_key, p.k AS parent_key FROM inh i JOIN types c ON c.repo_name = i.repo_name AND c.commit_sha = i.commit_sha AND c.qname = i.type_qname
  JOIN types p ON p.repo_name = i.repo_name AND p.commit_sha = i.commit_sha AND p.qname = i.base_qname WHERE c.k <> p.k)"""


def _trails(prefix: str, source: str, a: str, b: str, depth: int, key: str = "edge_key") -> str:
    return f"""WITH RECURSIVE {prefix}, e AS (SELECT {key} AS edge_key, {a} AS src, {b} AS dst FROM {source}), t AS (
  SELECT src AS start, dst AS node, [edge_key] AS used, 1 AS depth FROM e
  UNION ALL SELECT t.start, e.dst, list_append(t.used, e.edge_key), t.depth + 1 FROM t JOIN e ON e.src = t.node WHERE t.depth < {depth} AND NOT list_contains(t.used, e.edge_key)
) SELECT DISTINCT start, node, depth FROM t"""


_BM25 = r"""d AS (SELECT symbol_key AS key, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ts FROM symbol_docs WHERE text IS NOT NULL
), size AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d
), tf AS (SELECT term, key, dl, count(*) AS tf FROM (SELECT key, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1
), scored AS (
  SELECT q.query_id, tf.key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN size GROUP BY 1, 2)"""

_LETTERS = r"[\p{L}\p{M}\p{N}]+"


def _tokens(c: str) -> str:
    c = f"coalesce({c}, '')"
    return rf"list_concat(regexp_extract_all(lower({c}), '[\p{{L}}\p{{M}}\p{{N}}_.]+'), regexp_extract_all(lower(regexp_replace({c}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')), '{_LETTERS}'))"


def _hits(word: str) -> str:
    return "(" + " + ".join(f"CAST(list_contains({c}, '{word}') AS INT)" for c in ("a", "b", "c")) + ")"


_NORMAL = "trim(lower(regexp_replace(regexp_replace(regexp_extract({0}, '[^.]*$'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\W]+', ' ', 'g')))"

ORACLES = {
    "list_repositories": """WITH f AS (SELECT repo_name, count(DISTINCT file_key) AS files FROM (SELECT file_key, arg_max(repo_name, arrived_at) AS repo_name FROM files GROUP BY 1) GROUP BY 1)
  SELECT r.repo_name, r.c.commit_sha AS commit_sha, r.c.root_path AS root_path, coalesce(f.files, 0) AS files
  FROM (SELECT repo_name, arg_max(struct_pack(commit_sha := commit_sha, root_path := root_path), struct_pack(a := indexed_at, b := commit_sha)) AS c FROM repositories GROUP BY 1) r LEFT JOIN f USING (repo_name) ORDER BY 1 LIMIT 100""",
    "current_symbols": f"WITH {_SYM} SELECT repo_name, kind, count(*) AS n, max(end_line) AS last_line FROM sym GROUP BY 1, 2",
    "definition_unique": f"WITH {_SYM} SELECT repo_name, commit_sha, qname, max(key) AS key FROM sym WHERE kind <> 'module_init' GROUP BY 1, 2, 3 HAVING count(*) = 1",
    "qname_ambiguity": "SELECT qname, count(DISTINCT symbol_key) AS n FROM symbols WHERE kind <> 'module_init' GROUP BY 1 HAVING count(DISTINCT symbol_key) > 1",
    "callers_d1": f"WITH {_EDGES} SELECT DISTINCT dst AS key, src AS caller, resolution FROM edges",
    "callees_d1": f"WITH {_EDGES} SELECT DISTINCT src AS key, dst AS callee, resolution FROM edges",
    "callees_d3": _trails(_EDGES, "edges", "src", "dst", 3),
    "callers_d3": _trails(_EDGES, "edges", "dst", "src", 3),
    "call_path": f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), r AS (
  SELECT src AS start, dst AS node, 1 AS depth, [src, dst] AS path FROM e UNION ALL SELECT r.start, e.dst, r.depth + 1, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node WHERE r.depth < 8 AND NOT list_contains(r.path, e.dst)
) SELECT start, node, min(depth) AS depth, array_to_string(arg_min(path, struct_pack(d := depth, p := path)), ' > ') AS path FROM r GROUP BY 1, 2""",
    "hierarchy_up": _trails(_INH, "inherits", "child_key", "parent_key", 5, "child_key || '|' || parent_key"),
    "hierarchy_down": _trails(_INH, "inherits", "parent_key", "child_key", 5, "child_key || '|' || parent_key"),
    "dead_code": f"WITH {_SYM}, {_SITES} SELECT key, repo_name, qname, 'unreferenced_candidate' AS confidence FROM sym WHERE kind IN ('function', 'method') AND key NOT IN (SELECT target_key FROM sites WHERE target_key IS NOT NULL)",
    "complexity_topn": f"WITH {_SYM} SELECT key, qname, signature, cyclomatic FROM sym WHERE kind IN ('function', 'method') ORDER BY cyclomatic DESC NULLS LAST, qname, key LIMIT 25",
    "complexity_per_repository": f"WITH {_SYM} SELECT repo_name, max(cyclomatic) AS largest, CAST(sum(cyclomatic) AS BIGINT) AS total, CAST(quantile_disc(cyclomatic, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(cyclomatic, 0.95) AS DOUBLE) AS p95 FROM sym WHERE kind IN ('function', 'method') GROUP BY 1",
    "search_graph": f"""WITH {_SYM}, t AS (SELECT key, qname, {_tokens("name")} AS a, {_tokens("qname")} AS b, {_tokens("signature")} AS c FROM sym)
  SELECT key, qname, {" + ".join(map(_hits, GRAPH_QUERY.split()))} AS score FROM t WHERE {" AND ".join(f"{_hits(w)} > 0" for w in GRAPH_QUERY.split())}""",
    "search_lexical_bm25": f"WITH q AS (SELECT DISTINCT 1 AS query_id, unnest(regexp_extract_all(lower('{LEXICAL_QUERY}'), '{_LETTERS}')) AS term), {_BM25} SELECT key, score FROM scored ORDER BY score DESC, key LIMIT 25",
    "lexical_items": f"WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS term FROM eval_items), {_BM25} SELECT query_id, count(*) AS documents, max(score) AS best FROM scored GROUP BY 1",
    "index_terms": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, key, count(*) AS tf FROM (SELECT symbol_key AS key, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS term FROM symbol_docs) GROUP BY 1, 2) GROUP BY 1",
    "normalize_name": f"SELECT DISTINCT qname, {_NORMAL.format('qname')} AS normal FROM symbols",
    "symbol_texts": f"""WITH {_SYM} SELECT key, sha256(trim(array_to_string(list_filter([name, {_NORMAL.format('qname').replace('qname', 'name')}, qname, signature, docstring], lambda x: x IS NOT NULL AND x <> ''), chr(10)), ' ')) AS text_hash
  FROM sym WHERE kind IN ('function', 'method')""",
    "snippets": r"""SELECT symbol_key, CASE WHEN length(f) > 240 THEN rtrim(f[1:239]) || '...' ELSE f END AS snippet FROM (SELECT symbol_key, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM symbol_docs WHERE text IS NOT NULL)""",
    "doc_ids": "SELECT symbol_key, sha256(symbol_key) AS doc_id FROM symbol_docs",
    "csv_values": "SELECT DISTINCT chunk_key, coalesce(CAST(start_line AS VARCHAR), '') AS start_line, coalesce(array_to_string(mentions, ';'), '') AS mentions FROM doc_chunks",
    "mention_symbols": f"WITH {_SYM}, m AS (SELECT DISTINCT repo_name, chunk_key, unnest(mentions) AS qname FROM doc_chunks) SELECT DISTINCT m.chunk_key, s.key FROM m JOIN sym s ON s.repo_name = m.repo_name AND s.qname = m.qname WHERE s.kind IN ('function', 'method')",
    "status_histogram": f"WITH {_SITES} SELECT status, count(*) AS n FROM sites GROUP BY 1",
    "has_method": f"WITH {_SYM}, t AS (SELECT repo_name, commit_sha, qname, max(key) AS type_key FROM sym WHERE kind = 'type' GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT DISTINCT type_key, key AS method_key FROM sym s JOIN t ON t.repo_name = s.repo_name AND t.commit_sha = s.commit_sha AND t.qname = s.parent_qname WHERE s.kind = 'method'",
    "inherits": f"WITH {_INH} SELECT child_key, parent_key FROM inherits",
    "projection_completeness": f"""WITH {_EDGES}, p AS (SELECT s.status, s.status IN ({", ".join(f"'{s}'" for s in R.EXACT)}) AS exact, e.edge_key IS NOT NULL AS projected FROM sites s LEFT JOIN edges e ON e.edge_key = s.site_key)
  SELECT status, count(*) AS n, CAST(sum(CAST(projected AS INT)) AS BIGINT) AS projected, CAST(sum(CAST(exact IS DISTINCT FROM projected AS INT)) AS BIGINT) AS incomplete FROM p GROUP BY 1""",
    "key_consistency": f"""WITH {_SYM}, live AS (SELECT key FROM sym WHERE kind IN ('function', 'method')), e AS (SELECT DISTINCT symbol_key AS key FROM symbol_docs), i AS (SELECT DISTINCT symbol_key AS key FROM symbol_docs WHERE text IS NOT NULL), r AS (SELECT DISTINCT symbol_key AS key FROM symbols WHERE deleted_at IS NOT NULL)
  SELECT 'document_without_symbol' AS "check", key FROM e WHERE key NOT IN (SELECT key FROM live)
  UNION ALL SELECT 'symbol_without_document', key FROM live WHERE key NOT IN (SELECT key FROM e)
  UNION ALL SELECT 'document_not_indexed', key FROM e WHERE key NOT IN (SELECT key FROM i)
  UNION ALL SELECT 'replaced_still_indexed', key FROM r WHERE key NOT IN (SELECT key FROM e) AND key IN (SELECT key FROM i)""",
    "edge_set_diff": """WITH t AS (SELECT DISTINCT repo_name, type_qname AS a, base_qname AS b FROM inheritance WHERE base_qname IS NOT NULL), n AS (SELECT DISTINCT repo_name, qname AS a, parent_qname AS b FROM symbols WHERE parent_qname IS NOT NULL)
  SELECT repo_name, a, b, 'missing' AS difference FROM (SELECT * FROM t EXCEPT SELECT * FROM n) UNION ALL SELECT repo_name, a, b, 'extra' FROM (SELECT * FROM n EXCEPT SELECT * FROM t)""",
    "truth_diff": """WITH c AS (SELECT r.* FROM (SELECT site_key, arg_max(struct_pack(repo_name := repo_name, owner_key := owner_key, owner_qname := owner_qname, start_line := start_line, start_column := start_column, ordinal := ordinal,
    raw_callee := raw_callee, status := status, target_key := target_key), arrived_at) AS r FROM call_sites GROUP BY 1)
  ), a AS (SELECT DISTINCT repo_name, owner_qname, start_line, start_column, ordinal, raw_callee, CASE WHEN target_key IS NULL AND status LIKE 'exact%' THEN 'unresolved' ELSE status END AS status FROM c WHERE owner_key IN (SELECT symbol_key FROM symbols)
  ), b AS (SELECT DISTINCT repo_name, owner_qname, start_line, start_column, ordinal, raw_callee, status FROM c WHERE status <> 'owner_unresolved'
  ), j AS (SELECT CASE WHEN b.raw_callee IS NULL THEN 'missing' WHEN a.raw_callee IS NULL THEN 'extra' WHEN a.status IS DISTINCT FROM b.status THEN 'mismatch' END AS difference FROM a FULL JOIN b
    ON a.repo_name = b.repo_name AND a.owner_qname = b.owner_qname AND a.start_line = b.start_line AND a.start_column = b.start_column AND a.ordinal = b.ordinal AND a.raw_callee = b.raw_callee)
  SELECT difference, count(*) AS n FROM j WHERE difference IS NOT NULL GROUP BY 1""",
    "structural_metrics": f"""WITH {_EDGES}, {_INH[len(_SYM) + 2 :]} SELECT 'symbols_' || kind AS metric, count(*) AS n FROM sym GROUP BY 1 UNION ALL SELECT 'call_sites', count(*) FROM sites
  UNION ALL SELECT 'resolves_to', count(*) FROM sites WHERE target_key IS NOT NULL UNION ALL SELECT 'exact_calls', count(*) FROM edges UNION ALL SELECT 'inherits', count(*) FROM inherits
  UNION ALL SELECT 'status_' || coalesce(status, 'none'), count(*) FROM sites GROUP BY 1""",
    "fetched_documents": "SELECT symbol_key AS key, sha256(symbol_key) AS doc_id, repo_name FROM symbol_docs WHERE symbol_key IN (SELECT symbol_key FROM symbols WHERE deleted_at IS NOT NULL)",
    "remaining_documents": "SELECT repo_name, count(*) AS n FROM symbol_docs WHERE symbol_key NOT IN (SELECT symbol_key FROM symbols WHERE deleted_at IS NOT NULL) GROUP BY 1",
    "dup_keys": "SELECT symbol_key AS key, count(*) AS n FROM symbols GROUP BY 1 HAVING count(*) > 1",
    "dangling_edges": f'WITH {_SYM}, {_SITES} SELECT site_key AS edge_key, owner_key AS "end" FROM sites WHERE owner_key IS NOT NULL AND owner_key NOT IN (SELECT key FROM sym)',
    "export_counts": f"""WITH {_EDGES}, {_INH[len(_SYM) + 2 :]} SELECT 'nodes_' || k AS file, count(key) AS rows FROM (VALUES ('type'), ('function'), ('method'), ('module_init')) v(k) LEFT JOIN sym ON sym.kind = k GROUP BY 1
  UNION ALL SELECT 'nodes_call_site', count(*) FROM sites UNION ALL SELECT 'nodes_file', count(DISTINCT file_key) FROM files
  UNION ALL SELECT 'relationships_EXACT_CALLS', count(*) FROM edges UNION ALL SELECT 'relationships_INHERITS', count(*) FROM inherits""",
    "consistency_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, count(DISTINCT {k}) AS keys, count(*) - count(DISTINCT {k}) AS repeated FROM {t}" for t, k in (("files", "file_key"), ("symbols", "symbol_key"), ("call_sites", "site_key"), ("inheritance", "inherit_key"), ("doc_chunks", "chunk_key"))),
}
