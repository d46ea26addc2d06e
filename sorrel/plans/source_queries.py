"""Registered queries that read the stored sources and are compared with what the stored tables say of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.functions import scalars as C
from sorrel.operators import hierarchy as H
from sorrel.operators import resolve as R
from sorrel.plans import graph as G
from sorrel.plans.runtime import cut, table
from sorrel.sources import extract as X
from sorrel.sources import markdown as M

PLACE = ["file_key", "start_line", "start_column", "end_line", "end_column"]


def facts(spark, d):
    return X.extract(G.current(table(spark, d, "files"), "file_key"))


def _known_files(spark, d):
    """Files of which the symbol table holds more than the module's own row: those that parse."""
    return table(spark, d, "symbols").where("kind <> 'module_init'").select("file_key").distinct()


def _with_file(rows):
    return rows.withColumn("file_key", X.key("path"))


def extracted_symbols(spark, d):
    s = _with_file(X.symbol_rows(facts(spark, d))).join(_known_files(spark, d), "file_key", "left_semi")
    return s.select(F.col("key").alias("symbol_key"), "file_key", "kind", "name", "qname", "signature", "start_line", "cyclomatic")


def extracted_methods(spark, d):
    """The type around each method."""
    s = _with_file(X.symbol_rows(facts(spark, d))).join(_known_files(spark, d), "file_key", "left_semi")
    return s.where("kind = 'method'").select(F.col("key").alias("symbol_key"), "parent_qname")


def extracted_docstrings(spark, d):
    """Docstrings of symbols whose stored row has one with content, white space around left out."""
    stored = G.current(table(spark, d, "symbols"), "symbol_key").where(F.trim(F.regexp_replace("docstring", r"\s+", " ")) != "").select(F.col("symbol_key").alias("key"))
    s = X.symbol_rows(facts(spark, d)).join(stored, "key", "left_semi")
    return s.select(F.col("key").alias("symbol_key"), F.md5(F.regexp_replace("docstring", r"\s+", "")).alias("docstring"))


def extracted_bases(spark, d):
    """Base clauses of the types that the inheritance table knows."""
    known = table(spark, d, "inheritance").select("file_key", "type_qname").distinct()
    return _with_file(X.inheritance_rows(facts(spark, d))).join(known, ["file_key", "type_qname"], "left_semi").select("file_key", "type_qname", "base_name").distinct()


def _stored_sites(spark, d):
    """The places of the stored call sites in Python files."""
    return G.current(table(spark, d, "call_sites"), "site_key").where(F.col("file_key").endswith(".py"))


def extracted_calls(spark, d):
    places = _stored_sites(spark, d).select(*PLACE).distinct()
    return _with_file(X.call_rows(facts(spark, d))).join(places, PLACE, "left_semi").select(*PLACE, "owner_qname", "raw_callee", "callee_name")


def _sound(spark, d):
    """Stored sites with an owner, and a target that some symbol row has or none."""
    s = _stored_sites(spark, d).where("status <> 'owner_unresolved'")
    keys = table(spark, d, "symbols").select(F.col("symbol_key").alias("target_key")).distinct()
    return s.where("target_key is null").select(*PLACE).unionAll(s.join(keys, "target_key", "left_semi").select(*PLACE)).distinct()


def resolved_sites(spark, d):
    """Every sound stored call site, resolved from the sources."""
    res = _with_file(R.resolve(facts(spark, d)))
    return res.join(_sound(spark, d), PLACE, "left_semi").select(*PLACE, "status", "target_key")


def resolved_owners(spark, d):
    """The owner of every sound stored call site whose stored owner exists."""
    owners = table(spark, d, "symbols").select(F.col("symbol_key").alias("owner_key")).distinct()
    stored = _stored_sites(spark, d).where(F.col("owner_key").startswith(F.concat("file_key", F.lit(":"), "owner_qname", F.lit(":")))).join(owners, "owner_key", "left_semi").select(*PLACE).distinct()
    return _with_file(R.resolve(facts(spark, d))).join(stored, PLACE, "left_semi").select(*PLACE, "owner_key")


def projected_calls(spark, d):
    """CALLS rows of the sound stored call sites that resolve exactly."""
    res = cut(R.resolve(facts(spark, d)))
    edges = R.projections(res).select(F.col("edge_key").alias("site_key"), F.col("target_key").alias("dst"), "resolution")
    placed = _with_file(res).join(_sound(spark, d), PLACE, "left_semi").select("site_key", *PLACE)
    return placed.join(edges, "site_key").select(*PLACE, "dst", "resolution")


def resolved_bases(spark, d):
    """INHERITS edges from the sources, of the stored clauses whose base is a type of its name in the snapshot."""
    f = cut(facts(spark, d))
    sym = cut(X.symbol_rows(f))
    edges = R.inherits_edges(X.inheritance_rows(f), X.import_rows(f), sym)
    names = sym.where("kind = 'type'").select("key", "snap", "qname")
    named = edges.join(names.select(F.col("key").alias("child_key"), F.col("qname").alias("type_qname")), "child_key").join(names.select(F.col("key").alias("parent_key"), F.col("qname").alias("base_qname")), "parent_key")
    types = G.current(table(spark, d, "symbols"), "symbol_key").where("kind = 'type'").select("file_key", "qname").distinct()
    snap = F.substring_index("file_key", ":", 1)
    one = types.groupBy(snap.alias("snap"), "qname").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    stored = G.current(table(spark, d, "inheritance"), "inherit_key").where("base_qname is not null and file_key like '%.py'").where(F.substring_index("base_qname", ".", -1) == F.col("base_name")).withColumn("snap", snap)
    stored = stored.join(one.withColumnRenamed("qname", "base_qname"), ["snap", "base_qname"], "left_semi").join(one.withColumnRenamed("qname", "type_qname"), ["snap", "type_qname"], "left_semi").where("type_qname <> base_qname")
    return named.join(stored.select("snap", "type_qname", "base_qname").distinct(), ["snap", "type_qname", "base_qname"], "left_semi").select("snap", "type_qname", "base_qname")


def mro_members(spark, d):
    """Every type in the linearisation of every type, from the stored INHERITS edges.

    Bases of more ancestors come first: one order for all types, with which C3 never fails but for cycles."""
    g = G.from_tables(spark, d)
    inherits = cut(g.inherits)
    above = H.descendants(inherits.select(F.lit("").alias("grp"), F.col("child_key").alias("child"), F.col("parent_key").alias("parent"))).groupBy(F.col("descendant").alias("parent_key")).agg(F.count("*").alias("above"))
    types = g.symbols.where("kind = 'type'").select(F.concat_ws("@", "repo_name", "commit_sha").alias("snap"), F.col("key").alias("qname"))
    ranked = inherits.join(above, "parent_key", "left").select("child_key", F.struct((-F.coalesce("above", F.lit(0))).alias("rank"), F.col("parent_key").alias("key")).alias("p"))
    bases = ranked.groupBy(F.col("child_key").alias("type_qname")).agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["key"]).alias("parents"))
    bases = bases.join(types.withColumnRenamed("qname", "type_qname"), "type_qname").select("snap", "type_qname", "parents", F.lit(False).alias("incomplete"))
    return R.linearizations(types, bases).where("mro is not null").select(F.col("qname").alias("key"), F.posexplode("mro").alias("pos", "member")).where("pos > 0").select("key", "member")


def imported_names(spark, d):
    """Import rows of the files that parse."""
    return _with_file(X.import_rows(facts(spark, d))).join(_known_files(spark, d), "file_key", "left_semi").select("file_key", "module", "name", "alias").distinct()


def built_keys(spark, d):
    """File keys and module-init keys from their parts."""
    f = G.current(table(spark, d, "files"), "file_key")
    return f.select(X.key("path").alias("built"), X.key("path", F.lit("module-init")).alias("module_init"))


def path_modules(spark, d):
    """Module names that paths give, for Python files."""
    f = facts(spark, d.rstrip("/")).select("path", "repo_name")
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "")
    return f.select("path", "repo_name", F.when(stem == "", F.col("repo_name")).otherwise(F.replace(stem, F.lit("/"), F.lit("."))).alias("module")).distinct()


def scalar_values(spark, d):
    """Ratios, key shapes and clamps over the call sites of a repository."""
    cs = table(spark, d, "call_sites")
    by = cs.groupBy("repo_name").agg(
        F.count("*").alias("sites"), F.count("target_key").alias("targets"), F.sum(F.when(F.col("target_key").contains("@") & F.col("target_key").contains(":"), 1).otherwise(0)).alias("keys"))
    return by.select("repo_name", "sites", "keys", C.ratio(F.col("targets"), F.col("sites")).alias("targeted"), C.ratio(F.col("keys"), F.col("targets")).alias("shaped"))


def source_against_graph(spark, d):
    """Symbols by kind: those the sources hold, and those the graph holds now."""
    source = extracted_symbols(spark, d).groupBy("kind").agg(F.count("*").alias("source"))
    graph = G.from_tables(spark, d).symbols.where("kind <> 'module_init' and file_key like '%.py'").groupBy("kind").agg(F.count("*").alias("graph"))
    return source.join(graph, "kind", "full")


def _notes(spark, d):
    doc = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("")).alias("repo_name"), F.lit("").alias("commit_sha"), doc.alias("path"), F.col("text").alias("content"))


def note_headings(spark, d):
    """The headings of the documents read as Markdown notes, with the headings above them."""
    return M.chunk_notes(_notes(spark, d)).where(F.col("text").rlike(r"^#{1,6}\s+.")).select("path", "start_line", "heading_path")


def chunk_mentions(spark, d):
    """Dotted names in the stored chunks, in order of first use."""
    chunks = table(spark, d, "doc_chunks").where("text is not null").select("chunk_key", "text").distinct()
    found = F.pandas_udf(lambda texts: texts.map(M.mentions), "array<string>")
    return chunks.select("chunk_key", F.md5("text").alias("text_md5"), F.array_join(found("text"), ";").alias("mentions"))


QUERIES = {f.__name__: f for f in (
    extracted_symbols, extracted_methods, extracted_docstrings, extracted_bases, extracted_calls, resolved_sites, resolved_owners, projected_calls, resolved_bases, mro_members, imported_names, built_keys, path_modules, scalar_values, source_against_graph, note_headings, chunk_mentions,
)}

_PLACE = ", ".join(PLACE)
_SITES = """cs AS (SELECT site_key, r.* FROM (SELECT site_key, arg_max(struct_pack(file_key := file_key, owner_key := owner_key, owner_qname := owner_qname, raw_callee := raw_callee, callee_name := callee_name, receiver_kind := receiver_kind,
    start_line := start_line, start_column := start_column, end_line := end_line, end_column := end_column, status := status, target_key := target_key), arrived_at) AS r FROM call_sites GROUP BY 1) WHERE r.file_key LIKE '%.py')"""
# a chain of three names or more is no receiver by name
_STATUS = "CASE WHEN receiver_kind = 'name' AND length(raw_callee) - length(replace(raw_callee, '.', '')) > 1 THEN 'dynamic' ELSE status END"
_SOUND = "status <> 'owner_unresolved' AND (target_key IS NULL OR target_key IN (SELECT symbol_key FROM symbols))"
_TYPES = """cur AS (SELECT symbol_key, r.* FROM (SELECT symbol_key, arg_max(struct_pack(file_key := file_key, kind := kind, qname := qname, repo_name := repo_name, docstring := docstring, deleted_at := deleted_at), arrived_at) AS r FROM symbols GROUP BY 1) WHERE r.deleted_at IS NULL
), one AS (SELECT split_part(file_key, ':', 1) AS snap, qname, max(symbol_key) AS k FROM cur WHERE kind = 'type' GROUP BY 1, 2 HAVING count(*) = 1
), inh AS (SELECT inherit_key, r.*, split_part(r.file_key, ':', 1) AS snap FROM (SELECT inherit_key, arg_max(struct_pack(file_key := file_key, type_qname := type_qname, base_name := base_name, base_qname := base_qname), arrived_at) AS r FROM inheritance GROUP BY 1))"""
_FILES = "f AS (SELECT file_key, r.* FROM (SELECT file_key, arg_max(struct_pack(repo_name := repo_name, commit_sha := commit_sha, path := path, content := content), arrived_at) AS r FROM files GROUP BY 1))"

# line ends as Python sees them
_NOTES = r"""lines AS (SELECT path, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT doc_id || '.md' AS path, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE text IS NOT NULL))"""

ORACLES = {
    "extracted_symbols": "SELECT DISTINCT symbol_key, file_key, kind, name, qname, signature, start_line, cyclomatic FROM symbols WHERE kind <> 'module_init' AND file_key LIKE '%.py'",
    "extracted_methods": "SELECT DISTINCT symbol_key, left(qname, length(qname) - length(name) - 1) AS parent_qname FROM symbols WHERE kind = 'method' AND file_key LIKE '%.py'",
    "extracted_docstrings": rf"WITH {_TYPES} SELECT symbol_key, md5(regexp_replace(docstring, '\s+', '', 'g')) AS docstring FROM cur WHERE trim(regexp_replace(docstring, '\s+', ' ', 'g')) <> '' AND file_key LIKE '%.py'",
    "extracted_bases": "SELECT DISTINCT file_key, type_qname, base_name FROM inheritance WHERE file_key LIKE '%.py'",
    "extracted_calls": f"WITH {_SITES} SELECT DISTINCT {_PLACE}, owner_qname, raw_callee, callee_name FROM cs",
    "resolved_sites": f"WITH {_SITES} SELECT DISTINCT {_PLACE}, {_STATUS} AS status, target_key FROM cs WHERE {_SOUND}",
    "resolved_owners": f"WITH {_SITES} SELECT DISTINCT {_PLACE}, owner_key FROM cs WHERE starts_with(owner_key, file_key || ':' || owner_qname || ':') AND owner_key IN (SELECT symbol_key FROM symbols)",
    "projected_calls": f"WITH {_SITES} SELECT DISTINCT {_PLACE}, target_key AS dst, status AS resolution FROM cs WHERE target_key IS NOT NULL AND {_SOUND}",
    "resolved_bases": f"""WITH {_TYPES} SELECT DISTINCT i.snap, i.type_qname, i.base_qname FROM inh i JOIN one c ON c.snap = i.snap AND c.qname = i.type_qname JOIN one p ON p.snap = i.snap AND p.qname = i.base_qname
  WHERE i.type_qname <> i.base_qname AND i.file_key LIKE '%.py' AND regexp_extract(i.base_qname, '[^.]*$') = i.base_name""",
    # types above which there is a cycle have no linearisation
    "mro_members": f"""WITH RECURSIVE {_TYPES}, e AS (SELECT DISTINCT c.k AS a, p.k AS b FROM inh i JOIN one c ON c.snap = i.snap AND c.qname = i.type_qname JOIN one p ON p.snap = i.snap AND p.qname = i.base_qname WHERE c.k <> p.k
  ), up AS (SELECT a, b FROM e UNION SELECT up.a, e.b FROM up JOIN e ON e.a = up.b
  ), cyc AS (SELECT DISTINCT a FROM up WHERE a = b)
  SELECT a AS key, b AS member FROM up WHERE a NOT IN (SELECT a FROM cyc) AND a NOT IN (SELECT u.a FROM up u WHERE u.b IN (SELECT a FROM cyc))""",
    "imported_names": rf"""WITH {_FILES}, l AS (SELECT file_key, trim(unnest(string_split(content, chr(10)))) AS line FROM f WHERE path LIKE '%.py' AND file_key IN (SELECT file_key FROM symbols WHERE kind <> 'module_init')
  ), i AS (SELECT file_key, NULL AS module, trim(unnest(string_split(regexp_extract(line, '^import\s+(.*)$', 1), ','))) AS part FROM l WHERE regexp_matches(line, '^import\s+[\w.]+(\s+as\s+\w+)?(\s*,\s*[\w.]+(\s+as\s+\w+)?)*$')
  UNION ALL SELECT file_key, regexp_extract(line, '^from\s+(\S+)\s+import', 1), trim(unnest(string_split(regexp_extract(line, '^from\s+\S+\s+import\s+(.*)$', 1), ','))) FROM l WHERE regexp_matches(line, '^from\s+[\w.]+\s+import\s+[\w*]+(\s+as\s+\w+)?(\s*,\s*\w+(\s+as\s+\w+)?)*$'))
  SELECT DISTINCT file_key, coalesce(module, regexp_extract(part, '^[\w.]+')) AS module, regexp_extract(part, '^[\w.*]+') AS name, nullif(regexp_extract(part, '\sas\s+(\w+)$', 1), '') AS alias FROM i""",
    "built_keys": f"WITH {_FILES} SELECT file_key AS built, file_key || ':module-init' AS module_init FROM f",
    "path_modules": rf"WITH {_FILES} SELECT DISTINCT path, repo_name, CASE WHEN path = '__init__.py' THEN repo_name ELSE replace(regexp_replace(regexp_replace(path, '\.py$', ''), '/__init__$', ''), '/', '.') END AS module FROM f WHERE path LIKE '%.py' AND content IS NOT NULL",
    "source_against_graph": f"""WITH {_TYPES} SELECT kind, a.source, b.graph FROM (SELECT kind, count(DISTINCT symbol_key) AS source FROM symbols WHERE kind <> 'module_init' AND file_key LIKE '%.py' GROUP BY 1) a
  FULL JOIN (SELECT kind, count(*) AS graph FROM cur WHERE kind <> 'module_init' AND file_key LIKE '%.py' GROUP BY 1) b USING (kind)""",
    # a heading stands above another one when no heading of its level or a higher one comes between
    "note_headings": rf"""WITH {_NOTES}, h AS (SELECT path, n, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\s+(.+?)\s*#*$', 1)) AS title FROM lines WHERE regexp_matches(line, '^#{{1,6}}\s+.+?\s*#*$')
  ), up AS (SELECT i.path, i.n, j.n AS m, j.title FROM h i JOIN h j ON j.path = i.path AND (j.n = i.n OR j.n < i.n AND j.level < i.level AND NOT EXISTS (SELECT 1 FROM h k WHERE k.path = i.path AND k.n > j.n AND k.n < i.n AND k.level <= j.level)))
  SELECT path, CAST(n AS INTEGER) AS start_line, string_agg(title, ' > ' ORDER BY m) AS heading_path FROM up GROUP BY 1, 2""",
    "chunk_mentions": r"""SELECT DISTINCT chunk_key, md5(text) AS text_md5, array_to_string(list_filter(list_distinct_ordered, lambda x: length(x) <= 120), ';') AS mentions FROM (SELECT chunk_key, text,
    list_transform(list_filter(list_zip(m, range(len(m))), lambda z: list_position(m, z[1]) = z[2] + 1), lambda z: z[1]) AS list_distinct_ordered FROM (SELECT DISTINCT chunk_key, text, regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b') AS m FROM doc_chunks WHERE text IS NOT NULL))""",
    "scalar_values": """SELECT repo_name, count(*) AS sites, CAST(count(*) FILTER (WHERE target_key LIKE '%@%' AND target_key LIKE '%:%') AS BIGINT) AS keys, round(count(target_key) / count(*), 6) AS targeted,
  CASE WHEN count(target_key) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE target_key LIKE '%@%' AND target_key LIKE '%:%') / count(target_key), 6) END AS shaped FROM call_sites GROUP BY 1""",
}
