"""Static call resolution as joins over symbol, import and inheritance rows of one snapshot each.

Only C3 linearisation is Python: for each type, on the rows of its own ancestors, which an iterated join gathers; no task
holds a whole repository. Ambiguity stays visible: equal qualified names are never dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.plans.runtime import cut
from sorrel.sources import extract as X

EXACT = ("exact_local", "exact_import", "self_direct", "cls_direct", "inherited_method", "super_method")
STATUSES = (*EXACT, "owner_unresolved", "owner_ambiguous", "constructor_exact_local", "constructor_exact_import", "constructor_ambiguous", "ambiguous", "dynamic", "external", "unresolved", "mro_incomplete")


def bindings(imports: DataFrame) -> DataFrame:
    """snap, path, bound, target: the last from-import of a name, else its first plain import."""
    plain = F.col("name") == F.col("module")
    first = F.substring_index("module", ".", 1)
    bound = F.coalesce(F.when(F.col("alias") != "", F.col("alias")), F.when(plain, first).otherwise(F.col("name")))
    target = F.when(plain, F.when(F.col("alias").isNull(), first).otherwise(F.col("module"))).otherwise(F.concat_ws(".", "module", "name"))
    rows = imports.where("name <> '*'").select("snap", "path", bound.alias("bound"), target.alias("target"), "ord", plain.alias("plain"))
    return rows.groupBy("snap", "path", "bound").agg(F.max_by("target", F.when(~F.col("plain"), F.col("ord"))).alias("f"), F.min_by("target", F.when(F.col("plain"), F.col("ord"))).alias("p")).select("snap", "path", "bound", F.coalesce("f", "p").alias("target"))


def aliases(imports: DataFrame) -> DataFrame:
    """snap, path, bound, target as the inheritance edges read imports: later rows win, a module's first part only if nothing else bound it."""
    full = F.when(F.col("name") == F.col("module"), F.col("module")).otherwise(F.concat_ws(".", "module", "name"))
    named = F.coalesce(F.when(F.col("alias") != "", F.col("alias")), F.col("name"))
    sure = imports.select("snap", "path", "ord", named.alias("bound"), full.alias("target"), F.lit(True).alias("sure"))
    soft = imports.where("coalesce(alias, '') = ''").select("snap", "path", "ord", F.substring_index("module", ".", 1).alias("bound"), F.col("module").alias("target"), F.lit(False))
    rows = sure.unionAll(soft)
    return rows.groupBy("snap", "path", "bound").agg(F.max_by("target", F.when(F.col("sure"), F.col("ord"))).alias("a"), F.min_by("target", F.when(~F.col("sure"), F.col("ord"))).alias("b")).select("snap", "path", "bound", F.coalesce("a", "b").alias("target"))


def _inheritance_candidates(inheritance: DataFrame, bound: DataFrame) -> DataFrame:
    """Inheritance rows with ``rank`` and ``cand``: the base as written, its root rewritten, the bound base name."""
    root = F.substring_index("base_qname", ".", 1)
    rest = F.expr("substring(base_qname, length(substring_index(base_qname, '.', 1)) + 2)")
    b1 = bound.select("snap", "path", F.col("bound").alias("b1"), F.col("target").alias("t1"))
    b2 = bound.select("snap", "path", F.col("bound").alias("b2"), F.col("target").alias("t2"))
    i = inheritance.withColumn("b1", F.when(F.col("base_qname").contains("."), root)).withColumn("b2", F.col("base_name"))
    i = i.join(b1, ["snap", "path", "b1"], "left").join(b2, ["snap", "path", "b2"], "left")
    cands = F.array(F.col("base_qname"), F.when(F.col("t1").isNotNull(), F.concat_ws(".", F.col("t1"), rest)), F.col("t2"))
    return i.select("snap", "path", "ord", "type_qname", F.posexplode(cands).alias("rank", "cand")).where("cand is not null")


def base_rows(inheritance: DataFrame, bound: DataFrame, types: DataFrame) -> DataFrame:
    """snap, type_qname, parents (in clause order), incomplete. Every candidate counts; exactly one parent must come out."""
    unique = types.groupBy("snap", "qname").agg(F.count("*").alias("n"))
    cands = _inheritance_candidates(inheritance, bound)
    ts = types.select("snap", F.col("qname").alias("cand"), F.col("key").alias("pkey"))
    found = cands.join(ts, ["snap", "cand"], "left").groupBy("snap", "path", "ord", "type_qname").agg(F.count_distinct("pkey").alias("np"), F.max(F.when(F.col("pkey").isNotNull(), F.col("cand"))).alias("parent"))
    # clauses without any candidate keep their row
    clauses = inheritance.select("snap", "path", "ord", "type_qname").join(found, ["snap", "path", "ord", "type_qname"], "left")
    c = clauses.join(unique.withColumnRenamed("qname", "type_qname"), ["snap", "type_qname"], "left")
    ok = (F.col("np") == 1) & (F.col("n") == 1)
    return c.groupBy("snap", "type_qname").agg(
        F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("path", "ord", "parent")))), lambda x: x["parent"]).alias("parents"), F.max(~F.coalesce(ok, F.lit(False))).alias("incomplete"))


def c3_merge(orders: list[list[str]]) -> list[str] | None:
    """C3: the first head that stands behind no other one goes next; None if every head does."""
    left = [order[::-1] for order in orders if order]  # heads at the end
    behind = Counter(x for order in left for x in order[:-1])
    out: list[str] = []
    while left:
        free = [order[-1] for order in left if not behind[order[-1]]]
        if not free:
            return None
        out.append(free[0])
        for order in left:
            if order[-1] == free[0]:
                order.pop()
                if order:
                    behind[order[-1]] -= 1
        left = [order for order in left if order]
    return out


def linearize(start: str, parents: dict[str, list[str]], broken: set[str]) -> list[str] | None:
    """The method resolution order of a type, or None when a cycle, an incomplete or repeated type, or C3 prevents it.

    Types are settled when all their parents are: depth costs no frames."""
    if start in broken:
        return None
    waits = {t: len(parents.get(t, [])) for t in {start, *parents, *(p for ps in parents.values() for p in ps)}}
    children: dict[str, list[str]] = {}
    for t, ps in parents.items():
        for p in ps:
            children.setdefault(p, []).append(t)
    settled: dict[str, list[str] | None] = {}
    ready = [t for t, n in waits.items() if not n]
    while ready:
        t = ready.pop()
        above = parents.get(t, [])
        known = [settled[p] for p in above]
        # the order of a single base goes on as it is
        merged = None if t in broken or None in known else known[0] if len(known) == 1 else c3_merge([*known, above])
        settled[t] = None if merged is None else [t, *merged]
        for c in children.get(t, []):
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    return settled.get(start)  # what a cycle holds up is never settled


def linearizations(types: DataFrame, bases: DataFrame) -> DataFrame:
    """snap, qname, mro (null where there is none) of every qualified type name."""
    counts = types.groupBy("snap", "qname").agg(F.count("*").alias("n"))
    info = cut(counts.join(bases.withColumnRenamed("type_qname", "qname"), ["snap", "qname"], "left").select(
        "snap", "qname", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), (F.coalesce("incomplete", F.lit(False)) | (F.col("n") > 1)).alias("broken")))
    # a type without bases is its own order; the closure is that of the others
    lone = info.where(F.size("parents") == 0).select("snap", "qname", F.when(~F.col("broken"), F.array("qname")).alias("mro"))
    up = info.select("snap", "qname", F.explode("parents").alias("parent")).distinct()
    near = cut(up.select("snap", "qname", F.col("parent").alias("above")))
    known = near.count()
    while known:  # doubling: the number of rounds is the logarithm of the depth
        again = near.select("snap", "qname", F.col("above").alias("mid")).join(near.select("snap", F.col("qname").alias("mid"), "above"), ["snap", "mid"])
        near = cut(near.unionAll(again.select("snap", "qname", "above")).distinct())
        now = near.count()
        if now == known:
            break
        known = now
    near = near.unionAll(up.select("snap", "qname", F.col("qname").alias("above"))).distinct()
    rows = near.join(info.select("snap", F.col("qname").alias("above"), "parents", "broken"), ["snap", "above"]).groupBy("snap", "qname").agg(F.collect_list(F.struct("above", "parents", "broken")).alias("rows"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["mro"] = [linearize(q, {r["above"]: list(r["parents"]) for r in rows}, {r["above"] for r in rows if r["broken"]}) for q, rows in zip(pdf["qname"], pdf["rows"])]
            yield pdf[["snap", "qname", "mro"]]

    return lone.unionAll(rows.mapInPandas(run, "snap string, qname string, mro array<string>"))


def methods(symbols: DataFrame) -> DataFrame:
    """snap, type, name, keys of the methods a type defines itself."""
    m = symbols.where((F.col("kind") == "method") & (F.col("qname") == F.concat_ws(".", "parent_qname", "name")))
    return m.groupBy("snap", F.col("parent_qname").alias("type"), "name").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def _lexical(owner: str = "owner_qname", module: str = "module_qname", name: str = "callee_name"):
    """``scope.<locals>.name`` from the owner outwards, then ``module.name``."""
    parts = F.split(owner, r"\.<locals>\.")
    scopes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".<locals>."))
    inside = F.filter(scopes, lambda s: F.startswith(s, F.concat(F.col(module), F.lit("."))))
    return F.concat(F.transform(inside, lambda s: F.concat(s, F.lit(".<locals>."), F.col(name))), F.array(F.concat_ws(".", F.col(module), F.col(name))))


def resolve(facts: DataFrame) -> DataFrame:
    """One row per call site with status, owner_key, target_key, candidate_keys, construction_target_key, initializer columns and site_key."""
    facts = cut(facts)  # parsed once, read five times
    symbols, inits = cut(X.symbol_rows(facts)), X.init_rows(facts)
    types = symbols.where("kind = 'type'")
    bound = cut(bindings(X.import_rows(facts)))
    own = methods(symbols)
    mro = cut(linearizations(types, base_rows(X.inheritance_rows(facts), bound, types)))
    unique = types.groupBy("snap", "qname").agg(F.count("*").alias("n")).where("n = 1").select("snap", F.col("qname").alias("owner_type"))

    owners = symbols.where("kind <> 'type'").select("snap", "path", "qname", "key", "parent_qname").unionAll(inits.select("snap", "path", "qname", "key", F.lit(None).cast("string")))
    owners = owners.groupBy("snap", "path", "qname").agg(F.sort_array(F.collect_set("key")).alias("owner_keys"), F.max("parent_qname").alias("parent"))
    calls = X.call_rows(facts).join(owners.withColumnRenamed("qname", "owner_qname"), ["snap", "path", "owner_qname"], "left").withColumn("n_owner", F.coalesce(F.size("owner_keys"), F.lit(0)))
    calls = cut(calls.withColumn("owner_key", F.when(F.col("n_owner") == 1, F.element_at("owner_keys", 1))).withColumn("id", F.concat_ws("\x1f", "snap", "path", F.col("ordinal").cast("string"))))

    # direct candidates
    root = F.substring_index("raw_callee", ".", 1)
    b1 = bound.select("snap", "path", F.col("bound").alias("root"), F.col("target").alias("t1"))
    b2 = bound.select("snap", "path", F.col("bound").alias("bare"), F.col("target").alias("t2"))
    receiver = F.col("receiver_kind").isin("self", "cls", "super")
    direct = calls.where((F.col("n_owner") == 1) & ~receiver).withColumn("root", root).withColumn("bare", F.when(F.col("receiver_kind") == "none", F.col("callee_name")))
    direct = direct.join(b1, ["snap", "path", "root"], "left").join(b2, ["snap", "path", "bare"], "left")
    rewritten = F.when(F.col("t1").isNotNull(), F.concat(F.col("t1"), F.expr("substring(raw_callee, length(substring_index(raw_callee, '.', 1)) + 1)")))
    lexical = F.when((F.col("receiver_kind") == "none") & F.col("callee_name").isNotNull(), _lexical()).otherwise(F.array().cast("array<string>"))
    imported = F.filter(F.array(rewritten, F.col("t2")), lambda x: x.isNotNull())
    every = F.array_distinct(F.filter(F.concat(F.array("callee_qname_hint"), lexical, imported), lambda x: x.isNotNull() & (x != "")))
    direct = direct.withColumn("imported", imported).withColumn("cands", every)
    refs = symbols.select("snap", F.col("qname").alias("cand"), F.col("key").alias("skey"), F.col("kind").alias("skind"))
    hits = direct.select("id", "snap", "imported", F.explode("cands").alias("cand")).join(refs, ["snap", "cand"])
    hit = F.struct("skey", "cand", F.array_contains("imported", F.col("cand")).alias("imp"))
    found = hits.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(F.col("skind") == "type", hit))).alias("ts"), F.sort_array(F.collect_set(F.when(F.col("skind") != "type", hit))).alias("cs"))
    d = direct.join(found, "id", "left")
    nt = F.when(F.col("receiver_kind").isin("none", "name"), F.coalesce(F.size("ts"), F.lit(0))).otherwise(0)
    nc = F.coalesce(F.size("cs"), F.lit(0))
    how = lambda base, x: F.when(F.element_at(x, 1)["imp"], F.lit(base + "_import")).otherwise(F.lit(base + "_local"))
    keys_of = lambda x: F.transform(x, lambda s: s["skey"])
    none = F.array().cast("array<string>")
    d = d.select(
        "id",
        F.when(nt == 1, how("constructor_exact", F.col("ts"))).when(nt > 1, "constructor_ambiguous").when(nc == 1, how("exact", F.col("cs"))).when(nc > 1, "ambiguous")
        .when(F.col("receiver_kind").isin("dynamic", "attribute"), "dynamic").when(F.col("t1").isNotNull(), "external").otherwise("unresolved").alias("status"),
        F.when(nt > 0, keys_of("ts")).when(nc > 0, keys_of("cs")).otherwise(none).alias("candidate_keys"),
        F.when((nt == 0) & (nc == 1), F.element_at("cs", 1)["skey"]).alias("target_key"),
        F.when(nt == 1, F.element_at("ts", 1)["skey"]).alias("construction_target_key"), F.when(nt == 1, F.element_at("ts", 1)["cand"]).alias("ctype"), "snap")

    # initialisers of types: their own, else the first in the linearisation
    chain = mro.where("mro is not null").select("snap", "qname", F.posexplode("mro").alias("pos", "type"))
    init = own.where("name = '__init__'")
    at = chain.join(init, ["snap", "type"]).groupBy("snap", "qname").agg(F.min_by(F.struct("pos", "keys"), "pos").alias("m"))
    mine = init.select("snap", F.col("type").alias("qname"), F.struct(F.lit(0).alias("pos"), "keys").alias("own"))
    starts = at.join(mine, ["snap", "qname"], "full").select("snap", F.col("qname").alias("ctype"), F.coalesce("own", "m").alias("m"))
    one = F.size("m.keys") == 1
    d = d.join(starts, ["snap", "ctype"], "left").select(
        "id", "status", "candidate_keys", "target_key", "construction_target_key", F.coalesce("m.keys", none).alias("initializer_candidate_keys"),
        F.when(one, F.element_at("m.keys", 1)).alias("initializer_target_key"), F.when(one, F.when(F.col("m.pos") == 0, "exact_local").otherwise("inherited_method")).alias("initializer_status"))

    # self, cls and super
    r = calls.where((F.col("n_owner") == 1) & receiver).withColumn("owner_type", F.col("parent"))
    r = r.join(unique.withColumn("known", F.lit(True)), ["snap", "owner_type"], "left").join(mro.select("snap", F.col("qname").alias("owner_type"), "mro"), ["snap", "owner_type"], "left")
    steps = r.where("known").select("id", "snap", "receiver_kind", F.col("callee_name").alias("name"), F.posexplode(F.coalesce("mro", F.array("owner_type"))).alias("pos", "type")).where("pos > 0 or receiver_kind <> 'super'")
    first = steps.join(own, ["snap", "type", "name"]).groupBy("id").agg(F.min_by(F.struct("pos", "keys"), "pos").alias("m"))
    r = r.join(first, "id", "left")
    n, pos, sup = F.size("m.keys"), F.col("m.pos"), F.col("receiver_kind") == "super"
    status = (
        F.when(sup & ~F.col("raw_callee").startswith("super()."), "dynamic").when(F.col("known").isNull(), "unresolved")
        .when(F.col("m").isNotNull() & (n > 1), "ambiguous").when(F.col("m").isNotNull() & (pos == 0), F.concat("receiver_kind", F.lit("_direct")))
        .when(F.col("m").isNotNull(), F.when(sup, "super_method").otherwise("inherited_method")).when(F.col("mro").isNull(), "mro_incomplete").otherwise("unresolved")
    )
    r = r.withColumn("status", status)
    hit_ = F.col("status").isin("ambiguous", "self_direct", "cls_direct", "inherited_method", "super_method")
    r = r.select("id", "status", F.when(hit_, F.col("m.keys")).otherwise(none).alias("candidate_keys"), F.when(hit_ & (n == 1), F.element_at("m.keys", 1)).alias("target_key"))
    both = d.unionByName(r, allowMissingColumns=True)

    out = calls.join(both, "id", "left")
    status = F.when(F.col("n_owner") == 0, "owner_unresolved").when(F.col("n_owner") > 1, "owner_ambiguous").otherwise(F.col("status"))
    out = out.withColumn("status", status).withColumn("candidate_keys", F.when(F.col("n_owner") > 1, F.col("owner_keys")).otherwise(F.coalesce("candidate_keys", none)))
    span = [F.col(c).cast("string") for c in ("start_line", "start_column", "end_line", "end_column", "ordinal")]
    return out.withColumn("site_key", F.concat(F.col("snap"), F.lit(":"), F.concat_ws(":", "path", F.lit("callsite"), F.coalesce("owner_key", "owner_qname"), *span))).withColumn(
        "initializer_candidate_keys", F.coalesce("initializer_candidate_keys", none)).drop("id", "owner_keys", "parent", "n_owner", "ord")


def has_method_edges(symbols: DataFrame) -> DataFrame:
    """type_key, method_key where exactly one type has the parent's name."""
    types = symbols.where("kind = 'type'").groupBy("snap", F.col("qname").alias("parent_qname")).agg(F.count("*").alias("n"), F.max("key").alias("type_key")).where("n = 1")
    return symbols.where("kind = 'method'").join(types, ["snap", "parent_qname"]).select("snap", "type_key", F.col("key").alias("method_key")).distinct()


def inherits_edges(inheritance: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """child_key, parent_key: the first candidate with exactly one match wins; no self edges, no repeats."""
    one = symbols.where("kind = 'type'").groupBy("snap", "qname").agg(F.count("*").alias("n"), F.max("key").alias("k")).where("n = 1")
    cands = _inheritance_candidates(inheritance, aliases(imports))
    parents = cands.join(one.select("snap", F.col("qname").alias("cand"), F.col("k").alias("parent_key")), ["snap", "cand"])
    best = parents.groupBy("snap", "path", "ord", "type_qname").agg(F.min_by("parent_key", "rank").alias("parent_key"))
    child = one.select("snap", F.col("qname").alias("type_qname"), F.col("k").alias("child_key"))
    return best.join(child, ["snap", "type_qname"]).where("child_key <> parent_key").select("snap", "child_key", "parent_key").distinct()


def projections(resolved: DataFrame) -> DataFrame:
    """CALLS, EXACT_CALLS and RESOLVES_TO share these rows: edge_key, owner_key, target_key, resolution, line, column."""
    target = F.coalesce("target_key", "initializer_target_key")
    how = F.when(F.col("target_key").isNotNull(), F.col("status")).otherwise(F.col("initializer_status"))
    rows = resolved.where(F.col("owner_key").isNotNull() & target.isNotNull())
    return rows.select("snap", F.col("site_key").alias("edge_key"), "owner_key", target.alias("target_key"), how.alias("resolution"), F.col("start_line").alias("line_no"), F.col("start_column").alias("column_no"))


def constructions(resolved: DataFrame) -> DataFrame:
    """Two CONSTRUCTS edges for each construction of one known type: from the site and from its owner."""
    rows = resolved.where("owner_key is not null and construction_target_key is not null")
    return rows.select("snap", F.col("site_key").alias("edge_key"), F.explode(F.array("site_key", "owner_key")).alias("src_key"), F.col("construction_target_key").alias("type_key"), F.col("status").alias("resolution"), F.col("start_line").alias("line_no"), F.col("start_column").alias("column_no"))


def status_histogram(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("n"))
