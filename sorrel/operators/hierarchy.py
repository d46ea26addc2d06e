"""Parent-child links to full hierarchies by hash splitters.

``links`` have the columns grp, child, parent (strings). A node is (grp, name); inside, it is one 64-bit code, and codes
that two nodes share are found and dealt again with another seed. A node is a *splitter* when its hash says so, or when
it has more than ``FAN`` parents (so that a walk through non-splitters branches little).

1. every node walks along its links until it meets a splitter or a node without parents: a *segment*;
2. segments between splitters are the links of a reduced graph, which is solved the same way again;
3. paths and pairs are expanded exactly from the segments; a walk that returns to its start without meeting a splitter
   is a splitterless cycle and is named on the spot.

Null children, parents: no link. Repeated links count once. Self links are cycles of length one. Empty input gives
empty results. A node with several parents has one path for each chain. Links that leave a node on a cycle end
the path there: the path's ``root`` is then that node and ``root_on_cycle`` is true. Descendants go on through cycles:
the nodes of a cycle are descendants of each other and of themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.plans.runtime import cut, is_empty

FAN = 2
STEPS = 2
SOLVE_LINKS = 200_000


def clean_links(df: DataFrame, grp, child: str, parent: str) -> DataFrame:
    return df.select(grp.alias("grp"), F.col(child).alias("child"), F.col(parent).alias("parent")).where("child is not null and parent is not null").distinct()


def _code(name: str, seed: int):
    return F.xxhash64("grp", name, F.lit(seed))


def coded(links: DataFrame, seed: int = 0) -> DataFrame:
    """Distinct links of codes: child, parent (long)."""
    return links.select(_code("child", seed).alias("child"), _code("parent", seed).alias("parent")).distinct()


def _shared(names: DataFrame) -> bool:
    """Whether two of the nodes (grp, name, id) have one code."""
    return not is_empty(names.groupBy("id").agg(F.min(F.struct("grp", "name")).alias("lo"), F.max(F.struct("grp", "name")).alias("hi")).where("lo <> hi"))


def _nodes(links: DataFrame, seed: int) -> DataFrame:
    both = links.select("grp", F.col("child").alias("name"), _code("child", seed).alias("id")).unionAll(links.select("grp", "parent", _code("parent", seed)))
    return both.distinct()


def _named_codes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coded links and their nodes (grp, name, id), without shared codes."""
    seed = 0
    while _shared(nodes := cut(_nodes(links, seed))):
        seed += 1
    return cut(coded(links, seed)), nodes


def _marked(links: DataFrame, salt: int) -> DataFrame:
    """Links with ``split``: whether the parent is a splitter, and ``top``: whether it has no parents itself."""
    out = links.groupBy(F.col("child").alias("parent")).agg(F.count("*").alias("n"))
    wide = F.coalesce(F.col("n"), F.lit(0)) > FAN
    return links.join(out, "parent", "left").select("child", "parent", (_hashed("parent", salt) | wide).alias("split"), F.col("n").isNull().alias("top"))


def _hashed(name: str, salt: int):
    return F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(2)) == 0


def walk(links: DataFrame, salt: int = 0) -> DataFrame:
    """Segments start, seg (nodes from start, without the end), end, kind.

    kind: ``split`` (end is a splitter), ``top`` (end has no parents), ``loop`` (back at start, no splitter met), ``astray``
    (the walk ran into a splitterless cycle elsewhere, whose own nodes report it).
    """
    edges = cut(_marked(links, salt))
    kind = (
        F.when(F.col("split"), "split").when(F.col("top"), "top").when(F.col("cur") == F.col("start"), "loop")
        .when(F.array_contains("seg", F.col("cur")), "astray").otherwise("go")
    )
    step = edges.select(F.col("child").alias("cur"), F.col("parent").alias("nxt"), "split", "top")
    front = edges.select(F.col("child").alias("start"), F.array("child").alias("seg"), F.col("parent").alias("cur"), "split", "top").withColumn("kind", kind)
    done = None
    while True:
        for _ in range(STEPS):
            ended = front.where("kind <> 'go'").select("start", "seg", F.col("cur").alias("end"), "kind")
            done = ended if done is None else done.unionAll(ended)
            go = front.where("kind = 'go'").select("start", F.concat("seg", F.array("cur")).alias("seg"), "cur")
            front = go.join(step, "cur").select("start", "seg", F.col("nxt").alias("cur"), "split", "top").withColumn("kind", kind)
        front = cut(front)
        if is_empty(front):
            return done


def _seg_links(segs: DataFrame) -> DataFrame:
    """The links along each segment."""
    n = F.concat("seg", F.array("end"))
    return segs.withColumn("n", n).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda i: F.struct(F.element_at("n", i).alias("child"), F.element_at("n", i + 1).alias("parent")))).alias("l")).select("l.child", "l.parent")


def _trim(links: DataFrame, rounds: int = STEPS) -> DataFrame:
    """Drop links out of nodes that nothing links to and into nodes that link nowhere; no cycle loses a link."""
    for _ in range(rounds):
        links = links.join(links.select(F.col("parent").alias("child")), "child", "left_semi")
        links = cut(links.join(links.select(F.col("child").alias("parent")), "parent", "left_semi").select("child", "parent"))
    return links


def _closed(links: DataFrame) -> DataFrame:
    """Links on cycles, by doubling of distinct reachable pairs; for what neither trimming nor contraction shrinks."""
    reach = _doubled(links.withColumn("d", F.lit(1)))
    return links.join(reach.select(F.col("parent").alias("child"), F.col("child").alias("parent")), ["child", "parent"], "left_semi")


def _doubled(pairs: DataFrame) -> DataFrame:
    """All pairs child, parent that chains of the given pairs join, with the least sum of their d."""
    best = cut(pairs.groupBy("child", "parent").agg(F.min("d").alias("d")))
    size = best.agg(F.count("*"), F.sum("d")).first()
    while True:
        a, b = best.select("child", F.col("parent").alias("m"), "d"), best.select(F.col("child").alias("m"), "parent", F.col("d").alias("d2"))
        more = a.join(b, "m").select("child", "parent", (F.col("d") + F.col("d2")).alias("d"))
        best = cut(best.unionAll(more).groupBy("child", "parent").agg(F.min("d").alias("d")))
        now = best.agg(F.count("*"), F.sum("d")).first()
        if now == size:
            return best
        size = now


def _on_cycles(pdf):
    """The links of one graph that lie on a cycle: both ends in one strongly connected component (Tarjan, iterative)."""
    out: dict[int, list[int]] = {}
    for c, p in zip(pdf["child"], pdf["parent"]):
        out.setdefault(c, []).append(p)
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    comp: dict[int, int] = {}
    open_: list[int] = []
    for root in out:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        open_.append(root)
        work = [(root, iter(out[root]))]
        while work:
            node, todo = work[-1]
            for p in todo:
                if p not in index:
                    index[p] = low[p] = len(index)
                    open_.append(p)
                    work.append((p, iter(out.get(p, ()))))
                    break
                if p not in comp:
                    low[node] = min(low[node], index[p])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        x = open_.pop()
                        comp[x] = index[node]
                        if x == node:
                            break
    return pdf[[c == p or comp[c] == comp[p] for c, p in zip(pdf["child"], pdf["parent"])]][["child", "parent"]]


def _solved(links: DataFrame) -> DataFrame:
    """Cycle links of a reduced graph of at most SOLVE_LINKS links (checked by the caller), in one task."""
    return links.withColumn("graph", F.lit(1)).groupBy("graph").applyInPandas(_on_cycles, "child long, parent long")


def cycle_links(links: DataFrame, solve_links: int = SOLVE_LINKS) -> DataFrame:
    """The coded links that lie on a cycle: child, parent.

    The reduced graph is solved in one step when it has at most ``solve_links`` links; else it is trimmed and contracted
    again, until nothing is left. Every round shrinks the graph by a tenth or ends in the closure of what is left.
    """
    levels = []
    cur, on, n = cut(links), None, None
    while True:
        if levels:
            m = cur.count()
            if 0 < m <= solve_links:
                on = _solved(cur)
                break
        loops = cur.where("child = parent")
        cur = _trim(cur.where("child <> parent"))
        m = cur.count()
        if m == 0 or n is not None and m > 0.9 * n:
            on = loops if m == 0 else loops.unionAll(_closed(cur))
            break
        n = m
        salt = len(levels)
        segs = cut(walk(cur, salt))
        levels.append((segs, loops))
        cur = cut(_from_splitters(segs, cur, salt).select(F.col("start").alias("child"), F.col("end").alias("parent")).distinct())
    for segs, loops in reversed(levels):
        o = on.select(F.col("child").alias("start"), F.col("parent").alias("end")).distinct()
        hit = segs.where("kind = 'loop'").unionAll(segs.where("kind = 'split'").join(o, ["start", "end"], "left_semi").select("start", "seg", "end", "kind"))
        on = cut(loops.unionAll(_seg_links(hit)).distinct())
    return on


def cycle_nodes(links: DataFrame, solve_links: int = SOLVE_LINKS) -> DataFrame:
    """Each node that reaches itself over one or more links: grp, node."""
    seed = 0
    while True:
        # a code that two nodes share may close a false cycle, but hides none: only the found nodes need to be told apart
        found = cut(cycle_links(coded(links, seed), solve_links).select(F.col("child").alias("id")).distinct())
        nodes = cut(links.select("grp", F.col("child").alias("name"), _code("child", seed).alias("id")).join(found, "id", "left_semi").select("grp", "name", "id").distinct())
        if not _shared(nodes):
            return nodes.select("grp", F.col("name").alias("node"))
        seed += 1


def _from_splitters(segs: DataFrame, links: DataFrame, salt: int, kind: str = "split") -> DataFrame:
    """Segments of that kind which start at a splitter."""
    wide = links.groupBy("child").agg(F.count("*").alias("n")).where(F.col("n") > FAN).select(F.col("child").alias("start"))
    some = segs.where(F.col("kind") == kind)
    return some.where(_hashed("start", salt)).unionAll(some.where(~_hashed("start", salt)).join(wide, "start", "left_semi").select(*some.columns))


def _chains(dag: DataFrame) -> DataFrame:
    """start, seg (start and the nodes above it, without the root), end (the root) of every chain of a graph without cycles."""
    segs = cut(walk(dag))
    none = F.array().cast("array<bigint>")
    tops = dag.select("parent").join(dag.select(F.col("child").alias("parent")), "parent", "left_anti").distinct()
    # chains of splitters, doubled until each ends at a top
    ready = cut(tops.select(F.col("parent").alias("start"), none.alias("seg"), F.col("parent").alias("end")).unionAll(_from_splitters(segs, dag, 0, "top").select("start", "seg", "end")))
    todo = cut(_from_splitters(segs, dag, 0).select("start", "seg", "end"))
    while not is_empty(todo):
        nxt = ready.withColumn("top", F.lit(True)).unionAll(todo.withColumn("top", F.lit(False))).select(F.col("start").alias("end"), F.col("seg").alias("seg2"), F.col("end").alias("end2"), "top")
        j = cut(todo.join(nxt, "end").select("start", F.concat("seg", "seg2").alias("seg"), F.col("end2").alias("end"), "top"))
        ready = cut(ready.unionAll(j.where("top").drop("top")))
        todo = j.where("not top").drop("top")
    heads = segs.where("kind in ('split', 'top')").select("start", "seg", "end")
    # a walk that ended at a top needs no chain: the top's own empty chain completes it
    return heads.join(ready.select(F.col("start").alias("end"), F.col("seg").alias("seg2"), F.col("end").alias("root")), "end").select("start", F.concat("seg", "seg2").alias("seg"), F.col("root").alias("end")).distinct()


def paths(links: DataFrame) -> DataFrame:
    """grp, node, path (array, root first), depth, root, root_on_cycle, on_cycle: one row for each chain of each node."""
    codes, nodes = _named_codes(links)
    cyc = cut(cycle_links(codes).select(F.col("child").alias("id")).distinct())
    dag = cut(codes.join(cyc.withColumnRenamed("id", "child"), "child", "left_anti"))
    full = _chains(dag).select("end", F.concat("seg", F.array("end")).alias("up"))
    alone = nodes.select("id").join(dag.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("end"), F.array("id").alias("up"))
    whole = cut(full.unionAll(alone).join(cyc.select(F.col("id").alias("end"), F.lit(True).alias("rc")), "end", "left").select("up", F.coalesce("rc", F.lit(False)).alias("root_on_cycle")).withColumn("row", F.monotonically_increasing_id()))
    # codes to names, once for each place of a path
    placed = whole.select("row", "root_on_cycle", F.posexplode("up").alias("pos", "id")).join(nodes, "id")
    named = placed.groupBy("row", "root_on_cycle").agg(F.max("grp").alias("grp"), F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("pos"), "name"))).alias("p")).select("grp", F.transform("p", lambda x: x["name"]).alias("path"), "root_on_cycle")
    depth = F.size("path") - 1
    return named.select("grp", F.element_at("path", -1).alias("node"), "path", depth.alias("depth"), F.element_at("path", 1).alias("root"), "root_on_cycle", (F.col("root_on_cycle") & (depth == 0)).alias("on_cycle"))


def descendants(links: DataFrame) -> DataFrame:
    """grp, node, descendant, distance (the shortest, in links): one row for each pair, never a collected list.

    A way up is a walk to the first splitter, a chain of splitters, and the beginning of a walk from the last splitter; the
    chains are the closure of the reduced graph.
    """
    codes, nodes = _named_codes(links)
    segs = cut(walk(codes))
    n = F.concat("seg", F.array("end"))
    near = segs.select("start", F.posexplode(F.slice(n, F.lit(2), F.size(n) - 1)).alias("pos", "up")).groupBy("start", "up").agg((F.min("pos") + 1).alias("d"))
    near = cut(near)
    wide = codes.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > FAN)
    ids = nodes.select("id")
    splitters = cut(ids.where(_hashed("id", 0)).unionAll(ids.where(~_hashed("id", 0)).join(wide, "id", "left_semi")))
    to_split = cut(near.join(splitters.withColumnRenamed("id", "up"), "up", "left_semi").select("start", F.col("up").alias("m"), "d"))
    from_split = near.join(splitters.withColumnRenamed("id", "start"), "start", "left_semi").select(F.col("start").alias("m"), "up", F.col("d").alias("d2"))
    reduced = to_split.join(splitters.withColumnRenamed("id", "start"), "start", "left_semi").select(F.col("start").alias("child"), F.col("m").alias("parent"), "d")
    chains = _doubled(reduced)
    # from a splitter to everything above it: its own walks, or those of the splitters it reaches
    far = cut(from_split.unionAll(chains.select(F.col("child").alias("start"), F.col("parent").alias("m"), "d").join(from_split, "m").select(F.col("start").alias("m"), "up", F.col("d") + F.col("d2"))).groupBy("m", "up").agg(F.min("d2").alias("d2")))
    beyond = to_split.join(far, "m").select("start", "up", (F.col("d") + F.col("d2")).alias("d"))
    pairs = near.select("start", "up", "d").unionAll(beyond).groupBy("start", "up").agg(F.min("d").alias("d"))
    above = pairs.join(nodes.select(F.col("id").alias("up"), "grp", F.col("name").alias("node")), "up")
    return above.join(nodes.select(F.col("id").alias("start"), F.col("name").alias("descendant")), "start").select("grp", "node", "descendant", F.col("d").alias("distance"))
