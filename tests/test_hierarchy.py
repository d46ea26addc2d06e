import random

import pytest
from pyspark.sql import functions as F

from sorrel.operators import hierarchy as H

SCHEMA = "grp string, child string, parent string"


def brute_cycles(rows):
    up = {}
    for g, c, p in rows:
        up.setdefault((g, c), set()).add((g, p))
    found = set()
    for s in up:
        seen, todo = set(), list(up[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        if s in seen:
            found.add(s)
    return found, up


def brute_paths(rows):
    cyc, up = brute_cycles(rows)

    def chains(n):
        if n in cyc or n not in up:
            return [[n[1]]]
        return [c + [n[1]] for p in up[n] for c in chains(p)]

    nodes = {(g, x) for g, c, p in rows for x in (c, p)}
    return sorted((n[0], n[1], tuple(c)) for n in nodes for c in chains(n))


def sample(seed):
    rng = random.Random(seed)
    rows = {("a", f"n{i}", f"n{rng.randrange(i, 40)}" if rng.random() < 0.9 else f"n{rng.randrange(40)}") for i in range(40) for _ in range(rng.choice([1, 1, 2, 3]))}
    rows |= {("b", f"c{i}", f"c{(i + 1) % 25}") for i in range(25)} | {("b", f"d{i}", f"d{i + 1}") for i in range(20)} | {("b", "d20", "c3"), ("b", "self", "self"), ("a", "c1", "c2")}
    return sorted(rows)


@pytest.mark.parametrize("bound", [10_000, 0])
def test_cycles_against_brute_force(spark, bound):
    rows = sample(3)
    got = {tuple(r) for r in H.cycle_nodes(spark.createDataFrame(rows, SCHEMA), bound).collect()}
    assert got == brute_cycles(rows)[0]


def test_paths_against_brute_force(spark):
    rows = [(g, c, p) for g, c, p in sample(5) if not (g == "a" and int(c[1:]) < 22)]
    want = brute_paths(rows)
    paths = H.paths(spark.createDataFrame(rows, SCHEMA)).cache()
    assert sorted((r.grp, r.node, tuple(r.path)) for r in paths.collect()) == want
    assert all(r.depth == len(r.path) - 1 and r.root == r.path[0] for r in paths.collect())


def brute_pairs(rows):
    up = brute_cycles(rows)[1]
    out = {}
    for s in up:
        front, d = set(up[s]), 1
        while front:
            for x in front:
                out[x[0], x[1], s[1]] = d
            front, d = {y for x in front for y in up.get(x, ()) if (y[0], y[1], s[1]) not in out}, d + 1
    return out


@pytest.mark.parametrize("seed", [5, 8])
def test_descendants_through_cycles_against_brute_force(spark, seed):
    rows = sample(seed)
    got = {(r.grp, r.node, r.descendant): r.distance for r in H.descendants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_pairs(rows)


def test_shared_codes_are_dealt_again(spark, monkeypatch):
    # the first seed gives every node of a group one code
    monkeypatch.setattr(H, "_code", lambda name, seed: F.xxhash64("grp", name, F.lit(seed)) if seed else F.xxhash64("grp"))
    rows = sample(3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in H.cycle_nodes(df).collect()} == brute_cycles(rows)[0]
    assert H.paths(df.where("grp = 'b'")).count() == len(brute_paths([r for r in rows if r[0] == "b"]))


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("r", "x", "y", 1), ("r", "x", "y", 2), ("r", "y", None, 3), ("r", None, "x", 4), ("r", "y", "x", 5)], "repo string, a string, b string, grp int")
    links = H.clean_links(df, F.col("repo"), "a", "b")
    assert links.count() == 2
    assert {r.node for r in H.cycle_nodes(links).collect()} == {"x", "y"}
    none = spark.createDataFrame([], SCHEMA)
    assert H.cycle_nodes(none).count() == 0 and H.paths(none).count() == 0 and H.descendants(none).count() == 0
