"""The ten queries over a small graph of our own."""

import pytest

from sorrel.plans import graph as G

A = '''
import os
from lib.util import helper

def source():
    bridge()
    bridge()

def bridge():
    target()
    bridge()

def target():
    """Compress the ledger before the harbour closes."""
    helper()

def orphan():
    if a and b:
        for x in y: pass

class Root: pass
class Mid(Root): pass
class Leaf(Mid): pass

source()
'''
B = "def helper(): pass\ndef twin(): pass\ndef twin(): pass\n"
NOTE = "lost\n# Notes\nThe function lib.main.orphan drops pelicans.\n```\ncode lib.main.orphan\n```\n## Deep\nnothing\n"


@pytest.fixture(scope="module")
def g(spark):
    files = spark.createDataFrame([("r", "c1", "lib/main.py", A), ("r", "c1", "lib/util.py", B), ("s", "c9", "lib/main.py", "def source(): pass\n")], "repo_name string, commit_sha string, path string, content string")
    notes = spark.createDataFrame([("r", "c1", "README.md", NOTE)], "repo_name string, commit_sha string, path string, content string")
    return G.from_sources(files, notes)


def q(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_repositories_and_definition(g):
    assert q(G.list_repositories(g), "repo_name", "files") == [("r", 2), ("s", 1)]
    assert q(G.get_definition(g, "lib.main.source", repo="r"), "kind", "start_line") == [("function", 5)]
    for bad in ({"identifier": "lib.main.source"}, {"identifier": "lib.main.nope", "repo": "r"}, {"identifier": "lib.util.twin", "repo": "r"}, {"identifier": "r@c1:none", "repo": "r"}, {"identifier": "r@c1:lib/main.py:lib.main.source:5", "repo": "s"}):
        with pytest.raises(G.SymbolResolutionError):
            G.get_definition(g, **bad)


def test_callers_callees_paths(g):
    assert q(G.find_callees(g, "lib.main.source", repo="r"), "qname", "resolution") == [("lib.main.bridge", "exact_local")]
    deep = set(q(G.find_callees(g, "lib.main.source", repo="r", depth=3), "qname", "depth"))
    # the self call of bridge is one edge: it may be used once
    assert deep == {("lib.main.bridge", 1), ("lib.main.bridge", 2), ("lib.main.target", 2), ("lib.main.target", 3), ("lib.util.helper", 3)}
    assert q(G.find_callers(g, "lib.main.target", repo="r"), "qname") == [("lib.main.bridge",)]
    path = G.trace_call_path(g, "lib.main.source", "lib.util.helper", repo="r").collect()
    assert path[0].depth == 3 and [x.qname.split(".")[-1] for x in path[0].path] == ["source", "bridge", "target", "helper"]
    assert G.trace_call_path(g, "lib.main.source", "lib.main.source", repo="r").count() == 0


def test_hierarchy_dead_code_complexity_importers(g):
    assert q(G.get_class_hierarchy(g, "lib.main.Leaf", repo="r"), "qname", "depth") == [("lib.main.Mid", 1), ("lib.main.Root", 2)]
    assert q(G.get_class_hierarchy(g, "lib.main.Root", repo="r", direction="descendants"), "qname", "depth") == [("lib.main.Mid", 1), ("lib.main.Leaf", 2)]
    assert {x for x, in q(G.find_dead_code(g, "r"), "qname")} == {"lib.main.orphan", "lib.util.twin"}
    assert q(G.get_complexity(g, repo="r", top_n=1), "qname", "cyclomatic") == [("lib.main.orphan", 4)]
    assert q(G.find_importers(g, "lib.util", repo="r"), "path", "imported_name") == [("lib/main.py", "helper")]
    assert G.find_importers(g, "nothing", repo="r").count() == 0


def test_search(g):
    assert {x for x, in q(G.search_symbols(g, "main source", repo="r"), "qname")} == {"lib.main.source"}
    assert G.search_symbols(g, "", repo="s").count() == 1
    assert q(G.search_symbols(g, "ledger harbour", mode="lexical"), "qname") == [("lib.main.target",)]
    assert q(G.search_symbols(g, "pelicans", mode="lexical"), "qname") == [("lib.main.orphan",)]
    assert G.search_symbols(g, "pelicans", mode="lexical", kind="type").count() == 0


def test_tools_check_bounds_and_name_failures(g):
    from sorrel.plans.api import ReadError, Tools, read_rows

    tools = Tools(g)
    assert len(tools.names) == 10
    assert [r["repo_name"] for r in tools.call("list_repositories")] == ["r", "s"]
    for bad in ({"limit": 0}, {"depth": 11}, {"limit": 501}):
        with pytest.raises(ValueError):
            tools.call("find_callees", "lib.main.source", repo="r", **bad)
    with pytest.raises(ValueError):
        tools.call("search_symbols", "x", mode="semantic")
    with pytest.raises(ValueError):
        tools.call("delete_everything")
    from pyspark.sql import functions as F

    with pytest.raises(ReadError, match="broken"):
        read_rows(g.symbols.select(F.raise_error(F.lit("no"))), "broken")
