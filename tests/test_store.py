"""Scan, publish, export and the command line over a tree written by the test."""

import json

import pytest

from sorrel.plans import cli, evaluation
from sorrel.plans import graph as G
from sorrel.sources import export, scan
from sorrel.sources.store import SCHEMAS, Store, StoreError


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "alpha"
    (root / "pkg").mkdir(parents=True)
    (root / ".venv").mkdir()
    (root / ".venv" / "hidden.py").write_text("def hidden(): pass\n")
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "a b.py").write_text("def one():\n    two()\n\ndef two():\n    pass\n\nclass T:\n    def m(self):\n        self.m()\n")
    (root / "README.md").write_text("# Use\nThe function pkg.a b is odd.\n")
    return root


def test_identity_and_scan(spark, tree):
    repo, commit, root = scan.identity(tree)
    assert repo == "alpha" and len(commit) == 12
    (tree / "README.md").write_text("changed")
    assert scan.content_hash(tree) != commit
    git = tree / ".git" / "refs" / "heads"
    git.mkdir(parents=True)
    (tree / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "main").write_text("0123456789abcdef0123456789abcdef01234567\n")
    assert scan.identity(tree)[1] == "0123456789ab"
    assert {r.path for r in scan.scan(spark, tree).collect()} == {"pkg/__init__.py", "pkg/a b.py"}
    with pytest.raises(ValueError):
        scan.checked_roots(f"{tree};{tree}")
    with pytest.raises(ValueError):
        scan.identity(tree / "nothing")


def test_index_replace_delete_export(spark, tree, tmp_path, capsys):
    at = ["--store", str(tmp_path / "store")]
    assert cli.main([*at, "index", str(tree)], spark) == 0
    store = Store(spark, tmp_path / "store")
    assert {r.qname for r in store.read("symbols").collect()} == {"pkg.a b.one", "pkg.a b.two", "pkg.a b.T", "pkg.a b.T.m"}
    first = store.current
    (tree / "pkg" / "a b.py").write_text("def one():\n    pass\n")
    cli.main([*at, "reindex", str(tree)], spark)
    assert store.current != first and store.read("symbols").count() == 1

    def fail(read):
        raise ValueError("no")

    kept = store.current
    with pytest.raises(StoreError):
        store.replace("alpha", {}, fail)
    assert store.current == kept and store.read("symbols").count() == 1
    assert store.delete("nobody") == 0 and store.delete("alpha") == 4
    assert all(store.read(n).count() == 0 for n in SCHEMAS)
    with pytest.raises(StoreError):
        Store(spark, tmp_path / "none").read("symbols")


def test_documents_alone_and_other_repositories(spark, tree, tmp_path):
    store = Store(spark, tmp_path / "store")
    cli.index(spark, store, tree)
    other = tree.parent / "beta"
    other.mkdir()
    (other / "b.py").write_text("import os\nclass A:\n    def __init__(self):\n        pass\ndef make():\n    return A()\n")
    (other / "broken.py").write_text("def f(:\n")
    before = {n: dict(t) for n, t in store.current.items()}
    cli.index(spark, store, other)
    assert all(store.current[n].get("alpha") == before[n].get("alpha") for n in SCHEMAS)  # untouched
    counts = {n: store.read(n).count() for n in SCHEMAS}
    assert cli.main(["--store", str(tmp_path / "store"), "bulk-docs", str(tree)], spark) == 0
    assert {n: store.read(n).count() for n in SCHEMAS} == counts
    assert cli.main(["--store", str(tmp_path / "store"), "validate-bulk-index", str(tree)], spark) == 0
    (tree / "pkg" / "a b.py").write_text("def new():\n    pass\n")
    assert cli.main(["--store", str(tmp_path / "store"), "validate-bulk-index", str(tree)], spark) == 1
    kinds = {r.type: r["count"] for r in store.read("edges").where("repo_name = 'beta'").groupBy("type").count().collect()}
    assert kinds == {"CONTAINS": 7, "DEFINES": 2, "HAS_DIAGNOSTIC": 1, "INITIALIZES": 2, "HAS_METHOD": 1, "IMPORTS": 1, "HAS_CALLSITE": 1, "RESOLVES_TO": 1, "CALLS": 1, "EXACT_CALLS": 1, "CONSTRUCTS": 2}
    labels = {r.label: r["count"] for r in store.read("nodes").where("repo_name = 'beta'").groupBy("label").count().collect()}
    assert labels == {"Repository": 1, "File": 2, "Module": 3, "ParseDiagnostic": 1, "ModuleInit": 2, "Type": 1, "Function": 1, "Method": 1, "CallSite": 1}


def test_truth(spark, tree, tmp_path):
    _, g = cli.load(spark, tree)
    sites = [r.asDict() for r in g.resolved.select(*evaluation.SITE, "status").collect()]
    truth = {"call_sites": sites, "has_method": [["pkg.a b.T", "pkg.a b.T.m"]], "inherits": [], "calls": [["pkg.a b.one", "pkg.a b.two"], ["pkg.a b.T.m", "pkg.a b.T.m"]], "statuses": {"exact_local": 1, "self_direct": 1}, "lexical": [{"query": "one", "target": g.symbols.where("name = 'one'").first().key}]}
    (tmp_path / "t.json").write_text(json.dumps(truth))
    got = evaluation.compared(g, evaluation.load_truth(tmp_path / "t.json"))
    assert got["state"] == "passed" and got["lexical"]["top1"] == 1.0 and got["lexical"]["p95_ms"] > 0
    wrong = truth | {"call_sites": [sites[0] | {"status": "dynamic"}, *sites[1:]]}
    assert evaluation.compared(g, wrong)["state"] == "failed"
    assert evaluation.compared(g, truth | {"inherits": [["a", "b"]]})["differences"]["inherits"][0]["difference"] == "missing"
    (tmp_path / "u.json").write_text('{"inherits": []}')
    with pytest.raises(evaluation.EvaluationError):
        evaluation.load_truth(tmp_path / "u.json")


def test_export_round_trip(spark, tree, tmp_path):
    _, g = cli.load(spark, tree)
    a, b = export.export(g, tmp_path / "x"), export.export(g, tmp_path / "y")
    for f in sorted(p.name for p in a.parent.iterdir()):
        assert (a.parent / f).read_bytes() == (b.parent / f).read_bytes()
    m = export.read_manifest(a)
    assert m["nodes"]["Function"]["count"] == 2 and m["relationships"]["EXACT_CALLS"]["count"] == 2
    assert export.read_back(spark, a, "nodes", "Function").count() == 2
    nodes, edges = export.reload(spark, a)
    assert {r.start_line for r in nodes["Function"].collect()} == {1, 4} and edges["CALLS"].count() == 2 and "CONTAINS" in edges
    (a.parent / "nodes_Function.csv").unlink()
    with pytest.raises(export.ExportError):
        export.read_manifest(a)
    g.symbols = g.symbols.unionAll(g.symbols)
    with pytest.raises(export.ExportError):
        export.export(g, tmp_path / "z")
    assert not (tmp_path / "z").exists()


def test_evaluation_manifest(tmp_path, tree):
    good = {"version": 1, "corpora": [{"id": "a", "kind": "synthetic", "path": "alpha", "required": True, "pin": {"content_sha256": evaluation.tree_digest(tree)}}, {"id": "b", "kind": "dogfood", "path_env": "SORREL_NOWHERE", "pin": {"working_tree": "report"}}]}
    ready = evaluation.preflight(evaluation.check_manifest(good), tmp_path)
    assert [r["state"] for r in ready] == ["ready", "skipped"]
    for change in ({"version": 2}, {"corpora": good["corpora"][:1]}, {"corpora": [good["corpora"][0]] * 2}):
        with pytest.raises(evaluation.EvaluationError):
            evaluation.check_manifest(good | change)
    (tree / "new.py").write_text("x = 1\n")
    with pytest.raises(evaluation.EvaluationError):
        evaluation.preflight(good["corpora"], tmp_path)
    evaluation.write_report([{"state": "passed"}, {"state": "skipped"}], tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text())["summary"] == {"passed": 1, "failed": 0, "skipped": 1}


def test_graph_selectors_read_the_store(spark, tree, tmp_path):
    store = Store(spark, tmp_path / "s")
    cli.index(spark, store, tree)
    g = cli.stored(store)
    assert G.get_definition(g, "pkg.a b.one", repo="alpha").count() == 1
