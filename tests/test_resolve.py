"""Extraction and resolution over small trees of our own."""

import pytest

from sorrel.operators import resolve as R
from sorrel.sources import extract as X

HELPERS = '''
def one(): pass
def two(): pass
class Tool:
    def __init__(self): pass
    def run(self): pass
class Plain:
    pass
'''
CASES = '''
import pkg.helpers as h
import json
from pkg.helpers import one, Tool as T
from outside import missing

class Base:
    def shared(self): pass
    def own(self): pass

class Left(Base):
    pass

class Right(Base):
    pass

class Both(Left, Right):
    def go(self):
        self.shared()
        self.go()
        super().own()
        super(Both, self).own()
        self.nothing()
        one()
        h.two()
        T()
        h.Plain()
        missing()
        json.dumps(1)
        unknown()
        x.y.z()
        f()()

    @classmethod
    def make(cls):
        cls.make()

class Loose(Elsewhere):
    def go(self):
        self.other()

def twice(): pass
def twice(): pass

def outer():
    def inner(): pass
    inner()
    twice()
    (lambda: one())()

outer()
'''


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("r", "c1", "pkg/__init__.py", ""), ("r", "c1", "pkg/helpers.py", HELPERS), ("r", "c1", "pkg/cases.py", CASES), ("r", "c1", "bad.py", "def f(\n"), ("r", "c1", "notes.md", "x"), ("other", "c1", "pkg/cases.py", "one()\n"), ("r", "c1", "null.py", None)]
    df = X.extract(spark.createDataFrame(rows, "repo_name string, commit_sha string, path string, content string"))
    return df.cache()


def test_extraction(facts):
    rows = {r.path: r for r in facts.where("repo_name = 'r'").collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/helpers.py", "pkg/cases.py", "bad.py"}
    assert rows["bad.py"].parse_status == "error" and rows["bad.py"].diagnostics[0].category == "syntax_error"
    names = [s.qname for s in rows["pkg/cases.py"].symbols]
    assert "pkg.cases.outer.<locals>.inner" in names and "pkg.cases.Both.go" in names
    assert [c.ordinal for c in rows["pkg/cases.py"].calls] == list(range(1, len(rows["pkg/cases.py"].calls) + 1))
    assert rows["pkg/__init__.py"].module_qname == "pkg"


def test_statuses(facts):
    got = {}
    for r in R.resolve(facts).where("repo_name = 'r'").collect():
        got.setdefault(r.raw_callee, []).append((r.status, (r.target_key or "").split(":")[-2:-1]))
    s = {k: [x[0] for x in v] for k, v in got.items()}
    assert s["self.shared"] == ["inherited_method"] and s["self.go"] == ["self_direct"] and s["cls.make"] == ["cls_direct"]
    assert s["super().own"] == ["super_method"] and s["super(Both, self).own"] == ["dynamic"] and s["self.nothing"] == ["unresolved"]
    assert s["h.two"] == ["exact_import"] and s["T"] == ["constructor_exact_import"] and s["h.Plain"] == ["constructor_exact_import"]
    assert s["missing"] == ["external"] and s["json.dumps"] == ["external"] and s["unknown"] == ["unresolved"] and s["x.y.z"] == ["dynamic"]
    assert s["one"] == ["exact_import", "exact_import"] and s["inner"] == ["exact_local"] and s["twice"] == ["ambiguous"] and s["outer"] == ["exact_local"]
    assert s["self.other"] == ["mro_incomplete"]
    assert "dynamic" in s["f()"]


def test_projections(facts):
    res = R.resolve(facts).where("repo_name = 'r'").cache()
    edges = R.projections(res).collect()
    assert all(e.owner_key and e.target_key for e in edges)
    init = [e for e in edges if "Tool.__init__" in e.target_key]
    assert len(init) == 1 and init[0].resolution == "exact_local"
    assert R.constructions(res).count() == 4
    sym = X.symbol_rows(facts)
    assert R.has_method_edges(sym).where("snap = 'r@c1'").count() == 7
    inh = {(e.child_key.split(":")[2], e.parent_key.split(":")[2]) for e in R.inherits_edges(X.inheritance_rows(facts), X.import_rows(facts), sym).collect()}
    assert inh == {("pkg.cases.Left", "pkg.cases.Base"), ("pkg.cases.Right", "pkg.cases.Base"), ("pkg.cases.Both", "pkg.cases.Left"), ("pkg.cases.Both", "pkg.cases.Right")}


def test_linearization():
    assert R.linearize("D", {"D": ["B", "C"], "B": ["A"], "C": ["A"]}, set()) == ["D", "B", "C", "A"]
    assert R.linearize("D", {"D": ["A", "B"], "B": ["A"]}, set()) is None
    assert R.linearize("A", {"A": ["B"], "B": ["A"]}, set()) is None
    assert R.linearize("A", {"A": ["B"]}, {"B"}) is None


def test_depth_costs_no_frames(spark):
    source = "def f(a):\n    return " + " + ".join(["g(a)"] * 3000) + "\n"
    df = spark.createDataFrame([("r", "c", "a.py", source), ("r", "c", "b.py", "x = " + "(" * 5000 + ")" * 5000)], "repo_name string, commit_sha string, path string, content string")
    got = {r.path: r for r in X.extract(df).collect()}
    assert len(got["a.py"].calls) == 3000 and got["b.py"].parse_status == "error" and len(got["b.py"].diagnostics) == 1
    n = 5000
    order = R.linearize("t0", {f"t{k}": [f"t{k + 1}"] for k in range(n)}, set())
    assert order == [f"t{k}" for k in range(n + 1)]
    assert R.linearize("a", {"a": ["b"], "b": ["a"]}, set()) is None and R.linearize("a", {"a": ["b", "c"], "b": ["d"], "c": ["d"]}, set()) == ["a", "b", "c", "d"]
    assert R.linearize("a", {"a": ["b", "c"], "b": ["c", "d"], "c": ["d"], "e": ["b"]}, {"d"}) is None
