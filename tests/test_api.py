import pytest

from graphloom import experiment
from graphloom.functions import keys
from graphloom.operators import callgraph_api, incremental, roots, vta, vta_small
from graphloom.sources import solution
from pyspark.sql import functions as F

SOURCE = """using System;
namespace App {
  public class EventArgs { }
  public class Clicked : EventArgs { }
  public interface IShape { int Area(int scale); }
  public class Square : IShape { public int Area(int scale) { return Helper.Twice(scale); } }
  public class Round : IShape { public int Area(int scale) { return 1; } }
  public static class Helper { public static int Twice(int x) { return x; } }
  public class Form {
    static Form() { Helper.Twice(1); }
    public void OnClick(object sender, Clicked e) { }
    [TestMethod] public void Check() { Show(new Square()); }
    void Show(IShape s) { s.Area(1); }
    private IShape Unknown() { IShape x = null; x.Area(2); return x; }
  }
  class Program { static void Main(string[] args) { var f = new Form(); f.Check(); } }
}
"""


@pytest.fixture(scope="module")
def app(spark):
    p = solution.from_source(spark, SOURCE, "src/App.cs")
    rules = vta.Rules(p)
    state = vta_small.solve(rules, roots.main(p))
    edges, _ = vta.call_graph(rules, roots.main(p), state)
    name = {r.method_id: r.full for r in callgraph_api.names(p).collect()}
    return p, rules, state, callgraph_api.CallGraph(edges, roots.main(p)), name, {v: k for k, v in name.items()}


def test_questions(app):
    _, _, _, g, name, ids = app
    of = lambda df, c="callee": {name[r[c]] for r in df.collect()}
    assert of(g.callees(ids["Form.Show"])) == {"Square.Area"} == of(g.callees(ids["Form.Show"], 1))
    with pytest.raises(KeyError):
        g.callees(ids["Form.Show"], 9)
    assert of(g.callers(ids["Square.Area"]), "caller") == {"Form.Show"}
    assert g.is_reachable(ids["Helper.Twice"]) and not g.is_reachable(ids["Round.Area"])
    assert g.is_called(ids["Form.Check"]) and not g.is_called(ids["Program.Main"]) and g.is_caller(ids["Program.Main"])
    assert g.inverted().count() == g.edges.count() and g.add_calls(g.edges).edges.count() == g.edges.count() and g.clear().edges.isEmpty()
    assert g.by_index(0).first()[0] == min(r[0] for r in g.nodes().collect())
    one = g.random_method(g.nodes().withColumn("project", F.lit("p")), 3).collect()
    assert len(one) == 1 and g.is_reachable(one[0].method_id)
    sample = callgraph_api.sample_queries(g.edges, 3, share=1.0).collect()
    assert len(sample) == 3 and all(not g.callees(r.method_id, r.ordinal).isEmpty() for r in sample)


def test_references_and_files(app, spark):
    p, _, _, g, name, ids = app
    symbols = spark.createDataFrame([(f"{ids['Form.Show']}@1",), (str(ids["Helper.Twice"]),), ("x@y",)], "symbol string")
    got = {(name[r.method_id], r.ordinal) for r in callgraph_api.references(g.edges, symbols).collect()}
    assert got == {("Square.Area", None), ("Square.Area", 1)}
    files = callgraph_api.annotations(p).collect()
    assert [r.path for r in files] == ["src/App.cs"]
    check = next(e for e in files[0].entities if e.name == "Check")
    assert check.line == 12 and [x.ordinal for x in check.refs] == [1, 2]


def test_methods_by_name(app):
    p = app[0]
    find = lambda *a, **k: {(r._full, r.name) for r in callgraph_api.find_methods(p, *a, **k).collect()}
    assert find(name="Area") == {("App.IShape", "Area"), ("App.Square", "Area"), ("App.Round", "Area")}
    assert find("App.Square", "Area") == find("Other.Square", "Area") == {("App.Square", "Area")}
    assert find(name="OnClick", params=[None, "Clicked"]) and not find(name="OnClick", params=[None, "Form"]) and not find(name="OnClick", params=[None])
    assert find("Helper", is_static=True) == {("App.Helper", "Twice")}
    assert callgraph_api.nodes_like(p, "send").first().name == "sender"


def test_root_kinds(app):
    p, rules, _, _, name, _ = app
    of = lambda df: {name[r.method_id] for r in df.collect()}
    assert of(roots.main(p)) == {"Program.Main"} and of(roots.tests(p)) == {"Form.Check"}
    assert of(roots.event_handlers(p, rules)) == {"Form.OnClick"} and len(of(roots.static_constructors(p))) == 1
    assert "Form.Unknown" in of(roots.all_methods(p)) and "IShape.Area" not in of(roots.all_methods(p))
    assert "Form.OnClick" in of(roots.public(p)) and "Form.Show" not in of(roots.public(p))
    assert of(roots.union(p, rules)) >= {"Program.Main", "Form.Check", "Form.OnClick", "Square.Area"}
    assert [roots.parse_kind(x) for x in ("main", "PUBLIC", "root", "x", None)] == ["Main", "Public", "Root", "Default", "Default"]


def test_receivers_without_types(app):
    """Propagation stops at them, queries and repair use the instantiated types that their declaration allows."""
    p, rules, _, _, name, ids = app
    start = p.methods.filter("name = 'Unknown' OR name = 'Check'").select("method_id")
    state = vta_small.solve(rules, start)
    called = lambda s: {name[r.callee] for r in s.resolved.collect() if r.method_id == ids["Form.Unknown"]}
    assert called(state) == set()
    assert called(vta.propagate(rules, start, repair=True)) == {"Square.Area"}
    edges, _ = vta.call_graph(rules, start, state)
    assert {name[r.callee] for r in edges.collect() if r.caller == ids["Form.Unknown"]} == {"Square.Area"}
    row = callgraph_api.compare_policies(state.resolved.select(F.col("method_id").alias("caller"), "ordinal", "callee"), edges).first()
    assert row.most == 1 and row.n_far == 0


def test_removal_of_statements(app):
    p, rules, state, _, name, ids = app
    gone = p.allocs.join(p.types.filter("name = 'Square'").select("type_id"), "type_id", "left_semi").select("method_id", "node_id", "type_id")
    after = incremental.remove_facts(p, state, roots.main(p), allocs=gone)
    left = {name[r.method_id] for r in after.active.collect()}
    assert "Square.Area" not in left and "Form.Show" in left
    assert "Square.Area" in {name[r.method_id] for r in state.active.collect()}


def test_keys():
    inner = keys.type_key("a-b", "N.M", "List", [keys.type_key("x", "", "T,1"), keys.type_key("x", "", "U:2", [keys.type_key("y", "", "V")])])
    assert keys.parse_type_key(inner) == ("a-b", "N.M", "List", [("x", "", "T,1", []), ("x", "", "U:2", [("y", "", "V", [])])])


def test_names_and_paths(spark):
    row = spark.range(1).select(
        keys.metadata_name(F.lit("C"), F.lit(2)).alias("a"), keys.display_name(F.lit("C"), F.array(F.lit("A"), F.lit("B"))).alias("b"), keys.full_name(F.lit("asm"), F.lit("N"), F.lit("C")).alias("c"),
        keys.own_file(F.lit("x/.NETFramework,Version.cs")).alias("d"), keys.relative_path(F.lit("C:\\w\\a\\b.cs"), "C:\\w").alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("C`2", "C<A, B>", "asm: N.C", False, "a/b.cs")


def test_experiment(spark, app):
    told = []
    row, state = experiment.run("e1", "app", lambda: app[0], told=told.append)
    assert told == ["Compiling", "Running", "ComputingResults", "Ready"] and row.first().methods == state.active.count()
    times = experiment.query_times("e1", "app", app[3], n=3, warm_up=1).first()
    assert times.repetitions == 3 and times.min_ms <= times.median_ms <= times.max_ms
    with pytest.raises(ZeroDivisionError):
        experiment.run("e2", "app", lambda: 1 / 0, told=told.append)
    assert told[-1] == "Failed"


def test_projects(spark):
    projects = spark.createDataFrame([("A", "one", "b.csproj", "C#"), ("A", "two", "a.csproj", "C#"), ("B", "x", "c", "VB")], "assembly string, name string, path string, language string")
    assert [r.name for r in solution.first_of_assembly(solution.csharp_projects(projects)).collect()] == ["two"]
    docs = spark.createDataFrame([("A", "a.cs", "class X { void M() { } }"), ("B", "b.cs", "class Y { }")], "assembly string, path string, source string")
    p = solution.from_documents(docs, projects)
    assert {r.name for r in p.types.filter("NOT is_library").collect()} == {"X"}
    edited = incremental.replace_documents(docs, docs.filter("path = 'a.cs'").select("assembly", F.lit("A.CS").alias("path"), F.lit("new").alias("source")))
    assert {(r.path, r.source) for r in edited.collect()} == {("A.CS", "new"), ("b.cs", "class Y { }")}
    bad = spark.createDataFrame([("A", "a.cs", "class X { ")], docs.schema)
    assert solution.diagnostics(docs).isEmpty() and solution.diagnostics(bad).count() == 1
    with pytest.raises(KeyError):
        solution.from_test(spark, "nothing")
    assert {r.is_library for r in solution.project_of(p, spark.createDataFrame([(1,)], "type_id long")).collect()} == {True}
