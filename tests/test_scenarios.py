"""Small programs with the methods that must and must not be reached; all are one program, with a number for $ in their names."""

import pytest

from graphloom.operators import callgraph_api, incremental, roots, vta, vta_small
from graphloom.sources import solution

SCENARIOS = {
    "simple call": ("""class C$ { public virtual void m1(C$ x) { this.m2(x); x.m2(this); } public virtual void m2(C$ x) { } }
class D$ : C$ { public override void m2(C$ x) { x.Equals(this); } }
class P$ { static void Main() { var d = new D$(); d.m1(d); } }""", "C$.m1 D$.m2 Object.Equals", "C$.m2", "C$.m1>D$.m2"),
    "recursion": ("class P$ { static void Main() { r$(); } static void r$() { q$(); r$(); } static void q$() { r$(); } }", "P$.r$ P$.q$", "", "P$.r$>P$.r$ P$.r$>P$.q$ P$.q$>P$.r$ P$.Main>P$.r$"),
    "branches": ("class C$ { public virtual void m1() { } } class D$ : C$ { public override void m1() { } } class P$ { static void Main(string[] args) { C$ h = null; if (args.Length > 1) { h = new C$(); } else { h = new D$(); } h.m1(); } }", "C$.m1 D$.m1", "", ""),
    "interface": ("interface I$ { void M(); } class S$ : I$ { public void M() { } } class T$ : I$ { public void M() { } } class P$ { static void Main() { I$ v = new S$(); v.M(); } }", "S$.M", "T$.M I$.M", "P$.Main>S$.M"),
    "superclass": ("class A$ { public virtual void M() { } } class B$ : A$ { public override void M() { } } class P$ { static void Main() { A$ a = new B$(); a.M(); } }", "B$.M", "A$.M", ""),
    "loop": ("class C$ { public int Bound() { test$(); return 3; } void test$() { } } class P$ { static void Main() { var c = new C$(); for (int i = 0; i < c.Bound(); i++) { } foreach (var x in new C$[2]) { x.Bound(); } } }", "C$.Bound C$.test$", "", "P$.Main>C$.Bound"),
    "static delegate": ("delegate int F$(int x); class P$ { static int S(int x) { return x; } static int Unreachable(int x) { return x; } static void Main() { F$ a = new F$(P$.S); F$ b = P$.Unreachable; a(1); } }", "P$.S", "P$.Unreachable", ""),
    "interface delegate": ("delegate void F$(); interface I$ { void S(); void Unreachable(); } class S$ : I$ { public void S() { } public void Unreachable() { } } class P$ { static void Main() { I$ v = new S$(); F$ a = v.S; F$ b = v.Unreachable; a.Invoke(); } }", "S$.S", "S$.Unreachable", ""),
    "field in callee": ("""class C$ { public C$ f; public virtual void m1(C$ x) { f = x; Load(); } public void Load() { f.m2(this); } public virtual void m2(C$ x) { } }
class D$ : C$ { public override void m2(C$ x) { } } class P$ { static void Main() { C$ d = new D$(); d.m1(d); } }""", "C$.m1 D$.m2", "C$.m2", ""),
    "arrow": ("class P$ { static void Main() => Foo(); static void Foo() { } static void Other() { } }", "P$.Foo", "P$.Other", ""),
    "lambda": ("using System; class P$ { static void Foo() { } static void Main() { Action a = () => { Foo(); }; a(); } }", "P$.Foo", "", ""),
    "lambda as argument": ("using System; class Assert$ { public static void All(Func<int, bool> f) { f(1); } } class P$ { static void Main() { Assert$.All(x => x > 0); } }", "Assert$.All", "", ""),
    "extension": ("static class E$ { public static void Foo(this int x) { } } class P$ { static void Main() { var num = 1; num.Foo(); } }", "E$.Foo", "", ""),
    "static members": ("class S$ { public static int Field { get; set; } public static void Foo() { } } class P$ { static void Bar() { } static void Main() { Bar(); P$.Bar(); S$.Foo(); S$.Field = 1; var x = S$.Field; } }", "P$.Bar S$.Foo S$.get_Field S$.set_Field", "", ""),
    "property": ("class C$ { public C$ Field { get; set; } public virtual void m1() { } } class P$ { static void Main() { var c = new C$(); c.Field = c; c.Field.m1(); } }", "C$.get_Field C$.set_Field C$.m1", "", ""),
    "named arguments": ("class D$ { public virtual int GetValue() { return 1; } } class P$ { static int Take(int a = 1, D$ d = null) { return d.GetValue(); } static void Main() { Take(d: new D$()); } }", "P$.Take D$.GetValue", "", ""),
    "generic overload": ("class P$ { static void m1(bool b) { Error(); } static void m1<T>(T t) { Target(); } static void Error() { } static void Target() { } static void Main() { int x = 1; m1(x); } }", "P$.Target", "P$.Error", ""),
    "statements": ("class P$ { static void a$() { } static void b$() { } static void c$() { } static void d$() { } static void e$() { } static void g$() { } static void Main() { try { a$(); } catch (Exception x) { b$(); } finally { c$(); } switch (1) { case 1: d$(); break; default: break; } do { e$(); } while (false); var t = true ? 1 : Never(); lock (t) { using (var u = new P$()) g$(); } } static int Never() { return 1; } }", "P$.a$ P$.b$ P$.c$ P$.d$ P$.e$ P$.g$", "P$.Never", ""),
    "constructors": ("class F$ { } class C$ { F$ f = new F$(); public C$(int n) { Go(); } void Go() { } } class P$ { static void Main() { new C$(1); } }", "C$..ctor F$..ctor C$.Go", "", ""),
}

EDITS = {
    "remove override": ("class C$ { public virtual void m2() { } public virtual void m3() { } } class D$ : C$ { public override void m2() { m3(); } public override void m3() { } } class P$ { static void Main() { C$ c = new D$(); c.m2(); } }",
                        "class C$ { public virtual void m2() { } public virtual void m3() { } } class D$ : C$ { public override void m3() { } } class P$ { static void Main() { C$ c = new D$(); c.m2(); } }", "D$.m2 D$.m3", "C$.m2", "C$.m2", "D$.m2 D$.m3"),
    "add method": ("class P$ { static void Main() { } }", "class P$ { static void Main() { NewMethod(); } static void NewMethod() { } }", "P$.Main", "", "P$.NewMethod", ""),
    "update method": ("class C$ { public virtual void M1() { } public virtual void M2() { } public virtual void Middle() { } } class D$ : C$ { public override void M2() { } public override void Middle() { M1(); } } class P$ { static void Main() { C$ c = new D$(); c.Middle(); } }",
                      "class C$ { public virtual void M1() { } public virtual void M2() { } public virtual void Middle() { } } class D$ : C$ { public override void M2() { } public override void Middle() { M2(); } } class P$ { static void Main() { C$ c = new D$(); c.Middle(); } }", "D$.Middle C$.M1", "C$.M2 D$.M2", "D$.M2", "C$.M1 C$.M2"),
    "star": ("class B$ { public virtual void M() { } } class C1$ : B$ { public override void M() { } } class C2$ : B$ { public override void M() { } } class P$ { static B$ Make(int k) { if (k > 0) return new C1$(); return new C2$(); } static void Main() { B$ b = Make(1); b.M(); } }",
             "class B$ { public virtual void M() { } } class C1$ : B$ { public override void M() { } } class C2$ : B$ { public override void M() { } } class P$ { static B$ Make(int k) { return new B$(); } static void Main() { B$ b = Make(1); b.M(); } }", "C1$.M C2$.M", "B$.M", "B$.M", "C1$.M C2$.M"),
    "add override": ("class A$ { public virtual void Target() { } } class E$ : A$ { public override void Target() { } } class B$ { public virtual A$ M() { return new A$(); } } class C$ : B$ { } class P$ { static void Main() { B$ b = new C$(); A$ a = b.M(); a.Target(); } }",
                     "class A$ { public virtual void Target() { } } class E$ : A$ { public override void Target() { } } class B$ { public virtual A$ M() { return new A$(); } } class C$ : B$ { public override A$ M() { return new E$(); } } class P$ { static void Main() { B$ b = new C$(); A$ a = b.M(); a.Target(); } }", "B$.M A$.Target", "C$.M E$.Target", "C$.M E$.Target", "B$.M A$.Target"),
}


def named(program):
    return {r.method_id: r.full for r in callgraph_api.names(program).collect()}


def expect(text, k):
    return set(text.replace("$", str(k)).split())


@pytest.fixture(scope="module")
def analysed(spark):
    p = solution.from_source(spark, "\n".join(s[0].replace("$", str(k)) for k, s in enumerate(SCENARIOS.values())))
    rules = vta.Rules(p)
    start = roots.main(p)
    state = vta.propagate(rules, start)
    assert state.same(vta_small.solve(rules, start))
    edges, reached = vta.call_graph(rules, start, state)
    name = named(p)
    return {name[r.method_id] for r in reached.collect()}, {(name[r.caller], name[r.callee]) for r in edges.collect()}


@pytest.mark.parametrize("k, scenario", list(enumerate(SCENARIOS)))
def test_scenario(analysed, k, scenario):
    reached, edges = analysed
    _, yes, no, calls = SCENARIOS[scenario]
    assert expect(yes, k) <= reached and not expect(no, k) & reached
    assert {tuple(x.split(">")) for x in expect(calls, k)} <= edges


def test_edits_are_followed_as_from_scratch(spark):
    old, new = (solution.from_source(spark, "\n".join(e[i].replace("$", str(k)) for k, e in enumerate(EDITS.values()))) for i in (0, 1))
    start = roots.main(old)
    before = vta.propagate(vta.Rules(old), start)
    name = named(old) | named(new)
    graph = lambda p, s: {name[r.method_id] for r in vta.call_graph(vta.Rules(p), start, s)[1].collect()}
    was = graph(old, before)
    done = incremental.apply_modifications(old, new, before, start)
    now = graph(new, done.state)
    for k, (_, _, yes, no, yes2, no2) in enumerate(EDITS.values()):
        assert expect(yes, k) <= was and not expect(no, k) & was
        assert expect(yes2, k) <= now and not expect(no2, k) & now
    assert done.state.same(vta.propagate(vta.Rules(new), start))
    assert {r.kind for r in done.changes.collect()} == {"Added", "Removed", "Updated"}
