"""Registered queries over the whole program: root kinds, the full fixpoint, filtered types, references, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import callgraph, callgraph_api, incremental, roots, vta, vta_small
from graphloom.operators.fixpoint import cut, fixpoint
from graphloom.plans.base import CTES, query
from graphloom.plans.program_sql import PROGRAM, VTA
from graphloom.sources.star import Facts

PUBLIC = "SELECT o_orderkey::BIGINT AS method_id FROM orders JOIN f_method ON method_id = o_orderkey JOIN part ON p_partkey = type_id WHERE o_orderstatus = 'F' AND p_size % 2 = 0"
TESTS = f"{PUBLIC} AND o_orderpriority = '5-LOW'"
MAIN = "SELECT method_id FROM f_method WHERE is_root AND is_static"


@query(f"{CTES} {PUBLIC}")
def roots_public(f: Facts) -> DataFrame:
    return roots.public(f.program)


@query(f"{CTES} {TESTS}")
def roots_test_attr(f: Facts) -> DataFrame:
    return roots.tests(f.program)


@query(f"{CTES} {PUBLIC} UNION {MAIN}")
def roots_union(f: Facts) -> DataFrame:
    return roots.select(f.program, vta.Rules(f.program), "Public")


@query(f"{CTES} SELECT method_id FROM f_method")
def roots_all(f: Facts) -> DataFrame:
    return roots.all_methods(f.program)


@query(VTA + "SELECT k, a, b, c, d FROM g_all")
def full_vta_fixpoint(f: Facts) -> DataFrame:
    """The whole fixpoint as rows: A(method), P(node, type), R(method, ordinal, callee, receiver's type or -1)."""
    state = vta_small.solve(vta.Rules(f.program), f.methods.filter("is_root").select("method_id"))
    row = lambda k, a, b, c, d: [F.lit(k).alias("k"), *(x.cast("long").alias(n) for x, n in zip((a, b, c, d), "abcd"))]
    zero = F.lit(0)
    out = state.active.select(*row("A", F.col("method_id"), zero, zero, zero)).unionByName(state.pts.select(*row("P", F.col("node_id"), F.col("type_id"), zero, zero)))
    return out.unionByName(state.resolved.select(*row("R", F.col("method_id"), F.col("ordinal"), F.col("callee"), F.coalesce("recv", F.lit(-1)))))


@query(PROGRAM + """, g_pts AS (
  SELECT node, type_id FROM g_alloc
  UNION SELECT dst, p.type_id FROM g_pts p JOIN g_assign ON src = node JOIN g_node t ON t.node = dst JOIN g_sub u ON u.sup = t.declared AND u.sub = p.type_id
) SELECT node AS node_id, type_id FROM g_pts""")
def points_to_filtered(f: Facts) -> DataFrame:
    """Types of nodes within methods; an assignment carries those that its target's declared type allows."""
    p = f.program
    rules = vta.Rules(p)
    step = lambda new: rules.allowed(new.join(rules.assigns, new["node_id"] == rules.assigns["src"]).select(F.col("dst").alias("node_id"), "type_id"))
    return fixpoint(p.allocs.select("node_id", "type_id"), step)


@query(CTES + "SELECT caller, ordinal, static_target AS callee FROM f_call JOIN f_method ON method_id = static_target WHERE NOT is_static AND NOT is_virtual")
def resolve_nonvirtual(f: Facts) -> DataFrame:
    m = f.methods.filter("NOT is_static AND NOT is_virtual").select(F.col("method_id").alias("static_target"))
    return f.calls.join(m, "static_target").select("caller", "ordinal", F.col("static_target").alias("callee"))


#: Delegates of the star program: assignments whose part is a multiple of four also bind a method, calls of such suppliers go through the variable.
DELEGATES = """, f_bind AS (
  SELECT method_id, var, (a * 31 + b * 17 + ordinal) % (SELECT count(*) FROM orders) AS target FROM f_stmt WHERE stmt_kind = 'R' AND a % 4 = 0
), f_through AS (
  SELECT method_id, ordinal, var FROM f_stmt WHERE stmt_kind = 'N' AND b % 4 = 0
)
"""


@query(CTES + DELEGATES + """SELECT DISTINCT t.method_id AS caller, t.ordinal, CASE WHEN m.is_static THEN b.target ELSE coalesce(d.target, b.target) END AS callee
FROM f_through t JOIN f_bind b USING (method_id, var) JOIN f_method m ON m.method_id = b.target
LEFT JOIN f_pts p ON p.method_id = t.method_id AND p.var = t.var LEFT JOIN f_dispatch d ON d.recv_type = p.type_id AND d.slot = m.slot""")
def resolve_delegate(f: Facts) -> DataFrame:
    target = (F.col("a") * 31 + F.col("b") * 17 + F.col("ordinal")) % f.n_methods
    bound = f.statements.filter("stmt_kind = 'R' AND a % 4 = 0").select("method_id", "var", target.alias("target"))
    through = f.statements.filter("stmt_kind = 'N' AND b % 4 = 0").select("method_id", "ordinal", "var")
    m = f.methods.select(F.col("method_id").alias("target"), "slot", "is_static")
    held = through.join(bound, ["method_id", "var"]).join(m, "target").join(callgraph.points_to(f).withColumnRenamed("type_id", "recv_type"), ["method_id", "var"], "left")
    runs = callgraph.dispatch(f).withColumnRenamed("target", "impl")
    callee = F.when(F.col("is_static"), F.col("target")).otherwise(F.coalesce("impl", "target"))
    return held.join(runs, ["recv_type", "slot"], "left").select(F.col("method_id").alias("caller"), "ordinal", callee.alias("callee")).distinct()


BUSY = "(SELECT caller FROM f_edge GROUP BY caller ORDER BY count(*) DESC, caller LIMIT 1)"


def _graph(f: Facts) -> tuple[callgraph_api.CallGraph, int]:
    g = callgraph_api.CallGraph(cut(callgraph.edges(f)), f.methods.filter("is_root").select("method_id"))
    return g, g.edges.groupBy("caller").count().orderBy(F.desc("count"), "caller").first()[0]


@query(CTES + f"SELECT DISTINCT callee FROM f_edge WHERE caller = {BUSY}")
def callees_of(f: Facts) -> DataFrame:
    """The callees of the method with the most calls."""
    g, busy = _graph(f)
    return g.callees(busy)


@query(CTES + f"SELECT DISTINCT callee FROM f_edge WHERE caller = {BUSY} AND ordinal = (SELECT min(ordinal) FROM f_edge WHERE caller = {BUSY})")
def callees_at_site(f: Facts) -> DataFrame:
    g, busy = _graph(f)
    first = g.edges.filter(F.col("caller") == busy).agg(F.min("ordinal")).first()[0]
    return g.callees(busy, first)


@query(CTES + "SELECT callee, count(DISTINCT caller) AS n_callers, count(*) AS n_sites FROM f_edge GROUP BY callee ORDER BY n_callers DESC, callee LIMIT 20")
def top_referenced(f: Facts) -> DataFrame:
    own = callgraph.edges(f).groupBy("callee").agg(F.count_distinct("caller").alias("n_callers"), F.count("*").alias("n_sites"))
    return own.orderBy(F.desc("n_callers"), "callee").limit(20)


@query("""SELECT lower(o_orderpriority || '/' || o_orderkey) AS path FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 3 = 0
UNION SELECT lower(o_orderpriority || '/' || o_orderkey) FROM orders WHERE o_orderkey % 10 <> 1 AND o_orderkey % 3 = 0""")
def modified_documents(f: Facts) -> DataFrame:
    """Documents of a change list that the old or the new version has."""
    docs = f.table("orders").select("o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("path"))
    changed = docs.filter("o_orderkey % 3 = 0").select(F.upper("path").alias("path"))
    return incremental.modified_documents(docs.filter("o_orderkey % 10 <> 0"), docs.filter("o_orderkey % 10 <> 1"), changed)


@query(CTES + """SELECT caller || '@' || ordinal AS symbol, callee AS method_id, NULL::INT AS ordinal FROM f_edge WHERE caller % 5 = 0
UNION SELECT callee::VARCHAR, caller, ordinal FROM f_edge WHERE callee % 5 = 0""")
def parse_references(f: Facts) -> DataFrame:
    """What the symbols of every fifth method and of its call sites refer to."""
    edges = cut(callgraph.edges(f))
    sites = edges.filter("caller % 5 = 0").select(callgraph_api.symbol(F.col("caller"), F.col("ordinal")).alias("symbol"))
    own = edges.filter("callee % 5 = 0").select(callgraph_api.symbol(F.col("callee")).alias("symbol"))
    return callgraph_api.references(edges, sites.unionByName(own).distinct())


@query(CTES + "SELECT caller AS method_id, min(ordinal) AS ordinal FROM f_edge WHERE caller * 2654435761 % 4294967296 < 1073741824 GROUP BY caller ORDER BY caller * 2654435761 % 4294967296, caller LIMIT 50")
def random_sample_queries(f: Facts) -> DataFrame:
    """Fifty call sites of a quarter of the callers, by a multiplicative hash."""
    h = F.col("caller") * 2654435761 % 4294967296
    own = callgraph.edges(f).filter(h < 1073741824).groupBy("caller").agg(F.min("ordinal").alias("ordinal"))
    return own.orderBy(h, "caller").limit(50).withColumnRenamed("caller", "method_id")


@query(CTES + "SELECT caller, callee, count(*) AS n_sites FROM f_edge GROUP BY caller, callee")
def compressed_edges(f: Facts) -> DataFrame:
    g, _ = _graph(f)
    return g.compress()


@query("SELECT 'star' AS assembly, count(DISTINCT o_custkey % (SELECT count(*) FROM part)) AS n_types, count(*) AS n_methods, count_if(o_orderstatus = 'F' AND p_size % 2 = 0) AS n_public, count_if(o_orderkey % 50 = 0 AND o_orderpriority = '1-URGENT') AS n_main, whole FROM orders JOIN part ON p_partkey = o_custkey % (SELECT count(*) FROM part), (SELECT unnest([true, false]) AS whole) GROUP BY whole")
def program_statistics(f: Facts) -> DataFrame:
    return callgraph_api.statistics(f.program).withColumn("assembly", F.coalesce("assembly", F.lit("star")))
