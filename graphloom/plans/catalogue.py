"""The registered queries over program facts and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import callgraph
from graphloom.operators.fixpoint import cut
from graphloom.plans import more, program  # noqa: F401  they register their queries
from graphloom.plans.base import CTES, QUERIES, query
from graphloom.sources.star import Facts

def _query(sql: str, facts: bool = True):
    return query((CTES if facts else "") + sql)


@_query("SELECT method_id FROM f_reach")
def reachable_methods(f: Facts) -> DataFrame:
    return callgraph.reachable(callgraph.edges(f), f.methods.filter("is_root"))


@_query("SELECT sub, sup, dist FROM f_subtype")
def subtype_closure(f: Facts) -> DataFrame:
    return callgraph.subtypes(f)


@_query("SELECT recv_type, slot, target FROM f_dispatch")
def dispatch_table(f: Facts) -> DataFrame:
    return callgraph.dispatch(f)


@_query("SELECT method_id, var, type_id FROM f_pts")
def local_points_to(f: Facts) -> DataFrame:
    return callgraph.points_to(f)


@_query("SELECT caller, ordinal, callee FROM f_edge")
def call_edges_p(f: Facts) -> DataFrame:
    return callgraph.edges(f)


@_query("SELECT method_id, type_id FROM f_method WHERE is_root")
def roots_main(f: Facts) -> DataFrame:
    return f.methods.filter("is_root").select("method_id", "type_id")


@_query("SELECT DISTINCT callee, caller FROM f_edge")
def inverted_edges(f: Facts) -> DataFrame:
    return callgraph.edges(f).select("callee", "caller").distinct()


@_query("SELECT caller, ordinal, count(*) AS n_callees FROM f_edge GROUP BY ALL")
def callees_per_site(f: Facts) -> DataFrame:
    return callgraph.edges(f).groupBy("caller", "ordinal").agg(F.count("*").alias("n_callees"))


@_query("SELECT callee, count(*) AS n_sites FROM f_edge GROUP BY callee ORDER BY n_sites DESC, callee LIMIT 20")
def top_callees(f: Facts) -> DataFrame:
    return callgraph.edges(f).groupBy("callee").agg(F.count("*").alias("n_sites")).orderBy(F.desc("n_sites"), "callee").limit(20)


@_query("SELECT caller, count(*) AS n_calls FROM f_edge GROUP BY caller ORDER BY n_calls DESC, caller LIMIT 20")
def top_callers(f: Facts) -> DataFrame:
    return callgraph.edges(f).groupBy("caller").agg(F.count("*").alias("n_calls")).orderBy(F.desc("n_calls"), "caller").limit(20)


@_query("SELECT caller AS method_id, count(*) AS n_sites FROM f_call GROUP BY caller")
def callsite_count(f: Facts) -> DataFrame:
    return f.calls.groupBy(F.col("caller").alias("method_id")).agg(F.count("*").alias("n_sites"))


@_query("SELECT DISTINCT a AS type_id FROM f_stmt WHERE stmt_kind = 'A'")
def rta_instantiated(f: Facts) -> DataFrame:
    return f.allocs.select("type_id").distinct()


@_query("SELECT type_id, count(*) AS n_methods, count_if(is_static) AS n_static, count_if(is_virtual) AS n_virtual, count_if(is_root) AS n_roots FROM f_method GROUP BY type_id")
def solution_stats(f: Facts) -> DataFrame:
    return f.methods.groupBy("type_id").agg(F.count("*").alias("n_methods"), *(F.count_if(f"is_{x}").alias(f"n_{y}") for x, y in (("static", "static"), ("virtual", "virtual"), ("root", "roots"))))


@_query(
    """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS method_id, CASE WHEN a.o_orderkey IS NULL THEN 'Added' WHEN b.o_orderkey IS NULL THEN 'Removed' ELSE 'Updated' END AS kind
FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 1) b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM CASE WHEN b.o_orderkey % 7 = 0 THEN upper(b.o_orderpriority) ELSE b.o_orderstatus END""",
    facts=False,
)
def method_diff(f: Facts) -> DataFrame:
    return more.diff(f)


@_query("SELECT (user_id % 4)::BIGINT AS sender, (event_id % 4)::BIGINT AS receiver, count(*) AS n FROM events GROUP BY ALL", facts=False)
def msg_matrix(f: Facts) -> DataFrame:
    return f.table("events").groupBy((F.col("user_id") % 4).cast("long").alias("sender"), (F.col("event_id") % 4).cast("long").alias("receiver")).agg(F.count("*").alias("n"))


@_query("SELECT event_type AS op, count(*) AS n, count(DISTINCT user_id % 4) AS n_senders, min(value) AS least, max(value) AS most FROM events GROUP BY event_type", facts=False)
def latency_stats(f: Facts) -> DataFrame:
    return f.table("events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.count_distinct(F.col("user_id") % 4).alias("n_senders"), F.min("value").alias("least"), F.max("value").alias("most"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, folder, f=f: f(Facts(spark, folder)) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
