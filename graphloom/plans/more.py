"""More registered queries: resolution policies, deletion steps, set operations, telemetry and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import callgraph, incremental, resolution
from graphloom.operators.fixpoint import cut
from graphloom.plans.base import CTES, query
from graphloom.sinks import graphs
from graphloom.sources.star import Facts
from graphloom.streaming import monitor

Q = """, f_compat AS (
  SELECT DISTINCT s.sup AS type_id, s.sub AS compatible FROM f_subtype s JOIN f_stmt a ON a.stmt_kind = 'A' AND a.a = s.sub
), f_back AS (
  SELECT DISTINCT c.type_id, d.slot, d.target FROM f_compat c JOIN f_dispatch d ON d.recv_type = c.compatible
), f_fall AS (
  SELECT * FROM f_back UNION ALL SELECT recv_type, slot, target FROM f_dispatch d WHERE NOT EXISTS (SELECT 1 FROM f_back b WHERE b.type_id = d.recv_type AND b.slot = d.slot)
), f_edge_q AS (
  SELECT * FROM f_edge
  UNION SELECT c.caller, c.ordinal, coalesce(b.target, c.static_target)
  FROM f_call c JOIN f_method m ON m.method_id = c.static_target AND m.is_virtual LEFT JOIN f_fall b ON b.type_id = m.type_id AND b.slot = m.slot
  WHERE NOT EXISTS (SELECT 1 FROM f_edge e WHERE e.caller = c.caller AND e.ordinal = c.ordinal)
)
"""
CHANGED = """, f_diff AS (
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS method_id, CASE WHEN a.o_orderkey IS NULL THEN 'Added' WHEN b.o_orderkey IS NULL THEN 'Removed' ELSE 'Updated' END AS kind
  FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 1) b ON a.o_orderkey = b.o_orderkey
  WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM CASE WHEN b.o_orderkey % 7 = 0 THEN upper(b.o_orderpriority) ELSE b.o_orderstatus END
)
"""


def diff(f: Facts) -> DataFrame:
    """(method_id, kind) between the old and the new version of the orders."""
    orders, key = f.table("orders"), F.col("o_orderkey")
    old = orders.filter(key % 10 != 0).select(key.alias("method_id"), F.col("o_orderstatus").alias("body_text"))
    new = orders.filter(key % 10 != 1).select(key.alias("method_id"), F.when(key % 7 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("body_text"))
    return incremental.method_diff(old, new)


MADE = "SELECT a AS type_id FROM f_stmt WHERE stmt_kind = 'A'"
HELD = "SELECT type_id FROM f_method"


def log(f: Facts) -> DataFrame:
    """The message log: sender, receiver, op, latency, time."""
    part = lambda c: (F.col(c) % 4).cast("long")
    return f.table("events").select("event_id", "ts", part("user_id").alias("sender"), part("event_id").alias("receiver"), F.col("event_type").alias("op"), "value", "user_id")


def _totals(df: DataFrame, **marks: str) -> DataFrame:
    """Subtotals are called `all`; a key that is null itself stays null."""
    named = {c: F.when(F.col(m) == 1, "all").otherwise(F.col(c)) for c, m in marks.items()}
    return df.withColumns(named).drop(*marks.values())


@query(CTES + Q + "SELECT caller, ordinal, callee FROM f_edge_q")
def call_edges_q(f: Facts) -> DataFrame:
    return resolution.edges_q(f)


@query(CTES + Q + ", f_graph AS (SELECT method_id FROM f_method WHERE is_root UNION SELECT callee FROM f_graph JOIN f_edge_q ON caller = method_id) SELECT method_id FROM f_graph")
def call_graph_q(f: Facts) -> DataFrame:
    return callgraph.reachable(resolution.edges_q(f), f.methods.filter("is_root"))


@query(CTES + Q + "SELECT type_id, compatible FROM f_compat")
def rta_compatible_types(f: Facts) -> DataFrame:
    return resolution.compatible(f)


@query(CTES + ", f_level AS (SELECT method_id, 0 AS depth FROM f_method WHERE is_root UNION SELECT callee, depth + 1 FROM f_level JOIN f_edge ON caller = method_id WHERE depth < 200) SELECT method_id, min(depth) AS depth FROM f_level GROUP BY method_id")
def bfs_levels(f: Facts) -> DataFrame:
    return resolution.levels(callgraph.edges(f), f.methods.filter("is_root"))


@query(CTES + ", f_one AS (SELECT min(method_id) AS method_id FROM f_method WHERE is_root UNION SELECT callee FROM f_one JOIN f_edge ON caller = method_id) SELECT method_id FROM f_one")
def reachable_from_one(f: Facts) -> DataFrame:
    return callgraph.reachable(callgraph.edges(f), f.methods.filter("is_root").agg(F.min("method_id").alias("method_id")))


@query(CTES + "SELECT sub, sup FROM f_subtype WHERE dist > 0")
def is_subtype_pairs(f: Facts) -> DataFrame:
    return callgraph.subtypes(f).filter("dist > 0").select("sub", "sup")


@query(CTES + "SELECT caller, ordinal, static_target AS callee FROM f_call JOIN f_method ON method_id = static_target WHERE is_static")
def resolve_static(f: Facts) -> DataFrame:
    return f.calls.join(f.methods.filter("is_static").select(F.col("method_id").alias("static_target")), "static_target").select("caller", "ordinal", F.col("static_target").alias("callee"))


@query(CTES + "SELECT caller, ordinal, e.callee FROM f_edge e JOIN f_call c USING (caller, ordinal) JOIN f_method ON method_id = c.static_target WHERE is_virtual")
def resolve_virtual(f: Facts) -> DataFrame:
    virtual = f.calls.join(f.methods.filter("is_virtual").select(F.col("method_id").alias("static_target")), "static_target").select("caller", "ordinal")
    return callgraph.edges(f).join(virtual, ["caller", "ordinal"], "left_semi")


@query(CTES + "SELECT e.callee, e.caller, e.ordinal FROM f_edge e WHERE e.callee = (SELECT min(callee) FROM f_edge)")
def callers_of(f: Facts) -> DataFrame:
    edges = cut(callgraph.edges(f))
    return edges.join(edges.agg(F.min("callee").alias("callee")), "callee", "left_semi").select("callee", "caller", "ordinal")


@query(CTES + "SELECT a.callee AS one, b.callee AS other, count(DISTINCT a.caller) AS n FROM f_edge a JOIN f_edge b ON a.caller = b.caller AND a.callee < b.callee GROUP BY ALL ORDER BY n DESC, one, other LIMIT 20")
def cooccurrence(f: Facts) -> DataFrame:
    """Callees that most callers have in common; a caller's pairs are bounded by the size of one method."""
    pairs = cut(callgraph.edges(f).select("caller", F.col("callee").alias("one")).distinct())
    both = pairs.join(pairs.withColumnRenamed("one", "other"), "caller").filter("one < other")
    return both.groupBy("one", "other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "one", "other").limit(20)


@query(CTES + "SELECT CASE WHEN grouping(iface) = 1 THEN 'all' ELSE iface END AS project, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS n_methods, count_if(is_virtual) AS n_virtual FROM f_method m JOIN (SELECT p_partkey AS type_id, p_brand AS iface, p_type AS kind FROM part) t USING (type_id) GROUP BY ROLLUP (iface, kind)")
def solution_stats_rollup(f: Facts) -> DataFrame:
    own = f.methods.join(f.types.select("type_id", F.col("iface").alias("project"), "kind"), "type_id")
    out = own.rollup("project", "kind").agg(F.count("*").alias("n_methods"), F.count_if("is_virtual").alias("n_virtual"), F.grouping("project").alias("all_projects"), F.grouping("kind").alias("all_kinds"))
    return _totals(out, project="all_projects", kind="all_kinds")


@query(CTES + CHANGED + "SELECT callee, caller, ordinal FROM f_edge WHERE caller NOT IN (SELECT method_id FROM f_diff WHERE kind <> 'Added')")
def unregister_callers(f: Facts) -> DataFrame:
    gone = diff(f).filter("kind <> 'Added'").select(F.col("method_id").alias("caller"))
    return callgraph.edges(f).join(gone, "caller", "left_anti").select("callee", "caller", "ordinal")


@query(CTES + CHANGED + "SELECT DISTINCT caller FROM f_edge WHERE callee IN (SELECT method_id FROM f_diff) AND caller NOT IN (SELECT method_id FROM f_diff)")
def prune_changed_callers(f: Facts) -> DataFrame:
    changed = cut(diff(f).select(F.col("method_id").alias("callee")))
    touched = callgraph.edges(f).join(changed, "callee", "left_semi").select("caller").distinct()
    return touched.join(changed.withColumnRenamed("callee", "caller"), "caller", "left_anti")


@query(f"{CTES} {MADE} UNION ALL {HELD}")
def multiset_union(f: Facts) -> DataFrame:
    return f.allocs.select("type_id").unionAll(f.methods.select("type_id"))


@query(f"{CTES} {MADE} EXCEPT ALL {HELD}")
def multiset_except(f: Facts) -> DataFrame:
    return f.allocs.select("type_id").exceptAll(f.methods.select("type_id"))


@query(f"{CTES} {MADE} UNION {HELD}")
def set_union(f: Facts) -> DataFrame:
    return f.allocs.select("type_id").union(f.methods.select("type_id")).distinct()


@query(f"{CTES} {MADE} INTERSECT {HELD}")
def set_intersect(f: Facts) -> DataFrame:
    return f.allocs.select("type_id").intersect(f.methods.select("type_id"))


@query(f"{CTES} {MADE} EXCEPT {HELD}")
def set_except(f: Facts) -> DataFrame:
    return f.allocs.select("type_id").subtract(f.methods.select("type_id"))


@query(CTES + "SELECT caller, ordinal, ((row_number() OVER (PARTITION BY caller ORDER BY ordinal) - 1) // 8)::INT AS chunk FROM f_call")
def chunk_effects(f: Facts) -> DataFrame:
    """A method's call sites in groups of eight."""
    row = F.row_number().over(Window.partitionBy("caller").orderBy("ordinal"))
    return f.calls.select("caller", "ordinal", F.floor((row - 1) / 8).cast("int").alias("chunk"))


@query(CTES + "SELECT caller || '@' || ordinal AS symbol FROM f_call UNION ALL SELECT method_id::VARCHAR FROM f_method")
def symbol_ids(f: Facts) -> DataFrame:
    return f.calls.select(F.concat_ws("@", "caller", "ordinal").alias("symbol")).unionAll(f.methods.select(F.col("method_id").cast("string")))


@query(CTES + "SELECT DISTINCT id, '<Node Id=\"' || id || '\" Label=\"' || id || '\" />' AS line FROM (SELECT caller AS id FROM f_edge UNION SELECT callee FROM f_edge)")
def dgml_nodes(f: Facts) -> DataFrame:
    return graphs.dgml_nodes(cut(callgraph.edges(f)))


@query(CTES + "SELECT caller, callee, ordinal, '<Link Source=\"' || caller || '\" Target=\"' || callee || '\" Label=\"' || ordinal || '\" />' AS line FROM f_edge")
def dgml_links(f: Facts) -> DataFrame:
    return graphs.dgml_links(callgraph.edges(f))


@query("SELECT event_type AS op, count(*) AS n FROM events GROUP BY op")
def op_counters(f: Facts) -> DataFrame:
    return log(f).groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT user_id % 4 AS sender, count_if(user_id % 4 = event_id % 4) AS n_local, count_if(user_id % 4 <> event_id % 4) AS n_network FROM events GROUP BY sender")
def local_vs_network(f: Facts) -> DataFrame:
    return log(f).groupBy("sender").agg(F.count_if(F.col("sender") == F.col("receiver")).alias("n_local"), F.count_if(F.col("sender") != F.col("receiver")).alias("n_network"))


@query("SELECT event_id % 4 AS receiver, count_if(event_type = 'view') AS n_client FROM events GROUP BY receiver")
def client_msgs(f: Facts) -> DataFrame:
    return log(f).groupBy("receiver").agg(F.count_if(F.col("op") == "view").alias("n_client"))


@query("SELECT user_id % 4 AS sender, arg_max(event_id, (value, -event_id)) AS slowest, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY sender")
def slowest_and_latest(f: Facts) -> DataFrame:
    """Of messages equally slow the first counts, of those at one time the last."""
    return log(f).groupBy("sender").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("slowest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT CASE WHEN grouping(silo) = 1 THEN 'all' ELSE silo END AS silo, CASE WHEN grouping(class) = 1 THEN 'all' ELSE class END AS class, count(*) AS n FROM (SELECT (user_id % 4)::VARCHAR AS silo, event_type AS class FROM events) GROUP BY CUBE (silo, class)")
def activation_cube(f: Facts) -> DataFrame:
    return log(f).select(F.col("sender").cast("string").alias("silo"), F.col("op").alias("class")).cube("silo", "class").agg(F.count("*").alias("n"), F.grouping("silo").alias("all_silos"), F.grouping("class").alias("all_classes")).transform(_totals, **{"silo": "all_silos", "class": "all_classes"})


@query("SELECT strftime(time_bucket(INTERVAL 60 SECONDS, ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY minute")
def update_series_60s(f: Facts) -> DataFrame:
    return monitor.update_series(log(f)).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), "n")


@query("""WITH g AS (SELECT user_id % 4 AS sender, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id % 4 ORDER BY ts) > INTERVAL 10 SECONDS, true)::INT AS opens FROM events),
s AS (SELECT sender, ts, sum(opens) OVER (PARTITION BY sender ORDER BY ts) AS k FROM g)
SELECT sender, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS began, count(*) AS n FROM s GROUP BY sender, k""")
def idle_sessions(f: Facts) -> DataFrame:
    return monitor.busy_sessions(log(f)).select("sender", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("began"), "n")


@query("SELECT round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS deviation FROM events")
def query_time_summary(f: Facts) -> DataFrame:
    return log(f).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.stddev_pop("value"), 6).alias("deviation"))
