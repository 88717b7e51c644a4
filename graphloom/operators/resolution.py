"""Call edges by the query policy, which answers where propagation found no receiver type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import callgraph
from graphloom.operators.fixpoint import cut
from graphloom.sources.star import Facts


def compatible(facts: Facts) -> DataFrame:
    """(type_id, compatible): the instantiated types at or below each type."""
    made = facts.allocs.select(F.col("type_id").alias("sub")).distinct()
    return callgraph.subtypes(facts).join(made, "sub").select(F.col("sup").alias("type_id"), F.col("sub").alias("compatible"))


def fallback(facts: Facts) -> DataFrame:
    """(type_id, slot, target): what a call on a receiver of a declared type may run; one row for each distinct target,
    so that calls are not joined with types."""
    runs = cut(callgraph.dispatch(facts))
    by_type = compatible(facts).join(runs.withColumnRenamed("recv_type", "compatible"), "compatible").select("type_id", "slot", "target").distinct()
    declared = runs.withColumnRenamed("recv_type", "type_id").join(by_type.select("type_id", "slot"), ["type_id", "slot"], "left_anti")
    return by_type.unionByName(declared)


def edges_q(facts: Facts) -> DataFrame:
    """(caller, ordinal, callee): the propagation edges, and for virtual calls without receiver types the fallback."""
    typed = cut(callgraph.edges(facts))
    m = facts.methods.filter("is_virtual").select(F.col("method_id").alias("static_target"), "slot", "type_id")
    rest = facts.calls.join(m, "static_target").join(typed.select("caller", "ordinal"), ["caller", "ordinal"], "left_anti")
    rest = rest.join(fallback(facts), ["type_id", "slot"], "left").select("caller", "ordinal", F.coalesce("target", "static_target").alias("callee"))
    return typed.unionByName(rest).distinct()


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(method_id, depth): the fewest calls from a root."""
    pairs = cut(edges.select("caller", "callee").distinct())
    new = known = cut(roots.select("method_id", F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        depth += 1
        found = new.join(pairs, new["method_id"] == pairs["caller"]).select(F.col("callee").alias("method_id")).distinct()
        new = cut(found.join(known, "method_id", "left_anti").select("method_id", F.lit(depth).alias("depth")))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if depth % 8 == 0:
            known = cut(known)
