"""Types of variables, resolution of call sites, and reachability over program facts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import closure, cut, fixpoint
from graphloom.sources.star import Facts

#: Calls that one task searches: 16 bytes each, and about five times that in memory.
ONE_TASK = 4_000_000


def subtypes(facts: Facts) -> DataFrame:
    return closure(facts.types, "type_id", "base_type_id")


def dispatch(facts: Facts) -> DataFrame:
    """(recv_type, slot, target): the nearest type above that has an instance method in the slot; ties go to the smallest id."""
    own = facts.methods.filter("NOT is_static").groupBy("type_id", "slot").agg(F.min("method_id").alias("method_id"))
    up = subtypes(facts).join(own, F.col("sup") == F.col("type_id"))
    return up.groupBy(F.col("sub").alias("recv_type"), "slot").agg(F.min_by("method_id", "dist").alias("target"))


def points_to(facts: Facts) -> DataFrame:
    """(method_id, var, type_id): allocations carried over assignments, within a method."""
    assigns = cut(facts.assigns.distinct())

    def flow(new: DataFrame) -> DataFrame:
        return new.join(assigns, (new["method_id"] == assigns["method_id"]) & (new["var"] == assigns["src"])).select(new["method_id"], F.col("dst").alias("var"), "type_id")

    return fixpoint(facts.allocs, flow)


def edges(facts: Facts) -> DataFrame:
    """(caller, ordinal, callee) by the propagation policy: a virtual call whose receiver has no types has no callee."""
    m = facts.methods.select(F.col("method_id").alias("static_target"), F.col("slot"), "is_virtual")
    calls = cut(facts.calls.join(m, "static_target"))
    fixed = calls.filter("NOT is_virtual").select("caller", "ordinal", F.col("static_target").alias("callee"))
    pts = points_to(facts).select(F.col("method_id").alias("caller"), F.col("var").alias("recv"), F.col("type_id").alias("recv_type"))
    typed = calls.filter("is_virtual").join(pts, ["caller", "recv"]).join(dispatch(facts), ["recv_type", "slot"], "left")
    return fixed.unionByName(typed.select("caller", "ordinal", F.coalesce("target", "static_target").alias("callee"))).distinct()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b): calls, and roots where b is null -> what the roots reach, level by level over sorted arrays."""
    rows = list(batches)
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    root = t.column("b").is_null().to_numpy()
    a, b = t.column("a").to_numpy(), t.column("b").fill_null(0).to_numpy()
    ids, code = np.unique(np.r_[a, b[~root]], return_inverse=True)
    src, dst = code[: len(a)][~root], code[len(a) :]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    start = np.searchsorted(src, np.arange(len(ids) + 1))
    seen = np.zeros(len(ids), bool)
    now = np.unique(code[: len(a)][root])
    while len(now):
        seen[now] = True
        n = start[now + 1] - start[now]
        found = dst[np.repeat(start[now], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        now = np.unique(found[~seen[found]])
    yield pa.RecordBatch.from_arrays([pa.array(ids[seen])], ["method_id"])


def reachable(edges: DataFrame, roots: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """(method_id) of what the roots (method_id) reach, themselves included.  Up to `most` calls are searched in one task, as a deep graph has
    many rounds; more go round by round, by a copy of the calls that is cut once."""
    pairs = cut(edges.select("caller", "callee").distinct())
    if pairs.count() <= most:
        start = roots.select(F.col("method_id").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
        return pairs.select(F.col("caller").alias("a"), F.col("callee").alias("b")).unionByName(start).repartition(1).mapInArrow(_search, "method_id long")
    pairs = cut(pairs.repartition("caller"))
    return fixpoint(roots.select("method_id"), lambda new: new.join(pairs, new["method_id"] == pairs["caller"]).select(F.col("callee").alias("method_id")))
