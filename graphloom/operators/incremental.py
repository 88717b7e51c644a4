"""Changes of a program: differences, deletion with rederivation, and the protocol that applies an edit."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import cut
from graphloom.operators.vta import Rules, State, _minus, propagate
from graphloom.schema import SCHEMAS, Program

ADDED, REMOVED, UPDATED = "Added", "Removed", "Updated"


def method_diff(old: DataFrame, new: DataFrame, key: str = "method_id", text: str = "body_text") -> DataFrame:
    """(key, kind): methods that only new has, that only old has, and whose text differs; two null texts are equal."""
    a = old.select(key, F.struct(F.col(text).alias("t")).alias("was"))
    b = new.select(key, F.struct(F.col(text).alias("t")).alias("now"))
    kind = F.when(F.col("was").isNull(), ADDED).when(F.col("now").isNull(), REMOVED).otherwise(UPDATED)
    return a.join(b, key, "full").filter("was IS NULL OR now IS NULL OR NOT (was.t <=> now.t)").select(key, kind.alias("kind"))


def modified_documents(old: DataFrame, new: DataFrame, changed: DataFrame, column: str = "path") -> DataFrame:
    """The documents, in lower case, that a change list names and that either version has."""
    low = lambda d: d.select(F.lower(column).alias(column)).distinct()
    return low(changed).intersect(low(old).union(low(new)))


def replace_documents(documents: DataFrame, edited: DataFrame) -> DataFrame:
    """documents (assembly, path, source) with the edited ones in place of those with their path."""
    key = lambda d: F.lower(d["path"])
    e = edited.select(F.lower("path").alias("_path")).distinct()
    return documents.join(e, key(documents) == e["_path"], "left_anti").unionByName(edited.select(documents.columns))


def without_methods(p: Program, gone: DataFrame) -> Program:
    """The program without the facts of methods (method_id)."""
    own = lambda d: d.join(gone, "method_id", "left_anti")
    return Program(**{k: own(getattr(p, k)) if "method_id long" in SCHEMAS[k] else getattr(p, k) for k in SCHEMAS})


def overridden(p: Program, methods: DataFrame) -> DataFrame:
    """(method_id): the nearest methods above that methods (method_id) replace."""
    m = p.methods.join(methods, "method_id", "left_semi").filter("NOT is_static").join(p.types.select("type_id", "base_type_id"), "type_id")
    r = Rules(p).dispatch
    return m.select(F.col("base_type_id").alias("recv"), "slot").join(r, ["recv", "slot"]).select(F.col("target").alias("method_id")).distinct()


def callers_of(state: State, methods: DataFrame) -> DataFrame:
    """(method_id): methods with a resolved call of one of methods."""
    return state.resolved.join(methods.select(F.col("method_id").alias("callee")), "callee", "left_semi").select("method_id").distinct()


def unregister(state: State, gone: DataFrame) -> DataFrame:
    """The resolved calls without those that the methods make."""
    return state.resolved.join(gone, "method_id", "left_anti")


def forget(before: Rules, after: Rules, state: State, changed: DataFrame, roots: DataFrame) -> State:
    """The part of a state that does not hang on what changed: everything that some derivation leads to from a changed method is deleted.

    Over-deletion goes in rounds over types, delegates, calls, flows and activity together, as far as facts of the old program lead.
    What has another derivation is found again by `propagate`.
    """
    changed = cut(changed.select("method_id").distinct())
    nodes = cut(before.p.nodes.select("node_id", "method_id"))
    dispatched = cut(before.dispatch.exceptAll(after.dispatch).select(F.col("recv").alias("type_id"), "slot").distinct())
    touched = before.sites.join(dispatched.select("slot").distinct(), "slot", "left_semi").select("method_id", "ordinal").distinct()
    handed = before.sites.filter("call_kind = 'delegate'").select("method_id", "ordinal").distinct()
    bad_res = cut(state.resolved.join(changed, "method_id", "left_semi").unionByName(state.resolved.join(changed.select(F.col("method_id").alias("callee")), "callee", "left_semi").select(state.resolved.columns)).unionByName(state.resolved.join(touched.unionByName(handed).distinct(), ["method_id", "ordinal"], "left_semi").select(state.resolved.columns)).distinct())
    gone = cut(changed.join(state.active, "method_id", "left_semi"))
    bad_pts = cut(state.pts.join(nodes.join(changed, "method_id", "left_semi"), "node_id", "left_semi"))
    bad_dlg = cut(state.dlg.join(nodes.join(changed, "method_id", "left_semi"), "node_id", "left_semi"))
    bad_flows = state.flows.limit(0)
    new_res, new_gone, new_pts, new_dlg = bad_res, gone, bad_pts, bad_dlg
    all_flows = cut(before.assigns.unionByName(state.flows))
    while True:
        flows, direct = before.messages(new_res)
        new_flows = cut(flows.join(state.flows, ["src", "dst"], "left_semi").distinct())
        allocated, given = before.facts(new_gone)
        carried = new_pts.join(all_flows, new_pts["node_id"] == all_flows["src"]).select(F.col("dst").alias("node_id"), "type_id")
        lost = state.pts.join(new_flows, state.pts["node_id"] == new_flows["src"]).select(F.col("dst").alias("node_id"), "type_id")
        pts = cut(_minus(carried.unionByName(lost).unionByName(direct).unionByName(allocated).distinct().join(state.pts, ["node_id", "type_id"], "left_semi"), bad_pts))
        passed = new_dlg.join(before.assigns, new_dlg["node_id"] == before.assigns["src"]).select(F.col("dst").alias("node_id"), "target")
        dlg = cut(_minus(passed.unionByName(given).distinct().join(state.dlg, ["node_id", "target"], "left_semi"), bad_dlg))
        freed = new_res.select(F.col("callee").alias("method_id")).distinct().join(roots, "method_id", "left_anti")
        inactive = cut(_minus(freed.join(state.active, "method_id", "left_semi"), gone))
        res = cut(_minus(before.calls(new_gone, new_pts, new_dlg, state.pts, state.dlg).distinct(), bad_res).join(state.resolved.select("method_id", "ordinal").distinct(), ["method_id", "ordinal"], "left_semi").select(state.resolved.columns))
        if all(x.isEmpty() for x in (pts, dlg, inactive, res, new_flows)):
            break
        bad_pts, bad_dlg, gone, bad_res, bad_flows = (cut(a.unionByName(b)) for a, b in ((bad_pts, pts), (bad_dlg, dlg), (gone, inactive), (bad_res, res), (bad_flows, new_flows)))
        new_pts, new_dlg, new_gone, new_res = pts, dlg, inactive, res
    return State(*(cut(_minus(a, b)) for a, b in ((state.pts, bad_pts), (state.dlg, bad_dlg), (state.resolved, bad_res), (state.flows, bad_flows.distinct()), (state.active, gone))))


@dataclass
class Update:
    state: State
    changes: DataFrame  #: (method_id, kind)
    redone: DataFrame  #: (method_id): unchanged callers that are looked at again


def apply_modifications(old: Program, new: Program, state: State, roots: DataFrame) -> Update:
    """The state of the new program from that of the old one: methods that were removed or updated are deleted with what hangs on them,
    methods that added ones override count as updated, and what still holds or newly holds is derived from their callers and
    the roots (method_id, of the new program).  The result is what propagation from scratch gives."""
    before, after = Rules(old), Rules(new)
    changes = cut(method_diff(old.methods, new.methods))
    added = changes.filter(F.col("kind") == ADDED).select("method_id")
    hidden = overridden(new, added).withColumn("kind", F.lit(UPDATED)).join(changes.select("method_id"), "method_id", "left_anti")
    changes = cut(changes.unionByName(hidden))
    if before.subtypes.exceptAll(after.subtypes).isEmpty():
        kept = forget(before, after, state, changes.select("method_id"), roots)
    else:  # variables may take fewer types than before, in any method
        kept = None
    redone = cut(_minus(callers_of(state, changes), changes.select("method_id")))
    return Update(propagate(after, roots, start=kept), changes, redone)


def remove_method(p: Program, state: State, method: DataFrame, roots: DataFrame) -> Update:
    return apply_modifications(p, without_methods(p, method), state, roots)


def remove_facts(p: Program, state: State, roots: DataFrame, allocs: DataFrame | None = None, assigns: DataFrame | None = None) -> State:
    """The state after single statements went: allocations (method_id, node_id, type_id) and assignments (method_id, src, dst)."""
    less = {k: getattr(p, k).exceptAll(gone) for k, gone in (("allocs", allocs), ("assigns", assigns)) if gone is not None}
    new = Program(**({k: getattr(p, k) for k in SCHEMAS} | less))
    changed = [gone.select("method_id") for gone in (allocs, assigns) if gone is not None]
    changed = changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1])
    after = Rules(new)
    return propagate(after, roots, start=forget(Rules(p), after, state, changed, roots))


def session(versions: Iterator[Program], roots_of) -> Iterator[dict]:
    """A row of figures for each version: the first is analysed from scratch, the others from the one before."""
    old = state = None
    for k, p in enumerate(versions):
        began, roots = time.time(), roots_of(p)
        if old is None:
            state, changes = propagate(Rules(p), roots), 0
        else:
            done = apply_modifications(old, p, state, roots)
            state, changes = done.state, done.changes.count()
        old = p
        yield {"version": k, "seconds": time.time() - began, "changes": changes, "reachable": state.active.count(), "resolved": state.resolved.count()}
