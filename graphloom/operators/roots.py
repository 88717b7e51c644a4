"""Root methods of a program, by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.vta import Rules
from graphloom.schema import Program

#: The attributes that mark test methods.
TEST_ATTRIBUTES = ("TestMethodAttribute", "TestInitializeAttribute", "TestCleanupAttribute", "FactAttribute")


def _own(p: Program) -> DataFrame:
    """Methods of classes and structs, with their type's access."""
    t = p.types.filter("kind IN ('Class', 'Struct')").select("type_id", F.col("kind").alias("type_kind"), F.col("accessibility").alias("type_access"))
    return p.methods.join(t, "type_id")


def main(p: Program) -> DataFrame:
    return p.methods.filter("name = 'Main' AND is_static").select("method_id")


def all_methods(p: Program) -> DataFrame:
    return _own(p).filter("NOT is_abstract AND NOT is_implicit").select("method_id")


def public(p: Program) -> DataFrame:
    return _own(p).filter("accessibility = 'Public' AND type_access = 'Public'").select("method_id")


def tests(p: Program) -> DataFrame:
    marked = p.attributes.filter(F.col("attribute").isin(*TEST_ATTRIBUTES)).select("method_id").distinct()
    return public(p).join(marked, "method_id", "left_semi")


def static_constructors(p: Program) -> DataFrame:
    return p.methods.filter("is_static AND method_kind = 'constructor'").select("method_id")


def event_handlers(p: Program, rules: Rules) -> DataFrame:
    """Instance methods of classes without a result and with two parameters, an object and some EventArgs."""
    at = lambda k, n: p.nodes.filter(f"node_kind = 'parameter' AND position = {k}").select("method_id", F.col("type_id").alias(n))
    named = lambda x: p.types.filter(F.col("name") == x).select("type_id")
    args = rules.subtypes.join(named("EventArgs"), F.col("sup") == F.col("type_id"), "left_semi").select(F.col("sub").alias("last"))
    own = _own(p).filter("type_kind = 'Class' AND NOT is_static AND NOT is_abstract AND type_params = 0 AND returns_void AND n_params = 2").select("method_id")
    found = own.join(at(0, "one"), "method_id").join(at(1, "last"), "method_id")
    objects = named("Object").unionByName(named("object")).withColumnRenamed("type_id", "one")
    return found.join(objects, "one", "left_semi").join(args, "last", "left_semi").select("method_id")


KINDS = ("Main", "Public", "Root", "Default")


def parse_kind(name: str | None) -> str:
    """The root kind of a name, without regard to case; Default for any other."""
    return {k.lower(): k for k in KINDS}.get((name or "").strip().lower(), "Default")


def select(p: Program, rules: Rules, kind: str = "Default") -> DataFrame:
    """The roots of a kind; the entry points are always among them."""
    by = {"Main": lambda: main(p), "Public": lambda: public(p), "Root": lambda: union(p, rules), "Default": lambda: main(p)}
    return by[parse_kind(kind)]().unionByName(main(p)).distinct()


def union(p: Program, rules: Rules) -> DataFrame:
    parts = [main(p), tests(p), static_constructors(p), event_handlers(p, rules), public(p)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()
