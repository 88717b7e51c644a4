"""Schemas of the fact tables, and a program as a set of them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Columns of each fact table.  Ids are unique over all tables of a kind; node_id is unique over all methods.
SCHEMAS = {
    "projects": "assembly string, name string, path string, language string",
    "documents": "assembly string, path string, source string",
    "types": "type_id long, assembly string, namespace string, name string, kind string, is_reference boolean, accessibility string, is_library boolean, base_type_id long",
    "interfaces": "type_id long, iface_id long",
    "methods": "method_id long, type_id long, name string, slot string, is_static boolean, is_virtual boolean, is_abstract boolean, is_override boolean, is_implicit boolean, accessibility string, method_kind string, n_params int, type_params int, return_type_id long, returns_void boolean, analyzable boolean, path string, line int, body_text string",
    "attributes": "method_id long, attribute string",
    "nodes": "node_id long, method_id long, name string, type_id long, node_kind string, position int",
    "allocs": "method_id long, node_id long, type_id long",
    "assigns": "method_id long, src long, dst long",
    "delegates": "method_id long, node_id long, target long",
    "callsites": "method_id long, ordinal int, call_kind string, callee long, delegate_node long, receiver long, lhs long, line int",
    "args": "method_id long, ordinal int, pos int, node_id long",
}

#: Kinds of nodes: variable, parameter, this, return, field, property, delegate (a variable of a delegate type), call (a temporary of a call).
NODE_KINDS = ("variable", "parameter", "this", "return", "field", "property", "delegate", "call")


@dataclass
class Program:
    projects: DataFrame
    documents: DataFrame
    types: DataFrame
    interfaces: DataFrame
    methods: DataFrame
    attributes: DataFrame
    nodes: DataFrame
    allocs: DataFrame
    assigns: DataFrame
    delegates: DataFrame
    callsites: DataFrame
    args: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, rows: dict[str, list[tuple]]) -> Program:
        """A program of rows by table; tables that are not given are empty."""
        return cls(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Program:
        return cls(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()})

    def write(self, folder: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")
