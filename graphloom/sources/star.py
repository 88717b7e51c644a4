"""Program facts read from the star-schema tables: parts are types, orders are methods, line items are statements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import cut
from graphloom.schema import SCHEMAS, Program

#: A total order of a method's statements; (l_orderkey, l_linenumber) is not unique.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@dataclass
class Facts:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def types(self) -> DataFrame:
        key = F.col("p_partkey").cast("long")
        base = F.when(key != 0, F.floor((key - 1) / 3).cast("long"))
        return self.table("part").select(key.alias("type_id"), base.alias("base_type_id"), F.col("p_brand").alias("iface"), F.col("p_type").alias("kind"))

    @cached_property
    def methods(self) -> DataFrame:
        n = self.table("part").count()
        key, static = F.col("o_orderkey").cast("long"), F.col("o_orderpriority") == "1-URGENT"
        return self.table("orders").select(
            key.alias("method_id"),
            (F.col("o_custkey") % n).cast("long").alias("type_id"),
            (key % 4).cast("int").alias("slot"),
            static.alias("is_static"),
            (~static & (F.col("o_orderstatus") != "P")).alias("is_virtual"),
            (key % 50 == 0).alias("is_root"),
        )

    @cached_property
    def statements(self) -> DataFrame:
        row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("long").alias("method_id"),
            row.cast("int").alias("ordinal"),
            F.col("l_returnflag").alias("stmt_kind"),
            F.col("l_partkey").cast("long").alias("a"),
            F.col("l_suppkey").cast("long").alias("b"),
            (F.col("l_linenumber") % 3).cast("int").alias("var"),
        )

    @cached_property
    def allocs(self) -> DataFrame:
        return self.statements.filter("stmt_kind = 'A'").select("method_id", "var", F.col("a").alias("type_id"))

    @cached_property
    def assigns(self) -> DataFrame:
        return self.statements.filter("stmt_kind = 'R'").select("method_id", ((F.col("var") + 1) % 3).alias("src"), F.col("var").alias("dst"))

    @cached_property
    def calls(self) -> DataFrame:
        target = (F.col("a") * 31 + F.col("b") * 17 + F.col("ordinal")) % self.n_methods
        return self.statements.filter("stmt_kind = 'N'").select(F.col("method_id").alias("caller"), "ordinal", target.alias("static_target"), F.col("var").alias("recv"))

    @cached_property
    def program(self) -> Program:
        """The tables as a whole program: node k of method m is m * 8 + k, for variables (0 to 2), receiver (3), parameter (4) and result (5)."""
        m = cut(self.methods)
        spark, none = self.spark, F.lit(None)
        node = lambda method, k: F.col(method) * 8 + k
        types = self.types.join(self.access, "type_id").select("type_id", F.lit("star").alias("assembly"), F.col("iface").alias("namespace"), F.concat(F.lit("T"), "type_id").alias("name"), F.lit("Class").alias("kind"), F.lit(True).alias("is_reference"), "accessibility", F.lit(False).alias("is_library"), "base_type_id")
        text = self.table("orders").select(F.col("o_orderkey").cast("long").alias("method_id"), F.when(F.col("o_orderstatus") == "F", "Public").otherwise("Private").alias("accessibility"), F.col("o_orderpriority").alias("body_text"))
        methods = m.join(text, "method_id").select("method_id", "type_id", F.when(F.col("is_root"), "Main").otherwise("m").alias("name"), F.col("slot").cast("string").alias("slot"), "is_static", "is_virtual", F.lit(False).alias("is_abstract"), F.lit(False).alias("is_override"), F.lit(False).alias("is_implicit"), "accessibility", F.lit("method").alias("method_kind"), F.lit(1).alias("n_params"), F.lit(0).alias("type_params"), F.lit(0).cast("long").alias("return_type_id"), F.lit(False).alias("returns_void"), F.lit(True).alias("analyzable"), none.cast("string").alias("path"), none.cast("int").alias("line"), "body_text")
        kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("node_kind"), declared.cast("long").alias("type_id")) for k, kind, declared in ((0, "variable", F.lit(0)), (1, "variable", 1 + F.col("method_id") % 3), (2, "variable", 1 + F.col("method_id") % 12), (3, "this", F.col("type_id")), (4, "parameter", F.col("method_id") % 7), (5, "return", F.lit(0)))))
        nodes = m.select("method_id", "is_static", F.explode(kinds).alias("n")).filter("NOT (is_static AND n.k = 3)")
        nodes = nodes.select((F.col("method_id") * 8 + F.col("n.k")).alias("node_id"), "method_id", F.concat(F.lit("n"), "n.k").alias("name"), "n.type_id", "n.node_kind", F.when(F.col("n.k") == 4, 0).alias("position"))
        within = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(d).alias("d")) for s, d in ((3, 0), (4, 1), (2, 5))))).alias("v")
        fixed = m.select("method_id", within).select("method_id", node("method_id", F.col("v.s")).alias("src"), node("method_id", F.col("v.d")).alias("dst"))
        assigns = self.assigns.select("method_id", node("method_id", F.col("src")).alias("src"), node("method_id", F.col("dst")).alias("dst")).unionByName(fixed).distinct()
        allocs = self.allocs.select("method_id", node("method_id", F.col("var")).alias("node_id"), "type_id").distinct()
        target = (F.col("a") * 31 + F.col("b") * 17 + F.col("ordinal")) % self.n_methods
        calls = cut(self.statements.filter("stmt_kind = 'N'").withColumn("callee", target))
        kind = F.when(F.col("is_static"), "static").when(F.col("is_virtual"), "virtual").otherwise("instance")
        sites = calls.join(m.select(F.col("method_id").alias("callee"), "is_static", "is_virtual"), "callee")
        sites = sites.select("method_id", "ordinal", kind.alias("call_kind"), "callee", none.cast("long").alias("delegate_node"), F.when(~F.col("is_static"), node("method_id", F.col("var"))).alias("receiver"), node("method_id", F.col("b") % 3).alias("lhs"), F.col("ordinal").alias("line"))
        args = calls.select("method_id", "ordinal", F.lit(0).alias("pos"), node("method_id", F.col("a") % 3).alias("node_id"))
        empty = {k: spark.createDataFrame([], SCHEMAS[k]) for k in ("projects", "documents", "interfaces", "delegates")}
        marked = self.table("orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("long").alias("method_id"), F.lit("TestMethodAttribute").alias("attribute"))
        return Program(types=types, methods=methods, attributes=marked, nodes=nodes, allocs=allocs, assigns=assigns, callsites=sites, args=args, **empty)

    @cached_property
    def access(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("long").alias("type_id"), F.when(F.col("p_size") % 2 == 0, "Public").otherwise("Internal").alias("accessibility"))

    @cached_property
    def n_methods(self) -> int:
        return self.table("orders").count()
