"""Generated call graphs: the same rows for the same seed, on any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schema import SCHEMAS, Program


def layered(spark: SparkSession, methods: int, projects: int, most_callees: int, seed: int = 0) -> DataFrame:
    """(caller, ordinal, callee, project): method k is in project k * projects / methods and calls the next one, so that all
    are reached from 0, and up to most_callees - 2 others of its own or later projects, without repeats."""
    k = F.col("id")
    first = F.ceil(F.floor(k * projects / methods) * methods / projects).cast("long")
    extra = F.pmod(F.xxhash64(F.lit(seed), k), F.lit(max(1, most_callees - 1)))
    others = F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1)).cast("int")), lambda j: first + F.pmod(F.xxhash64(F.lit(seed), k, j), F.lit(methods) - first))
    chain = F.when(k + 1 < methods, F.array(k + 1)).otherwise(F.array().cast("array<bigint>"))
    callees = F.array_distinct(F.when(extra > 0, F.concat(chain, others)).otherwise(chain))
    project = F.floor(k * projects / methods).cast("int").alias("project")
    return spark.range(methods).select(k.alias("caller"), project, F.posexplode(callees).alias("at", "callee")).select("caller", (F.col("at") + 1).alias("ordinal"), "callee", "project")


def change_list(text: DataFrame, root: str, suffix: str = ".cs") -> DataFrame:
    """(path) of a change list's lines (column value): empty ones go, source files stay, under root with forward slashes."""
    line = F.explode(F.split("value", r"\r?\n")).alias("line")
    return text.select(line).filter(F.col("line").endswith(suffix)).select(F.concat(F.lit(root.rstrip("/") + "/"), F.translate("line", "\\", "/")).alias("path"))


def _numbered(edges: DataFrame) -> DataFrame:
    """Edges (caller, callee) without repeats, with each caller's ordinals from 1 on in the order of callees."""
    own = Window.partitionBy("caller").orderBy("callee")
    return edges.distinct().select("caller", F.row_number().over(own).alias("ordinal"), "callee")


def random_graph(spark: SparkSession, methods: int, seed: int = 0) -> DataFrame:
    """(caller, ordinal, callee) with about two random calls for each method; method 0 also calls every ceil(methods / 100)-th one."""
    pick = lambda j: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(j)), F.lit(methods))
    calls = spark.range(2 * methods).select(pick(0).alias("caller"), pick(1).alias("callee"))
    main = spark.range(1, methods, -(-methods // 100)).select(F.lit(0).cast("long").alias("caller"), F.col("id").alias("callee"))
    return _numbered(calls.unionByName(main))


def connected(spark: SparkSession, methods: int, more: int = 10, seed: int = 0) -> DataFrame:
    """(caller, ordinal, callee): every method but 0 is called by an earlier one, and by `more` random ones."""
    k = F.col("id")
    chain = F.pmod(F.xxhash64(F.lit(seed), k), k)
    others = F.transform(F.sequence(F.lit(1), F.lit(more)), lambda j: F.pmod(F.xxhash64(F.lit(seed), k, j), F.lit(methods)))
    return _numbered(spark.range(1, methods).select(k.alias("callee"), F.explode(F.concat(F.array(chain), others)).alias("caller")).select("caller", "callee"))


def program(spark: SparkSession, edges: DataFrame, classes: int = 1) -> Program:
    """Edges as a program of static methods: method k is in class k mod classes; of calls between classes those to a lower or equal one stay, and all
    of method 0."""
    kept = edges.filter((F.col("caller") == 0) | (F.col("callee") % classes <= F.col("caller") % classes))
    ids = edges.select(F.explode(F.array("caller", "callee")).alias("method_id")).distinct()
    null = lambda kind: F.lit(None).cast(kind)
    types = spark.range(classes).select(F.col("id").alias("type_id"), F.lit("synthetic").alias("assembly"), F.lit("").alias("namespace"), F.concat(F.lit("C"), "id").alias("name"), F.lit("Class").alias("kind"), F.lit(True).alias("is_reference"), F.lit("Public").alias("accessibility"), F.lit(False).alias("is_library"), null("long").alias("base_type_id"))
    name = F.when(F.col("method_id") == 0, "Main").otherwise(F.concat(F.lit("N"), "method_id"))
    no, yes = F.lit(False), F.lit(True)
    methods = ids.select("method_id", (F.col("method_id") % classes).alias("type_id"), name.alias("name"), F.concat(name, F.lit("/0/0")).alias("slot"), yes.alias("is_static"), no.alias("is_virtual"), no.alias("is_abstract"), no.alias("is_override"), no.alias("is_implicit"), F.lit("Public").alias("accessibility"), F.lit("method").alias("method_kind"), F.lit(0).alias("n_params"), F.lit(0).alias("type_params"), null("long").alias("return_type_id"), yes.alias("returns_void"), yes.alias("analyzable"), F.lit("").alias("path"), null("int").alias("line"), name.alias("body_text"))
    sites = kept.select(F.col("caller").alias("method_id"), "ordinal", F.lit("static").alias("call_kind"), "callee", *(null("long").alias(c) for c in ("delegate_node", "receiver", "lhs")), null("int").alias("line"))
    rest = {k: spark.createDataFrame([], SCHEMAS[k]) for k in SCHEMAS if k not in ("types", "methods", "callsites")}
    return Program(types=types, methods=methods, callsites=sites, **rest)
