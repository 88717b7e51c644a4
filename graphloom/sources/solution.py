"""Programs from source documents and from stored facts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import cut
from graphloom.schema import SCHEMAS, Program
from graphloom.sources import csharp

EXTRACTED = [k for k in SCHEMAS if k not in ("projects", "documents")]


def csharp_projects(projects: DataFrame) -> DataFrame:
    """Projects in the language that the front end reads."""
    return projects.filter("lower(language) IN ('c#', 'csharp')")


def first_of_assembly(projects: DataFrame) -> DataFrame:
    """One project for each assembly: the one whose path sorts first."""
    own = Window.partitionBy("assembly").orderBy("path", "name")
    return projects.withColumn("_k", F.row_number().over(own)).filter("_k = 1").drop("_k")


def from_documents(documents: DataFrame, projects: DataFrame | None = None, sound_conditional: bool = False) -> Program:
    """The program of documents (assembly, path, source); a project is read by one task, and names of other projects are joined by their ids.
    Rows that two projects give for one type or method are one, and those with a body win over library ones."""
    if projects is not None:
        kept = first_of_assembly(csharp_projects(projects))
        documents = documents.join(kept.select("assembly"), "assembly", "left_semi")
    else:
        projects = documents.select("assembly", F.col("assembly").alias("name"), F.lit(None).cast("string").alias("path"), F.lit("C#").alias("language")).distinct()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = csharp.facts(sorted(zip(frame["path"], frame["source"])), key[0], sound_conditional)
        text = lambda v: v if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        out = [(k, json.dumps(list(map(text, r)))) for k in EXTRACTED for r in rows[k]]
        return pd.DataFrame(out, columns=["kind", "row"])

    found = cut(documents.groupBy("assembly").applyInPandas(run, "kind string, row string"))
    tables = {}
    for name in EXTRACTED:
        columns = [c.split() for c in SCHEMAS[name].split(", ")]
        parts = F.from_json("row", F.lit("array<string>"))
        own = found.filter(F.col("kind") == name).select(parts.alias("x")).select(*(F.col("x")[i].cast(t).alias(c) for i, (c, t) in enumerate(columns)))
        tables[name] = own.distinct()
    key, better = {"types": "type_id", "methods": "method_id"}, {"types": F.col("is_library").asc(), "methods": F.col("analyzable").desc()}
    for name, k in key.items():
        ranked = tables[name].withColumn("_k", F.row_number().over(Window.partitionBy(k).orderBy(better[name], *(c for c in tables[name].columns if c != k))))
        tables[name] = ranked.filter("_k = 1").drop("_k")
    return Program(projects=projects, documents=documents, **{k: cut(v) for k, v in tables.items()})


def from_source(spark: SparkSession, source: str, path: str = "Program.cs", assembly: str = "MyProject", **options) -> Program:
    return from_documents(spark.createDataFrame([(assembly, path, source)], SCHEMAS["documents"]), **options)


def from_folder(spark: SparkSession, folder: str, assembly: str = "MyProject") -> Program:
    """All .cs files below a folder, as one project."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.cs").text(folder)
    return from_documents(files.select(F.lit(assembly).alias("assembly"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("source")))


#: Programs by name.
REGISTRY: dict[str, str] = {}


def from_test(spark: SparkSession, name: str) -> Program:
    if name not in REGISTRY:
        raise KeyError(f"no program named {name}")
    return from_source(spark, REGISTRY[name])


def diagnostics(documents: DataFrame) -> DataFrame:
    """(assembly, path, message) of documents whose brackets do not match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for a, p, s in zip(b["assembly"], b["path"], b["source"]):
                toks = [t for t, _ in csharp.tokens(s or "")]
                rows += [(a, p, f"{x} {toks.count(x)} times, {y} {toks.count(y)} times") for x, y in ("{}", "()", "[]") if toks.count(x) != toks.count(y)]
            yield pd.DataFrame(rows, columns=["assembly", "path", "message"])

    return documents.select("assembly", "path", "source").mapInPandas(run, "assembly string, path string, message string")


def project_of(p: Program, types: DataFrame) -> DataFrame:
    """types (type_id) with their project's name, and whether they are of a library: unknown assemblies are."""
    own = types.join(p.types.select("type_id", "assembly", "is_library"), "type_id", "left")
    named = own.join(p.projects.select("assembly", F.col("name").alias("project")), "assembly", "left")
    return named.select("type_id", "assembly", "project", F.coalesce(F.col("is_library"), F.lit(True)).alias("is_library"))
