"""Call graphs as DGML and GraphViz text, ranked reports and telemetry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dgml_nodes(edges: DataFrame) -> DataFrame:
    """(id, line) of the methods that call or are called."""
    ids = edges.select(F.col("caller").alias("id")).union(edges.select("callee")).distinct()
    return ids.select("id", F.format_string('<Node Id="%s" Label="%s" />', _quoted(F.col("id")), _quoted(F.col("id"))).alias("line"))


def dgml_links(edges: DataFrame) -> DataFrame:
    """(caller, callee, ordinal, line); a link's label is the ordinal of its call."""
    line = F.format_string('<Link Source="%s" Target="%s" Label="%s" />', _quoted(F.col("caller")), _quoted(F.col("callee")), _quoted(F.col("ordinal")))
    return edges.select("caller", "callee", "ordinal", line.alias("line"))


def _ordered(parts: list[DataFrame], path: str) -> None:
    """Lines (at, key, line) as text files in order; file names rise with the order."""
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    lines.repartitionByRange("at", "key").sortWithinPartitions("at", "key").select("line").write.mode("overwrite").text(path)


def _fixed(edges: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    return edges.sparkSession.createDataFrame([(k, "", x) for k, x in rows], "at int, key string, line string")


def _lines(df: DataFrame, at: int, *key: str) -> DataFrame:
    return df.select(F.lit(at).alias("at"), F.concat_ws(",", *(F.format_string("%020d", F.col(k).cast("long")) for k in key)).alias("key"), "line")


def write_dgml(edges: DataFrame, path: str) -> None:
    frame = _fixed(edges, [(0, '<DirectedGraph xmlns="http://schemas.microsoft.com/vs/2009/dgml">\n<Nodes>'), (2, "</Nodes>\n<Links>"), (4, "</Links>\n</DirectedGraph>")])
    _ordered([frame, _lines(dgml_nodes(edges), 1, "id"), _lines(dgml_links(edges), 3, "caller", "callee", "ordinal")], path)


def write_graphviz(edges: DataFrame, path: str) -> None:
    line = F.format_string('"%s" -> "%s" [label="%s"];', _escaped(F.col("caller")), _escaped(F.col("callee")), F.col("ordinal")).alias("line")
    _ordered([_fixed(edges, [(0, "digraph calls {"), (2, "}")]), _lines(edges.select("caller", "callee", "ordinal", line), 1, "caller", "callee", "ordinal")], path)


def write_report(ranked: DataFrame, path: str) -> None:
    """Lines "count TAB method" of (method_id, n), the largest count first."""
    ranked.orderBy(F.desc("n"), "method_id").select(F.concat_ws("\t", "n", "method_id").alias("line")).write.mode("overwrite").text(path)


def write_metrics(rows: DataFrame, path: str, reset: bool = False) -> None:
    """Telemetry rows as CSV with a header, after what is there or in its place."""
    rows.write.mode("overwrite" if reset else "append").option("header", True).csv(path)


def read_dgml(spark: SparkSession, path: str) -> DataFrame:
    """The edges (caller, ordinal, callee) of the links in DGML files."""
    lines = spark.read.text(path).filter(F.ltrim("value").startswith("<Link "))
    of = lambda name: F.regexp_extract("value", f'{name}="([^"]*)"', 1)
    return lines.select(of("Source").try_cast("long").alias("caller"), of("Label").try_cast("int").alias("ordinal"), of("Target").try_cast("long").alias("callee"))


def write_propagation_graph(nodes: DataFrame, assigns: DataFrame, pts: DataFrame, types: DataFrame, deleted: DataFrame, path: str) -> None:
    """A method's propagation graph as GraphViz: nodes (node_id, name) with the types that they hold, how often if several facts give one,
    and in brackets those that were deleted (pts and deleted: node_id, type_id); assigns are src, dst."""

    def bag(rows: DataFrame, name: str) -> DataFrame:
        counted = rows.groupBy("node_id", "type_id").count().join(types.select("type_id", F.col("name").alias("type")), "type_id")
        label = F.when(F.col("count") > 1, F.format_string("%s x%d", "type", "count")).otherwise(F.col("type"))
        return counted.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_list(label)), ", ").alias(name))

    own = nodes.join(bag(pts, "held"), "node_id", "left").join(bag(deleted, "gone"), "node_id", "left")
    text = F.concat("name", F.lit(" {"), F.coalesce("held", F.lit("")), F.lit("}"), F.when(F.col("gone").isNotNull(), F.concat(F.lit(" ["), "gone", F.lit("]"))).otherwise(""))
    drawn = own.select("node_id", F.format_string('"%s" [label="%s"];', F.col("node_id"), _escaped(text)).alias("line"))
    edges = assigns.select("src", "dst", F.format_string('"%s" -> "%s";', F.col("src"), F.col("dst")).alias("line"))
    _ordered([_fixed(nodes, [(0, "digraph method {"), (3, "}")]), _lines(drawn, 1, "node_id"), _lines(edges, 2, "src", "dst")], path)
