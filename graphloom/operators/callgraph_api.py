"""Questions to a call graph: callees, callers, reachability, rankings, references, samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import cut, fixpoint
from graphloom.schema import Program


def names(p: Program) -> DataFrame:
    """(method_id, full): Type.method."""
    t = p.types.select("type_id", F.col("name").alias("_type"))
    return p.methods.join(t, "type_id", "left").select("method_id", F.concat_ws(".", "_type", "name").alias("full"))


@dataclass
class CallGraph:
    """Edges (caller, ordinal, callee) and roots (method_id)."""

    edges: DataFrame
    roots: DataFrame
    _known: dict = field(default_factory=dict)

    @classmethod
    def empty(cls, spark: SparkSession) -> CallGraph:
        return cls(spark.createDataFrame([], "caller long, ordinal int, callee long"), spark.createDataFrame([], "method_id long"))

    def add_calls(self, rows: DataFrame) -> CallGraph:
        return CallGraph(self.edges.unionByName(rows.select("caller", "ordinal", "callee")).distinct(), self.roots)

    def add_roots(self, rows: DataFrame) -> CallGraph:
        return CallGraph(self.edges, self.roots.unionByName(rows.select("method_id")).distinct())

    def clear(self) -> CallGraph:
        return CallGraph(self.edges.limit(0), self.roots.limit(0))

    def compress(self) -> DataFrame:
        """(caller, callee, n_sites): one edge for each pair."""
        return self.edges.groupBy("caller", "callee").agg(F.count("*").alias("n_sites"))

    def nodes(self) -> DataFrame:
        ends = self.edges.select(F.explode(F.array("caller", "callee")).alias("method_id"))
        return ends.unionByName(self.roots).distinct()

    def inverted(self) -> DataFrame:
        return self.edges.select(F.col("callee").alias("caller"), "ordinal", F.col("caller").alias("callee"))

    def callees(self, method: int, ordinal: int | None = None) -> DataFrame:
        """The methods that a method, or its call site `ordinal` (from 1 on), may call; an unknown site raises an error."""
        own = self.edges.filter(F.col("caller") == method)
        if ordinal is not None:
            own = own.filter(F.col("ordinal") == ordinal)
            if own.isEmpty():
                raise KeyError(f"method {method} has no call site {ordinal}")
        return own.select("callee").distinct()

    def callers(self, method: int) -> DataFrame:
        return self.edges.filter(F.col("callee") == method).select("caller", "ordinal")

    def reachable(self) -> DataFrame:
        if "reach" not in self._known:
            pairs = cut(self.edges.select("caller", "callee").distinct())
            self._known["reach"] = fixpoint(self.roots, lambda new: new.join(pairs, new["method_id"] == pairs["caller"]).select(F.col("callee").alias("method_id")))
        return self._known["reach"]

    def is_reachable(self, method: int) -> bool:
        return not self.reachable().filter(F.col("method_id") == method).isEmpty()

    def is_called(self, method: int) -> bool:
        return not self.edges.filter(F.col("callee") == method).isEmpty()

    def is_caller(self, method: int) -> bool:
        return not self.edges.filter(F.col("caller") == method).isEmpty()

    def random_method(self, project: DataFrame, seed: int) -> DataFrame:
        """One reachable method: a project (method_id, project) is drawn first, then a method in it, by a hash of the seed."""
        own = self.reachable().join(project, "method_id")
        one = own.select("project").distinct().orderBy(F.xxhash64("project", F.lit(seed)), "project").limit(1)
        return own.join(F.broadcast(one), "project", "left_semi").orderBy(F.xxhash64("method_id", F.lit(seed)), "method_id").limit(1)

    def by_index(self, k: int) -> DataFrame:
        """The k-th method (from 0) in the order of ids."""
        return self.nodes().orderBy("method_id").offset(k).limit(1)


def find_methods(p: Program, type_name: str | None = None, name: str | None = None, is_static: bool | None = None, params: list[str | None] | None = None) -> DataFrame:
    """Methods by name; None stands for anything, also as a parameter's type.  Names without a namespace are looked up where
    no full one fits."""
    t = p.types.select("type_id", F.col("name").alias("_type"), F.concat_ws(".", F.when(F.col("namespace") != "", F.col("namespace")), "name").alias("_full"))
    m = p.methods.join(t, "type_id")
    if type_name is not None:
        full = m.filter(F.col("_full") == type_name)
        m = full if not full.isEmpty() else m.filter(F.col("_type") == type_name.rpartition(".")[2])
    if name is not None:
        m = m.filter(F.col("name") == name)
    if is_static is not None:
        m = m.filter(F.col("is_static") == is_static)
    if params is not None:
        m = m.filter(F.col("n_params") == len(params))
        at = p.nodes.filter("node_kind = 'parameter'").join(p.types.select("type_id", F.col("name").alias("_kind")), "type_id")
        for k, want in enumerate(params):
            if want is not None:
                m = m.join(at.filter((F.col("position") == k) & (F.col("_kind") == want)).select("method_id"), "method_id", "left_semi")
    return m.select("method_id", "_full", "name")


def nodes_like(p: Program, prefix: str) -> DataFrame:
    """The first node, by name and id, whose name begins so."""
    return p.nodes.filter(F.col("name").startswith(prefix)).orderBy("name", "node_id").limit(1)


def symbol(method: Column, ordinal: Column | None = None) -> Column:
    return F.concat_ws("@", method.cast("string"), *([] if ordinal is None else [ordinal.cast("string")]))


def parse_symbol(s: Column) -> Column:
    """(method_id, ordinal) of a symbol; ordinal is null for a method's own."""
    parts = F.split(s, "@")
    return F.struct(parts[0].try_cast("long").alias("method_id"), F.get(parts, 1).try_cast("int").alias("ordinal"))


def references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, method_id, ordinal): of method@k the callees there, with no ordinal; of a method the call sites that call it."""
    s = symbols.select("symbol", parse_symbol(F.col("symbol")).alias("p")).select("symbol", F.col("p.method_id").alias("_m"), F.col("p.ordinal").alias("_k"))
    there = s.filter("_k IS NOT NULL").join(edges, (F.col("_m") == F.col("caller")) & (F.col("_k") == F.col("ordinal"))).select("symbol", F.col("callee").alias("method_id"), F.lit(None).cast("int").alias("ordinal"))
    calls = s.filter("_k IS NULL").join(edges, F.col("_m") == F.col("callee")).select("symbol", F.col("caller").alias("method_id"), "ordinal")
    return there.unionByName(calls).distinct()


def annotations(p: Program) -> DataFrame:
    """(path, entities): each file's methods in the order of lines, with their declaration's line and their call sites' lines relative to
    it."""
    m = p.methods.filter("analyzable AND path <> ''").select("method_id", "path", "name", "line")
    calls = p.callsites.join(m.select("method_id", F.col("line").alias("_first")), "method_id")
    refs = calls.groupBy("method_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", (F.col("line") - F.col("_first")).alias("offset"), symbol(F.col("method_id"), F.col("ordinal")).alias("symbol")))).alias("refs"))
    own = m.join(refs, "method_id", "left")
    return own.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "method_id", "name", "refs"))).alias("entities"))


def statistics(p: Program) -> DataFrame:
    """Counts by project, and over all in the row with whole = true."""
    from_main = (F.col("name") == "Main") & F.col("is_static")
    t = p.types.select("type_id", "assembly", F.col("accessibility").alias("_access"))
    m = p.methods.filter("analyzable").join(t, "type_id")
    out = m.rollup("assembly").agg(F.count_distinct("type_id").alias("n_types"), F.count("*").alias("n_methods"), F.count_if((F.col("accessibility") == "Public") & (F.col("_access") == "Public")).alias("n_public"), F.count_if(from_main).alias("n_main"), F.grouping("assembly").cast("boolean").alias("whole"))
    return out


def sample_queries(edges: DataFrame, n: int, seed: int = 0, share: float = 0.5) -> DataFrame:
    """(method_id, ordinal) of n call sites: a share of the callers, by a hash of the seed, and one site of each."""
    low = F.pmod(F.xxhash64("caller", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    sites = edges.filter(low).groupBy("caller").agg(F.min_by("ordinal", F.xxhash64("ordinal", "caller", F.lit(seed))).alias("ordinal"))
    return sites.orderBy(F.xxhash64("caller", F.lit(seed + 1)), "caller").limit(n).withColumnRenamed("caller", "method_id")


def compare_policies(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """One row: how many more callees sites have in wide than in narrow, at most, on average, and at how many sites over five more."""
    count = lambda d, n: d.groupBy("caller", "ordinal").agg(F.count_distinct("callee").alias(n))
    both = count(wide, "w").join(count(narrow, "n"), ["caller", "ordinal"], "left").select((F.col("w") - F.coalesce("n", F.lit(0))).alias("d"))
    return both.agg(F.max("d").alias("most"), F.avg("d").alias("mean"), F.count_if(F.col("d") > 5).alias("n_far"))
