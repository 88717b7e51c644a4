"""Semi-naive evaluation of recursive rules over DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Guessed bytes from which a size says nothing; Spark takes the greatest long for an unknown one.
FAR = 1 << 62


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder, without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return bounded(df.checkpoint())


def bounded(df: DataFrame) -> DataFrame:
    """A checkpoint without Spark's guess of its size where that is beyond a long.  A checkpoint keeps the guess for the plan that made it, which for a join
    is the product of both sides; in loops the number's length doubles a round, until it alone fills the driver's memory."""
    plan, spark = df._jdf.logicalPlan(), df.sparkSession
    if plan.stats().sizeInBytes() < FAR:
        return df
    sql, none = spark._jvm.org.apache.spark.sql, spark._jvm.scala.Option.empty()
    bare = sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


@contextmanager
def measured_sizes(spark: SparkSession) -> Iterator[None]:
    """Within it Spark broadcasts tables of which it has measured that they are small, and none by a guess.  It guesses a table after an explode, and
    one read from compressed files, many times too small, and collects what it broadcasts in the driver."""
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    guessed, measured = spark.conf.get(names[0]), spark.conf.getAll.get(names[1])
    spark.conf.set(names[0], "-1")
    if measured is None:
        spark.conf.set(names[1], guessed)
    try:
        yield
    finally:
        spark.conf.set(names[0], guessed)
        if measured is None:
            spark.conf.unset(names[1])


def by_measured_sizes(f: Callable) -> Callable:
    """f, whose first argument has a Spark session, with all its steps within `measured_sizes`."""

    @wraps(f)
    def run(rules, *args, **named):
        with measured_sizes(rules.spark):
            return f(rules, *args, **named)

    return run


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], compact: int = 8) -> DataFrame:
    """The least relation that holds seed and is closed under step, which is linear: it maps new rows to candidates.

    A round joins only the rows that the last one found.  What is known is kept as the rounds' checkpoints, put
    together every `compact` rounds.
    """
    names = seed.columns
    new = known = cut(seed.distinct())
    rounds = 0
    while True:
        new = cut(step(new).select(*names).distinct().join(known, names, "left_anti"))
        if new.isEmpty():
            return known
        rounds += 1
        known = known.unionByName(new)
        if rounds % compact == 0:
            known = cut(known)


def closure(base: DataFrame, sub: str, sup: str) -> DataFrame:
    """(sub, sup, dist): the reflexive and transitive closure of a forest, given as a row for each node.  Each round joins the pairs found so
    far with themselves, so it doubles the distance: a forest of depth d takes about log2(d) rounds.  A cycle raises an error."""
    n = base.count()
    pairs = cut(base.filter(F.col(sup).isNotNull()).select(F.col(sub).alias("sub"), F.col(sup).alias("sup"), F.lit(1).alias("dist")).distinct())
    known, far = pairs, pairs  # far: pairs at the greatest distance that is a power of two
    while not far.isEmpty():
        if far.agg(F.max("dist")).first()[0] > n:
            raise ValueError(f"{sub} and {sup} make a cycle")
        step = far.select(F.col("sub").alias("_at"), F.col("sup").alias("_up"), F.col("dist").alias("_dist"))
        more = cut(known.join(step, F.col("sup") == F.col("_at")).select("sub", F.col("_up").alias("sup"), (F.col("dist") + F.col("_dist")).alias("dist")))
        reach = far.agg(F.max("dist")).first()[0]
        known = known.unionByName(more)
        far = cut(more.filter(F.col("dist") == 2 * reach))
    own = base.select(F.col(sub).alias("sub"), F.col(sub).alias("sup"), F.lit(0).alias("dist")).distinct()
    return cut(known.unionByName(own))
