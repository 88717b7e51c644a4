"""Counters and busy sessions over a message log (ts, sender, ...); each works on batches and on streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def update_series(log: DataFrame, every: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(window, n): messages by tumbling window; those later than `late` are left out of a stream."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"))


def busy_sessions(log: DataFrame, idle: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """(sender, session, n): runs of a sender's messages without a silence of `idle`."""
    return log.withWatermark("ts", late).groupBy("sender", F.session_window("ts", idle).alias("session")).agg(F.count("*").alias("n"))


def follow_changes(spark: SparkSession, folder: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Calls apply(changes, batch) for the change files that appear in a folder; a batch comes again after a failure."""
    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def status_at(log: DataFrame, now: dt.datetime, idle: str = "10 seconds", inactive: str = "20 seconds") -> DataFrame:
    """(sender, status) at a time: Busy, Idle after a silence of `idle`, Inactive after `inactive` more.  On a stream it is the
    status of the rows so far, as each batch ends."""
    last = log.filter(F.col("ts") <= F.lit(now)).groupBy("sender").agg(F.max("ts").alias("last"))
    quiet = lambda span: F.lit(now) - F.expr(f"INTERVAL {span}")
    status = F.when(F.col("last") > quiet(idle), "Busy").when(F.col("last") > quiet(idle) - F.expr(f"INTERVAL {inactive}"), "Idle").otherwise("Inactive")
    return last.select("sender", status.alias("status"))


def method_states(effects: DataFrame) -> DataFrame:
    """(method_id, n_effects, last): the state of each method over a stream of effects (ts, method_id), kept in the state store by method."""
    return effects.groupBy("method_id").agg(F.count("*").alias("n_effects"), F.max("ts").alias("last"))


def spread(effects: DataFrame, instances: int, streams: int = 4) -> DataFrame:
    """Effects dealt in turn to instances * streams partitions."""
    return effects.repartition(instances * streams)


class Progress(StreamingQueryListener):
    """Calls told(name, event) as streams start, advance and end."""

    def __init__(self, told: Callable[[str, str], None]) -> None:
        self.told = told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.told(event.name or str(event.id), "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.told(event.progress.name or str(event.progress.id), f"{event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.told(str(event.id), "idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.told(str(event.id), "ended")


def reset(spark: SparkSession, folder: str) -> None:
    """Deletes a stream's state, so that it starts again from nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
