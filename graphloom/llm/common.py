"""What the operators of this package share: tables, checkpoints, size checks, batches."""

from __future__ import annotations

import gc
import re
import tempfile
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import bounded

#: White space of the word rules: the class [\x20\x09-\x0D], which is also what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the cluster names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isEmpty() and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = now.get() if now.isDefined() else "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return bounded(df.checkpoint())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are checkpointed: it does so when the driver's garbage is collected, which
    by itself happens rarely.  Python gives up its references in a thread that looks about once a second, so that is waited for."""
    gc.collect()
    given_up = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(100):
        time.sleep(0.05)
        if not given_up:
            break
    spark.sparkContext._jvm.System.gc()


#: What a plan may hold whose rows come in the same order whenever it runs.
_STEADY = {"ColumnarToRow", "FileScan", "Project", "Filter", "Scan", "LocalTableScan"}


def settled(df: DataFrame) -> DataFrame:
    """df, if it only reads and projects stored rows, so that row numbers are the same whenever it is run; else a checkpoint of it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    steps = {m[1] for x in plan.splitlines() if (m := re.match(r"[\s:+\-|]*(?:\*\(\d+\) )?(\w+)", x))}
    return df if steps <= _STEADY else cut(df)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda variable is never inlined by the optimizer."""
    return F.transform(F.array(value), body).getItem(0)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of `column` each; one row may be longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            n = n or 0
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
