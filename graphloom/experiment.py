"""Runs of an analysis with their figures, as telemetry rows."""

from __future__ import annotations

import datetime as dt
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import roots, vta, vta_small
from graphloom.operators.callgraph_api import CallGraph, sample_queries
from graphloom.schema import Program

log = logging.getLogger("graphloom")

#: States of a run, in the order in which it goes through them, and its two other ends.
STATES = ("None", "Compiling", "Running", "ComputingResults", "Ready", "Failed", "Cancelled")
RESULTS = "exp_id string, time timestamp, subject string, status string, methods long, messages long, types long, elapsed_ms long"
QUERIES = "exp_id string, subject string, repetitions int, avg_ms double, min_ms double, max_ms double, median_ms double, stddev_ms double"


def run(exp_id: str, subject: str, load: Callable[[], Program], kind: str = "Main", told: Callable[[str], None] = log.info) -> tuple[DataFrame, vta.State]:
    """Loads and analyses a program; one row of RESULTS and the state.  told gets each state of the run."""
    told("Compiling")
    try:
        p = load()
        rules = vta.Rules(p)
        told("Running")
        began = time.time()
        state = vta_small.solve(rules, roots.select(p, rules, kind))
        told("ComputingResults")
        row = (exp_id, dt.datetime.now(), subject, "Ready", state.active.count(), state.resolved.count(), state.pts.count(), int(1000 * (time.time() - began)))
    except Exception:
        told("Failed")
        raise
    told("Ready")
    return rules.spark.createDataFrame([row], RESULTS), state


def query_times(exp_id: str, subject: str, graph: CallGraph, n: int = 50, warm_up: int = 50, seed: int = 0) -> DataFrame:
    """One row of QUERIES: the times of n questions for the callees of random call sites, after some that are not counted."""
    sites = sample_queries(graph.edges, n + warm_up, seed, 1.0).collect()
    spark, took = graph.edges.sparkSession, []
    for k, r in enumerate(sites * (1 + (n + warm_up) // max(1, len(sites)))):
        if k == n + warm_up:
            break
        began = time.time()
        graph.callees(r.method_id, r.ordinal).collect()
        if k >= warm_up:
            took.append((1000 * (time.time() - began),))
    times = spark.createDataFrame(took, "ms double")
    of = times.agg(F.count("*").cast("int").alias("repetitions"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.percentile("ms", 0.5).alias("median_ms"), F.stddev_pop("ms").alias("stddev_ms"))
    return of.select(F.lit(exp_id).alias("exp_id"), F.lit(subject).alias("subject"), "*")
