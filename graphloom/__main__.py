"""python -m graphloom COMMAND FOLDER [OUT]: analyses the .cs files below a folder.

reachable   the methods that the entry points reach
graph       the call graph, as DGML files in OUT
callers     methods by the number of their callers, as a report in OUT
files       each file's methods and call sites
statistics  counts of types and methods
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import callgraph_api, roots, vta, vta_small
from graphloom.sinks import graphs
from graphloom.sources import solution


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("reachable", "graph", "callers", "files", "statistics"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    p = solution.from_folder(spark, args[1])
    if args[0] == "statistics":
        callgraph_api.statistics(p).show(truncate=False)
    elif args[0] == "files":
        callgraph_api.annotations(p).show(truncate=False)
    else:
        rules = vta.Rules(p)
        edges, reached = vta.call_graph(rules, roots.main(p), vta_small.solve(rules, roots.main(p)))
        if args[0] == "graph":
            graphs.write_dgml(edges, args[2])
        elif args[0] == "callers":
            graphs.write_report(edges.groupBy(F.col("callee").alias("method_id")).agg(F.count_distinct("caller").alias("n")), args[2])
        else:
            reached.join(callgraph_api.names(p), "method_id").orderBy("full").show(10_000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
