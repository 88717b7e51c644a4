import datetime as dt

from graphloom.operators import callgraph, vta, vta_small
from graphloom.sinks import graphs
from graphloom.sources import synthetic
from graphloom.streaming import monitor


def read(spark, path):
    return [r.value for r in sorted(spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").collect(), key=lambda r: r.file_path)]


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 10), (10, 1, 1)], "caller long, ordinal int, callee long")
    graphs.write_dgml(edges, f"{tmp_path}/d")
    lines = read(spark, f"{tmp_path}/d")
    assert lines[1] == "<Nodes>" and lines[2:5] == [f'<Node Id="{k}" Label="{k}" />' for k in (1, 2, 10)] and lines[-1] == "</DirectedGraph>"
    assert sorted(map(tuple, graphs.read_dgml(spark, f"{tmp_path}/d").collect())) == sorted(map(tuple, edges.collect()))
    graphs.write_graphviz(edges, f"{tmp_path}/g")
    assert read(spark, f"{tmp_path}/g") == ["digraph calls {", '"1" -> "2" [label="1"];', '"2" -> "10" [label="1"];', '"10" -> "1" [label="1"];', "}"]


def test_layered_graph_is_reached(spark):
    edges = synthetic.layered(spark, 60, 4, 6)
    rows = edges.collect()
    assert len({(r.caller, r.callee) for r in rows}) == len(rows) and all(r.callee // 15 >= r.project for r in rows)
    assert callgraph.reachable(edges, spark.range(1).withColumnRenamed("id", "method_id")).count() == 60


def test_change_list(spark):
    text = spark.createDataFrame([("a\\b.cs\n\nc.txt\r\nd.cs",)], "value string")
    assert [r.path for r in synthetic.change_list(text, "/r/").collect()] == ["/r/a/b.cs", "/r/d.cs"]


def test_stream_counts_as_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(at + dt.timedelta(seconds=s), 1) for s in (0, 5, 70, 75, 200)], "ts timestamp, sender long")
    log.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    for name, f in (("series", monitor.update_series), ("sessions", monitor.busy_sessions)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(log).collect()))


def test_propagation_graph(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 'a "b"'), (2, "c")], "node_id long, name string")
    pts = spark.createDataFrame([(1, 7), (1, 7), (1, 8)], "node_id long, type_id long")
    types = spark.createDataFrame([(7, "T"), (8, "U")], "type_id long, name string")
    assigns = spark.createDataFrame([(1, 2)], "src long, dst long")
    graphs.write_propagation_graph(nodes, assigns, pts, types, pts.limit(0), f"{tmp_path}/p")
    assert read(spark, f"{tmp_path}/p") == ["digraph method {", '"1" [label="a \\"b\\" {T x2, U}"];', '"2" [label="c {}"];', '"1" -> "2";', "}"]


def test_reports_and_metrics(spark, tmp_path):
    graphs.write_report(spark.createDataFrame([(1, 2), (2, 9), (3, 2)], "method_id long, n long"), f"{tmp_path}/r")
    assert read(spark, f"{tmp_path}/r") == ["9\t2", "2\t1", "2\t3"]
    rows = spark.createDataFrame([("x", 1)], "subject string, methods long")
    graphs.write_metrics(rows, f"{tmp_path}/m")
    graphs.write_metrics(rows, f"{tmp_path}/m")
    again = lambda: spark.read.option("header", True).csv(f"{tmp_path}/m")
    assert again().count() == 2 and again().columns == ["subject", "methods"]
    graphs.write_metrics(rows, f"{tmp_path}/m", reset=True)
    assert again().count() == 1


def test_generated_graphs(spark):
    g = synthetic.random_graph(spark, 50).collect()
    assert len({(r.caller, r.callee) for r in g}) == len(g) and {r.callee for r in g if r.caller == 0} >= set(range(1, 50))
    c = synthetic.connected(spark, 60)
    assert callgraph.reachable(c, spark.range(1).withColumnRenamed("id", "method_id")).count() == 60
    p = synthetic.program(spark, c, 4)
    rules = vta.Rules(p)
    start = spark.range(1).withColumnRenamed("id", "method_id")
    state = vta_small.solve(rules, start)
    kept = {(r.caller, r.callee) for r in c.collect() if r.caller == 0 or r.callee % 4 <= r.caller % 4}
    assert {(r.method_id, r.callee) for r in state.resolved.collect()} <= kept


def test_changes_are_followed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"path": "a.cs"}\n{"path": "b.cs"}\n')
    seen = []
    q = monitor.follow_changes(spark, f"{tmp_path}/in", "path string", lambda d, k: seen.extend(r.path for r in d.collect()), f"{tmp_path}/state", every="1 second")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a.cs", "b.cs"]


def test_status_of_dispatchers(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(at + dt.timedelta(seconds=s), k) for s, k in ((0, 1), (4, 1), (30, 1), (29, 2))], "ts timestamp, sender long")
    rows = monitor.status_at(log, at + dt.timedelta(seconds=35)).collect()
    assert {r.sender: r.status for r in rows} == {1: "Busy", 2: "Busy"}
    assert {r.sender: r.status for r in monitor.status_at(log, at + dt.timedelta(seconds=45)).collect()} == {1: "Idle", 2: "Idle"}
    assert {r.status for r in monitor.status_at(log, at + dt.timedelta(seconds=90)).collect()} == {"Inactive"}
