"""Scans, sidecars and sinks on hand-made files."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringEndsWith, StringStartsWith

from folioscope.operators.store import scratch
from folioscope.sources import scan, sidecars, sinks


def folder(spark, files):
    root = scratch(spark, "files").removeprefix("file://")
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    return root


RUNS = {
    "a/phase1.json": json.dumps({"pages_total": 10, "pages_candidate": 4, "figures": "three", "more": [1]}),
    "a/result.json": json.dumps({"status": "ok", "phase_cost": {"detect": 0.4, "convert": 1}}),
    "b/phase1.json": "not json {",
    "b/result.json": json.dumps({"status": "ok"}),
    "c/phase1.json": json.dumps({"pages_total": 5}),
    "d/phase1.json": json.dumps([1, 2]),
    "_done/phase1.json": json.dumps({"pages_total": 99}),
    "é/phase1.json": json.dumps({"pages_total": 2**70, "pages_candidate": True}),
    "plain.json": "{}",
}


def read(spark, root, name="phase1.json", schema=scan.PHASE_ONE, **options):
    sidecars.register(spark)
    return spark.read.format("sidecars").schema("doc_id string, " + schema).options(name=name, **options).load(root)


def test_sidecars(spark):
    root = folder(spark, RUNS)
    got = {r["doc_id"]: (r["pages_total"], r["pages_candidate"], r["figures"]) for r in read(spark, root, folders=2).collect()}
    assert got == {"a": (10, 4, None), "b": (None, None, None), "c": (5, None, None), "d": (None, None, None), "é": (None, None, None)}
    assert {r["doc_id"] for r in read(spark, root, "result.json", scan.RESULT).collect()} == {"a", "b"}
    first, result = read(spark, root), read(spark, root, "result.json", scan.RESULT)
    assert [tuple(r) for r in scan.history(first, result).collect()] == [("a", 10, 4, 0.4, 1.0)]
    # Spark's own reader tells the same of whole files
    other = {r["doc_id"]: r["pages_total"] for r in scan.sidecars(spark, "file://" + root, "phase1.json", scan.PHASE_ONE).collect()}
    assert other["a"] == 10 and other["c"] == 5 and "_done" not in other
    assert read(spark, root + "/nothing").collect() == []


@pytest.mark.parametrize(
    ("condition", "kept"),
    [("doc_id = 'a'", "a"), ("doc_id in ('a', 'c', 'zz')", "ac"), ("doc_id > 'b'", "cdé"), ("doc_id <> 'c'", "abdé"), ("doc_id like 'd%'", "d"), ("doc_id = 'a' or pages_total = 5", "ac"), ("doc_id <= 'b' and pages_total = 10", "a"), ("doc_id = '_done'", ""), ("doc_id is null", "")],
)
def test_pushed_filters(spark, condition, kept):
    root = folder(spark, RUNS)
    assert sorted(r["doc_id"] for r in read(spark, root).where(condition).collect()) == list(kept)


def test_pruned_folders_are_not_opened(spark):
    root = folder(spark, {"a/phase1.json": "{}", "b/phase1.json": "{}", "_c/phase1.json": "{}"})
    schema = read(spark, root).schema
    reader = sidecars.Reader(schema, root, "phase1.json", 10)
    left = list(reader.pushFilters([Not(EqualTo(("doc_id",), "b")), GreaterThan(("pages_total",), 3), StringEndsWith(("doc_id",), "x")]))
    assert left == [GreaterThan(("pages_total",), 3), StringEndsWith(("doc_id",), "x")] and reader.folders() == ["a"]
    # folders that are named are not listed: the root needn't be there
    reader = sidecars.Reader(schema, "/nowhere", "phase1.json", 10)
    assert list(reader.pushFilters([In(("doc_id",), ("q", "p", "_r")), StringStartsWith(("doc_id",), "p")])) == []
    assert [p.names for p in reader.partitions()] == [["p"]] and list(reader.read(reader.partitions()[0])) == []


def test_written_sidecars(spark):
    root = folder(spark, {"x/other.json": "{}"})
    df = spark.createDataFrame([("x", 1, None), ("ü y", 2, [1.5])], "doc_id string, pages_total long, bbox array<double>")
    sidecars.register(spark)
    for _ in range(2):
        df.write.format("sidecars").option("name", "phase1.json").mode("append").save(root)
    assert sorted(os.listdir(root)) == ["x", "ü y"] and sorted(os.listdir(f"{root}/x")) == ["other.json", "phase1.json"]
    got = {r["doc_id"]: (r["pages_total"], r["bbox"]) for r in read(spark, root, schema="pages_total long, bbox array<double>").collect()}
    assert got == {"x": (1, None), "ü y": (2, [1.5])}
    for bad in ("", "_a", "a/b", None):
        with pytest.raises(Exception, match="can't name a folder"):
            spark.createDataFrame([(bad, 1)], "doc_id string, pages_total long").write.format("sidecars").option("name", "p.json").mode("append").save(root)


def test_documents(spark):
    root = folder(spark, {"b.pdf": "bb", "a.b.pdf": "a", "c.PDF": "", "d.txt": "no", "below/e.pdf": "no"})
    files = scan.documents(spark, "file://" + root)
    assert {(r["doc_id"], r["size"], bytes(r["content"])) for r in files.collect()} == {("a.b", 1, b"a"), ("b", 2, b"bb")}
    assert [(r["doc_id"], r["index"], r["total"]) for r in scan.numbered(files).orderBy("index").collect()] == [("a.b", 0, 2), ("b", 1, 2)]
    many = spark.range(1000).select(F.format_string("d%d", "id").alias("doc_id"), F.format_string("/p/%04d", 999 - F.col("id")).alias("path"), F.lit(1).alias("size"))
    got = [(r["path"], r["index"], r["total"]) for r in scan.numbered(many).orderBy("path").collect()]
    assert got == [(f"/p/{i:04d}", i, 1000) for i in range(1000)]
    assert scan.numbered(many.limit(0)).collect() == []


def test_runs_replace_themselves(spark):
    path = scratch(spark, "runs")
    for run, values in (("r1", [1, 2]), ("r2", [3]), ("r1", [4])):
        sinks.write_run(spark.createDataFrame([(v,) for v in values], "v long"), path, run)
    assert sorted((r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("r1", 4), ("r2", 3)]


def test_report_and_detections(spark):
    results = spark.createDataFrame([(1, "ok", 1.5, "warn", 99.0, None, 3, None), (2, None, None, None, None, None, 0, "broken")], "doc_id long, status string, cost_usd double, verify_status string, text_coverage double, table_coverage double, figures long, error string")
    got = {r["doc_id"]: json.loads(r["payload"]) for r in sinks.report(results).collect()}
    assert got[1] == {"status": "ok", "cost": {"total_usd": 1.5}, "verify": {"status": "warn", "text_coverage": 99.0}, "figures": 3}
    assert got[2] == {"cost": {}, "verify": {}, "figures": 0, "error": "broken"}
    box = "page_no int, x0 double, y0 double, x1 double, y1 double"
    figures = spark.createDataFrame([(1, "FIG_2", "b.png", 2, 0.0, 0.0, 1.0, 1.0), (1, "FIG_1", "a.png", 1, 5.0, 9.0, 6.0, 10.0), (1, "FIG_0", "z.png", 1, 7.0, 3.0, 8.0, 4.0)], f"doc_id long, fig_id string, file string, {box}")
    others = spark.createDataFrame([(2, "table", 1, 0.0, 0.0, 1.0, 1.0)], f"doc_id long, rtype string, {box}")
    got = {r["doc_id"]: json.loads(r["payload"]) for r in sinks.detections(figures, others).collect()}
    assert [f["fig_id"] for f in got[1]["figures"]] == ["FIG_0", "FIG_1", "FIG_2"] and "other_detections" not in got[1]
    assert got[2]["other_detections"][0]["rtype"] == "table"


def test_detections_of_unflagged_lines(spark, tmp_path):
    """A document whose lines have no flag has a row without figures, as in the SQL; lines meet their orders once."""
    import duckdb

    from folioscope.plans import ORACLE_SQL, QUERIES

    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 7, 2, 1, "R"), (1, 5, 2, 2, "R"), (1, 5, 2, 3, "N"), (2, 1, 1, 1, None), (3, 1, 1, 1, "A"), (9, 1, 1, 1, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["detection_payloads"](spark, str(tmp_path))
    sql = ORACLE_SQL["detection_payloads"]
    for t in ("orders", "lineitem"):
        sql = sql.replace(f" {t} ", f" '{tmp_path}/{t}.parquet/*.parquet' ", 1)
    assert sorted(map(tuple, df.collect())) == sorted(duckdb.sql(sql).fetchall()) == [(1, "2,1", 1), (2, None, 0), (3, None, 1)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
