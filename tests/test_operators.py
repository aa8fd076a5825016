"""Operators without a SQL form against brute force, parsing rules, sources and sinks."""

import itertools
import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abacist.functions import geometry as G
from abacist.functions import scalars as S
from abacist.functions import text as X
from abacist.operators import align, assign, associate, cluster, conformal, extract, protocol, routing
from abacist.sources import readers, writers
from abacist.streaming import events as streaming


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10_000))
def test_hungarian_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m)).round(2)
    pairs = assign.hungarian(cost)
    small, large = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), len(small)))
    assert len(pairs) == min(n, m) and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def test_nms_and_greedy():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30]], float)
    assert assign.nms(boxes, np.array([0.5, 0.9, 0.4]), 0.45) == [1, 2]
    assert assign.greedy(np.array([[0.6, 0.9], [0.1, 0.8]]), 0.5) == [(0, 1)]


def test_clusters():
    points = np.array([[0, 0], [0, 1], [1, 0], [10, 10], [10, 11], [11, 10], [50, 50]], float)
    assert cluster.dbscan(points, 1.5, 3).tolist() == [0, 0, 0, 1, 1, 1, -1]
    rng = np.random.default_rng(0)
    assert cluster.gmm_bic(np.r_[rng.normal(0, 1, 60), rng.normal(20, 1, 60)])[0] == 2
    assert cluster.gmm_bic(rng.normal(0, 1, 100))[0] == 1
    assert cluster.kmeans_choice(np.vstack([rng.normal(c, 0.2, (20, 2)) for c in (0, 5, 10)]))[0] == 3


def test_text_rules(spark):
    rows = spark.createDataFrame([("1,5 kg",), ("l0O",), ("$ 2k",), ("25%",), ("−0.5",), ("abc",), (None,), ("1d",)], "t string")
    got = [tuple(r) for r in rows.select(
        X.label_number(F.col("t")), X.first_number(X.digits_corrected(F.col("t"))), X.unit_number(F.col("t"))["value"], X.pie_share(F.col("t")), X.safe_number(F.col("t"))).collect()]
    assert got[0][0] == 1.5 and got[1][1] == 100.0 and got[2][2] == 2000.0 and got[3][3] == 0.25
    assert got[5] == (None, None, None, None, None) and got[6] == (None, None, None, None, None) and got[7][4] is None
    cells = spark.createDataFrame([("a|b<0x0A>1 & 2",)], "t string").select(X.table_cells(F.col("t"))).first()[0]
    assert cells == [["a", "b"], ["1", "2"]]


def test_scalar_rules(spark):
    row = spark.range(1).select(
        S.chart_type(F.lit(" Unknown ")), S.orientation(F.lit("H")), S.calibration_quality(F.lit(0.5)), S.strategy(F.lit("auto"), F.lit(0.3), F.lit(0.1), F.lit("high")),
        S.scaled(F.lit("log10"), F.lit(1.0), F.lit(0.0), F.lit(2.0)), G.valid_box(F.array(F.lit(1.0), F.lit(2.0))), readers.figure_id(F.lit("/x/a.b.pdf"), F.lit(1), F.lit(2))).first()
    assert tuple(row) == ("bar", "horizontal", "approximate", "vlm", 100.0, False, "a.b_p001_f02")


def test_protocol_projection(spark):
    element = "struct<type:string,bbox:array<double>,xyxy:array<double>,x:double,y:double,value:string,estimated_value:string,text_label:string,bar_label:string,label:string,tick_label:struct<text:string>,error_bar:struct<margin:double>,confidence:double>"  # noqa: E501
    schema = f"source_file string, page_index int, chart_type string, elements array<{element}>, baselines array<struct<value:double>>, titles array<string>"
    bar = ("bar", None, [0.0, 0.0, 1.0, 1.0], None, None, None, "12.5", None, None, None, (" Group A ",), (1.0,), 0.9)
    total = ("summary", [0.0], None, None, None, "9", None, None, None, None, None, None, None)
    rows = spark.createDataFrame([("a.pdf", 0, "bar", [bar, total], [(3.0,)], ["body Weight (kg)"])], schema)
    got = protocol.project(rows, {"outcomes": ["Weight", "Volume"], "units": {"Weight": "kg"}}).collect()
    assert len(got) == 1 and (got[0]["value"], got[0]["group"], got[0]["outcome"], got[0]["unit"], got[0]["baseline_value"]) == (12.5, "Group A", "Weight", "kg", 3.0)


def test_validation_gates(spark):
    gold = spark.createDataFrame([("s", "bar", 1, 12.5), ("s", "bar", 2, 10.2), ("s", "line", 3, 3.8), ("s", "line", 4, 2.1)], "f string, chart_type string, o int, value double")
    bad = gold.withColumn("value", 20 - F.col("value"))
    for pred, passed in ((gold, True), (bad, False)):
        pairs = align.bag_align(gold, pred, ["f", "chart_type"], ["o"], ["value", "chart_type"], ["value", "chart_type"])
        total = align.report(pairs, "gold_value", "pred_value", "gold_chart_type", "pred_chart_type").first()
        assert total["passed"] is passed and (total["accuracy"], total["kappa"]) == (1.0, 1.0)
    half = align.bag_align(gold, gold.where("o < 4"), ["f", "chart_type"], ["o"], ["value", "chart_type"], ["value", "chart_type"])
    missed = align.report(half, "gold_value", "pred_value", "gold_chart_type", "pred_chart_type").first()
    assert (missed["success_rate"], missed["accuracy"], missed["unmatched_gold"], missed["passed"]) == (0.75, 0.75, 1, False)
    empty = align.bag_align(gold.limit(0), gold.limit(0), ["f", "chart_type"], ["o"], ["value", "chart_type"], ["value", "chart_type"])
    for required in (True, False):
        none = align.report(empty, "gold_value", "pred_value", "gold_chart_type", "pred_chart_type", required, required).first()
        assert (none["success_rate"], none["accuracy"], none["ccc"], none["kappa"], none["passed"]) == (1.0, 1.0, None, None, not required)


def test_intervals_and_fallback(spark):
    rows = spark.createDataFrame([("a", float(i), float(i % 7)) for i in range(40)], "family string, feature double, score double")
    edges = conformal.bins(rows, "family", "feature", 4)
    assert edges.count() == 4 and conformal.binned(rows, edges, "family", "feature").where("bin IS NULL").count() == 0
    q = conformal.quantiles(rows, ["family"], "score", 0.1).first()
    assert q["q_alpha"] == sorted(i % 7 for i in range(40))[36] and q["n_cal"] == 40
    first = spark.createDataFrame([(1, "x")], "chart int, v string")
    second = spark.createDataFrame([(1, "y"), (2, "z")], "chart int, v string")
    assert sorted(tuple(r) for r in routing.with_fallback(first, second, ["chart"]).collect()) == [(1, "x"), (2, "z")]
    checked = spark.range(1).select(extract.box_checked(*[F.lit(v) for v in (5.0, 4.0, 9.0, 8.0, 12.0)], F.array(F.lit(1.0), F.lit(5.0), F.lit(20.0))).alias("b")).select("b.*").first()
    assert (checked["whisker_low"], checked["median"], checked["whisker_high"], checked["outliers"], checked["suspect"]) == (4.0, 8.0, 12.0, [1.0, 20.0], False)


def test_contained_is_exact(spark):
    rng = np.random.default_rng(1)
    points = [(1, int(x)) for x in rng.integers(0, 500, 60)]
    spans = [(1, i, int(a), int(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 500, 20), rng.integers(-5, 90, 20)))]
    p, s = spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(spans, "k int, i int, a int, b int")
    got = sorted((r["at"], r["i"]) for r in associate.contained(p, s, ["k"], F.col("at"), "a", "b", 32.0).select("at", "i").collect())
    assert got == sorted((x, i) for _, x in points for _, i, a, b in spans if a <= x <= b)


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", "0", "bar", "s", "g", "o", "1.5", "kg", "SD", "", "", "0.9", "auto", "")], protocol.COLUMNS)
    for name, data in (("full", rows), ("none", rows.limit(0))):
        writers.protocol_csv(data, str(tmp_path / name))
    assert readers.protocol_csv(spark, str(tmp_path / "full")).count() == 1
    for kind in ("json", "csv", "txt"):
        writers.export(rows, str(tmp_path / kind), kind)
    assert writers.run_manifest(rows, {"mode": "auto"}).first()["assets"] == 1
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"imgname": "x/1.png", "query": "q", "label": "l", "type": "t"}]}))
    got = readers.benchmark_records(readers.manifest(spark, str(tmp_path / "m.json"))).first()
    assert (got["sample_id"], got["benchmark_format"], got["answer"]) == ("1", "chartqa", "l")
    (tmp_path / "img").mkdir()
    for n in ("b.pdf", "a.PNG", "c.txt"):
        (tmp_path / "img" / n).write_text("x")
    assert [r["path"].rsplit("/")[-1] for r in readers.assets(spark, str(tmp_path / "img")).collect()] == ["a.PNG", "b.pdf"]
    (tmp_path / "y.txt").write_text("0 .5 .5 .1 .2\nbad\n")
    assert readers.yolo_labels(spark, str(tmp_path / "y.txt")).count() == 1


def test_streams(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id AS event_id, id % 2 AS user_id, 'a' AS event_type, 1.0D AS value FROM range(20)").write.parquet(str(tmp_path / "e"))
    for f in (streaming.windowed, streaming.sessions, streaming.without_repeats):
        stream = f(spark.readStream.schema("ts timestamp, event_id long, user_id long, event_type string, value double").parquet(str(tmp_path / "e")))
        q = stream.writeStream.format("memory").queryName(f"q_{f.__name__}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("q_without_repeats").count() == 20
