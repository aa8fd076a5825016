"""Sources, sinks, refined fits and curve values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.operators import align, cluster, documents, fits, values
from abacist.sources import readers, writers


def test_missing_and_damaged_files(spark, tmp_path):
    assert readers.assets(spark, str(tmp_path / "none")).collect() == []
    assert readers.checked_csv(spark, str(tmp_path / "none.csv"))[1].startswith("File not found")
    (tmp_path / "a.csv").write_text("source_file,chart_type\nx,bar\n")
    rows, error = readers.checked_csv(spark, str(tmp_path / "a.csv"))
    assert rows is None and "group" in error
    (tmp_path / "m.json").write_text("[1, 2]")
    (tmp_path / "l.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n')
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "m.json"))
    assert readers.manifest(spark, str(tmp_path / "l.jsonl")).count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"summary": {"f1": 1.0}}))
    with pytest.raises(ValueError, match="per_chart_metrics"):
        readers.evaluation_payload(spark, str(tmp_path / "p.json"))
    (tmp_path / "p.json").write_text(json.dumps({"summary": {"f1": 1.0}, "per_chart_metrics": [{"f1": 0.5}]}))
    assert readers.evaluation_payload(spark, str(tmp_path / "p.json")).first()["summary"]["f1"] == 1.0
    (tmp_path / "c.json").write_text(json.dumps({"families": {"bar.y": {"mode": "relative", "tau": 0.5, "bins": [{"bin_edges": [0.0, 1.0], "q_alpha": 0.1, "n_cal": 9}]}}}))
    (tmp_path / "d.json").write_text("{}")
    assert [readers.conformal_sidecar(spark, str(tmp_path / n))[1] for n in ("c.json", "d.json", "e.json")] == [True, False, False]


def test_likely_figures(spark):
    rows = spark.createDataFrame([(100, 100, 3, 2), (100, 400, 9, 9), (100, 20, 9, 9), (100, 100, 2, 9), (100, 100, None, None), (100, 500, None, None)], "w int, h int, t int, l int")
    got = rows.select(readers.likely_figure(F.col("w"), F.col("h"), F.col("t"), F.col("l"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, True, False]


def test_reports_and_subsets(spark, tmp_path):
    gold = spark.createDataFrame([("s", "bar", i, float(i)) for i in range(1, 9)], "f string, chart_type string, o int, value double")
    pairs = align.bag_align(gold, gold.where("o < 8"), ["f", "chart_type"], ["o"], ["value", "chart_type"], ["value", "chart_type"])
    total = align.report(pairs, "gold_value", "pred_value", "gold_chart_type", "pred_chart_type")
    each = align.by_type(pairs, "chart_type", "gold_value", "pred_value", F.lit(True))
    report = json.loads(writers.report_document(total, each, "chart_type").first()["report"])
    assert report["alignment"] == {"matched": 7, "unmatched_gold": 1, "unmatched_pred": 0, "total": 8} and report["all_thresholds_met"] is False
    assert report["gates"]["success_rate"] == {"observed": 0.875, "threshold": 0.99, "pass": False} and report["per_chart_type"]["bar"]["count"] == 7
    documents_ = spark.createDataFrame([("a", "x"), ("c", None)], "id string, content string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    for _ in range(2):  # what was there before goes
        assert {r["reason"]: r["n"] for r in writers.subset(wanted, documents_, "id", str(tmp_path / "s")).collect()} == {"written": 1, "missing": 2}
    assert spark.read.json(str(tmp_path / "s")).count() == 1
    with pytest.raises(ValueError):
        writers.subset(wanted, documents_, "id", str(tmp_path / "s"), "error")
    names = spark.createDataFrame([("/a/b.c.png",), ("d.jpg",)], "p string").select(writers.analysis_name(F.col("p"))).collect()
    assert [r[0] for r in names] == ["b.c_analysis.json", "d_analysis.json"]
    rows = spark.createDataFrame([(f"f{i % 3}.png", 0, "bar", "g", "o", str(i), "", "SD") for i in range(9)], documents.GOLD)
    writers.gold_csv(rows, str(tmp_path / "gold"))
    assert [r["source_file"] for r in spark.read.option("header", True).csv(str(tmp_path / "gold")).collect()] == sorted(["f0.png", "f1.png", "f2.png"] * 3)


def test_truth_documents(spark, tmp_path):
    schema = ("path string, chart_type string, scale_info struct<x_min:double,x_max:double,x_scale:string,y_min:double,y_max:double,y_scale:string,primary_scale_axis:string,secondary_scale_axis:string>, "
              "bars array<struct<top:double,height:double,center:double,bottom:double,width:double>>, boxes array<struct<q1:double,quartile_1:double,lower_quartile:double,median:double,median_value:double,q2:double,"
              "q3:double,quartile_3:double,upper_quartile:double>>, series array<struct<points:array<struct<x:double,y:double>>>>")  # fmt: skip
    bars = [(None, 3.0, 1.0, 0.0, 2.0), (4.0, 9.0, None, 0.0, 2.0)]
    rows = spark.createDataFrame([("a", "bar", (0.0, 1.0, None, None, None, "log", None, None), bars, None, None), ("b", "histogram", None, bars, None, None), ("c", None, None, None, None, None)], schema)
    got = {r["path"]: r for r in documents.truth_document(rows).collect()}
    assert [tuple(b) for b in got["a"]["bar_values"]] == [(3.0, 1.0), (4.0, None)] and got["a"]["histogram_bins"] is None
    assert [tuple(b) for b in got["b"]["histogram_bins"]] == [(0, 3.0, 0.0, 2.0), (1, 9.0, None, None)] and got["c"]["chart_type"] == "unknown"
    assert got["a"]["axis_calibration"]["y_axis"]["scale"] == "log" and got["b"]["axis_calibration"]["primary_scale_axis"] == "y"
    writers.truth_documents(documents.truth_document(rows), str(tmp_path / "t"), compact=True)
    assert spark.read.json(str(tmp_path / "t")).count() == 3


def plain_refined(points, limit):
    """All pairs, the best by score, then refits; ties to the earlier pair."""
    score = lambda m, c: round(0.5 * sum(abs(y - m * x - c) <= limit for x, y, _ in points) - sum(w * min((y - m * x - c) ** 2, limit**2) for x, y, w in points), 6)

    def refit(some, before):
        sw = sum(w for *_, w in some)
        if len(some) < 2:
            return before
        mx, my = sum(w * x for x, _, w in some) / sw, sum(w * y for _, y, w in some) / sw
        sxx = sum(w * (x - mx) ** 2 for x, _, w in some)
        return before if sxx <= 1e-12 else (m := sum(w * (x - mx) * (y - my) for x, y, w in some) / sxx, my - m * mx)

    inside = lambda line, t: [p for p in points if abs(p[1] - line[0] * p[0] - line[1]) <= t]
    lines = [((m := (b[1] - a[1]) / (b[0] - a[0])), a[1] - m * a[0]) for i, a in enumerate(points) for b in points[i + 1 :] if abs(b[0] - a[0]) > 1e-12]
    best = max(lines, key=lambda line: score(*line))
    best = at = refit(inside(best, limit), best)
    top = score(*best)
    for _ in range(2):
        at = refit(inside(at, 0.9 * limit), at)
        if score(*at) > top:
            best, top = at, score(*at)
    return (*best, top, len(inside(best, limit)))


def test_refined_fits_are_those_of_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(x), float(2 * x + 1 + rng.normal(0, 0.5) + (20 if rng.random() < 0.25 else 0)), float(rng.choice([0.0, 0.3, 0.8, 2.0]))) for g in range(25) for x in rng.permutation(30)[:8]]
    got = {r["g"]: tuple(r)[1:] for r in fits.refined_fit(spark.createDataFrame(rows, "g int, x double, y double, w double"), ["g"], "x", "y", "w", 1.0).collect()}
    for g in range(25):
        points = sorted((x, y, min(max(w, 1e-6), 1.0)) for k, x, y, w in rows if k == g)
        wanted = plain_refined(points, 1.0)
        assert np.allclose(got[g], wanted, atol=1e-5), (got[g], wanted)


def test_curve_and_clusters(spark):
    rng = np.random.default_rng(0)
    curve = [([0.0, 0.0, 0.0], 1.0), ([10.0, 0.0, 0.0], 2.0), ([10.0, 20.0, 5.0], 8.0)]
    rows = [(curve, rng.uniform(-5, 25, 3).tolist()) for _ in range(40)]
    table = spark.createDataFrame(rows, "curve array<struct<color:array<double>,value:double>>, color array<double>")
    for r in table.select("color", values.curve_value(F.col("curve"), F.col("color")).alias("v")).collect():
        best = (np.inf, 0.0)
        for (a, u), (b, v) in zip(curve, curve[1:]):
            a_, b_, q = np.array(a), np.array(b), np.array(r["color"])
            s = min(max(np.dot(q - a_, b_ - a_) / np.dot(b_ - a_, b_ - a_), 0), 1)
            best = min(best, (float(((a_ + s * (b_ - a_) - q) ** 2).sum()), u + s * (v - u)))
        assert abs(r["v"]["value"] - best[1]) < 1e-6 and abs(r["v"]["confidence"] - np.exp(-best[0] / 450)) < 1e-6
    points = [(c, k * 100 + i, float(x), float(y)) for c in range(3) for k in range(c + 2) for i, (x, y) in enumerate(rng.normal((k * 50, k * 50), 0.5, (12, 2)))]
    got = cluster.chosen_clusters(spark.createDataFrame(points, "c int, i int, x double, y double"), "c", "i", "x", "y").collect()
    assert {(r["c"], r["k"]) for r in got if r["c"] < 2} <= {(0, 2), (1, 3)} and len(got) == len(points)
