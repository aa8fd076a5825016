"""Nested documents and orchestration on the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.operators import cluster, documents, fits, values
from abacist.plans.link_queries import _LI, _lines
from abacist.plans.queries import query, r4, t


def _charts(spark, d, struct):
    """A chart per order with an array of structs of its lines, by line number."""
    rows = _lines(spark, d)
    return rows.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", struct.alias("e")))), lambda x: x["e"]).alias("items"))


_CLASS = """list_extract(CASE o % 3 WHEN 0 THEN ['chart','bar','axis_title','legend','chart_title','data_label','axis_labels'] WHEN 1 THEN ['slice']
            ELSE ['chart','bar','axis_title','significance_marker','error_bar','legend','chart_title','data_label','axis_labels'] END, n::int + 1)"""


@query(f"WITH {_LI} SELECT o, n, coalesce({_CLASS}, 'unknown') AS class_name FROM li")
def class_names(spark, d):
    kind = F.when(F.col("o") % 3 == 0, "histogram").when(F.col("o") % 3 == 1, "pie").otherwise("radar")
    return _lines(spark, d).select("o", "n", documents.class_name(kind, F.col("n")).alias("class_name"))


@query(f"""WITH {_LI} SELECT o, n, CASE WHEN n % 4 = 0 AND o % 2 = 0 THEN 'abc' WHEN n % 4 = 0 THEN '0123456789.,-eE+%' WHEN n % 4 = 1 THEN '0123456789.,-+%' END AS allowed FROM li""")
def ocr_whitelists(spark, d):
    label = F.when(F.col("n") % 4 == 0, "scale_label").when(F.col("n") % 4 == 1, "data_label").otherwise("other")
    settings = F.when(F.col("o") % 2 == 0, F.create_map(F.lit("scale_label"), F.lit("abc")))
    return _lines(spark, d).select("o", "n", documents.whitelist(label, settings).alias("allowed"))


@query(f"""WITH {_LI} SELECT o, round(CASE WHEN o % 2 = 0 THEN d * 100 + 2 ELSE q + 5 END, 4) AS at, CASE WHEN n % 3 = 0 THEN q ELSE n * 1.5 END::double AS value, round(CASE WHEN n = 4 THEN 0.8 ELSE least(q / 40, 1) END, 4) AS weight
           FROM li WHERE n <> 5 AND (n % 3 <> 1 OR n = 1 OR n = 4)""")
def calibration_points(spark, d):
    q, disc, n = F.col("q"), F.col("d") * 100, F.col("n")
    text = F.when(n == 7, "none").otherwise(F.concat(F.lit("about "), F.regexp_replace((n * 1.5).cast("string"), r"\.", ","), F.lit(" kg")))
    rows = _lines(spark, d).select("o", F.when(n != 5, F.array(q, disc, q + 10, disc + 4)).alias("xyxy"), F.when(n % 3 == 0, q).alias("cleaned"), text.alias("text"), F.when(n != 4, q / 40).alias("confidence"))
    return r4(documents.calibration_points(rows, ["o"], F.col("o") % 2 == 0), "at", "weight")


def _bar():
    n = F.col("n")
    return F.struct(F.when(n % 3 == 0, F.col("q")).alias("top"), F.when(n % 2 == 0, F.col("p")).alias("height"), F.when(n != 5, F.col("q") + 1).alias("center"), (F.col("d") * 10).alias("width"))


@query(f"WITH {_LI} SELECT o, (row_number() OVER (PARTITION BY o ORDER BY n) - 1)::int AS pos, CASE WHEN n % 3 = 0 THEN q WHEN n % 2 = 0 THEN p ELSE 0 END AS value, CASE WHEN n <> 5 THEN q + 1 END AS x_position FROM li")
def truth_bars(spark, d):
    rows = _charts(spark, d, _bar()).select("o", F.posexplode(documents.bar_values(F.col("items"))).alias("pos", "b"))
    return rows.select("o", "pos", "b.value", "b.x_position")


@query(f"""WITH {_LI} SELECT o, (row_number() OVER (PARTITION BY o ORDER BY n) - 1)::int AS bin_index, CASE WHEN n % 2 = 0 THEN p WHEN n % 3 = 0 THEN q ELSE 0 END AS frequency,
                  round(CASE WHEN n <> 5 THEN q + 1 - d * 10 / 2 END, 4) AS left_edge, round(CASE WHEN n <> 5 THEN q + 1 + d * 10 / 2 END, 4) AS right_edge FROM li""")
def truth_bins(spark, d):
    rows = _charts(spark, d, _bar()).select("o", F.explode(documents.histogram_bins(F.col("items"))).alias("b"))
    return r4(rows.select("o", "b.*"), "left_edge", "right_edge")


@query(f"WITH {_LI} SELECT o, q AS x, CASE WHEN k = 1 THEN p ELSE d END AS y FROM li, (VALUES (1), (2)) v(k) WHERE n % 4 <> 1 AND (k = 1 OR n % 2 = 0)")
def truth_points(spark, d):
    point = lambda y: F.struct(F.when(F.col("n") % 4 != 1, F.col("q")).alias("x"), y.alias("y"))
    series = F.struct(F.when(F.col("n") != 3, F.array(point(F.col("p")), point(F.when(F.col("n") % 2 == 0, F.col("d"))))).otherwise(F.array(point(F.col("p")))).alias("points"))
    return _charts(spark, d, series).select("o", F.explode(documents.data_points(F.col("items"))).alias("p")).select("o", "p.x", "p.y")


@query(f"WITH {_LI} SELECT o, q - 1 AS q1, q AS median, q + 2 AS q3 FROM li WHERE n <> 6")
def truth_boxes(spark, d):
    q, n = F.col("q"), F.col("n")
    names = ("q1", "quartile_1", "lower_quartile", "median", "median_value", "q2", "q3", "quartile_3", "upper_quartile")
    value = lambda i, k: F.when((n % 3 == i % 3) & (n != (6 if k == "q3" else 9)), {"q1": q - 1, "median": q, "q3": q + 2}[k])
    return _charts(spark, d, F.struct(*[value(i, names[i // 3 * 3]).alias(name) for i, name in enumerate(names)])).select("o", F.explode(documents.box_statistics(F.col("items"))).alias("b")).select("o", "b.*")


@query(f"WITH {_LI} SELECT o, n, CASE WHEN n % 3 > 0 THEN n::int END AS class_id, 1.0::double AS confidence, 'text ' || n AS text FROM li WHERE n <> 7")
def truth_annotations(spark, d):
    n = F.col("n")
    item = F.when(n != 7, F.struct(F.array(F.col("q")).alias("bbox"), F.concat(F.lit("text "), n.cast("string")).alias("text"), F.when(n % 3 > 0, n.cast("string")).otherwise("bar").alias("class_id"), F.lit("c").alias("class_name"), n.alias("n")))
    rows = _charts(spark, d, item).select("o", F.explode(F.zip_with(documents.annotations(F.col("items")), F.filter("items", lambda x: x.isNotNull()), lambda a, x: F.struct(x["n"].alias("n"), a.alias("a")))).alias("r"))
    return rows.select("o", "r.n", "r.a.class_id", "r.a.confidence", "r.a.text")


@query("""SELECT c_custkey, c_acctbal AS x_min, CASE WHEN c_custkey % 2 = 0 THEN 'log' ELSE 'linear' END AS x_scale, 'linear' AS y_scale, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE 'y' END AS primary_scale_axis FROM customer""")
def truth_axes(spark, d):
    k, none = F.col("c_custkey"), F.lit(None)
    info = F.struct(F.col("c_acctbal").alias("x_min"), none.cast("double").alias("x_max"), F.when(k % 2 == 0, "log").alias("x_scale"), none.cast("double").alias("y_min"), none.cast("double").alias("y_max"), none.cast("string").alias("y_scale"),
                    F.when(k % 5 == 0, "x").alias("primary_scale_axis"), none.cast("string").alias("secondary_scale_axis"))
    rows = t(spark, d, "customer").select("c_custkey", documents.axis_calibration(info).alias("a"))
    return rows.select("c_custkey", F.col("a.x_axis.min").alias("x_min"), F.col("a.x_axis.scale").alias("x_scale"), F.col("a.y_axis.scale").alias("y_scale"), "a.primary_scale_axis")


_KINDS = "['bar','histogram','line','scatter','box','area','pie','heatmap']"


@query(f"""WITH {_LI}, k AS (SELECT *, list_extract({_KINDS}, (o % 8 + 1)::int) AS kind FROM li)
           SELECT 'chart_' || o || '.png' AS source_file, 0 AS page_index, kind AS chart_type, CASE WHEN n % 2 = 0 THEN 'g' || n WHEN kind IN ('line', 'scatter', 'area') THEN 'Series' WHEN kind = 'pie' THEN 'Slice' WHEN kind = 'heatmap' THEN 'Row' WHEN kind = 'histogram' THEN 'Bin' ELSE 'Group' END AS "group",
                  CASE WHEN kind = 'heatmap' THEN 'c' || n WHEN o % 3 = 0 THEN 'Weight' ELSE 'Value' END AS outcome, CASE WHEN n = 3 THEN '' ELSE q::int::varchar END AS value, CASE WHEN o % 2 = 0 THEN 'kg' ELSE '' END AS unit,
                  CASE WHEN kind = 'box' THEN 'IQR' WHEN kind IN ('pie', 'heatmap', 'histogram') THEN '' ELSE 'SD' END AS error_bar_type FROM k""")
def synthetic_gold(spark, d):
    n, text = F.col("n"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    item = F.struct(F.when(n % 2 == 0, text("g", n)).alias("name"), text("c", n).alias("column"), F.when(n != 3, F.col("q").cast("int")).alias("value"))
    kinds = F.array(*[F.lit(k) for k in ("bar", "histogram", "line", "scatter", "box", "area", "pie", "heatmap")])
    charts = _charts(spark, d, item).withColumnRenamed("items", "elements").withColumns({
        "path": F.concat(text("/x/chart_", F.col("o")), F.lit("_detailed.json")), "chart_type": F.get(kinds, (F.col("o") % 8).cast("int")), "error_bar_type": F.lit(None).cast("string"),
        "unit": F.when(F.col("o") % 2 == 0, "kg"), "outcome_label": F.when(F.col("o") % 3 == 0, "Weight"), "y_label": F.lit(None).cast("string")})
    return documents.gold_rows(charts)


@query(f"""WITH {_LI} SELECT o, n, CASE WHEN n % 2 = 0 THEN 'bar ' || n WHEN n % 3 = 0 THEN 'tick' ELSE '' END AS label, coalesce(CASE WHEN n % 2 = 1 THEN q END, p) AS value, d AS confidence FROM li""")
def bar_tab(spark, d):
    n = F.col("n")
    rows = _lines(spark, d).select("o", "n", F.when(n % 2 == 0, F.concat(F.lit(" bar "), n.cast("string"))).otherwise(" ").alias("bar_label"), F.when(n % 3 == 0, "tick ").alias("tick_text"), F.when(n % 2 == 1, F.col("q")).alias("value"), F.col("p").alias("estimated_value"), F.col("d").alias("confidence"))
    return documents.tab_rows(rows, ["o", "n"], "bar", "n").select("o", "n", "label", "value", "confidence")


@query(f"""WITH {_LI} SELECT o, n, CASE WHEN n = 1 THEN 0 ELSE d END AS value, round(CASE WHEN n = 1 THEN 0 ELSE d END * 100, 4) AS percent, q AS angle, n <> 2 AS editable FROM li""")
def pie_tab(spark, d):
    rows = _lines(spark, d).select("o", "n", F.when(F.col("n") != 1, F.col("d")).alias("value"), F.col("q").alias("angle"), F.when(F.col("n") == 2, "pie_summary").otherwise("pie_slice").alias("type"))
    return r4(documents.tab_rows(rows, ["o", "n"], "pie", "n").select("o", "n", "value", "percent", "angle", (F.size("editable") > 0).alias("editable")), "percent")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'line' WHEN o_orderpriority = '5-LOW' THEN 'pie' ELSE 'bar' END AS kind,
                 CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS value, CASE WHEN o_orderpriority = '5-LOW' THEN 'Unsupported chart type: pie' END AS error FROM orders""")
def orchestrated(spark, d):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", " Line").when(F.col("o_orderpriority") == "5-LOW", "pie").otherwise("unknown")
    charts = t(spark, d, "orders").select("o_orderkey", kind.alias("kind"), "o_totalprice")
    handlers = {"line": lambda c: c.select("o_orderkey", "kind", (F.col("o_totalprice") * 2).alias("value")), "bar": lambda c: c.select("o_orderkey", "kind", F.col("o_totalprice").alias("value"))}
    return documents.dispatched(charts, "kind", handlers).select("o_orderkey", "kind", "value", "error")


@query(f"""WITH {_LI}, k AS (SELECT o, list_extract(['pie','bar','line','radar'], (n % 4 + 1)::int) AS kind FROM li), g AS (SELECT o, kind, count(*) AS detections FROM k WHERE kind <> 'radar' GROUP BY 1, 2)
           SELECT o, kind, detections, row_number() OVER (PARTITION BY o ORDER BY list_position({_KINDS}, kind))::int AS turn FROM g""")
def detected_types(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in ("pie", "bar", "line", "radar")]), (F.col("n") % 4).cast("int"))
    return documents.detected_types(_lines(spark, d).select("o", kind.alias("kind")), ["o"], "kind")


@query(f"""WITH {_LI}, r AS (SELECT o, CASE WHEN o % 3 > 0 THEN o % 10 / 20.0 END AS r2 FROM li GROUP BY 1), v AS (SELECT li.o, n, p AS value FROM li JOIN r USING (o) WHERE (r2 IS NULL OR r2 < 0.15) AND o % 2 = 0 AND n < 3)
           SELECT o, n, q AS value, 'standard' AS value_source FROM li WHERE o NOT IN (SELECT o FROM v) UNION ALL SELECT o, n, value, 'vlm_override' FROM v""")
def hybrid_strategy(spark, d):
    rows = _lines(spark, d)
    standard = rows.select("o", "n", F.col("q").alias("value"), F.when(F.col("o") % 3 > 0, F.col("o") % 10 / 20.0).alias("r2"))
    override = rows.where("o % 2 = 0 AND n < 3").select("o", "n", F.col("p").alias("value"))
    return documents.hybrid(standard, override, ["o"], "r2").select("o", "n", "value", "value_source")


@query("""WITH m AS (SELECT l_returnflag AS method, avg(l_discount) AS detection_f1, CASE WHEN l_returnflag = 'N' THEN 'Infinity'::double ELSE avg(l_quantity) END AS value_mae FROM lineitem GROUP BY 1)
          SELECT method, round(detection_f1, 6) AS detection_f1, CASE WHEN value_mae < 1e300 THEN round(value_mae, 6) END AS value_mae, row_number() OVER (ORDER BY value_mae, method) = 1 AS recommended FROM m""")
def compared_methods(spark, d):
    rows = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.avg("l_discount").alias("detection_f1"), F.avg("l_quantity").alias("value_mae"), F.avg("l_tax").alias("relaxed_accuracy"), F.avg("l_tax").alias("relative_error_pct"))
    got = documents.compared_methods(rows.withColumn("value_mae", F.when(F.col("method") != "N", F.col("value_mae"))))
    return got.select("method", F.round("detection_f1", 6).alias("detection_f1"), F.when(F.col("value_mae") < 1e300, F.round("value_mae", 6)).alias("value_mae"), "recommended")


@query("SELECT o_orderpriority, count(*) AS count, round(sum(o_totalprice), 2) AS total_time, round(avg(o_totalprice), 4) AS avg_time, round(avg(o_custkey), 4) AS avg_confidence FROM orders GROUP BY 1")
def type_statistics(spark, d):
    got = documents.type_statistics(t(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_custkey")
    return r4(got, "avg_time", "avg_confidence").withColumn("total_time", F.round("total_time", 2))


# --- clustering and fits of charts ----------------------------------------------------------------------

_PAIRS = f"""{_LI}, pr AS (SELECT a.o, a.n, b.n AS m, sqrt((a.q - b.q) ** 2 + (a.d * 400 - b.d * 400) ** 2) AS far FROM li a JOIN li b ON a.o = b.o AND a.n <> b.n),
             dn AS (SELECT o, 1 / (avg(far) + 1e-6) AS den FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY o, n ORDER BY far) <= 5) GROUP BY o, n),
             mn AS (SELECT o, avg(far) AS mean, stddev_pop(far) AS dev FROM pr GROUP BY 1), al AS (SELECT o, count(*) FILTER (near > 2 * mean) AS alone, count(*) AS n FROM (SELECT o, n, min(far) AS near FROM pr GROUP BY 1, 2) JOIN mn USING (o) GROUP BY 1),
             dv AS (SELECT o, stddev_pop(den) / (avg(den) + 1e-6) AS density FROM dn GROUP BY 1)"""


def _features(spark, d):
    return cluster.point_features(_lines(spark, d).withColumn("y", F.col("d") * 400), ["o"], "q", "y")


@query(f"""WITH {_PAIRS}, ex AS (SELECT o, (max(q) - min(q)) / (max(d * 400) - min(d * 400) + 1e-6) AS aspect FROM li GROUP BY 1)
           SELECT o, n::int AS n, round(mean, 4) AS mean_distance, round(dev, 4) AS std_distance, round(density, 5) AS density_variance, round(alone / n::double, 5) AS outlier_ratio, CASE WHEN aspect < 1000 THEN round(aspect, 4) END AS aspect_ratio FROM mn JOIN al USING (o) JOIN dv USING (o) JOIN ex USING (o)""")
def point_features(spark, d):
    got = _features(spark, d).withColumns({c: F.round(c, 5) for c in ("density_variance", "outlier_ratio")})
    return r4(got.withColumn("aspect_ratio", F.when(F.col("aspect_ratio") < 1000, F.col("aspect_ratio"))), "mean_distance", "std_distance", "aspect_ratio")


@query(f"""WITH {_PAIRS}, f AS (SELECT o, al.n, mean, round(density, 9) AS density, list_extract(['bar', 'box', 'line', 'scatter', 'pie'], (o % 5 + 1)::int) AS kind FROM mn JOIN al USING (o) JOIN dv USING (o))
           SELECT o, kind, CASE WHEN kind = 'box' THEN 'intersection_alignment' WHEN density > 0.5 OR kind IN ('line', 'scatter') THEN 'hdbscan' WHEN kind = 'bar' THEN 'dbscan' ELSE 'kmeans' END AS algorithm,
                  CASE WHEN kind = 'bar' AND density <= 0.5 THEN 24.0 END::double AS eps, CASE WHEN kind = 'box' THEN NULL WHEN density > 0.5 THEN CASE WHEN kind = 'scatter' THEN 3 ELSE 2 END WHEN kind IN ('line', 'scatter') THEN 3 WHEN kind = 'bar' THEN 2 END::int AS min_size,
                  CASE WHEN kind = 'box' THEN 0.95 WHEN density > 0.5 THEN 0.85 WHEN kind IN ('line', 'scatter') THEN 0.8 WHEN kind = 'bar' THEN 0.9 ELSE 0.75 END::double AS confidence FROM f""")
def clustering_choice(spark, d):
    kind = F.get(F.array(*[F.lit(k) for k in ("bar", "box", "line", "scatter", "pie")]), (F.col("o") % 5).cast("int"))
    rows = _features(spark, d).withColumn("density_variance", F.round("density_variance", 9)).withColumn("kind", kind)
    return cluster.recommendation(rows, "kind", F.lit(600.0)).select("o", "kind", "algorithm", "eps", "min_size", "confidence")


@query()
def kmeans_by_chart(spark, d):
    rows = _lines(spark, d).where("o % 20 < 10").select(F.floor(F.col("o") / 20).alias("chart"), (F.col("o") * 8 + F.col("n")).alias("k0"), "q", (F.col("d") * 400).alias("y"))
    return cluster.chosen_clusters(rows, "chart", "k0", "q", "y")


@query()
def refined_fits(spark, d):
    rows = _lines(spark, d).select("o", "q", (F.col("p") / 1000).alias("y"), (1 - F.col("d")).alias("w"))
    return fits.refined_fit(rows, ["o"], "q", "y", "w", 3.0)


@query(f"""WITH {_LI}, s AS (SELECT o, n, d * 2500 AS r, x * 3000 AS g FROM li), t AS (SELECT o, n, r, g, least(greatest(r / 100, 0), 1) AS a, least(greatest(g / 200, 0), 1) AS b FROM s),
                k AS (SELECT *, (r - 100 * a) ** 2 + g ** 2 AS da, (r - 100) ** 2 + (g - 200 * b) ** 2 AS db FROM t)
           SELECT o, n, round(CASE WHEN round(da, 9) <= round(db, 9) THEN 10 + a * 20 ELSE 30 + b * 70 END, 4) AS value, round(exp(-least(da, db) / 450), 6) AS confidence FROM k""")
def color_curve_values(spark, d):
    point = lambda r, g, v: F.struct(F.array(F.lit(r), F.lit(g)).alias("color"), F.lit(v).alias("value"))
    curve = F.array(point(0.0, 0.0, 10.0), point(100.0, 0.0, 30.0), point(100.0, 200.0, 100.0))
    rows = _lines(spark, d).select("o", "n", values.curve_value(curve, F.array(F.col("d") * 2500, F.col("x") * 3000)).alias("v"))
    return rows.select("o", "n", F.round("v.value", 4).alias("value"), F.round("v.confidence", 6).alias("confidence"))
