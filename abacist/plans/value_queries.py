"""The value operators on the driver's tables, with their DuckDB counterparts. A chart is an order, its elements are the order's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.operators import extract, fits, values
from abacist.plans.queries import query, r4, t

_FIT = "f AS (SELECT l_orderkey, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND var_pop(l_quantity) > 1e-12)"


def _fits(spark, d):
    return fits.line_fit(t(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice").withColumn("scale", F.lit("linear")).drop("n")


@query("""SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity + (1 + l_linenumber % 3) / 2, l_quantity, l_extendedprice) - 1)::int AS bin_index,
                 l_quantity AS low, l_quantity + 1 + l_linenumber % 3 AS high, (1 + l_linenumber % 3)::double AS width, l_extendedprice AS value FROM lineitem""")
def histogram_bins(spark, d):
    wide = F.col("l_quantity") + 1 + F.col("l_linenumber") % 3
    got = values.histogram_bins(t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity"), wide, "l_extendedprice")
    return got.select("l_orderkey", "bin_index", "low", "high", "width", "value")


@query(f"""WITH {_FIT} SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey) - 1)::int AS index,
                  round(CASE WHEN m IS NOT NULL AND l_orderkey % 5 > 0 THEN abs((m * 20 + c) - (m * l_quantity + c)) WHEN l_orderkey % 5 > 0 THEN abs(20 - l_quantity) ELSE 0 END + 0.0003, 3) AS value FROM lineitem LEFT JOIN f USING (l_orderkey)""")
def line_values(spark, d):
    base = F.when(F.col("l_orderkey") % 5 > 0, 20.0)
    got = values.height_values(t(spark, d, "lineitem"), _fits(spark, d), ["l_orderkey"], F.col("l_quantity"), base)
    got = values.indexed(got.withColumn("tie", F.struct("l_linenumber", "l_partkey")), ["l_orderkey"], F.col("l_discount"), "tie")
    return got.select("l_orderkey", "l_linenumber", "index", F.round(F.col("value") + 0.0003, 3).alias("value"))  # off the halves


@query(f"""WITH {_FIT}, p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 1000 AS x, CASE WHEN m IS NOT NULL THEN abs((m * 20 + c) - (m * l_quantity + c)) ELSE abs(20 - l_quantity) END AS v, m * 20 + c AS b FROM lineitem LEFT JOIN f USING (l_orderkey)),
                a AS (SELECT l_orderkey, b, (x - lag(x) OVER w) * (v + lag(v) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY x, l_linenumber, l_partkey))
           SELECT l_orderkey, count(*) AS num_points, round(any_value(b) + 0.0003, 2) AS baseline_value, CASE WHEN any_value(b) IS NOT NULL THEN round(sum(a) + 0.003, 0) END AS total_auc FROM a GROUP BY 1""")
def area_summary(spark, d):
    got = values.height_values(t(spark, d, "lineitem"), _fits(spark, d), ["l_orderkey"], F.col("l_quantity"), F.lit(20.0))
    # by quantity where the SQL leaves the order open; sums whose last bits depend on the rows' order are first rounded past those, so that halves go up
    got = values.area_summary(got.withColumn("tie", F.struct("l_linenumber", "l_partkey", "l_quantity")), ["l_orderkey"], F.col("l_discount") * 1000, "tie", F.lit(20.0))
    base, area = F.round("baseline_value", 9) + 0.0003, F.round("total_auc", 7) + 0.003
    return got.select("l_orderkey", "num_points", F.round(base, 2).alias("baseline_value"), F.round(area, 0).alias("total_auc"))


_BOX = """bx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity AS q1, l_quantity + 1 + l_linenumber * 2 AS q3, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity + 0.5 + l_tax * 10 END AS median,
                  CASE WHEN l_returnflag = 'A' THEN l_quantity - l_discount * 50 END AS wl, CASE WHEN l_returnflag = 'A' THEN l_quantity + 1 + l_linenumber * 2 + l_tax * 40 END AS wh, 0.3 + l_discount * 6 AS conf,
                  CASE WHEN l_linestatus = 'F' THEN [l_quantity - 2, l_quantity + 0.5, l_quantity + 60.0] ELSE [] END AS outliers FROM lineitem)"""


def _boxes(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    flagged = F.col("l_returnflag") == "A"
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", q.alias("q1"), (q + 1 + n * 2).alias("q3"), F.when(n % 3 > 0, q + 0.5 + F.col("l_tax") * 10).alias("median"),
        F.when(flagged, q - F.col("l_discount") * 50).alias("whisker_low"), F.when(flagged, q + 1 + n * 2 + F.col("l_tax") * 40).alias("whisker_high"),
        (0.3 + F.col("l_discount") * 6).alias("whisker_confidence"), F.when(F.col("l_linestatus") == "F", F.array(q - 2, q + 0.5, F.lit(60.0) + q)).otherwise(F.array().cast("array<double>")).alias("outliers"),
    )


@query(f"""WITH {_BOX} SELECT l_orderkey, l_linenumber, round(CASE WHEN a >= q1 AND b <= q3 THEN q1 - 1.5 * (q3 - q1) ELSE least(a, q1) END, 4) AS whisker_low,
                  round(CASE WHEN a >= q1 AND b <= q3 THEN q3 + 1.5 * (q3 - q1) ELSE greatest(b, q3) END, 4) AS whisker_high, CASE WHEN a >= q1 AND b <= q3 THEN 'iqr_fallback' ELSE 'indicator' END AS method
           FROM (SELECT *, least(q1 + conf * 10 - 6, q3 - conf * 9 + 4) AS a, greatest(q1 + conf * 10 - 6, q3 - conf * 9 + 4) AS b FROM bx)""")
def indicator_whiskers(spark, d):
    one, other = F.col("q1") + F.col("whisker_confidence") * 10 - 6, F.col("q3") - F.col("whisker_confidence") * 9 + 4
    rows = _boxes(spark, d).select("l_orderkey", "l_linenumber", values.whiskers_of_indicator(one, other, F.col("q1"), F.col("q3")).alias("w"))
    return r4(rows.select("l_orderkey", "l_linenumber", "w.*"), "whisker_low", "whisker_high")


@query(f"""WITH {_BOX}, r AS (SELECT l_orderkey, median((median - q1) / (q3 - q1)) AS place FROM bx GROUP BY 1)
           SELECT l_orderkey, l_linenumber, round(coalesce(median, q1 + place * (q3 - q1), (q1 + q3) / 2), 4) AS median,
                  CASE WHEN median IS NOT NULL THEN 'detected_line' WHEN place IS NOT NULL THEN 'neighbor_based' ELSE 'geometric_center' END AS median_method,
                  CASE WHEN median IS NOT NULL THEN 1.0 WHEN place IS NOT NULL THEN 0.7 ELSE 0.3 END::double AS median_confidence FROM bx JOIN r USING (l_orderkey)""")
def neighbour_medians(spark, d):
    got = values.median_by_neighbours(_boxes(spark, d), ["l_orderkey"], "l_linenumber")
    return r4(got.select("l_orderkey", "l_linenumber", "median", "median_method", "median_confidence"), "median")


@query(f"""WITH {_BOX}, n AS (SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_extendedprice, sum(b.conf) AS w, sum(b.conf * (b.q1 - b.wl) / (b.q3 - b.q1)) AS l, sum(b.conf * (b.wh - b.q3) / (b.q3 - b.q1)) AS h
                FROM bx a JOIN bx b ON a.l_orderkey = b.l_orderkey AND (a.l_linenumber, a.l_partkey, a.l_extendedprice) <> (b.l_linenumber, b.l_partkey, b.l_extendedprice) AND b.wl IS NOT NULL AND b.conf >= 0.5 GROUP BY 1, 2, 3, 4)
           SELECT l_orderkey, l_linenumber, round(CASE WHEN len(outliers) > 0 THEN greatest(q1 - 1.5 * (q3 - q1), list_max(list_filter(outliers, lambda o: o < q1))) WHEN w > 0 THEN q1 - l / w * (q3 - q1) ELSE q1 - 1.5 * (q3 - q1) END + 0.000023, 4) AS low,
                  round(CASE WHEN len(outliers) > 0 THEN least(q3 + 1.5 * (q3 - q1), list_min(list_filter(outliers, lambda o: o > q3))) WHEN w > 0 THEN q3 + h / w * (q3 - q1) ELSE q3 + 1.5 * (q3 - q1) END + 0.000023, 4) AS high,
                  CASE WHEN len(outliers) > 0 THEN 'outliers' WHEN w > 0 THEN 'neighbors' ELSE 'iqr' END AS method FROM bx LEFT JOIN n USING (l_orderkey, l_linenumber, l_partkey, l_extendedprice)""")
def estimated_whiskers(spark, d):
    got = values.estimated_whiskers(_boxes(spark, d), ["l_orderkey"])
    return got.select("l_orderkey", "l_linenumber", *[F.round(F.col(c) + 0.000023, 4).alias(c) for c in ("low", "high")], "method")


@query("""SELECT user_id, event_id, round(CASE WHEN count(*) OVER w >= 2 THEN greatest(0.3, least(0.6, avg(value / 100) OVER w - stddev_pop(value / 100) OVER w)) ELSE 0.3 END, 4) AS threshold
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_threshold(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100).alias("conf"))
    return r4(values.running_threshold(rows, ["user_id"], "event_id", "conf", 0.3), "threshold").drop("conf")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_quantity + 10, CASE WHEN l_linenumber % 4 > 0 THEN l_discount * 500 END, l_quantity + 20 - l_tax * 30, l_quantity + 18] AS v FROM lineitem),
               s AS (SELECT *, len(list_filter(v, lambda x: x IS NULL)) > 0 AS missing, list_sort(v) AS o FROM n),
               m AS (SELECT *, list_max(list_transform(list_zip(v, o), lambda p: abs(p[1] - p[2]))) AS moved, list_max(v) - list_min(v) AS span FROM s)
          SELECT l_orderkey, l_linenumber, round(CASE WHEN missing THEN v[2] ELSE o[2] END, 4) AS q1, round(CASE WHEN missing THEN v[4] ELSE o[4] END, 4) AS q3,
                 NOT missing AND moved > 0 AS corrected, NOT missing AND moved > 0.1 * span AS severe FROM m""")
def five_numbers_checked(spark, d):
    q = F.col("l_quantity")
    numbers = F.array(q, q + 10, F.when(F.col("l_linenumber") % 4 > 0, F.col("l_discount") * 500), q + 20 - F.col("l_tax") * 30, q + 18)
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.five_checked(numbers).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("c.numbers")[1], 4).alias("q1"), F.round(F.col("c.numbers")[3], 4).alias("q3"), "c.corrected", "c.severe")


@query(f"""WITH {_BOX}, k AS (SELECT *, q1 - 1 + conf AS lo, q3 + conf - 1 AS hi, q1 + conf * 12 - 6 AS mid FROM bx),
               w AS (SELECT *, least(lo, q1) AS nl, greatest(hi, q3) AS nh FROM k), o AS (SELECT *, list_filter(outliers, lambda x: x < nl OR x > nh) AS outside FROM w)
           SELECT l_orderkey, l_linenumber, round(nl, 4) AS whisker_low, round(least(greatest(mid, q1), q3), 4) AS median, round(nh, 4) AS whisker_high,
                  2 * (len(outliers) - len(outside)) > len(outliers) AS suspect, CASE WHEN 2 * (len(outliers) - len(outside)) > len(outliers) THEN len(outliers) ELSE len(outside) END::int AS n_outliers FROM o""")
def boxes_checked(spark, d):
    rows, c = _boxes(spark, d), F.col("whisker_confidence")
    checked = extract.box_checked(F.col("q1") - 1 + c, F.col("q1"), F.col("q1") + c * 12 - 6, F.col("q3"), F.col("q3") + c - 1, F.col("outliers"))
    got = rows.select("l_orderkey", "l_linenumber", checked.alias("b")).select("l_orderkey", "l_linenumber", "b.whisker_low", "b.median", "b.whisker_high", "b.suspect", F.size("b.outliers").alias("n_outliers"))
    return r4(got, "whisker_low", "median", "whisker_high")


_ANGLES = "an AS (SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 9) AS a FROM (SELECT *, degrees(atan2(l_discount * 1000 - 51, l_quantity - 25.3)) AS d FROM lineitem))"


def _angles(spark, d):
    angle = values.mid_angle(F.col("l_quantity"), F.col("l_discount") * 1000, F.lit(25.3), F.lit(51))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("tie"), F.round(angle, 9).alias("a"))


@query(f"""WITH {_ANGLES}, n AS (SELECT *, a - coalesce(lag(a) OVER w, last(a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b,
                      coalesce(lead(a) OVER w, first(a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - a AS f FROM an WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, l_linenumber, l_partkey))
           SELECT l_orderkey, l_linenumber, round(a, 4) AS angle, round((CASE WHEN b < 0 THEN b + 360 ELSE b END + CASE WHEN f <= 0 THEN f + 360 ELSE f END) / 2, 4) AS span FROM n""")
def pie_neighbour_spans(spark, d):
    got = values.neighbour_spans(_angles(spark, d), ["l_orderkey"], "a", "tie")
    return got.select("l_orderkey", "l_linenumber", F.round("a", 4).alias("angle"), F.round("span", 4).alias("span"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, unnest([(l_quantity, l_discount * 900), (l_tax * 500, l_quantity), (CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 44 END, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity / 2 END), (5 + l_linenumber, 60)]) AS p FROM lineitem),
               a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END AS a FROM (SELECT *, atan2(p[2] - 30, p[1] - 25) AS t FROM k WHERE NOT (p[1] <= 0 AND p[2] <= 0))),
               g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, count(*) OVER e AS n, coalesce(lead(a) OVER (e ORDER BY a), min(a) OVER e + 2 * pi()) - a AS gap FROM a WINDOW e AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
               s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, max(gap) AS gap, max(n) AS n FROM g GROUP BY 1, 2, 3, 4)
          SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n >= 2 THEN round(least(greatest(2 * pi() - gap, 0), 2 * pi()), 5) END AS span FROM s""")
def keypoint_spans(spark, d):
    n = F.col("l_linenumber")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(
        point(F.lit(0), F.lit(0)), point(F.col("l_quantity"), F.col("l_discount") * 900), point(F.col("l_tax") * 500, F.col("l_quantity")),
        point(F.when(n % 3 == 0, -1).otherwise(44), F.when(n % 3 == 0, 0).otherwise(F.col("l_quantity") / 2)), point(5 + n, F.lit(60)),
    )
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(values.keypoint_span(points, F.lit(25.0), F.lit(30.0)), 5).alias("span"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER e AS g, CASE WHEN l_orderkey % 3 > 0 AND (l_linenumber % 2 = 0 OR l_orderkey % 4 = 0) AND l_discount > 0 THEN l_discount * CASE WHEN l_orderkey % 5 = 0 THEN 9 ELSE 1 END END AS l,
                            count(*) OVER e AS n FROM lineitem WINDOW e AS (PARTITION BY l_orderkey)),
               s AS (SELECT *, count(l) OVER e AS k, round(sum(l) OVER e, 9) AS sl, sum(g) FILTER (l IS NULL) OVER e AS u FROM g WINDOW e AS (PARTITION BY l_orderkey))
          SELECT l_orderkey, l_linenumber, round(CASE WHEN k = 0 THEN g WHEN sl <= 1 THEN coalesce(l, (1 - sl) * g / u) WHEN k = n THEN l / sl ELSE g END + 0.0000003, 6) AS value,
                 CASE WHEN k = 0 THEN 'geometric' WHEN sl <= 1 THEN CASE WHEN l IS NOT NULL THEN 'data_label' ELSE 'geometric_residual' END WHEN k = n THEN 'data_label_normalized' ELSE 'geometric' END AS source FROM s""")
def pie_values(spark, d):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    shown = (o % 3 > 0) & ((n % 2 == 0) | (o % 4 == 0))
    rows = t(spark, d, "lineitem").withColumn("label", F.when(shown, F.col("l_discount") * F.when(o % 5 == 0, 9).otherwise(1)))
    got = values.pie_values(rows, ["l_orderkey"], "l_quantity", "label")
    return got.select("l_orderkey", "l_linenumber", F.round(F.col("value") + 0.0000003, 6).alias("value"), "source")


_RUNS = """SELECT l_suppkey, avg(x) AS c FROM (SELECT l_suppkey, x, sum(o) OVER (PARTITION BY l_suppkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS r FROM
             (SELECT l_suppkey, x, coalesce((x - lag(x) OVER (PARTITION BY l_suppkey ORDER BY x) > {gap})::int, 0) AS o FROM {rows})) GROUP BY l_suppkey, r"""
_GRID = f"""ce AS (SELECT l_suppkey, l_quantity * 7 + l_discount * 40 AS x, l_orderkey, l_linenumber FROM lineitem), co AS ({_RUNS.format(gap="7.5", rows="ce")}),
            st AS (SELECT l_suppkey, median(d) AS s FROM (SELECT l_suppkey, c - lag(c) OVER (PARTITION BY l_suppkey ORDER BY c) AS d FROM co) GROUP BY 1),
            cs AS (SELECT ce.*, coalesce(0.5 * s, 7.5) AS gap FROM ce JOIN st USING (l_suppkey)), li AS (SELECT l_suppkey, c, (row_number() OVER (PARTITION BY l_suppkey ORDER BY c) - 1)::int AS line FROM ({_RUNS.format(gap="gap", rows="cs")}))"""


def _cells(spark, d):
    return t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity") * 7 + F.col("l_discount") * 40).alias("x"))


@query(f"WITH {_GRID} SELECT l_suppkey, line, round(c, 4) AS center FROM li")
def heatmap_lines(spark, d):
    return r4(values.grid_lines(_cells(spark, d), ["l_suppkey"], "x", 500.0), "center")


@query(f"""WITH {_GRID} SELECT ce.l_orderkey, ce.l_linenumber, round(ce.x, 4) AS x, arg_min(line, (round(abs(c - ce.x), 9), line)) AS col FROM ce JOIN li USING (l_suppkey) GROUP BY ce.l_orderkey, ce.l_linenumber, ce.l_suppkey, ce.x""")
def heatmap_cells(spark, d):
    cells = _cells(spark, d)
    lines = values.grid_lines(cells, ["l_suppkey"], "x", 500.0)
    got = values.nearest_line(cells.dropDuplicates(["l_orderkey", "l_linenumber", "l_suppkey", "x"]), lines, ["l_suppkey"], "x", "col")
    return got.select("l_orderkey", "l_linenumber", F.round("x", 4).alias("x"), "col")


@query("""SELECT l_suppkey, round(quantile_cont(l_quantity, 0.05), 4) AS "left", round(quantile_cont(l_tax, 0.05), 4) AS top, round(quantile_cont(l_quantity + 5, 0.95), 4) AS "right",
                 round(quantile_cont(l_tax + l_discount, 0.95), 4) AS bottom FROM lineitem GROUP BY 1""")
def heatmap_bounds(spark, d):
    cells = t(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x1"), F.col("l_tax").alias("y1"), (F.col("l_quantity") + 5).alias("x2"), (F.col("l_tax") + F.col("l_discount")).alias("y2"))
    return r4(values.robust_bounds(cells, ["l_suppkey"]), "left", "top", "right", "bottom")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_tax * 12.5 AS pos, CASE l_linenumber % 4 WHEN 0 THEN [] WHEN 1 THEN [(0.5, 7.0)] ELSE [(0.2, 10.0), (0.4, 30.0), (0.9, 20.0)] END AS p FROM lineitem)
          SELECT l_orderkey, l_linenumber, round(CASE WHEN len(p) = 0 THEN 5 + pos * 20 WHEN len(p) = 1 THEN 7 WHEN pos <= 0.4 THEN 10 + (pos - 0.2) * 100 ELSE 30 - (pos - 0.4) * 20 END, 4) AS value FROM a""")
def color_bar_values(spark, d):
    anchor = lambda p, v: F.struct(F.lit(p).alias("position"), F.lit(v).alias("value"))
    k = F.col("l_linenumber") % 4
    none = F.array().cast("array<struct<position:double,value:double>>")
    anchors = F.when(k == 0, none).when(k == 1, F.array(anchor(0.5, 7.0))).otherwise(F.array(anchor(0.2, 10.0), anchor(0.4, 30.0), anchor(0.9, 20.0)))
    value = extract.color_value(anchors, F.col("l_tax") * 12.5, F.lit(5.0), F.lit(25.0))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 4).alias("value"))


@query("""WITH l AS (SELECT l_orderkey // 2 AS axis, l_quantity + l_linenumber / 100 AS x, CASE WHEN l_orderkey % 16 < 2 AND l_linenumber = 1 THEN 0 ELSE l_linenumber * 10 - (l_orderkey // 2) % 60 END AS v FROM lineitem),
               g AS (SELECT axis, count(*) AS n, avg(x) FILTER (v = 0) AS z, covar_pop(x, v) / nullif(var_pop(x), 0) AS m, avg(x) AS mx, avg(v) AS mv FROM l GROUP BY 1)
          SELECT axis, round(coalesce(z, CASE WHEN n >= 2 AND abs(m) >= 1e-6 THEN mx - mv / m END) + 0.00023, 3) AS zero_at, CASE WHEN z IS NOT NULL THEN 'zero_labels' WHEN n >= 2 THEN 'fit' END AS method FROM g WHERE z IS NOT NULL OR (n >= 2 AND abs(m) >= 1e-6)""")
def zero_line(spark, d):
    o = F.floor(F.col("l_orderkey") / 2)
    zero = (F.col("l_orderkey") % 16 < 2) & (F.col("l_linenumber") == 1)
    rows = t(spark, d, "lineitem").select(o.alias("axis"), (F.col("l_quantity") + F.col("l_linenumber") / 100).alias("x"), F.when(zero, 0).otherwise(F.col("l_linenumber") * 10 - o % 60).alias("v"))
    got = values.zero_line(rows, ["axis"], "x", "v").where("method IN ('zero_labels', 'fit')")
    return got.select("axis", F.round(F.col("zero_at") + 0.00023, 3).alias("zero_at"), "method")


@query("""WITH b AS (SELECT l_orderkey, l_quantity * 2 AS x, l_tax * 1200 AS y FROM lineitem)
          SELECT l_orderkey, round(coalesce(median(y) FILTER (y >= 75), median(y) FILTER (y <= 25)), 4) AS x_axis_at, round(coalesce(median(x) FILTER (x <= 25), median(x) FILTER (x >= 75)), 4) AS y_axis_at FROM b GROUP BY 1""")
def scatter_baselines(spark, d):
    return r4(values.edge_baseline(t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") * 2, F.col("l_tax") * 1200, 100.0, 100.0), "x_axis_at", "y_axis_at")


@query("""WITH p AS (SELECT l_suppkey, l_quantity AS x, least(greatest((l_quantity - 5) / 40, 0), 1) AS p, median(l_quantity) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)
          SELECT l_suppkey, round(avg(exp(-p / 0.08)), 6) AS low_score, round(avg(exp(-(1 - p) / 0.08)), 6) AS high_score, round(1 - abs(count(*) FILTER (x < m) - count(*) FILTER (x >= m)) / count(*)::double, 6) AS balance FROM p GROUP BY 1""")
def edge_scores(spark, d):
    got = values.edge_scores(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 5.0, 45.0)
    return got.withColumns({c: F.round(c, 6) for c in ("low_score", "high_score", "balance")})


@query("""WITH f AS (SELECT l_suppkey % 50 AS chart, l_suppkey, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1, 2)
          SELECT chart, round(min(r2), 6) AS worst_r2, count(*) FILTER (r2 < 0.85) AS warnings, CASE WHEN min(r2) IS NULL OR min(r2) < 0.4 THEN 'uncalibrated' WHEN min(r2) < 0.85 THEN 'approximate' ELSE 'high' END AS calibration_quality FROM f GROUP BY 1""")
def calibration_gate(spark, d):
    li = t(spark, d, "lineitem").where("l_suppkey % 7 > 0")
    axes = fits.line_fit(li, ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("chart", F.col("l_suppkey") % 50)
    return values.calibration_gate(axes, ["chart"], "r2").withColumn("worst_r2", F.round("worst_r2", 6))


@query("""WITH q(family, bin, lo, hi, q) AS (VALUES ('box.median', 0, -1e308, 10.0, 1.5), ('box.median', 1, 10.0, 1e308, 2.5), ('box.q1', 0, -1e308, 20.0, 0.5))
          SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN round(l_quantity - CASE WHEN l_quantity < 10 THEN 1.5 ELSE 2.5 END, 4) END AS median_low,
                 round(l_quantity - 3 - 0.5, 4) AS q1_low, round(l_quantity - 3 + 0.5, 4) AS q1_high, NULL::double AS q3_low FROM lineitem""")
def box_intervals(spark, d):
    inf = float("inf")
    table = spark.createDataFrame([("box.median", 0, -inf, 10.0, 1.5), ("box.median", 1, 10.0, inf, 2.5), ("box.q1", 0, -inf, 20.0, 0.5)], "family string, bin int, lo double, hi double, q_alpha double")
    q = F.col("l_quantity")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 > 0, q).alias("median"), (q - 3).alias("q1"), (q + 3).alias("q3"))
    got = values.with_intervals(rows, "box", table, False, 1.0)
    of = lambda k, side: F.round(F.try_element_at("uncertainty", F.lit(k))[side], 4)
    return got.select("l_orderkey", "l_linenumber", of("median", "low").alias("median_low"), of("q1", "low").alias("q1_low"), of("q1", "high").alias("q1_high"), of("q3", "low").alias("q3_low"))
