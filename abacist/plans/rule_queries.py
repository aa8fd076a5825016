"""Scalar rules on the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions import geometry as G
from abacist.functions import scalars as S
from abacist.functions import text as X
from abacist.operators import assign, associate, axis, evaluate, extract, fits, protocol, routing
from abacist.plans.link_queries import _LI, _lines
from abacist.plans.queries import query, r4, t


@query(f"WITH {_LI} SELECT o, n, CASE n % 5 WHEN 0 THEN round(q / 100, 6) WHEN 1 THEN round(-q / 100, 6) WHEN 2 THEN d WHEN 3 THEN CASE WHEN q * 4 <= 1 THEN q * 4 WHEN q * 4 <= 100 THEN q * 4 / 100 END END AS share FROM li")
def pie_label_shares(spark, d):
    n, whole = F.col("n"), F.col("q").cast("int").cast("string")
    text = F.when(n % 5 == 0, F.concat(F.lit(" "), whole, F.lit(" %"))).when(n % 5 == 1, F.concat(F.lit("–"), whole, F.lit("%"))).when(n % 5 == 2, F.col("d").cast("string")).when(n % 5 == 3, (F.col("q") * 4).cast("int").cast("string")).otherwise("n = 4")
    return _lines(spark, d).select("o", "n", F.round(X.pie_share(text), 6).alias("share"))


@query(f"WITH {_LI} SELECT o, n, CASE WHEN n % 2 = 0 THEN '1 ' || (q::int) || '0 x' ELSE 'Oil only' END AS cleaned FROM li")
def ocr_cleaning(spark, d):
    digits = F.concat(F.lit("​l  "), F.col("q").cast("int").cast("string"), F.lit("O \n x "))
    return _lines(spark, d).select("o", "n", X.cleaned(F.when(F.col("n") % 2 == 0, digits).otherwise(" Oil   only")).alias("cleaned"))


@query(f"""WITH {_LI}, v AS (SELECT o, count(*) FILTER (n % 3 > 0) > count(*) FILTER (n % 3 = 0) AS comma FROM li GROUP BY 1)
           SELECT o, n, CASE WHEN n % 3 > 0 THEN CASE WHEN comma THEN q + 0.5 ELSE q * 10 + 5 END ELSE CASE WHEN comma THEN q * 10 + 5 ELSE q + 0.5 END END AS number FROM li JOIN v USING (o)""")
def number_formats(spark, d):
    whole = F.col("q").cast("int").cast("string")
    rows = _lines(spark, d).select("o", "n", F.concat(whole, F.when(F.col("n") % 3 > 0, ",").otherwise("."), F.lit("5")).alias("text"))
    votes = rows.groupBy("o").agg(X.comma_decimals(F.col("text")).alias("comma"))
    return rows.join(votes, "o").select("o", "n", X.robust_number(F.col("text"), F.col("comma")).alias("number"))


@query(f"WITH {_LI} SELECT o, n, q BETWEEN 10 - 0.2 * (5 + n * 4) AND 15 + n * 4 + 0.2 * (5 + n * 4) AS inside FROM li")
def label_ranges(spark, d):
    return _lines(spark, d).select("o", "n", X.in_label_range(F.col("q"), F.lit(10), 15 + F.col("n") * 4).alias("inside"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'chart.v' || c_custkey WHEN 1 THEN c_custkey::varchar ELSE 'plain' END AS sample FROM customer")
def sample_ids(spark, d):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    image = F.when(k % 3 == 0, F.concat(F.lit("/data/x/chart.v"), text, F.lit(".png")))
    return t(spark, d, "customer").select("c_custkey", X.sample_id(F.when(k % 3 == 1, text).otherwise(" "), image, F.lit("plain")).alias("sample"))


@query(f"""WITH {_LI}, a AS (SELECT o, n, abs(degrees(atan2(d * 100 - 5, q - 25))) AS a FROM li)
           SELECT o, n, CASE WHEN a <= 5 OR a >= 175 THEN 'horizontal' WHEN abs(a - 90) <= 5 THEN 'vertical' ELSE 'diagonal' END AS direction FROM a""")
def line_directions(spark, d):
    box = G.Box(F.lit(25.0), F.lit(5.0), F.col("q"), F.col("d") * 100)
    return _lines(spark, d).select("o", "n", G.line_direction(box).alias("direction"))


@query(f"""WITH {_LI} SELECT o, n, a.o IS NOT NULL AS touches FROM li LEFT JOIN (SELECT DISTINCT a.o, a.n FROM li a JOIN li b ON a.o = b.o AND a.n <> b.n AND a.q <= b.q + 4 AND b.q <= a.q + 4 AND a.d * 100 <= b.d * 100 + 2 AND b.d * 100 <= a.d * 100 + 2) a USING (o, n)""")
def touching_boxes(spark, d):
    side = lambda p: _lines(spark, d).select("o", F.col("n").alias(f"{p}n"), F.col("q").alias(f"{p}x1"), (F.col("d") * 100).alias(f"{p}y1"), (F.col("q") + 4).alias(f"{p}x2"), (F.col("d") * 100 + 2).alias(f"{p}y2"))
    pairs = side("a_").join(side("b_"), "o").where("a_n <> b_n")
    found = pairs.where(G.intersects(G.box("a_"), G.box("b_"))).select("o", F.col("a_n").alias("n")).distinct().withColumn("touches", F.lit(True))
    return _lines(spark, d).select("o", "n").join(found, ["o", "n"], "left").withColumn("touches", F.coalesce("touches", F.lit(False)))


@query(f"""WITH {_LI} SELECT o, n, round(CASE n % 3 WHEN 0 THEN d * 3 + 1 WHEN 1 THEN exp(d * 3 + 1) ELSE pow(10, d * 3 + 1) END, 6) AS value FROM li""")
def scale_application(spark, d):
    scale = F.when(F.col("n") % 3 == 0, "linear").when(F.col("n") % 3 == 1, "ln").otherwise("log10")
    return _lines(spark, d).select("o", "n", F.round(S.scaled(scale, F.lit(3.0), F.lit(1.0), F.col("d")), 6).alias("value"))


@query(f"""WITH {_LI} SELECT o, n, CASE n % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'pie' WHEN 2 THEN 'bar' ELSE 'heatmap' END AS chart_type, CASE n % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'slice' WHEN 2 THEN 'bar' ELSE 'cell' END AS element,
                  CASE n % 4 WHEN 0 THEN 'vertical' WHEN 1 THEN 'horizontal' WHEN 2 THEN 'not_applicable' ELSE 'horizontal' END AS orientation, 0.4::double AS least FROM li""")
def chart_vocabulary(spark, d):
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("n") % 4).cast("int"))
    kind = S.chart_type(pick("chart", " Pie", None, "HEATMAP"))
    return _lines(spark, d).select("o", "n", kind.alias("chart_type"), S.element_key(kind).alias("element"), S.orientation(pick("V", "0", "n/a", "false")).alias("orientation"), S.least_confidence(kind).alias("least"))


@query(f"""WITH {_LI} SELECT o, max(q) - min(q) > 0.6 * 50 AS has_dual, (max(q) + min(q)) / 2 AS threshold FROM li GROUP BY 1""")
def second_axes(spark, d):
    return axis.second_axis(_lines(spark, d), ["o"], "q", 50.0)


@query(f"""WITH {_LI}, p AS (SELECT o, n, d * 100 AS v FROM li), a AS (SELECT *, abs(v - median(v) OVER (PARTITION BY o)) AS away FROM p), b AS (SELECT *, median(away) OVER (PARTITION BY o) AS mad FROM a)
           SELECT o, round(avg(v), 6) AS center, count(*) AS kept FROM b WHERE mad = 0 OR away <= 3 * mad GROUP BY 1""")
def trimmed_centers(spark, d):
    rows = _lines(spark, d).select("o", (F.col("d") * 100).alias("v"))
    return axis.trimmed_center(rows, ["o"], "v", rounds=1).withColumn("center", F.round("center", 6))


@query(f"""WITH {_LI}, f AS (SELECT o // 10 AS g, regr_slope(y, q) AS mx, regr_intercept(y, q) AS cx FROM (SELECT o, q, q * 2 + n AS y FROM li) GROUP BY 1)
           SELECT o, n, round(mx * (q + 2) + cx, 4) AS x, round(pow(10, 0.01 * (d * 100 + 1) + 0.5), 4) AS y FROM li JOIN f ON f.g = o // 10""")
def scatter_points(spark, d):
    rows = _lines(spark, d).withColumn("g", F.floor(F.col("o") / 10))
    x_fits = fits.line_fit(rows.withColumn("v", F.col("q") * 2 + F.col("n")), ["g"], "q", "v").withColumn("scale", F.lit("linear"))
    y_fits = x_fits.select("g", F.lit("log10").alias("scale"), F.lit(0.01).alias("slope"), F.lit(0.5).alias("intercept"))
    points = rows.select("g", "o", "n", F.col("q").alias("x1"), (F.col("d") * 100).alias("y1"), (F.col("q") + 4).alias("x2"), (F.col("d") * 100 + 2).alias("y2"))
    return r4(extract.point_values(points, x_fits, y_fits, ["g"]).select("o", "n", "x", "y"), "x", "y")


# --- baselines, limits, reports and fallbacks -------------------------------------------------------------


@query(f"""WITH {_LI}, e AS (SELECT o, greatest(q, d * 400) AS hi, least(q, d * 400) AS lo, o % 2 = 0 AS v FROM li)
           SELECT o, min(CASE WHEN v THEN hi ELSE lo END) AS near_min, max(CASE WHEN v THEN hi ELSE lo END) AS near_max, round(avg(CASE WHEN v THEN hi ELSE lo END), 6) AS near_avg,
                  min(CASE WHEN v THEN lo ELSE hi END) AS far_min, max(CASE WHEN v THEN lo ELSE hi END) AS far_max, round(avg(CASE WHEN v THEN lo ELSE hi END), 6) AS far_avg FROM e GROUP BY 1""")
def bar_ends(spark, d):
    got = axis.ends(_lines(spark, d), ["o"], F.col("q"), F.col("d") * 400, F.col("o") % 2 == 0)
    return got.withColumns({c: F.round(c, 6) for c in ("near_avg", "far_avg")})


@query(f"""WITH {_LI}, b AS (SELECT o, floor(q / 12) AS band, d * 400 AS e, o % 2 = 0 AS v, (o % 2 = 0) <> (o % 5 = 0) AS up, CASE WHEN o % 3 > 0 THEN (o % 9) * 5 END AS z FROM li),
                k AS (SELECT o, band, any_value(up) AS up, CASE WHEN any_value(up) THEN max(e) ELSE min(e) END AS e FROM b GROUP BY 1, 2),
                s AS (SELECT o, count(*) AS bands, CASE WHEN any_value(up) THEN quantile_cont(e, 0.95) ELSE quantile_cont(e, 0.05) END AS p FROM k GROUP BY 1),
                m AS (SELECT o, median(e) AS m, any_value(v) AS v, any_value(z) AS z FROM b GROUP BY 1), f AS (SELECT *, CASE WHEN bands >= 2 THEN p ELSE m END AS one FROM s JOIN m USING (o))
           SELECT o, round(CASE WHEN z IS NOT NULL AND (NOT v OR abs(one - z) <= 10) THEN z ELSE one END, 5) AS baseline, bands, CASE WHEN z IS NOT NULL AND (NOT v OR abs(one - z) <= 10) THEN 'zero' WHEN bands >= 2 THEN 'stacks' ELSE 'median' END AS method FROM f""")
def detected_baselines(spark, d):
    o = F.col("o")
    rows = _lines(spark, d).withColumn("near", F.col("d") * 400)
    got = axis.detected_baseline(rows, ["o"], "q", "near", 12.0, o % 2 == 0, o % 5 == 0, F.when(o % 3 > 0, (o % 9) * 5))
    return got.withColumn("baseline", F.round("baseline", 5))


@query("""WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1),
               r AS (SELECT l_suppkey, round(abs(l_extendedprice - (m * l_quantity + c)), 9) AS r FROM lineitem JOIN f USING (l_suppkey)), a AS (SELECT *, abs(r - median(r) OVER (PARTITION BY l_suppkey)) AS a FROM r)
          SELECT l_suppkey, count(*) AS n, round(greatest(2.5 * CASE WHEN median(a) > 1e-9 THEN 1.4826 * median(a) ELSE stddev_pop(r) END, 100), 2) AS threshold FROM a GROUP BY 1""")
def residual_thresholds(spark, d):
    got = fits.residual_threshold(t(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice", 100.0)
    return got.withColumn("threshold", F.round("threshold", 2))


@query(f"""WITH {_LI}, p AS (SELECT o, n, n % 2 AS label, q * 3 AS pos, 1 - d AS c, x AS dist, CASE o % 3 WHEN 0 THEN 'grouped' WHEN 1 THEN 'mixed' ELSE 'simple' END AS layout FROM li),
                s AS (SELECT *, max(pos) OVER w - min(pos) OVER w AS span, least(150, 50 * sqrt(count(*) OVER w)) AS lim, row_number() OVER (PARTITION BY o, label ORDER BY c DESC, dist, pos) AS r FROM p WINDOW w AS (PARTITION BY o, label))
           SELECT o, n, label FROM s WHERE r = 1 OR span < CASE layout WHEN 'grouped' THEN lim WHEN 'mixed' THEN 100 ELSE 0 END""")
def shared_labels(spark, d):
    layout = F.get(F.array(F.lit("grouped"), F.lit("mixed"), F.lit("simple")), (F.col("o") % 3).cast("int"))
    pairs = _lines(spark, d).select("o", "n", (F.col("n") % 2).alias("label"), (F.col("q") * 3).alias("at"), (1 - F.col("d")).alias("confidence"), F.col("x").alias("distance"), layout.alias("layout"))
    return associate.shared_when_grouped(pairs, ["o"], "label", "at", "layout", "n").select("o", "n", "label")


@query("""WITH s AS (SELECT o_orderpriority AS kind, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)
          SELECT kind, n AS count, round(m, 4) AS f1_mean, round(s, 4) AS f1_std, row_number() OVER (ORDER BY m, kind)::int AS place FROM s""")
def handler_report(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("f1"))
    return r4(evaluate.handler_report(rows, "kind", ["f1"]), "f1_mean", "f1_std")


@query(f"""WITH {_LI}, a AS (SELECT o, n, CASE WHEN n % 3 = 0 THEN 'bar' ELSE 'legend' END AS c, 'first' AS w FROM li WHERE o % 2 = 0), l AS (SELECT o, n, CASE WHEN n % 2 = 0 THEN 'bar' ELSE 'legend' END AS c, 'lower' AS w FROM li WHERE o % 5 > 1),
                b AS (SELECT o, n, CASE WHEN n % 4 = 1 THEN 'bar' ELSE 'chart' END AS c, 'borrowed' AS w FROM li), ab AS (SELECT DISTINCT o FROM a WHERE c = 'bar'), lb AS (SELECT DISTINCT o FROM l WHERE c = 'bar')
           SELECT o, n, c AS class_name, w AS source FROM a WHERE o IN (FROM ab) OR o NOT IN (FROM lb) UNION ALL SELECT * FROM l WHERE o NOT IN (FROM ab) AND o IN (FROM lb) UNION ALL SELECT * FROM b WHERE c = 'bar' AND o NOT IN (FROM ab) AND o NOT IN (FROM lb)""")
def histogram_fallbacks(spark, d):
    n = F.col("n")
    side = lambda rows, bar, other, name: rows.select("o", "n", F.when(bar, "bar").otherwise(other).alias("class_name"), F.lit(name).alias("source"))
    parts = (_lines(spark, d).where("o % 2 = 0"), n % 3 == 0, "legend", "first"), (_lines(spark, d).where("o % 5 > 1"), n % 2 == 0, "legend", "lower"), (_lines(spark, d), n % 4 == 1, "chart", "borrowed")
    return routing.histogram_fallback(*[side(*p) for p in parts], ["o"])


@query("SELECT o_custkey, count(*) AS total_rows, ceil(count(*) / 10.0)::int AS total_pages, o_custkey % 2 = 0 AND count(*) > 10 AS enabled FROM orders GROUP BY 1")
def tab_pagination(spark, d):
    kind = F.when(F.col("o_custkey") % 2 == 0, "heatmap").otherwise("bar")
    return protocol.pagination(t(spark, d, "orders").withColumn("kind", kind), ["o_custkey"], "kind", 10)


@query(f"WITH {_LI} SELECT o, n, CASE WHEN n % 4 = 0 THEN 'uncalibrated' WHEN d * 10 >= 0.85 AND (n % 4 = 1 OR x * 4 < 0.15) THEN 'high' WHEN d * 10 >= 0.15 THEN 'approximate' ELSE 'uncalibrated' END AS quality FROM li")
def calibration_grades(spark, d):
    n = F.col("n")
    quality = S.calibration_quality(F.when(n % 4 > 0, F.col("d") * 10), F.when(n % 4 != 1, F.col("x") * 4))
    return _lines(spark, d).select("o", "n", quality.alias("quality"))


@query()
def threshold_tuning(spark, d):
    """The confidence threshold of best F1, detections matched anew at each; thresholds from 0.1 by 0.05."""
    q, disc = F.col("q"), F.col("d") * 100
    box = [q.alias("x1"), disc.alias("y1"), (q + 10).alias("x2"), (disc + 5).alias("y2")]
    rows = _lines(spark, d)
    truth = rows.where("n % 2 = 1").select("o", F.col("n").cast("long").alias("idx"), *box)
    found = rows.where("n % 2 = 0").select("o", F.col("n").cast("long").alias("idx"), *box, (F.col("x") * 12).alias("conf"))
    return evaluate.best_threshold(assign.threshold_counts(truth, found, "o", [round(0.1 + 0.05 * i, 2) for i in range(18)], 0.1))
