"""Associations and label roles on the driver's tables, with their DuckDB counterparts. A chart is an order, its elements are the order's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from abacist.functions import geometry as G
from abacist.operators import assign, labels, link
from abacist.plans.queries import query, r4, t

#: One element per line number of an order.
_LI = "li AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_quantity) AS q, min(l_extendedprice) AS p, min(l_discount) AS d, min(l_tax) AS x FROM lineitem GROUP BY 1, 2)"
_SIDES = f"""{_LI}, b AS (SELECT o, n AS bar, q * 4 AS x1, 40 + d * 500 AS y1, q * 4 + 12 AS x2, 100.0 AS y2, (q * 4 + q * 4 + 12) / 2 AS cx FROM li WHERE n % 2 = 1),
             m AS (SELECT o, n AS other, q * 4 + x * 100 AS x1, d * 900 AS y1, q * 4 + x * 100 + 10 AS x2, d * 900 + 9 AS y2, (q * 4 + x * 100 + (q * 4 + x * 100 + 10)) / 2 AS cx FROM li WHERE n % 2 = 0)"""


def _lines(spark, d):
    least = [F.min(c).alias(a) for c, a in (("l_quantity", "q"), ("l_extendedprice", "p"), ("l_discount", "d"), ("l_tax", "x"))]
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(*least)


def _side(spark, d, odd, name, prefix):
    rows = _lines(spark, d).where(F.col("n") % 2 == (1 if odd else 0))
    q, x, disc = F.col("q") * 4, F.col("q") * 4 + F.col("x") * 100, F.col("d")
    box = (q, 40 + disc * 500, q + 12, F.lit(100.0)) if odd else (x, disc * 900, x + 10, disc * 900 + 9)
    return rows.select("o", F.col("n").alias(name), *[c.cast("double").alias(f"{prefix}{k}") for c, k in zip(box, ("x1", "y1", "x2", "y2"))])


@query(f"""WITH {_SIDES}, g AS (SELECT o, coalesce(median(gap), 100) AS s FROM (SELECT o, cx - lag(cx) OVER (PARTITION BY o ORDER BY cx) AS gap FROM b) GROUP BY 1),
                r AS (SELECT b.o, bar, other AS label, abs(m.cx - b.cx) AS away, greatest(least(b.x2, m.x2) - greatest(b.x1, m.x1), 0) / (m.x2 - m.x1) AS shared, s FROM b JOIN m USING (o) JOIN g USING (o)),
                k AS (SELECT *, CASE WHEN shared >= 0.1 THEN 'direct_overlap' WHEN away <= 18 THEN 'proximity' WHEN away <= 0.4 * s THEN 'spacing_based' WHEN away <= 2 * s THEN 'zone_fallback' END AS strategy,
                        round(CASE WHEN shared >= 0.1 THEN least(shared, 1) WHEN away <= 18 THEN 1 - 0.5 * away / 18 WHEN away <= 0.4 * s THEN 1 - 0.3 * away / (0.4 * s) WHEN away <= 2 * s THEN greatest(1 - away / (2 * s), 0.3) END, 9) AS c FROM r),
                w AS (SELECT * FROM k WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o, bar ORDER BY c DESC, round(away, 9), label) = 1)
           SELECT o, bar, label, strategy, round(c, 4) AS confidence FROM w QUALIFY row_number() OVER (PARTITION BY o, label ORDER BY c DESC, round(away, 9), bar) = 1""")
def data_label_association(spark, d):
    bars = _side(spark, d, True, "bar", "")
    spacing = link.median_spacing(bars.withColumn("cx", (F.col("x1") + F.col("x2")) / 2), ["o"], "cx")
    got = link.bar_labels(bars.join(spacing, "o"), _side(spark, d, False, "label", "l_"), ["o"], F.lit(True))
    return got.select("o", "bar", "label", "strategy", F.round("confidence", 4).alias("confidence"))


@query(f"""WITH {_SIDES}, v AS (SELECT b.o, bar, other AS marker, round(abs(m.cx - b.cx), 9) AS distance FROM b JOIN m USING (o) WHERE (m.y1 + m.y2) / 2 < b.y1 AND b.y1 - m.y2 < 100),
                k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o, marker ORDER BY distance, bar) = 1)
           SELECT o, bar, marker, round(distance, 4) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY o, bar ORDER BY marker DESC) = 1""")
def significance_markers(spark, d):
    return r4(link.significance(_side(spark, d, True, "bar", ""), _side(spark, d, False, "marker", "m_"), ["o"], F.lit(True)), "distance")


@query(f"""WITH {_SIDES} SELECT b.o, other AS marker, bar, count(*) OVER (PARTITION BY b.o, other) AS span_count FROM b JOIN m ON b.o = m.o AND b.cx BETWEEN m.x1 - 30 AND m.x2 + 30 AND m.y2 < b.y1""")
def significance_spans(spark, d):
    markers = _side(spark, d, False, "marker", "m_").withColumns({"m_x1": F.col("m_x1") - 30, "m_x2": F.col("m_x2") + 30})
    return link.spanned(_side(spark, d, True, "bar", ""), markers, ["o"], F.lit(True))


_NEAR = f"""{_SIDES}, pr AS (SELECT b.o, bar AS box, other, m.x1, m.y1, m.x2, m.y2, b.x1 <= m.x2 AND m.x1 <= b.x2 AND b.y1 <= m.y2 AND m.y1 <= b.y2 AS touch,
              CASE WHEN abs(m.cx - b.cx) < 6 THEN abs((m.y1 + m.y2) / 2 - (b.y1 + b.y2) / 2) END AS away FROM b JOIN m USING (o))"""


@query(f"""WITH {_NEAR}, e AS (SELECT o, box, count(*) FILTER (touch) AS touching, min(x1) FILTER (touch) AS a1, min(y1) FILTER (touch) AS b1, max(x2) FILTER (touch) AS a2, max(y2) FILTER (touch) AS b2,
                 arg_min((x1, y1, x2, y2), (away, other)) FILTER (NOT touch AND away IS NOT NULL) AS near FROM pr WHERE touch OR away IS NOT NULL GROUP BY 1, 2)
           SELECT o, box, touching, round(coalesce(a1, near[1]), 4) AS o_x1, round(coalesce(b1, near[2]), 4) AS o_y1, round(coalesce(a2, near[3]), 4) AS o_x2, round(coalesce(b2, near[4]), 4) AS o_y2 FROM e""")
def box_whisker_groups(spark, d):
    got = link.box_whiskers(_side(spark, d, True, "box", ""), _side(spark, d, False, "indicator", "o_"), ["o"], F.lit(True))
    return r4(got, "o_x1", "o_y1", "o_x2", "o_y2")


@query(f"""WITH {_NEAR}, e AS (SELECT o, box, count(*) FILTER (touch) AS touching, arg_min((x1, y1), other) FILTER (touch) AS f, arg_min((x1, y1), (away, other)) FILTER (NOT touch AND away IS NOT NULL) AS near FROM pr WHERE touch OR away IS NOT NULL GROUP BY 1, 2)
           SELECT o, box, touching, round(coalesce(f, near)[1], 4) AS o_x1, round(coalesce(f, near)[2], 4) AS o_y1 FROM e""")
def box_median_lines(spark, d):
    got = link.box_medians(_side(spark, d, True, "box", ""), _side(spark, d, False, "line", "o_"), ["o"], F.lit(True))
    return r4(got.select("o", "box", "touching", "o_x1", "o_y1"), "o_x1", "o_y1")


@query(f"WITH {_SIDES} SELECT b.o, bar AS box, other AS point FROM b JOIN m ON b.o = m.o AND abs(m.cx - b.cx) < 0.4 * (b.x2 - b.x1)")
def box_outlier_points(spark, d):
    return link.box_outliers(_side(spark, d, True, "box", ""), _side(spark, d, False, "point", "o_"), ["o"], F.lit(True))


_SPACING = f"""{_SIDES}, gp AS (SELECT o, bar, cx, cx - lag(cx) OVER (PARTITION BY o ORDER BY cx, bar) AS gap FROM b),
               sp AS (SELECT o, median(gap) AS mid, count(*) >= 3 AND max(gap) > 2 * min(gap) AS grouped,
                        CASE WHEN count(*) < 2 THEN 100 WHEN count(*) > 2 AND round(stddev_pop(gap) - 0.5 * median(gap), 9) > 0 THEN min(gap) ELSE median(gap) END AS s FROM gp GROUP BY 1)"""


@query(f"""WITH {_SPACING}, cl AS (SELECT o, bar, cx, sum(coalesce((gap > 1.5 * mid)::int, 0)) OVER (PARTITION BY o ORDER BY cx, bar ROWS UNBOUNDED PRECEDING) AS cluster FROM gp JOIN sp USING (o) WHERE grouped),
                cc AS (SELECT o, cluster, avg(cx) AS c FROM cl GROUP BY 1, 2), bl AS (SELECT cc.o, cluster, other AS label, abs(c - m.cx) AS distance FROM cc JOIN m USING (o) QUALIFY row_number() OVER (PARTITION BY cc.o, cluster ORDER BY round(abs(c - m.cx), 9), other) = 1)
           SELECT o, bar AS box, 1 AS rank, label, round(distance, 4) AS distance FROM cl JOIN bl USING (o, cluster)
           UNION ALL SELECT b.o, bar, row_number() OVER (PARTITION BY b.o, bar ORDER BY round(abs(m.cx - b.cx), 9), other)::int, other, round(abs(m.cx - b.cx), 4) FROM b JOIN sp USING (o) JOIN m ON m.o = b.o WHERE NOT grouped AND abs(m.cx - b.cx) < 0.35 * s""")
def box_tick_labels(spark, d):
    middle = lambda p: ((F.col(f"{p}x1") + F.col(f"{p}x2")) / 2).alias("at")
    boxes = _side(spark, d, True, "box", "").select("o", "box", middle(""))
    ticks = _side(spark, d, False, "label", "l_").select("o", "label", middle("l_").alias("label_at"))
    return r4(link.box_tick_labels(boxes, ticks, ["o"], "at", "label_at"), "distance")


@query(f"""WITH {_LI}, g AS (SELECT o, n, q - lag(q) OVER (PARTITION BY o ORDER BY q) AS gap FROM li), m AS (SELECT *, median(gap) OVER (PARTITION BY o) AS mid FROM g)
           SELECT o, coalesce(any_value(mid) >= 1e-6 AND round(stddev_pop(gap) / nullif(any_value(mid), 0), 9) < 0.1, false) AS is_grid, any_value(mid) AS spacing, 1 + count(*) FILTER (gap > 2 * mid AND mid >= 1e-6) AS groups FROM m GROUP BY 1""")
def box_grid_layout(spark, d):
    return link.grid_layout(_lines(spark, d), ["o"], "q")


@query(f"""WITH {_SIDES}, s AS (SELECT b.o, bar AS box, other, sqrt((m.cx - b.cx) ** 2 + ((m.y1 + m.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) AS far, 1 - least(1, abs(m.cx - b.cx) / 12) AS al, m.x1 >= b.x1 AND m.x2 <= b.x2 AS inside FROM b JOIN m USING (o))
           SELECT o, box, other, round(0.4 * (1 - least(1, far / 120)) + 0.4 * CASE WHEN inside THEN least(1, al + 0.2) ELSE al END + 0.1, 5) AS score FROM s""")
def box_grouping_score(spark, d):
    pairs = _side(spark, d, True, "box", "").join(_side(spark, d, False, "other", "o_"), "o")
    score = link.grouping_score(G.box(), G.box("o_"), F.lit(True), F.lit(400.0), F.lit(0.5))
    return pairs.select("o", "box", "other", F.round(score, 5).alias("score"))


@query(f"""WITH {_LI}, s AS (SELECT o, n, row_number() OVER (PARTITION BY o ORDER BY (q * 7 - 270 + 360) % 360, n) AS k FROM li), l AS (SELECT o, n, row_number() OVER (PARTITION BY o ORDER BY d, n) AS k FROM li WHERE n % 3 > 0)
           SELECT s.o, s.n AS slice, l.n AS label FROM s JOIN l USING (o, k)""")
def legend_clock_order(spark, d):
    rows = _lines(spark, d)
    slices = rows.select("o", F.col("n").alias("slice"), (F.col("q") * 7).alias("angle"))
    return link.legend_by_clock(slices, rows.where("n % 3 > 0").select("o", F.col("n").alias("label"), F.col("d").alias("y")), ["o"])


_POINTS = f"{_LI}, s AS (SELECT o, n AS slice, q AS x, d * 100 AS y FROM li WHERE n % 2 = 1), l AS (SELECT o, n AS label, q + 3 AS x, x * 200 AS y, CASE WHEN n = 6 THEN NULL ELSE 'legend ' || n END AS text FROM li WHERE n % 2 = 0)"


def _legend(spark, d):
    rows = _lines(spark, d)
    slices = rows.where("n % 2 = 1").select("o", F.col("n").alias("slice"), F.col("q").alias("x"), (F.col("d") * 100).alias("y"))
    text = F.when(F.col("n") != 6, F.concat(F.lit("legend "), F.col("n").cast("string")))
    return slices, rows.where("n % 2 = 0").select("o", F.col("n").alias("label"), (F.col("q") + 3).alias("x"), (F.col("x") * 200).alias("y"), text.alias("text"))


@query(f"""WITH {_POINTS} SELECT s.o, slice, coalesce(arg_min(text, (round(sqrt((s.x - l.x) ** 2 + (s.y - l.y) ** 2), 9), label)) FILTER (text IS NOT NULL), 'Unknown') AS text FROM s LEFT JOIN l USING (o) GROUP BY 1, 2""")
def legend_nearest(spark, d):
    return link.legend_nearest(*_legend(spark, d), ["o"])


@query(f"WITH {_POINTS} SELECT o, count(*) >= 2 AND stddev_pop(x) < 10 AS is_column FROM l GROUP BY 1")
def legend_columns(spark, d):
    return link.legend_column(_legend(spark, d)[1], ["o"])


@query()
def pie_label_matching(spark, d):
    return link.slice_labels(*_legend(spark, d), ["o"])


@query()
def legend_matching(spark, d):
    """Optimal one-to-one matching of slices and legend labels, for legends that aren't one column."""
    slices, legend = _legend(spark, d)
    open_form = link.without_column(legend, ["o"])
    return assign.match_points(slices.select("o", F.col("slice").cast("long").alias("idx"), "x", "y"), open_form.select("o", F.col("label").cast("long").alias("idx"), "x", "y"), "o")


@query()
def heatmap_label_bands(spark, d):
    rows = _lines(spark, d)
    bands = rows.select("o", F.col("n").cast("long").alias("idx"), F.col("q").alias("low"), (F.col("q") + 6).alias("high"))
    lines = rows.where("n % 2 = 0").select("o", F.col("n").cast("long").alias("idx"), (F.col("q") + 4).alias("low"), (F.col("q") + 4).alias("high"))
    return assign.match_bands(bands, lines, "o")


def _stacked(spark, d):
    boxes = _side(spark, d, True, "bar", "").unionByName(_side(spark, d, True, "bar", "").withColumns({"bar": F.col("bar") + 10, "x1": F.col("x1") + 2, "x2": F.col("x2") + 2, "y1": F.col("y1") - 30, "y2": F.col("y1")}))
    shaped = boxes.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "w": F.col("x2") - F.col("x1")})
    return link.stacks(shaped, ["o"], "bar", "cx", "w", -F.col("y2")).join(link.median_spacing(shaped, ["o"], "cx"), "o")


@query()
def stack_labels(spark, d):
    return link.stack_labels(_stacked(spark, d), _side(spark, d, False, "label", "l_"), ["o"], F.lit(True)).select("o", "bar", "stack", "place", "stack_size", "label", "strategy", "confidence")


@query(f"WITH {_LI} SELECT a.o, a.n FROM li a WHERE n % 2 = 0 AND (NOT EXISTS (SELECT 1 FROM li b WHERE b.o = a.o AND b.n % 2 = 1) OR EXISTS (SELECT 1 FROM li b WHERE b.o = a.o AND b.n % 2 = 1 AND abs(a.q - b.q) < 0.15 * 50))")
def aligned_ticks(spark, d):
    rows = _lines(spark, d).select("o", "n", "q")
    return link.aligned_ticks(rows.where("n % 2 = 0"), rows.where("n % 2 = 1"), ["o"], "q", "q", 50.0).select("o", "n")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_clerk FROM lineitem LEFT JOIN (SELECT o_orderkey AS l_orderkey, o_orderstatus, o_orderpriority AS o_clerk FROM orders WHERE o_orderkey % 3 > 0) USING (l_orderkey)")
def provenance(spark, d):
    assets = t(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.col("o_orderpriority").alias("o_clerk"))
    return link.with_provenance(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), assets, ["l_orderkey"], ["o_orderstatus", "o_clerk"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 AND NOT c_custkey % 2 = 0 THEN 'unified_json' ELSE 'gt_json' END AS gt_format,
                 CASE WHEN c_custkey % 2 = 0 THEN 's' || c_custkey || '_gt.json' WHEN c_custkey % 3 > 0 THEN 's' || c_custkey || '_unified.json' END AS gt,
                 CASE WHEN c_custkey % 5 > 0 THEN 's' || c_custkey || '_analysis.json' END AS baseline, CASE WHEN c_custkey % 7 > 0 THEN 's' || c_custkey || '_analysis.json' END AS candidate FROM customer""")
def resolved_pairs(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sample_id"))
    file = lambda rows, root, end: rows.select(F.lit(root).alias("root"), F.concat("sample_id", F.lit(end)).alias("name"))
    files = file(c.where("c_custkey % 2 = 0"), "gt", "_gt.json").unionByName(file(c.where("c_custkey % 3 > 0"), "gt", "_unified.json"))
    files = files.unionByName(file(c.where("c_custkey % 5 > 0"), "baseline", "_analysis.json")).unionByName(file(c.where("c_custkey % 7 > 0"), "candidate", "_analysis.json"))
    return link.resolved_pairs(c, files, "sample_id").drop("sample_id")


@query(f"""WITH {_LI}, e AS (SELECT a.o, abs(a.q - b.q) AS q, abs(a.d - CASE WHEN b.n % 2 = 0 THEN b.x END) AS d FROM li a JOIN li b ON a.n = b.n AND a.o % 4 = 0 AND b.o = a.o + 1)
           SELECT o, round((coalesce(sum(q), 0) + coalesce(sum(d), 0)) / (count(q) + count(d)), 6) AS mae, round(avg(q), 6) AS q_mae, round(avg(d), 6) AS d_mae FROM e GROUP BY 1""")
def positional_errors(spark, d):
    rows = _lines(spark, d)
    found = rows.select((F.col("o") - 1).alias("o"), "n", "q", F.when(F.col("n") % 2 == 0, F.col("x")).alias("d"))
    got = link.positional_errors(rows.where("o % 4 = 0").select("o", "n", "q", "d"), found, ["o"], "n", ["q", "d"])
    return got.withColumns({c: F.round(c, 6) for c in ("mae", "q_mae", "d_mae")})


# --- label roles ---------------------------------------------------------------------------------------


@query(f"""WITH {_LI}, b AS (SELECT o, q + 3 AS cx, d * 100 + 2 AS cy, 6.0 + n AS w, 4.0 AS h FROM (SELECT *, q - n / 2 AS q0 FROM li)),
                g AS (SELECT o, count(*) AS n, min(cx) AS l, max(cx) AS r, min(cy) AS t, max(cy) AS bt, median(w) AS mw, median(h) AS mh FROM b GROUP BY 1)
           SELECT o, n AS num_elements, round(l - 0.02 * (r - l), 4) AS "left", round(bt + 0.02 * (bt - t), 4) AS bottom, round(CASE WHEN n > 1 THEN CASE WHEN o % 2 = 0 THEN r - l ELSE bt - t END / (n - 1) ELSE 0 END, 4) AS avg_spacing,
                  CASE WHEN o % 3 = 0 THEN mw ELSE 0 END::double AS median_box_width, round(CASE WHEN o % 3 = 1 AND r > l AND bt > t THEN n / greatest(1.04 * 1.04 * (r - l) * (bt - t), 1) ELSE 0 END, 6) AS point_density FROM g""")
def element_context(spark, d):
    half = (6.0 + F.col("n")) / 2
    cx, cy = F.col("q") + 3, F.col("d") * 100 + 2
    rows = _lines(spark, d).select("o", (cx - half).alias("x1"), (cy - 2).alias("y1"), (cx + half).alias("x2"), (cy + 2).alias("y2"))
    kind = F.when(F.col("o") % 3 == 0, "box").when(F.col("o") % 3 == 1, "line").otherwise("bar")
    got = labels.element_context(rows, ["o"], kind, F.col("o") % 2 == 0)
    return got.select("o", "num_elements", *[F.round(c, 4).alias(c) for c in ("left", "bottom", "avg_spacing", "median_box_width")], F.round("point_density", 6).alias("point_density"))


@query()
def dispatched_roles(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("bar", "box", "line", "scatter", "histogram", "unknown")]), (F.col("n") % 6 + 1).cast("int"))
    rows = _lines(spark, d).select("o", "n", (F.col("q") / 51).alias("nx"), (F.col("x") * 10).alias("ny"), F.col("d").alias("w"), (F.col("d") / 2).alias("h"), (F.col("n") % 2 == 0).alias("numeric"),
                                   (F.col("o") % 2 == 0).alias("vertical"), kind.alias("kind"), (0.5 + F.col("d") * 5).alias("confidence"))
    return labels.dispatched(rows, "kind", "confidence").select("o", "n", "scorer", "role")


@query(f"""WITH {_LI}, p AS (SELECT o // 3 AS c, o, n, q * 10 AS cx, d * 5000 + n / 100 AS cy FROM li), b AS (SELECT *, floor(cy / 25) AS rb, floor(cx / 25) AS cb FROM p),
                s AS (SELECT *, count(*) OVER r AS rn, avg(cy) OVER r AS ra, count(*) OVER k AS kn, avg(cx) OVER k AS ka FROM b WINDOW r AS (PARTITION BY c, rb), k AS (PARTITION BY c, cb)),
                x AS (SELECT c, rb, ra FROM s WHERE rn >= 2 QUALIFY row_number() OVER (PARTITION BY c ORDER BY rn DESC, round(ra, 9) DESC, rb DESC) = 1),
                y AS (SELECT c, cb, ka FROM s WHERE kn >= 2 QUALIFY row_number() OVER (PARTITION BY c ORDER BY kn DESC, round(ka, 9), cb DESC) = 1),
                f AS (SELECT s.*, x.rb AS xb, y.cb AS yb, coalesce(abs(cy - x.ra), 9999) AS dx, coalesce(abs(cx - y.ka), 9999) AS dy FROM s LEFT JOIN x USING (c) LEFT JOIN y USING (c))
           SELECT c, o, n, CASE WHEN rb = xb THEN 'x' WHEN cb = yb THEN 'y' WHEN dx < 25 AND dx < dy THEN 'x' WHEN dy < 25 THEN 'y' WHEN cy / 500 > 0.75 THEN 'x' WHEN cx / 500 < 0.2 THEN 'y' END AS axis FROM f""")
def scatter_axes(spark, d):
    rows = _lines(spark, d).select(F.floor(F.col("o") / 3).alias("c"), "o", "n", (F.col("q") * 10).alias("cx"), (F.col("d") * 5000 + F.col("n") / 100).alias("cy"))
    return labels.axes_of_scatter(rows, ["c"], 500.0, 500.0).select("c", "o", "n", "axis")


_HEAT = f"""{_LI}, h AS (SELECT o, n, q * 16 AS x1, d * 6000 AS y1, q * 16 + 40 + n * 15 AS x2, d * 6000 + 25 + n * 5 AS y2, 100.0 AS l, 80.0 AS t, 600.0 AS r, 500.0 AS b FROM li), c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM h)"""


def _heat(spark, d):
    q, disc, n = F.col("q"), F.col("d"), F.col("n")
    bounds = {"left": 100.0, "top": 80.0, "right": 600.0, "bottom": 500.0, "width": 800.0, "height": 600.0}
    return _lines(spark, d).select("o", "n", (q * 16).alias("x1"), (disc * 6000).alias("y1"), (q * 16 + 40 + n * 15).alias("x2"), (disc * 6000 + 25 + n * 5).alias("y2"), *[F.lit(v).alias(k) for k, v in bounds.items()])


@query(f"""WITH {_HEAT} SELECT o, n, CASE WHEN cy BETWEEN t AND b AND NOT cx BETWEEN l AND r THEN 'y' WHEN cx BETWEEN l AND r AND NOT cy BETWEEN t AND b THEN 'x'
                  WHEN least(abs(cx - l), abs(cx - r)) < least(abs(cy - t), abs(cy - b)) THEN 'y' ELSE 'x' END AS axis FROM c""")
def heatmap_axes(spark, d):
    cx, cy = G.center(G.box())
    return _heat(spark, d).select("o", "n", labels.axis_of_heatmap(cx, cy, *[F.col(c) for c in ("left", "top", "right", "bottom")]).alias("axis"))


def _iou(x1, y1, x2, y2):
    shared = f"greatest(least(x2, {x2}) - greatest(x1, {x1}), 0) * greatest(least(y2, {y2}) - greatest(y1, {y1}), 0)"
    return f"({shared}) / ((x2 - x1) * (y2 - y1) + ({x2} - {x1}) * ({y2} - {y1}) - {shared})"


def _heat_score(w, h):
    bell = lambda cx, cy, weight, where: f"CASE WHEN {where} THEN {weight} * exp(-((cx / {w} - {cx}) ** 2 + (cy / {h} - {cy}) ** 2) / 0.005) ELSE 0 END"
    nx, ny = f"cx / {w}", f"cy / {h}"
    middle = f"CASE WHEN {nx} > 0.2 AND {nx} < 0.8 AND {ny} > 0.2 AND {ny} < 0.8 THEN exp(-(({nx} - 0.5) ** 2 + ({ny} - 0.5) ** 2) / 0.08) ELSE 0 END"
    tall, wide = f"{ny} > 0.1 AND {ny} < 0.9", f"{nx} > 0.15 AND {nx} < 0.85"
    regions = f"6 * ({_iou('0', 't', 'l', 'b')} + {_iou('r', 't', '2 * r', 'b')} + {_iou('l', 'b', 'r', '2 * b')} + {_iou('l', '0', 'r', 't')})"
    scale = f"{regions} + {bell(0.08, 0.5, 6, f'{nx} < 0.2 AND {tall}')} + {bell(0.92, 0.5, 3, f'{nx} > 0.8 AND {tall}')} + {bell(0.5, 0.92, 6, f'{wide} AND {ny} > 0.8')} - 3 * {middle}"
    return scale, bell(0.5, 0.08, 4, f"{wide} AND {ny} < 0.15")


@query(f"""WITH {_HEAT}, s AS (SELECT o, n, {_heat_score(800.0, 600.0)[0]} AS sc, {_heat_score(800.0, 600.0)[1]} AS ti, {_heat_score(1000.0, 1000.0)[0]} AS sc2, {_heat_score(1000.0, 1000.0)[1]} AS ti2 FROM c)
           SELECT o, n, CASE WHEN greatest(sc, 0, ti) > 1.8 THEN CASE WHEN sc = greatest(sc, 0, ti) THEN 'scale' ELSE 'title' END WHEN sc2 > ti2 THEN 'scale' ELSE 'title' END AS role, round(greatest(sc, 0, ti), 5) AS role_score FROM s""")
def heatmap_roles(spark, d):
    return labels.heatmap_roles(_heat(spark, d)).select("o", "n", "role", F.round("role_score", 5).alias("role_score"))


@query(f"""WITH {_LI} SELECT o, n, CASE WHEN n = 7 THEN NULL WHEN n % 3 = 0 OR n % 3 = 1 AND o % 2 = 0 THEN 'data_label' WHEN n % 2 = 1 AND q > 12 THEN 'legend' ELSE 'data_label' END AS role FROM li""")
def pie_roles(spark, d):
    n, o = F.col("n"), F.col("o")
    text = F.when(n == 7, "").when(n % 3 == 0, "about 25% of it").when((n % 3 == 1) & (o % 2 == 0), " 12.5 ").otherwise("Group 2")
    role = labels.pie_role(text, F.when(n % 2 == 1, 0).otherwise(-1), F.col("q"), F.lit(10.0))
    return _lines(spark, d).select("o", "n", role.alias("role"))


@query(f"""WITH {_LI}, e AS (SELECT o, (max(q) - min(q)) / greatest(count(*) - 1, 1) AS gap FROM li WHERE n % 2 = 1 GROUP BY 1), k AS (SELECT a.o, a.n, min(abs(a.q + 2 - b.q)) AS near FROM li a JOIN li b ON a.o = b.o AND a.n % 2 = 0 AND b.n % 2 = 1 GROUP BY 1, 2)
           SELECT li.o, li.n, CASE WHEN near < 0.5 * gap THEN 1 WHEN near < gap THEN 0.5 ELSE 0 END::double AS alignment FROM li LEFT JOIN k USING (o, n) LEFT JOIN e ON e.o = li.o WHERE li.n % 2 = 0""")
def label_alignment(spark, d):
    rows = _lines(spark, d)
    ticks = rows.where("n % 2 = 0").select("o", "n", (F.col("q") + 2).alias("at"))
    return labels.alignment(ticks, rows.where("n % 2 = 1").select("o", "q"), ["o"], "at", "q").select("o", "n", "alignment")
