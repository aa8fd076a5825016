"""The operators on the driver's tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.functions import geometry as G
from abacist.functions import scalars as S
from abacist.functions import text as X
from abacist.operators import align, assign, associate, axis, cluster, conformal, evaluate, extract, fits, labels, protocol, routing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 4) for c in columns})


# --- protocol rows -------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(l_returnflag), ''), '') AS "group", coalesce(l_extendedprice, l_discount)::double AS value,
                 CASE WHEN l_discount > 0.05 THEN 'low' ELSE 'high' END AS series_id, 'auto' AS review_status FROM lineitem""")
def protocol_projection(spark, d):
    li = t(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", protocol.group_label(F.col("l_returnflag")).alias("group"),
        protocol.value_ladder(F.col("l_extendedprice"), F.col("l_discount")).alias("value"),
        F.when(F.col("l_discount") > 0.05, "low").otherwise("high").alias("series_id"), F.lit("auto").alias("review_status"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def protocol_filter(spark, d):
    return protocol.filtered(t(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey="All").select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE coalesce(o_orderpriority, '') <> ''")
def distinct_filter_values(spark, d):
    return protocol.distinct_values(t(spark, d, "orders"), "o_orderpriority")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'HOUSE' WHEN lower('BUILDING FACTORY') LIKE '%' || lower(c_mktsegment) || '%' THEN 'building factory' ELSE '' END AS outcome
          FROM (SELECT *  FROM customer)""")
def outcome_match(spark, d):
    c = t(spark, d, "customer")
    single = F.array(F.lit("HOUSE"))
    several = F.array(F.lit("building factory"), F.lit("zzz"))
    outcomes = F.when(F.col("c_nationkey") % 3 == 0, single).otherwise(several)
    return c.select("c_custkey", protocol.outcome(outcomes, F.array("c_mktsegment")).alias("outcome"))


@query("""WITH held AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'noted' END AS note, c_mktsegment AS outcome, c_custkey % 5 = 0 AS edited FROM customer WHERE c_custkey % 3 <> 0),
               fresh AS (SELECT c_custkey, c_name AS note, 'fresh' AS outcome FROM customer WHERE c_custkey % 4 <> 0)
          SELECT coalesce(h.c_custkey, f.c_custkey) AS c_custkey,
                 CASE WHEN h.c_custkey IS NOT NULL AND (h.edited OR f.c_custkey IS NULL) THEN coalesce(nullif(h.note, ''), f.note) ELSE f.note END AS note,
                 CASE WHEN h.c_custkey IS NOT NULL AND (h.edited OR f.c_custkey IS NULL) THEN h.outcome ELSE f.outcome END AS outcome
          FROM held h FULL JOIN fresh f ON h.c_custkey = f.c_custkey""")
def context_merge(spark, d):
    c = t(spark, d, "customer")
    note = F.when(F.col("c_custkey") % 2 == 0, "").otherwise("noted")
    held = c.where("c_custkey % 3 <> 0").select("c_custkey", note.alias("note"), F.col("c_mktsegment").alias("outcome"))
    fresh = c.where("c_custkey % 4 <> 0").select("c_custkey", F.col("c_name").alias("note"), F.lit("fresh").alias("outcome"))
    return protocol.context_merge(fresh, held, ["c_custkey"], ["note"], F.col("c_custkey") % 5 == 0)


@query("""WITH e AS (SELECT l_orderkey AS o_orderkey, max_by(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) FILTER (l_linenumber % 2 = 0) AS p, max_by(l_returnflag, (l_linenumber, l_partkey, l_extendedprice)) FILTER (l_linenumber % 2 = 1) AS s
                     FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
          SELECT o_orderkey, coalesce(p, o_totalprice) AS o_totalprice, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(p::varchar, s) IS NOT NULL AS is_edited
          FROM orders LEFT JOIN e USING (o_orderkey)""")
def apply_edits(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    edits = t(spark, d, "lineitem").where("l_quantity > 40").select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(even, "o_totalprice").otherwise("o_orderstatus").alias("field"),
        F.when(even, F.col("l_extendedprice").cast("string")).otherwise(F.col("l_returnflag")).alias("new_value"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("edit_no"),
    )
    orders = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return protocol.apply_edits(orders, edits, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS row_no, ceil(row_number() OVER w / 10.0)::int AS page FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def paging(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("source_file"), "o_orderkey")
    return protocol.page(rows, ["o_orderkey"], 10).withColumnRenamed("source_file", "o_custkey")


# --- alignment and agreement ---------------------------------------------------------------------

_PAIRS = """g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem),
            p AS (SELECT *, l_extendedprice * (1 + l_discount / 100) AS v, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem WHERE l_linenumber % 3 <> 0)"""


def _aligned(spark, d):
    gold = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_extendedprice").alias("value"), F.col("l_linestatus").alias("mark"))
    pred = t(spark, d, "lineitem").where("l_linenumber % 3 <> 0").select(
        "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_extendedprice") * (1 + F.col("l_discount") / 100)).alias("value"), F.col("l_linestatus").alias("mark"))
    return align.bag_align(gold, pred, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_extendedprice"], ["value", "mark"], ["value", "mark"])


@query(f"""WITH {_PAIRS} SELECT coalesce(g.l_orderkey, p.l_orderkey) AS l_orderkey, coalesce(g.l_returnflag, p.l_returnflag) AS l_returnflag, coalesce(g.rn, p.rn)::int AS pair_no,
                  g.rn IS NOT NULL AS in_gold, p.rn IS NOT NULL AS in_pred, round(g.l_extendedprice, 4) AS gold_value, round(p.v, 4) AS pred_value
           FROM g FULL JOIN p ON g.l_orderkey = p.l_orderkey AND g.l_returnflag = p.l_returnflag AND g.rn = p.rn""")
def bag_align_outer(spark, d):
    return r4(_aligned(spark, d), "gold_value", "pred_value").select("l_orderkey", "l_returnflag", "pair_no", "in_gold", "in_pred", "gold_value", "pred_value")


_MATCHED = f"""{_PAIRS}, a AS (SELECT coalesce(g.l_returnflag, p.l_returnflag) AS l_returnflag, g.rn IS NOT NULL AS ig, p.rn IS NOT NULL AS ip, g.l_extendedprice AS gv, p.v AS pv,
               g.l_linestatus AS gm, p.l_linestatus AS pm FROM g FULL JOIN p ON g.l_orderkey = p.l_orderkey AND g.l_returnflag = p.l_returnflag AND g.rn = p.rn)"""
_CCC = "2 * covar_pop(gv, pv) / (var_pop(gv) FILTER (ip) + var_pop(pv) FILTER (ig) + (avg(gv) FILTER (ip) - avg(pv) FILTER (ig)) ** 2)"


@query(f"""WITH {_MATCHED}, s AS (SELECT count(*) FILTER (ig AND ip) AS matched, count(*) FILTER (ig AND NOT ip) AS unmatched_gold, count(*) FILTER (ip AND NOT ig) AS unmatched_pred, count(*) AS total,
                 count(*) FILTER (gm = pm) AS equal, {_CCC} AS ccc FROM a),
               x AS (SELECT CASE WHEN ig AND ip THEN gm WHEN ig THEN 'G' ELSE 'P' END AS ga, CASE WHEN ig AND ip THEN pm WHEN ig THEN 'P' ELSE 'G' END AS pa FROM a),
               m AS (SELECT sum(na * nb) AS pr FROM (SELECT ga AS l, count(*)::double AS na FROM x GROUP BY 1) JOIN (SELECT pa AS l, count(*)::double AS nb FROM x GROUP BY 1) USING (l)),
               k AS (SELECT count(*) FILTER (ga = pa) / count(*)::double AS po, any_value(pr) / count(*)::double / count(*) AS pe FROM x, m),
               f AS (SELECT s.*, matched / total::double AS success_rate, equal / total::double AS accuracy, (po - pe) / (1 - pe) AS kappa FROM s, k)
           SELECT matched, unmatched_gold, unmatched_pred, total, round(success_rate, 6) AS success_rate, round(accuracy, 6) AS accuracy, round(ccc, 6) AS ccc, round(kappa, 6) AS kappa,
                  success_rate >= 0.99 AND accuracy >= 0.95 AND ccc >= 0.9 AND kappa >= 0.81 AS passed FROM f""")
def validation_metrics(spark, d):
    found = align.report(_aligned(spark, d), "gold_value", "pred_value", "gold_mark", "pred_mark")
    return found.withColumns({c: F.round(c, 6) for c in ("success_rate", "accuracy", "ccc", "kappa")})


@query(f"""WITH {_MATCHED} SELECT l_returnflag, count(*) AS count, round(avg((gm = pm)::int::double), 6) AS accuracy, round({_CCC}, 6) AS ccc FROM a WHERE ig AND ip GROUP BY 1""")
def validation_by_type(spark, d):
    found = align.by_type(_aligned(spark, d), "l_returnflag", "gold_value", "pred_value", F.col("gold_mark") == F.col("pred_mark"))
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "ccc")})


@query("""WITH x AS (SELECT substr(o_orderpriority, 1, 1) AS a, (1 + least(floor(o_totalprice / 100000), 4)::int)::varchar AS b FROM orders),
               c AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL), w AS (SELECT sum(n)::double AS n, sum(n) FILTER (a = b) AS same FROM c),
               m AS (SELECT sum(na * nb) AS pr FROM (SELECT a AS l, sum(n)::double AS na FROM c GROUP BY 1) JOIN (SELECT b AS l, sum(n)::double AS nb FROM c GROUP BY 1) USING (l))
          SELECT round((same / n - pr / (n * n)) / (1 - pr / (n * n)), 4) AS kappa FROM w, m""")
def cohens_kappa(spark, d):
    rows = t(spark, d, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("a"), (1 + F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4))).cast("string").alias("b"))
    return r4(align.kappa(rows, "a", "b"), "kappa")


@query("""WITH a AS (SELECT l_suppkey, l_extendedprice AS gt, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rank FROM lineitem WHERE l_returnflag = 'A'),
               b AS (SELECT l_suppkey, l_extendedprice AS pred, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rank FROM lineitem WHERE l_returnflag = 'R')
          SELECT l_suppkey, count(*) AS n, round(avg(abs(pred - gt)), 4) AS mae, round(avg(abs(pred - gt) / (abs(gt) + 1e-10)), 4) AS relative_error,
                 round(avg((abs(pred - gt) / (abs(gt) + 1e-10) <= 0.05)::int::double), 4) AS relaxed_accuracy FROM a JOIN b USING (l_suppkey, rank) GROUP BY 1""")
def sorted_positional_metrics(spark, d):
    li = t(spark, d, "lineitem")
    order = [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    side = lambda flag, name: li.where(F.col("l_returnflag") == flag).select("l_suppkey", F.col("l_extendedprice").alias(name), F.struct(*order).alias(f"{name}_order"))  # noqa: E731,E501
    pairs = align.rank_merge(side("A", "gt"), side("R", "pred"), ["l_suppkey"], [F.col("gt_order")], [F.col("pred_order")])
    return r4(evaluate.value_metrics(pairs, ["l_suppkey"], "gt", "pred"), "mae", "relative_error", "relaxed_accuracy")


# --- fits ----------------------------------------------------------------------------------------


@query("""SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
                 round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND var_pop(l_quantity) > 1e-12""")
def ols_fit(spark, d):
    got = fits.line_fit(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return got.select("l_suppkey", "n", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 4).alias("r2"))


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
                     FROM (SELECT l_suppkey, 1 - l_discount AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1)
          SELECT l_suppkey, n, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 2) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 1) AS intercept FROM s WHERE n >= 2""")
def wls_fit(spark, d):
    li = t(spark, d, "lineitem").withColumn("w", 1 - F.col("l_discount"))
    got = fits.line_fit(li, ["l_suppkey"], "l_quantity", "l_extendedprice", "w")
    return got.select("l_suppkey", "n", F.round("slope", 2).alias("slope"), F.round("intercept", 1).alias("intercept"))


@query("""SELECT l_suppkey, count(*) AS n, round(regr_slope(log10(l_extendedprice), l_quantity), 6) + 0.0::double AS slope, round(regr_intercept(log10(l_extendedprice), l_quantity), 4) AS intercept
          FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1 HAVING count(*) >= 2 AND var_pop(l_quantity) > 1e-12""")
def log_fit(spark, d):
    got = fits.log_fit(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return r4(got, "intercept").withColumn("slope", F.round("slope", 6) + 0.0).drop("r2")


@query("""WITH m AS (SELECT l_suppkey, l_quantity, abs(l_quantity - median(l_quantity) OVER (PARTITION BY l_suppkey)) AS away FROM lineitem)
          SELECT l_suppkey, round(median(away), 4) AS mad, round(greatest(2.5 * CASE WHEN median(away) > 0 THEN 1.4826 * median(away) ELSE stddev_pop(l_quantity) END, 1e-6), 4) AS threshold FROM m GROUP BY 1""")
def mad_threshold(spark, d):
    return r4(fits.mad_threshold(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity"), "mad", "threshold")


@query("""WITH p AS (SELECT l_orderkey, (l_linenumber * 10000000::bigint + l_partkey) * 100 + l_quantity::bigint AS o, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
               h AS (SELECT a.l_orderkey, a.o AS i, b.o AS j, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c
                     FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.o < b.o AND abs(a.x - b.x) > 1e-12),
               s AS (SELECT h.l_orderkey, i, j, m, c, round(0.5 * count(*) FILTER (power(y - (m * x + c), 2) <= 25) - sum(least(power(y - (m * x + c), 2), 25)), 5) AS score,
                            count(*) FILTER (power(y - (m * x + c), 2) <= 25) AS k FROM h JOIN p USING (l_orderkey) GROUP BY ALL),
               b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, k DESC, i, j) = 1)
          SELECT l_orderkey, count(*) AS n_inliers, round(covar_pop(x, y) / var_pop(x), 2) + 0.0::double AS slope FROM b JOIN p USING (l_orderkey)
          WHERE power(y - (m * x + c), 2) <= 25 GROUP BY 1 HAVING count(*) >= 2 AND var_pop(x) > 1e-12""")
def consensus_fit(spark, d):
    li = t(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    li = li.withColumn("o", (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long"))
    got = fits.consensus_fit(li, ["l_orderkey"], "l_quantity", "y", "o", 5.0)
    return got.select("l_orderkey", "n_inliers", (F.round("slope", 2) + 0.0).alias("slope"))


@query("""WITH v AS (SELECT user_id % 400 AS axis, CASE WHEN user_id % 3 = 0 THEN pow(2, event_id % 6) ELSE (event_id % 7) * 10 - 5 END::double AS value FROM events),
               s AS (SELECT axis, value, value - lag(value) OVER w AS d, CASE WHEN lag(value) OVER w > 0 THEN value / lag(value) OVER w END AS q FROM (SELECT DISTINCT * FROM v) WINDOW w AS (PARTITION BY axis ORDER BY value)),
               g AS (SELECT axis, count(*) AS n, CASE WHEN avg(d) <> 0 THEN stddev_pop(d) / abs(avg(d)) ELSE 1e300 END AS cd,
                            CASE WHEN count(*) FILTER (value > 0) >= 3 THEN stddev_pop(q) / abs(avg(q)) ELSE 1e300 END AS cq FROM s GROUP BY 1)
          SELECT axis, n, CASE WHEN n < 3 THEN 'unknown' WHEN cd < 0.15 THEN 'linear' WHEN cq < 0.15 AND cd > cq THEN 'log' WHEN cd < 0.5 THEN 'linear' ELSE 'unknown' END AS scale,
                 round(CASE WHEN n < 3 THEN 0 WHEN cd < 0.15 THEN 1 - cd WHEN cq < 0.15 AND cd > cq THEN 1 - cq ELSE greatest(0.3, 1 - least(cd, cq)) END, 6) AS confidence FROM g""")
def axis_scale(spark, d):
    value = F.when(F.col("user_id") % 3 == 0, F.pow(F.lit(2.0), F.col("event_id") % 6)).otherwise((F.col("event_id") % 7) * 10.0 - 5)
    rows = t(spark, d, "events").select((F.col("user_id") % 400).alias("axis"), value.alias("value")).distinct()
    return fits.axis_scale(rows, ["axis"], "value").select("axis", "n", "scale", F.round("confidence", 6).alias("confidence"))


@query("""WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS c, max(l_extendedprice) - min(l_extendedprice) AS span FROM lineitem GROUP BY 1),
               n AS (SELECT l_orderkey, l_linenumber, l_suppkey, abs(l_extendedprice - (m * l_quantity + c)) <= 0.1 * span AS near FROM lineitem JOIN f USING (l_suppkey))
          SELECT l_orderkey, l_linenumber, l_suppkey FROM n QUALIFY near OR sum(near::int) OVER (PARTITION BY l_suppkey) < 2""")
def scale_consistency(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return fits.consistent_labels(li, ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_suppkey")


# --- conformal -----------------------------------------------------------------------------------

_SCORES = """sc AS (SELECT l_returnflag AS family, l_quantity AS feature, l_extendedprice AS truth, round(p_retailprice * l_quantity, 4) AS guess,
                    round(abs(l_extendedprice - round(p_retailprice * l_quantity, 4)), 4) AS score FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _scores(spark, d):
    guess = F.round(F.col("p_retailprice") * F.col("l_quantity"), 4)
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("family"), F.col("l_quantity").alias("feature"), F.col("l_extendedprice").alias("truth"), guess.alias("guess"))
    return rows.withColumn("score", F.round(S.nonconformity(F.col("truth"), F.col("guess"), False, 1.0), 4))


@query(f"""WITH {_SCORES}, r AS (SELECT family, score, row_number() OVER (PARTITION BY family ORDER BY score) AS rn, count(*) OVER (PARTITION BY family) AS n FROM sc)
           SELECT family, round(score, 4) AS q_alpha, n AS n_cal FROM r WHERE rn = least(ceil((n + 1) * 0.9), n) AND n >= 2""")
def conformal_quantile(spark, d):
    return conformal.quantiles(_scores(spark, d), ["family"], "score", 0.1)


_BINS = """e AS (SELECT family, quantile_cont(feature, [0.25, 0.5, 0.75]) AS q FROM sc GROUP BY 1),
           bx AS (SELECT family, unnest([0, 1, 2, 3]) AS bin, unnest([-1e308, q[1], q[2], q[3]]) AS lo, unnest([q[1], q[2], q[3], 1e308]) AS hi FROM e)"""


@query(f"""WITH {_SCORES}, {_BINS} SELECT family, bin::int AS bin, CASE WHEN lo < -1e300 THEN NULL ELSE round(lo, 4) END AS lo, CASE WHEN hi > 1e300 THEN NULL ELSE round(hi, 4) END AS hi FROM bx""")
def conformal_bins(spark, d):
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.round(c, 4)).alias(c)
    return conformal.bins(_scores(spark, d), "family", "feature", 4).select("family", "bin", finite("lo"), finite("hi"))


@query(f"""WITH {_SCORES}, {_BINS}, k AS (SELECT sc.family, bin, score FROM sc JOIN bx ON bx.family = sc.family AND feature >= lo AND feature < hi),
           r AS (SELECT family, bin, score, row_number() OVER (PARTITION BY family, bin ORDER BY score) AS rn, count(*) OVER (PARTITION BY family, bin) AS n FROM k),
           q AS (SELECT family, bin, score AS q FROM r WHERE rn = least(ceil((n + 1) * 0.9), n)),
           a AS (SELECT sc.*, bin FROM sc JOIN bx ON bx.family = sc.family AND feature >= lo AND feature < hi)
           SELECT a.family, a.bin::int AS bin, count(*) AS n, round(avg((truth BETWEEN guess - q AND guess + q)::int::double), 3) AS coverage, round(max(q), 3) AS half_width
           FROM a JOIN q ON q.family = a.family AND q.bin = a.bin GROUP BY 1, 2""")
def conformal_intervals(spark, d):
    scored = _scores(spark, d)
    binned = conformal.binned(scored, conformal.bins(scored, "family", "feature", 4), "family", "feature")
    table = conformal.quantiles(binned, ["family", "bin"], "score", 0.1)
    found = conformal.intervals(binned, table, "family", "guess", False, 1.0)
    inside = F.col("truth").between(F.col("low"), F.col("high")).cast("double")
    return found.groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(inside), 3).alias("coverage"), F.round(F.max("q_alpha"), 3).alias("half_width"))


# --- axis, layout, clusters ----------------------------------------------------------------------


@query("""WITH b AS (SELECT l_orderkey // 4 AS chart, l_quantity + 5 AS w, CASE WHEN l_orderkey % 8 < 4 THEN l_extendedprice / 1000 + 1 ELSE l_quantity + 3 + l_linenumber END AS h, l_discount * 1000 AS x, l_tax * 500 AS y FROM lineitem),
               g AS (SELECT chart, count(*) AS n, stddev_pop(h) / avg(h) AS ch, stddev_pop(w) / avg(w) AS cw, median(h) / median(w) AS a, var_pop(x) / 10000 AS vx, var_pop(y) / 2500 AS vy,
                            count(*) FILTER (h > 1.5 * w) AS up, count(*) FILTER (w > 1.5 * h) AS flat FROM b GROUP BY 1),
               k AS (SELECT *, greatest(up, flat) / n::double AS agree, vx / (vy + 1e-6) / 2 AS sx, vy / (vx + 1e-6) / 2 AS sy FROM g)
          SELECT chart, n, CASE WHEN n = 1 THEN CASE WHEN a > 1 THEN 'vertical' ELSE 'horizontal' END WHEN ch > 0.15 AND ch > 2 * cw THEN 'vertical' WHEN cw > 0.15 AND cw > 2 * ch THEN 'horizontal'
                   WHEN a > 1.5 AND agree > 0.6 THEN 'vertical' WHEN a < 1 / 1.5 AND agree > 0.6 THEN 'horizontal' WHEN vx > 2 * vy AND sx > 0.6 THEN 'vertical' WHEN vy > 2 * vx AND sy > 0.6 THEN 'horizontal'
                   WHEN flat > up THEN 'horizontal' ELSE 'vertical' END AS orientation,
                 CASE WHEN n = 1 THEN 'single_element' WHEN (ch > 0.15 AND ch > 2 * cw) OR (cw > 0.15 AND cw > 2 * ch) THEN 'variance' WHEN (a > 1.5 OR a < 1 / 1.5) AND agree > 0.6 THEN 'aspect_ratio'
                   WHEN (vx > 2 * vy AND sx > 0.6) OR (vy > 2 * vx AND sy > 0.6) THEN 'spatial_distribution' WHEN flat <> up THEN 'majority_vote' ELSE 'default_fallback' END AS method,
                 round(least(1, CASE WHEN n = 1 THEN abs(a - 1) WHEN ch > 0.15 AND ch > 2 * cw THEN ch / (cw + 1e-6) / 2 WHEN cw > 0.15 AND cw > 2 * ch THEN cw / (ch + 1e-6) / 2
                   WHEN a > 1.5 AND agree > 0.6 THEN agree * (a - 1.5) / 1.5 WHEN a < 1 / 1.5 AND agree > 0.6 THEN agree * (1 / a - 1.5) / 1.5 WHEN vx > 2 * vy AND sx > 0.6 THEN sx WHEN vy > 2 * vx AND sy > 0.6 THEN sy
                   WHEN flat <> up THEN greatest(up, flat) / n::double ELSE 0.5 END), 5) AS confidence FROM k""")
def orientation_cv(spark, d):
    tall = F.col("l_extendedprice") / 1000 + 1
    bars = t(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("chart"), (F.col("l_quantity") + 5).alias("w"),
        F.when(F.col("l_orderkey") % 8 < 4, tall).otherwise(F.col("l_quantity") + 3 + F.col("l_linenumber")).alias("h"), (F.col("l_discount") * 1000).alias("x"), (F.col("l_tax") * 500).alias("y"),
    )
    # rounded as a scaled double, as the SQL does: 0.265825 is 26582.499999999996 / 1e5
    return axis.orientation(bars, ["chart"], "w", "h", "x", "y", (100.0, 50.0)).withColumn("confidence", F.round(F.col("confidence") * 100000) / 100000)


@query("""SELECT user_id, event_id, (sum(o) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::bigint AS session
          FROM (SELECT user_id, event_id, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) > 3600000000)::int, 0) AS o FROM events)""")
def gap_sessions(spark, d):
    ev = t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return cluster.gap_sessions(ev, ["user_id"], ["us", "event_id"], F.col("us"), 3_600_000_000).select("user_id", "event_id", "session")


@query("""WITH s AS (SELECT user_id, event_id, value, sum(o) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS session
                     FROM (SELECT user_id, event_id, value, coalesce((value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 5)::int, 0) AS o FROM events))
          SELECT user_id, session::bigint AS session, round(avg(value), 4) AS coordinate, round(median(value), 4) AS value, count(*) AS n FROM s GROUP BY 1, 2""")
def tick_merge(spark, d):
    ev = t(spark, d, "events").select("user_id", "event_id", "value", F.col("value").alias("v"))
    return r4(cluster.tick_merge(ev, ["user_id"], "value", "v", "event_id"), "coordinate", "value")


@query("""WITH s AS (SELECT c_nationkey, c_acctbal AS x, row_number() OVER w AS k, count(*) OVER p AS n, sum(c_acctbal - m) OVER (w ROWS UNBOUNDED PRECEDING) AS s, m
                     FROM (SELECT *, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer) WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), p AS (PARTITION BY c_nationkey)),
               b AS (SELECT *, round(s * s / k + s * s / (n - k), 6) AS gain FROM s WHERE k < n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY round(s * s / k + s * s / (n - k), 3) DESC, k) = 1)
          SELECT c_nationkey, k::int AS n_low, n - k AS n_high, round(m + s / k, 6) AS low_center, round(m - s / (n - k), 6) AS high_center FROM b""")
def two_means_1d(spark, d):
    got = cluster.two_means(t(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")
    return got.select("c_nationkey", "n_low", "n_high", F.round("low_center", 6).alias("low_center"), F.round("high_center", 6).alias("high_center"))


@query("""WITH p AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS x, value AS y FROM events),
               a AS (SELECT user_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id))
          SELECT user_id, round(coalesce(sum(a), 0), 0) AS auc, count(*) AS points FROM a GROUP BY 1""")
def auc_trapezoid(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return axis.trapezoid(t(spark, d, "events"), ["user_id"], seconds, "value", "event_id").withColumn("auc", F.round("auc", 0))


@query("""WITH e AS (SELECT l_returnflag, floor(l_extendedprice / 1000) AS band, max(l_quantity) AS far_end FROM lineitem GROUP BY 1, 2)
          SELECT l_returnflag, round(quantile_cont(far_end, 0.95), 4) AS baseline FROM e GROUP BY 1""")
def stack_baseline(spark, d):
    ends = axis.stack_ends(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 1000.0)
    return r4(axis.baseline(ends, ["l_returnflag"], "far_end"), "baseline")


@query("""WITH z AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal = 0 THEN c_custkey::double
                            WHEN c_acctbal * lead(c_acctbal) OVER w < 0 THEN c_custkey + (lead(c_custkey) OVER w - c_custkey) * c_acctbal / (c_acctbal - lead(c_acctbal) OVER w) END AS z0
                     FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
          SELECT c_nationkey, round(min_by(z0, c_custkey), 4) AS zero_at FROM z WHERE z0 IS NOT NULL GROUP BY 1""")
def zero_crossing(spark, d):
    return r4(axis.zero_crossing(t(spark, d, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal"), "zero_at")


@query("""WITH b AS (SELECT o_custkey, floor(o_totalprice / 50000) * 50000 / CASE WHEN o_custkey % 5 = 0 THEN 1e6 ELSE 1 END AS s, (40000 + (o_orderkey % 3) * 10000) / CASE WHEN o_custkey % 5 = 0 THEN 1e6 ELSE 1 END AS w FROM orders),
               g AS (SELECT o_custkey, lead(s) OVER (PARTITION BY o_custkey ORDER BY s + s + w, s) - (s + w) AS gap, median(w) OVER (PARTITION BY o_custkey) AS m FROM b),
               f AS (SELECT o_custkey, count(*) AS bins, count(*) FILTER (m >= 1 AND gap / m > 0.15) > 0 AS a, count(*) FILTER (m >= 1 AND gap / m < -0.15) > 0 AS o FROM g GROUP BY 1)
          SELECT o_custkey, bins, CASE WHEN a AND o THEN 'gaps_and_overlaps' WHEN a THEN 'gaps' WHEN o THEN 'overlaps' ELSE 'ok' END AS contiguity FROM f""")
def bin_contiguity(spark, d):
    unit = F.when(F.col("o_custkey") % 5 == 0, 1e6).otherwise(1.0)
    start, wide = F.floor(F.col("o_totalprice") / 50000) * 50000 / unit, (40000 + (F.col("o_orderkey") % 3) * 10000) / unit
    return axis.contiguity(t(spark, d, "orders").select("o_custkey", start.alias("s"), (start + wide).alias("e")), ["o_custkey"], "s", "e")


@query("""WITH g AS (SELECT l_orderkey, l_quantity AS c, l_tax * 100 AS w, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS gap FROM lineitem),
               f AS (SELECT l_orderkey, count(gap) AS n, min(gap) AS lo, max(gap) AS hi, median(w) AS w, round(stddev_pop(gap) / (median(gap) + 1e-6), 9) AS cg, round(stddev_pop(w) / (median(w) + 1e-6), 9) AS cw FROM g GROUP BY 1)
          SELECT l_orderkey, CASE WHEN n >= 3 AND hi > 2.5 * lo THEN 'grouped' WHEN lo < 0.3 * w THEN 'stacked' WHEN n > 1 AND (cg > 0.5 OR cw > 0.5) THEN 'mixed' ELSE 'simple' END AS layout FROM f""")
def bar_layout(spark, d):
    rows = t(spark, d, "lineitem").withColumn("w", F.col("l_tax") * 100)
    return axis.layout(rows, ["l_orderkey"], "l_quantity", "w", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, round(coalesce(lead(a) OVER w, first(a) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 360) - a, 4) AS span
          FROM (SELECT l_orderkey, l_linenumber, l_quantity * 7 AS a FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, l_linenumber)""")
def pie_spans(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 7).alias("a"))
    return r4(axis.circular_spans(rows, ["l_orderkey"], "a", "l_linenumber"), "span").drop("a")


@query("""WITH c AS (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER w AS u, l_tax * 500 - avg(l_tax * 500) OVER w AS v FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
               g AS (SELECT l_suppkey, count(*) AS n, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u + u*v*v) AS a, sum(v*v*v + v*u*u) AS b FROM c GROUP BY 1),
               k AS (SELECT l_suppkey, n, uu, vv, (a * vv - b * uv) / (2 * (uu * vv - uv * uv)) AS uc, (b * uu - a * uv) / (2 * (uu * vv - uv * uv)) AS vc FROM g WHERE abs(uu * vv - uv * uv) > 1e-12)
          SELECT l_suppkey, round(sqrt(uc * uc + vc * vc + (uu + vv) / n), 3) AS radius FROM k""")
def circle_fit(spark, d):
    rows = t(spark, d, "lineitem").withColumn("y", F.col("l_tax") * 500)
    return axis.circle_fit(rows, ["l_suppkey"], "l_quantity", "y").select("l_suppkey", F.round("radius", 3).alias("radius"))


# --- associations --------------------------------------------------------------------------------


@query("""SELECT s_nationkey AS nation, s_suppkey, c_custkey, round(abs(c_acctbal - s_acctbal), 2) AS distance FROM supplier JOIN customer ON c_nationkey = s_nationkey
          WHERE abs(c_acctbal - s_acctbal) < 500 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c_acctbal - s_acctbal), c_custkey) = 1""")
def nearest_within_radius(spark, d):
    targets = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    sources = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    got = associate.nearest_along(targets, sources, ["nation"], "s_acctbal", "c_acctbal", 500.0, "s_suppkey", "c_custkey")
    return got.select("nation", "s_suppkey", "c_custkey", F.round("distance", 2).alias("distance"))


@query("""WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS bar, b.l_linenumber AS label, abs(a.l_quantity - b.l_quantity - 2) AS d, a.l_discount * 100 AS w,
                            CASE WHEN a.l_returnflag = b.l_linestatus OR a.l_partkey % 7 = b.l_partkey % 7 THEN 0.9 ELSE 0 END AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1),
               q AS (SELECT l_orderkey, bar, label, d, CASE WHEN shared >= 0.1 THEN 'direct_overlap' WHEN d <= 1.5 * w THEN 'proximity' WHEN d <= 4 THEN 'spacing_based' WHEN d <= 20 THEN 'zone_fallback' END AS strategy,
                            CASE WHEN shared >= 0.1 THEN shared WHEN d <= 1.5 * w THEN 1 - 0.5 * CASE WHEN w > 0 THEN d / (1.5 * w) ELSE 0 END WHEN d <= 4 THEN 1 - 0.3 * d / 4 WHEN d <= 20 THEN greatest(1 - d / 20, 0.3) END AS c FROM p),
               b AS (SELECT * FROM q WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey, bar ORDER BY round(c, 9) DESC, d, label) = 1)
          SELECT l_orderkey, bar, label, strategy, round(c, 4) AS confidence FROM b QUALIFY row_number() OVER (PARTITION BY l_orderkey, label ORDER BY round(c, 9) DESC, d, bar) = 1""")
def ranked_association(spark, d):
    li = t(spark, d, "lineitem")
    side = lambda odd, p: li.where(F.col("l_linenumber") % 2 == odd).select("l_orderkey", F.col("l_linenumber").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("l_quantity", "l_returnflag", "l_linestatus", "l_partkey", "l_discount")])  # noqa: E731,E501
    away = F.abs(F.col("bar_l_quantity") - F.col("label_l_quantity") - 2)
    shared = F.when((F.col("bar_l_returnflag") == F.col("label_l_linestatus")) | (F.col("bar_l_partkey") % 7 == F.col("label_l_partkey") % 7), 0.9).otherwise(0.0)
    # a twentieth of 0.4 and 2.0 spacings: 4 and 20
    plans = [(n, c, F.round(v, 9)) for n, c, v in associate.overlap_strategies(shared, away, F.col("bar_l_discount") * 100, F.lit(10.0))]
    got = associate.ranked(side(0, "bar"), side(1, "label"), ["l_orderkey"], plans, away, "bar", "label")
    return got.select("l_orderkey", "bar", "label", "strategy", F.round("confidence", 4).alias("confidence"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber AS bar, l_quantity AS x1, 0.0 AS y1, l_quantity + 4 AS x2, 60.0 + l_linenumber AS y2 FROM lineitem WHERE l_linenumber % 2 = 1),
               w AS (SELECT l_orderkey, l_linenumber AS whisker, l_quantity + l_tax * 10 + 1.5 AS x1, 10.0 AS y1, l_quantity + l_tax * 10 + 2.5 AS x2, 10.0 + l_discount * 800 AS y2 FROM lineitem),
               s AS (SELECT l_orderkey, bar, whisker, abs((w.x1 + w.x2) / 2 - (b.x1 + b.x2) / 2) AS off, (w.y2 - w.y1) / (w.x2 - w.x1 + 1e-6) AS aspect, (w.y2 - w.y1) / (b.y2 - b.y1 + 1e-6) AS size FROM b JOIN w USING (l_orderkey)),
               c AS (SELECT *, 1 - least(1, off / 2) AS align FROM s WHERE off <= 6),
               k AS (SELECT l_orderkey, bar, whisker, round(0.3 * least(aspect / 5, 1) + 0.4 * align + 0.3, 6) AS confidence FROM c WHERE aspect > 2 AND align > 0.7 AND size BETWEEN 0.05 AND 0.8)
          SELECT * FROM k WHERE confidence > 0.5 QUALIFY row_number() OVER (PARTITION BY l_orderkey, bar ORDER BY confidence DESC, whisker) = 1""")
def error_bar_association(spark, d):
    li = t(spark, d, "lineitem")
    q, x = F.col("l_quantity"), F.col("l_quantity") + F.col("l_tax") * 10
    bars = li.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("bar"), q.alias("x1"), F.lit(0.0).alias("y1"), (q + 4).alias("x2"), (F.col("l_linenumber") + 60.0).alias("y2"))
    whiskers = li.select("l_orderkey", F.col("l_linenumber").alias("whisker"), (x + 1.5).alias("w_x1"), F.lit(10.0).alias("w_y1"), (x + 2.5).alias("w_x2"), (F.col("l_discount") * 800 + 10).alias("w_y2"))
    return associate.error_bars(bars, whiskers, ["l_orderkey"], "bar", "whisker", F.lit(True)).withColumn("confidence", F.round("confidence", 6))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, abs(l_extendedprice - p_retailprice * l_quantity) / greatest(abs(l_extendedprice), 1000) AS score FROM lineitem JOIN part ON p_partkey = l_partkey)
          SELECT l_orderkey, l_linenumber, round(score, 6) AS score FROM s""")
def relative_nonconformity(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    score = S.nonconformity(F.col("l_extendedprice"), F.col("p_retailprice") * F.col("l_quantity"), True, 1000.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("""WITH s AS (SELECT o_custkey AS user_id, o_orderkey, (epoch_us(o_orderdate) // 1000000) % 2592000 AS a, (epoch_us(o_orderdate) // 1000000) % 2592000 + 86400 * (1 + o_orderkey % 5) AS b FROM orders)
          SELECT e.user_id, event_id, o_orderkey FROM events e JOIN s ON s.user_id = e.user_id AND (epoch_us(ts) // 1000000) % 2592000 BETWEEN a AND b""")
def interval_containment(spark, d):
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) % 2592000
    spans = t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", seconds("o_orderdate").alias("a"), (seconds("o_orderdate") + 86400 * (1 + F.col("o_orderkey") % 5)).alias("b"))
    events = t(spark, d, "events").select("user_id", "event_id", "ts")
    return associate.contained(events, spans, ["user_id"], seconds("ts"), "a", "b", 86400.0).select("user_id", "event_id", "o_orderkey")


_BOXES = "bx AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 + l_tax * 100 AS x2, l_discount * 100 + 5 AS y2 FROM lineitem)"


def _boxes(spark, d):
    tax, disc = F.col("l_tax") * 100, F.col("l_discount") * 100
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), disc.alias("y1"), (F.col("l_quantity") + 10 + tax).alias("x2"), (disc + 5).alias("y2"))


_IOU = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


@query(f"""WITH {_BOXES}, i AS (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other, {_IOU} AS s, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u
              FROM bx a JOIN bx b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
           SELECT l_orderkey, l_linenumber, other, round(s / (u - s), 4) AS iou FROM i WHERE s > 0""")
def iou_pairs(spark, d):
    a, b = _boxes(spark, d).alias("a"), _boxes(spark, d).alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    iou = G.iou(G.box("a."), G.box("b."))
    found = pairs.select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_linenumber").alias("l_linenumber"), F.col("b.l_linenumber").alias("other"), iou.alias("iou"))
    return r4(found.where("iou > 0"), "iou")


@query(f"""WITH {_BOXES} SELECT l_orderkey, l_linenumber FROM bx a WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber
             AND {_IOU} >= 0.3 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU}))""")
def iou_anti_join(spark, d):
    too_much = (F.col("b.l_linenumber") < F.col("a.l_linenumber")) & (G.iou(G.box("a."), G.box("b.")) >= 0.3)
    return associate.without_overlap(_boxes(spark, d), _boxes(spark, d), ["l_orderkey"], too_much).select("l_orderkey", "l_linenumber")


# --- values --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def pie_shares(spark, d):
    got = extract.shares(t(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice")
    return got.select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"))


@query("""WITH q AS (SELECT l_partkey, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1),
               f AS (SELECT l_partkey, q, l_extendedprice AS v, l_extendedprice BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS i FROM lineitem JOIN q USING (l_partkey))
          SELECT l_partkey, round(min(v) FILTER (i), 4) AS whisker_low, round(first(q[1]), 4) AS q1, round(first(q[2]), 4) AS median, round(first(q[3]), 4) AS q3,
                 round(max(v) FILTER (i), 4) AS whisker_high, count(*) FILTER (NOT i) AS outliers FROM f GROUP BY 1""")
def five_number_summary(spark, d):
    return r4(extract.five_numbers(t(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice"), "whisker_low", "q1", "median", "q3", "whisker_high")


@query("""SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 4) AS mean_x, round(avg(l_extendedprice), 2) AS mean_y, round(stddev_pop(l_quantity), 4) AS std_x,
                 round(stddev_pop(l_extendedprice), 2) AS std_y, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem GROUP BY 1""")
def scatter_statistics(spark, d):
    got = extract.point_statistics(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return got.select("l_suppkey", "n", *[F.round(c, k).alias(c) for c, k in (("mean_x", 4), ("mean_y", 2), ("std_x", 4), ("std_y", 2), ("r", 4))])


@query("""WITH f AS (SELECT l_orderkey, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND var_pop(l_quantity) > 1e-12)
          SELECT l_orderkey, l_linenumber, round(CASE WHEN m IS NOT NULL THEN (m * e + c) - (m * 20 + c) ELSE 5 END, 3) AS value
          FROM (SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 20) > abs(l_quantity + 5 - 20) THEN l_quantity ELSE l_quantity + 5 END AS e FROM lineitem) LEFT JOIN f USING (l_orderkey)""")
def bar_values(spark, d):
    li = t(spark, d, "lineitem")
    calibrations = fits.line_fit(li, ["l_orderkey"], "l_quantity", "l_extendedprice").withColumn("scale", F.lit("linear")).drop("n")
    bars = li.select("l_orderkey", "l_linenumber", F.lit(0.0).alias("x1"), F.col("l_quantity").alias("y1"), F.lit(1.0).alias("x2"), (F.col("l_quantity") + 5).alias("y2"), F.lit(0.9).alias("confidence"))
    got = extract.bar_values(bars, calibrations, F.lit(True), F.lit(20.0), ["l_orderkey"])
    return got.select("l_orderkey", "l_linenumber", F.round("value", 3).alias("value"))


# --- evaluation ----------------------------------------------------------------------------------

_ARMS = """a AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'base' ELSE 'new' END AS arm, avg(l_discount) AS f1, avg(l_tax) AS mae, avg(l_quantity) AS precision FROM lineitem GROUP BY 1),
           u AS (UNPIVOT a ON f1, mae, precision INTO NAME metric VALUE value),
           w AS (SELECT metric, max(value) FILTER (arm = 'base') AS base, max(value) FILTER (arm = 'new') AS new FROM u GROUP BY 1)"""


def _arms(spark, d):
    arm = F.when(F.col("l_orderkey") % 2 == 0, "base").otherwise("new").alias("arm")
    rows = t(spark, d, "lineitem").groupBy(arm).agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("mae"), F.avg("l_quantity").alias("precision"))
    return evaluate.deltas(rows, "arm", "base", "new", ["f1", "mae", "precision"])


@query(f"""WITH {_ARMS} SELECT metric, round(base, 6) AS base, round(new, 6) AS new, (new - base) * CASE metric WHEN 'mae' THEN -1 ELSE 1 END > 0 AS improved FROM w""")
def ab_deltas(spark, d):
    return _arms(spark, d).select("metric", F.round("base", 6).alias("base"), F.round("new", 6).alias("new"), "improved")


@query(f"""WITH {_ARMS} SELECT metric, (new - base) * CASE metric WHEN 'mae' THEN -1 ELSE 1 END >= -0.01 AS passed FROM w WHERE metric IN ('f1', 'mae')""")
def ab_gates(spark, d):
    return evaluate.gates(_arms(spark, d), {"f1": -0.01, "mae": -0.01}).select("metric", "passed")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS chart_type, count(*) FILTER (o_orderstatus = 'F') AS tp, count(*) AS n_gt, count(*) FILTER (o_orderstatus <> 'O') AS n_det FROM orders GROUP BY 1, 2),
               m AS (SELECT chart_type, CASE WHEN n_det > 0 THEN tp / n_det::double ELSE 0 END AS p, tp / n_gt::double AS r FROM c),
               f AS (SELECT chart_type, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
          SELECT chart_type, count(*) AS charts, round(avg(f1), 4) AS mean_f1, round(avg(precision), 4) AS mean_precision, round(stddev_samp(f1), 4) AS std_f1, round(avg((f1 <= 0)::int::double), 4) AS hard_failure_rate
          FROM f GROUP BY GROUPING SETS ((), (chart_type))""")
def detection_summary(spark, d):
    done = F.col("o_orderstatus")
    counts = t(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("chart_type")).agg(
        F.sum((done == "F").cast("int")).alias("tp"), F.count(F.lit(1)).alias("n_gt"), F.sum((done != "O").cast("int")).alias("n_det"), F.lit(0.0).alias("sum_iou"))
    got = evaluate.summary(evaluate.detection_metrics(counts), "chart_type", ["f1", "precision"])
    return got.select("chart_type", "charts", *[F.round(c, 4).alias(c) for c in ("mean_f1", "mean_precision", "std_f1", "hard_failure_rate")])


@query("""WITH th AS (SELECT unnest([0.02, 0.04, 0.06, 0.08]) AS threshold), g AS (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A'),
               s AS (SELECT threshold, count(*) AS n_det, count(*) FILTER (l_returnflag = 'A') AS tp FROM th JOIN lineitem ON l_discount >= threshold GROUP BY 1)
          SELECT threshold, n_det, tp, round(2 * (tp / n_det::double) * (tp / n::double) / (tp / n_det::double + tp / n::double), 4) AS f1 FROM s, g""")
def threshold_sweep(spark, d):
    li = t(spark, d, "lineitem").withColumn("hit", F.col("l_returnflag") == "A")
    truth = li.where("hit").count()  # one number
    return r4(evaluate.threshold_sweep(li, "l_discount", "hit", F.lit(truth), [0.02, 0.04, 0.06, 0.08]), "f1")


# --- routing, labels, text -----------------------------------------------------------------------


@query("""SELECT o_custkey AS cid, coalesce(max_by(o_orderpriority, (o_totalprice, o_orderpriority)) FILTER (o_orderpriority <> '5-LOW'), 'bar') AS chart_type FROM orders GROUP BY 1""")
def classifier_pick(spark, d):
    got = routing.best_class(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", ignored="5-LOW")
    return got.withColumnRenamed("o_custkey", "cid")


@query("""WITH s AS (SELECT user_id, event_id, value / 100 AS c FROM events), th AS (SELECT unnest([0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]) AS th),
               n AS (SELECT user_id, th FROM s, th WHERE c >= th - 1e-9 GROUP BY 1, 2 HAVING count(*) >= 3), m AS (SELECT user_id, max(th) AS th FROM n GROUP BY 1)
          SELECT s.user_id, event_id FROM s LEFT JOIN m USING (user_id) WHERE c >= coalesce(th, 0) - 1e-9""")
def adaptive_confidence(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100).alias("c"))
    return routing.adaptive_confidence(rows, ["user_id"], "c", 3).select("user_id", "event_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.04 AND l_tax < 0.03 THEN 'vlm' WHEN l_returnflag = 'N' AND l_tax >= 0.05 THEN 'hybrid' ELSE 'standard' END AS strategy FROM lineitem""")
def strategy_routing(spark, d):
    quality = F.when(F.col("l_returnflag") == "N", "uncalibrated").otherwise("high")
    chosen = S.strategy(F.lit("auto"), F.col("l_discount") * 10, F.col("l_tax") * 10, quality)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", chosen.alias("strategy"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents)
          SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS first, count(*) OVER (PARTITION BY digest) AS copies FROM h""")
def content_dedup(spark, d):
    return routing.content_dedup(t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query("""SELECT page_id, TRY_CAST(nullif(regexp_extract(replace(replace(url, ' ', ''), ',', '.'), '([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1), '') AS double) AS number,
                 regexp_matches(regexp_replace(url, '[,%$\\s]', '', 'g'), '^\\s*[-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?\\s*$') AS numeric FROM pages""")
def number_parse(spark, d):
    return t(spark, d, "pages").select("page_id", X.label_number(F.col("url")).alias("number"), X.is_numeric(F.col("url")).alias("numeric"))


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_size / 100.0 WHEN p_partkey % 3 = 1 THEN p_size * 1000.0 ELSE p_size END, 4)::double AS value,
                 CASE WHEN p_partkey % 3 = 0 THEN '%' WHEN p_partkey % 3 = 1 THEN '$' END AS unit FROM part""")
def unit_parse(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("~ "), size, F.lit(" %"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("$"), size, F.lit("k"))).otherwise(size)
    parsed = X.unit_number(text)
    return t(spark, d, "part").select("p_partkey", F.round(parsed["value"], 4).alias("value"), parsed["unit"].alias("unit"))


@query("""WITH l AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '<0x0A>|\\n'), lambda x: trim(x) <> '')) AS line FROM documents)
          SELECT doc_id, count(*) AS lines, sum(len(string_split_regex(line, '\\||&')))::bigint AS cells FROM l GROUP BY 1""")
def table_parse(spark, d):
    cells = t(spark, d, "documents").select("doc_id", X.table_cells(F.col("text")).alias("rows")).where(F.size("rows") > 0)
    return cells.select("doc_id", F.size("rows").cast("long").alias("lines"), F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + F.size(r)).alias("cells"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity / 51.0 AS nx, l_tax * 10 AS ny, l_discount AS w, l_discount / 2 AS h, l_returnflag = 'N' AS num, l_linestatus = 'O' AS v FROM lineitem),
               e AS (SELECT *, least(nx, 1 - nx, ny, 1 - ny) AS edge, exp(-((nx - 0.08) ** 2 + (ny - 0.5) ** 2) / (2 * 0.0081)) AS kl, exp(-((nx - 0.92) ** 2 + (ny - 0.5) ** 2) / (2 * 0.0081)) AS kr,
                            exp(-((nx - 0.5) ** 2 + (ny - 0.92) ** 2) / (2 * 0.0081)) AS kb, exp(-((nx - 0.5) ** 2 + (ny - 0.08) ** 2) / (2 * 0.0081)) AS kt,
                            CASE WHEN nx > 0.2 AND nx < 0.8 AND ny > 0.2 AND ny < 0.8 THEN exp(-((nx - 0.5) ** 2 + (ny - 0.5) ** 2) / 0.08) ELSE 0 END AS kc FROM f),
               s AS (SELECT l_orderkey, l_linenumber, num, edge, w < 0.08 AND h < 0.04 AS small,
                 round(CASE WHEN nx < 0.2 AND ny > 0.1 AND ny < 0.9 THEN 5 * kl ELSE 0 END + CASE WHEN nx > 0.8 AND ny > 0.1 AND ny < 0.9 THEN 4 * kr ELSE 0 END + CASE WHEN w < 0.08 AND h < 0.04 THEN 3 ELSE 0 END
                   + CASE WHEN v AND nx < 0.15 THEN 6 ELSE 0 END + CASE WHEN v AND nx > 0.85 THEN 5 ELSE 0 END + CASE WHEN NOT v AND ny > 0.85 THEN 5.5 ELSE 0 END + CASE WHEN num THEN 3 ELSE 0 END
                   + 2 * greatest((0.2 - edge) / 0.2, 0) - 3 * kc, 9) AS sc,
                 round(CASE WHEN nx > 0.15 AND nx < 0.85 AND ny > 0.8 THEN 6 * kb ELSE 0 END + CASE WHEN v AND ny > 0.75 THEN 7 ELSE 0 END + CASE WHEN NOT v AND nx < 0.25 THEN 6.5 ELSE 0 END + CASE WHEN NOT num THEN 2 ELSE 0 END - 1.5 * kc, 9) AS ti,
                 round(CASE WHEN nx > 0.15 AND nx < 0.85 AND ny < 0.15 THEN 4 * kt ELSE 0 END + CASE WHEN w > 0.15 OR h > 0.1 THEN 4 ELSE 0 END + CASE WHEN w / (h + 1e-6) > 5 OR w / (h + 1e-6) < 0.2 THEN 3.5 ELSE 0 END, 9) AS tt FROM e),
               m AS (SELECT *, greatest(sc, ti, tt) AS best, list_sort([sc, ti, tt])[3] - list_sort([sc, ti, tt])[2] AS margin FROM s),
               r AS (SELECT *, CASE WHEN best > CASE WHEN margin < 0.5 THEN 2.5 WHEN margin > 2 THEN 1.8 ELSE 2 END THEN CASE WHEN sc = best THEN 'scale' WHEN ti = best THEN 'tick' ELSE 'title' END
                            WHEN edge < 0.15 THEN 'scale' WHEN edge > 0.3 THEN 'tick' WHEN small OR num THEN 'scale' ELSE 'tick' END AS first FROM m)
          SELECT l_orderkey, l_linenumber, CASE WHEN first = 'scale' AND edge >= 0.25 THEN 'tick' WHEN first = 'tick' AND edge < 0.1 THEN 'scale' ELSE first END AS role FROM r""")
def label_roles(spark, d):
    rows = t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 51.0).alias("nx"), (F.col("l_tax") * 10).alias("ny"), F.col("l_discount").alias("w"),
        (F.col("l_discount") / 2).alias("h"), (F.col("l_returnflag") == "N").alias("numeric"), (F.col("l_linestatus") == "O").alias("vertical"),
    )
    return labels.roles(rows, "bar").select("l_orderkey", "l_linenumber", "role")


@query("SELECT o_custkey AS source_file, count(*) AS rows FROM orders GROUP BY 1")
def rows_per_asset(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("source_file")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_type, user_id % 4 AS class_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((), (event_type), (event_type, user_id % 4))")
def coverage_report(spark, d):
    ev = t(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("class_id"))
    return ev.groupingSets([[], ["event_type"], ["event_type", "class_id"]], "event_type", "class_id").agg(F.count(F.lit(1)).alias("n"))


# --- matching and clustering in numpy: no SQL form, tested against brute force ---------------------


@query()
def hungarian_match(spark, d):
    rows = _boxes(spark, d).withColumn("idx", F.col("l_linenumber").cast("long"))
    truth, found = rows.where("l_linenumber % 2 = 1"), rows.where("l_linenumber % 2 = 0")
    return assign.match_boxes(truth, found, "l_orderkey", 0.05)


@query()
def nms(spark, d):
    rows = _boxes(spark, d).join(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("conf")), ["l_orderkey", "l_linenumber"])
    return assign.suppressed(rows.withColumn("idx", F.col("l_linenumber").cast("long")), "l_orderkey", 0.3)


@query()
def dbscan_2d(spark, d):
    rows = t(spark, d, "lineitem").withColumn("y", F.col("l_tax") * 100)
    return cluster.dbscan_2d(rows.withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "l_suppkey", "k", "l_quantity", "y", 2.0, 3)


@query()
def gmm_bic(spark, d):
    return cluster.gmm_1d(t(spark, d, "lineitem"), "l_suppkey", "l_quantity")

