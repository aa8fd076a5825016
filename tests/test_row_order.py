"""Results that depend on the rows, not on their order or on the last bits of sums."""

from abacist.operators import cluster
from abacist.plans import queries, rule_queries, value_queries

POINTS = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double"


def both_ways(spark, folder, rows, fields, query, table="lineitem"):
    """The query's rows on a table and on its reverse."""
    got = []
    for name, part in (("ahead", rows), ("back", rows[::-1])):
        spark.createDataFrame(part, fields).coalesce(1).write.parquet(f"{folder}/{name}/{table}.parquet")
        got.append(sorted(tuple(r) for r in query(spark, f"{folder}/{name}").collect()))
    return got


def test_area_of_equal_places(spark, tmp_path):
    rows = [(1, 1, 4681, 15.0, 18136.83, 0.0), (1, 6, 19799, 37.0, 38480.13, 0.0), (1, 1, 9243, 8.0, 32179.51, 0.02), (1, 1, 12438, 35.0, 27686.45, 0.04),
            (1, 1, 8636, 42.0, 71252.19, 0.09), (1, 1, 8636, 11.0, 66629.61, 0.09)]
    # exactly 1344112.497 + 0.003
    rows += [(2, 2, 18265, 48.0, 11331.2, 0.06), (2, 6, 9483, 30.0, 77428.06, 0.06), (2, 7, 4608, 49.0, 36750.46, 0.03), (2, 1, 8706, 31.0, 25976.23, 0.03)]
    ahead, back = both_ways(spark, tmp_path, rows, POINTS, value_queries.area_summary)
    assert ahead == back
    assert ahead[1] == (2, 4, 68526.69, 1344113.0)


def test_association_of_equal_pairs(spark, tmp_path):
    fields = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    rows = [(1, 2, 4999, 49.0, 0.1, "A", "F"), (1, 2, 19770, 23.0, 0.01, "R", "F"), (1, 5, 14660, 24.0, 0.09, "R", "O"), (1, 5, 6961, 50.0, 0.09, "N", "F")]
    ahead, back = both_ways(spark, tmp_path, rows, fields, queries.ranked_association)
    assert ahead == back == [(1, 2, 5, "direct_overlap", 0.9)]


def test_label_of_equal_bars(spark, tmp_path):
    # simple layouts (o % 3 = 2), bars 2 and 6 equal but for their number
    rows = [(o, n, q, 1000.0, d, 0.02) for o in range(2, 62, 3) for n, q, d in ((1, 43.0, 0.05), (6, 8.0, 0.06), (4, 47.0, 0.09), (2, 8.0, 0.06), (7, 23.0, 0.02))]
    fields = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    ahead, back = both_ways(spark, tmp_path, rows, fields, rule_queries.shared_labels)
    assert ahead == back == sorted((o, n, n % 2) for o in range(2, 62, 3) for n in (2, 7))


def test_point_at_twice_the_mean_distance(spark):
    ends = [(a, b) for a in range(1, 50) for b in range(0, 41, 4)]
    rows = [(i, float(x), float(y)) for i, e in enumerate(ends) for x, y in ((0, 0), (0, 0), (0, 0), e)]
    rows += [(-1, float(x), 0.0) for x in (0, 0, 0, 0, 9)]  # beyond twice the mean
    got = cluster.point_features(spark.createDataFrame(rows, "o long, x double, y double"), ["o"], "x", "y").collect()
    assert {r.o: r.outlier_ratio for r in got} == {-1: 0.2} | dict.fromkeys(range(len(ends)), 0.0)


BARS = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"


def test_orientation_of_equal_spreads(spark, tmp_path):
    # the y centres' spread is exactly twice that of the x centres
    rows = [(17858, 6, 7.0, 45677.44, 0.08, 0.07), (17856, 7, 40.0, 61460.26, 0.08, 0.02), (17857, 4, 41.0, 81960.81, 0.09, 0.02),
            (17858, 5, 49.0, 81644.81, 0.07, 0.05), (17857, 3, 7.0, 55904.08, 0.05, 0.07), (17858, 5, 49.0, 13646.05, 0.04, 0.07),
            (17857, 2, 10.0, 30923.26, 0.07, 0.02)]
    ahead, back = both_ways(spark, tmp_path, rows, BARS, queries.orientation_cv)
    assert ahead == back == [(4464, 7, "vertical", 0.71429, "majority_vote")]


def test_orientation_is_rounded_as_in_sql(spark, tmp_path):
    rows = [(129088, 3, 9.0, 3430.89, 0.04, 0.02), (129090, 5, 26.0, 57151.86, 0.08, 0.05), (129090, 2, 21.0, 71186.63, 0.05, 0.05),
            (129088, 2, 45.0, 90071.28, 0.08, 0.05), (129088, 5, 11.0, 28320.68, 0.06, 0.08), (129091, 7, 1.0, 15870.96, 0.02, 0.01),
            (129088, 5, 38.0, 24596.5, 0.08, 0.07), (129091, 1, 27.0, 55744.02, 0.04, 0.0), (129091, 5, 2.0, 35809.6, 0.05, 0.01),
            (129089, 4, 34.0, 98458.04, 0.0, 0.05), (129090, 6, 25.0, 26488.81, 0.09, 0.01), (129088, 6, 20.0, 93269.9, 0.06, 0.03),
            (129091, 7, 28.0, 90186.84, 0.09, 0.03), (129088, 3, 17.0, 58683.84, 0.03, 0.02), (129089, 5, 32.0, 39913.4, 0.03, 0.01),
            (129089, 1, 2.0, 66690.5, 0.03, 0.08), (129091, 6, 15.0, 80743.34, 0.06, 0.0), (129088, 4, 32.0, 5058.16, 0.1, 0.06),
            (129088, 2, 23.0, 65164.8, 0.03, 0.0), (129091, 2, 50.0, 48357.27, 0.07, 0.03), (129091, 2, 26.0, 69257.85, 0.04, 0.05),
            (129088, 1, 6.0, 74596.93, 0.1, 0.04), (129088, 5, 2.0, 42529.7, 0.04, 0.04), (129090, 7, 47.0, 77627.43, 0.08, 0.07)]
    ahead, back = both_ways(spark, tmp_path, rows, BARS, queries.orientation_cv)
    assert ahead == back == [(32272, 24, "vertical", 0.26582, "aspect_ratio")]
