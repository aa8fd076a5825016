"""The posterior bound and the registered domain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.llm import url_reputation


@pytest.mark.parametrize("a,b", [(0.02, 0.5), (0.5, 0.5), (1.0, 1.0), (1.0, 3.0), (8.0, 0.7), (30.0, 4.0), (900.0, 1500.0)])
def test_quantile_against_draws(spark, a, b):
    rows = spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"))
    got = url_reputation.beta_quantile(rows, F.col("a"), F.col("b"), 0.05, "bound").first()["bound"]
    draws = np.random.default_rng(0).beta(a, b, 400_000)
    assert 0 <= got <= 1 and abs((draws < got).mean() - 0.05) < 0.002


def test_closed_forms(spark):
    """Beta(1, 1) is uniform, Beta(a, 1) has the quantile p^(1/a)."""
    rows = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "a double")
    got = url_reputation.beta_quantile(rows, F.col("a"), F.lit(1.0), 0.05, "q").collect()
    assert all(abs(r["q"] - 0.05 ** (1 / r["a"])) < 1e-3 for r in got)


def test_sites_below_a_double_suffix_stay_apart(spark):
    """A bad site of co.uk doesn't lower its unlabelled neighbour as one of its own domain does."""
    rows = [(i, f"http://bad.shop.co.uk/{i}", 0) for i in range(40)] + [(100 + i, f"http://a{i}.org.uk/", 1) for i in range(40)]
    rows += [(200, "http://new.shop.co.uk/", None), (201, "http://other.co.uk/", None), (202, "http://1.2.3.4:80/", None), (203, "http://" + "l." * 5000 + "com/" + "p" * 100_000, None)]
    table = spark.createDataFrame([(*r, "clash", 1.0) for r in rows + rows[:2]], "page_id long, url string, good int, host string, rate double")
    got = {r["page_id"]: r for r in url_reputation.judge(table, table.select("page_id", "good"), []).collect()}
    assert got[200]["rate"] < got[201]["rate"] and len(got) == len(rows)
    domain, suffix = url_reputation.site(F.col("h"), url_reputation.DOUBLE_SUFFIXES)
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.com",), ("com",), ("",), ("1.2.3.4",)], "h string")
    assert [tuple(r) for r in hosts.select(domain, suffix).collect()] == [
        ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", ""), ("1.2.3.4", "")]
