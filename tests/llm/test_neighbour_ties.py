"""Neighbours: ties, recall on the given table and the work done for it."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from abacist.llm import pstable_ann
from abacist.llm.queries import op7_pstable_ann

SF = "/root/testdata/sf0.01"


def test_ties_go_to_the_smaller_id(spark):
    """500 different vectors with one product with the query, besides worse ones and a clashing column."""
    rng = np.random.default_rng(5)
    rest = rng.normal(size=(500, 7))
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    rows = [(0, [1.0] + [0.0] * 7, 1)] + [(i + 1, [0.5, *x], 2) for i, x in enumerate(rest.tolist())]
    rows += [(1000 + i, [0.25, *x], 3) for i, x in enumerate(rest[:300].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(5)
    got = pstable_ann.search(table, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and {r["score"] for r in got} == {0.5}


def test_recall_and_work_on_the_given_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, v = np.array(t["vec_id"]), np.array(t["embedding"], dtype=np.float64)
    got: dict[int, list[int]] = {}
    for r in op7_pstable_ann(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = wanted = 0
    for q in np.flatnonzero(ids % 20 == 0):
        order = [int(ids[i]) for i in np.lexsort((ids, -(v @ v[q]))) if i != q][:20]
        hits, wanted = hits + len(set(order) & set(got[ids[q]])), wanted + len(order)
    assert hits >= 0.9 * wanted
    hashing = pstable_ann.Hashing(v)
    keys, sure, _ = hashing.visits(v[::20], 20)
    tables = [np.unique(c, return_inverse=True) for c in hashing.index_keys(v).T]
    scored = pstable_ann._candidates(tables, keys)[sure].sum() + len(v) * (~sure).sum()
    assert scored < len(v) * len(sure)  # fewer pairs than brute force
