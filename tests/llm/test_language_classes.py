"""Every label has a class: rare ones, and more of them than any cap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.llm import language_fusion


def texts_of(number: int, rows: int, rng) -> list[str]:
    """Rows in a made-up language with an alphabet of its own."""
    letters = [chr(0x4E00 + 40 * number + i) for i in range(30)]
    words = ["".join(rng.choice(letters, 5)) for _ in range(25)]
    return [" ".join(rng.choice(words, 40)) for _ in range(rows)]


def judged(spark, rows):
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    model = language_fusion.fit(docs)
    got = language_fusion.identify(docs, model, F.col("lang"), F.lit(""), F.lit("one")).collect()
    return model, {r["doc_id"]: (r["lang"], r["kept"]) for r in got}


def test_a_rare_language_has_a_class(spark, monkeypatch):
    monkeypatch.setattr(language_fusion, "SAMPLE_ROWS", 20)
    rng = np.random.default_rng(0)
    rows = [(t, "aa") for t in texts_of(0, 4000, rng)] + [(t, "zz") for t in texts_of(1, 8, rng)] + [("equal rows " * 9, "ee")] * 50
    model, got = judged(spark, rows)
    assert model[0].languages == model[1].languages == ["aa", "ee", "zz", "und"]
    assert [got[i] for i in range(4000, 4008)] == [("zz", True)] * 8 and got[0] == ("aa", True)


def test_languages_are_not_capped(spark):
    rng = np.random.default_rng(0)
    rows = [(t, f"l{k:02}") for k in range(70) for t in texts_of(k, 16, rng)]
    model, got = judged(spark, rows)
    assert len(model[0].languages) == 71 and all(got[i] == (k, True) for i, (_, k) in enumerate(rows))


def test_sparse_and_dense_models_agree(monkeypatch):
    rng = np.random.default_rng(0)
    of, bucket, n = np.repeat([0, 1, 2], 500), np.concatenate([rng.permutation(language_fusion.BUCKETS)[:500] for _ in range(3)]), rng.integers(1, 99, 1500)
    dense = language_fusion.TextModel(["a", "b", "c"], of, bucket, n)
    monkeypatch.setattr(language_fusion, "DENSE", 2)
    sparse = language_fusion.TextModel(["a", "b", "c"], of, bucket, n)
    codes = rng.choice(np.r_[bucket, rng.integers(0, language_fusion.BUCKETS, 900)], 5000)
    assert sparse.table is None and dense.sums(codes).tolist() == sparse.sums(codes).tolist() == dense.table[codes].sum(axis=0).tolist()
    assert sparse.sums(codes[:0]).tolist() == [0] * 4
