"""The fused posterior against plain Python, held-out folds, and evidence from markup and addresses."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.llm import language_fusion as lf


def softmax(logs):
    top = max(logs)
    e = [math.exp(x - top) for x in logs]
    return [x / sum(e) for x in e]


def plain_posteriors(rows, models):
    """``rows``: (id, text, declared, suffix, host, fold). Posteriors by loops over whole rows, leaving each one's own part out."""
    n, none = len(models[0].languages), len(models[0].languages) - 1
    scores = [models[f].scores(None if t is None else t.encode()) for _, t, *_, f in rows]
    part = [None if s is None else [float(round(p * lf.UNIT)) for p in softmax(s)] for s in scores]
    zero = [0.0] * n
    host, suffix, said = defaultdict(lambda: list(zero)), defaultdict(lambda: list(zero)), defaultdict(lambda: list(zero))
    whole, stated = list(zero), list(zero)
    for (_, _, d, s, h, _), p in zip(rows, part):
        for k in range(n) if p else ():
            host[s, h][k] += p[k]
            suffix[s][k] += p[k]
            whole[k] += p[k]
            if d is not None:
                said[d][k] += p[k]
                stated[k] += p[k]
    out = {}
    for (i, _, d, s, h, _), sc, p in zip(rows, scores, part):
        if p is None:
            out[i] = ("und", 0.0)
            continue
        start = [1 / max(1, n - 1) / (1 + lf.NONE_PRIOR)] * n
        start[none] = lf.NONE_PRIOR / (1 + lf.NONE_PRIOR)
        prior = [(whole[k] - p[k] + start[k] * lf.UNIT) / (sum(whole) + lf.UNIT - sum(p)) for k in range(n)]
        for counts, strength in ((suffix[s], lf.SUFFIX_STRENGTH), (host[s, h], lf.HOST_STRENGTH)):
            left = [max(c - q, 0) for c, q in zip(counts, p)]
            prior = [(left[k] + strength * lf.UNIT * prior[k]) / (sum(left) + strength * lf.UNIT) for k in range(n)]
        logs = [sc[k] + math.log(max(prior[k], 1e-12)) for k in range(n)]
        if d is not None and d in said:
            logs = [x + math.log((max(said[d][k] - p[k], 0) + lf.UNIT / (len(said) + 1)) / (max(stated[k] - p[k], 0) + lf.UNIT)) for k, x in enumerate(logs)]
        post = softmax(logs)
        best = max(range(n), key=lambda k: post[k])
        out[i] = (models[0].languages[best], round(post[best], 6))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    words = {k: ["".join(rng.choice(list(a), int(rng.integers(2, 7)))) for _ in range(60)] for k, a in (("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "xyzuvw"))}
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    docs = spark.createDataFrame([(i, text(k, 60), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)], "doc_id long, text string, lang string")
    rows = [(i, text(k, int(n)), d, s, h) for i, (k, n, d, s, h) in enumerate(
        (k, rng.choice([1, 2, 5, 40]), d, s, f"{k}{rng.integers(0, 3)}.{s}") for k in ("aa", "bb", "cc") for _ in range(40) for d, s in [(rng.choice(["aa", "bb", "cc"], p=[0.2, 0.2, 0.6]), rng.choice(["x", "y"]))])]
    rows = [(i, t, None if i % 7 == 0 else str(d), str(s), h) for i, t, d, s, h in rows]
    rows += [(900, None, "aa", "x", "aa0.x"), (901, "", None, "", ""), (902, "eg", "bb", "x", "new.x"), (903, "gef hij", None, "x", "new.x"), (5, "gef hij", None, "x", "new.x")]
    rows += rows[:2] + [(904, text("cc", 40) + " word" * 300_000, "cc", "y", "cc0.y")]  # longer than one piece
    return docs, rows, lf.fit(docs)


def test_posterior_is_that_of_plain_python(spark, fitted):
    _, rows, models = fitted
    table = spark.createDataFrame([(*r, 0.5, "clash") for r in rows], "doc_id long, text string, d string, s string, h string, posterior double, scores string").repartition(3)
    folds = {(r["doc_id"], r["text"]): r["f"] for r in table.select("doc_id", "text", lf.fold_of(F.col("text")).alias("f")).collect()}
    wanted = plain_posteriors([(j, *r[1:], folds[r[0], r[1]]) for j, r in enumerate(rows)], models)
    got = lf.identify(table, models, F.col("d"), F.col("s"), F.col("h")).collect()
    wanted = Counter((rows[j][0], lang, f"{p:.5f}") for j, (lang, p) in wanted.items())
    assert Counter((r["doc_id"], r["lang"], f"{r['posterior']:.5f}") for r in got) == wanted
    assert set(lf.identify(table.limit(0), models, F.col("d"), F.col("s"), F.col("h")).collect()) == set()


def test_model_is_counted_over_the_other_fold(fitted):
    docs, _, models = fitted
    rows = docs.select("text", "lang", lf.fold_of(F.col("text")).alias("f")).collect()
    for f, model in enumerate(models):
        for k, language in enumerate(model.languages[:-1]):
            counts = Counter(int(c) for r in rows if r["f"] != f and r["lang"] == language for c in lf.trigrams(r["text"].encode()))
            total = sum(counts.values()) + 0.05 * lf.BUCKETS
            for bucket in [*list(counts)[:50], 1, 2, 3]:
                assert model.table[bucket, k] == round(math.log((counts[bucket] + 0.05) / total) * 1024)


def test_a_suffix_speaks_for_its_new_hosts(spark, fitted):
    """Without telling text, an unknown host goes with the language of its suffix's other hosts."""
    docs, _, models = fitted
    base = [(r["doc_id"], r["text"], "t" + r["lang"][0], f"h{r['doc_id']}") for r in docs.collect()]
    rows = base + [(900 + n, "efg", f"t{k}", "new") for n, k in enumerate("ab")]
    got = {r["doc_id"]: r["lang"] for r in lf.identify(spark.createDataFrame(rows, "doc_id long, text string, s string, h string"), models, F.lit(None), F.col("s"), F.col("h")).collect()}
    assert got[900] == "aa" and got[901] == "bb"


def test_markup_and_address(spark):
    pages = [
        ('<!DOCTYPE html><html lang="fr-CA"><body>x</body>', "https://Blog.Example.co.uk/a?b", "fr", "co.uk", "blog.example.co.uk"),
        ("<HTML class=a LANG=DE>", "http://a.de", "de", "de", "a.de"), ("<html xml:lang='es' lang='es'>", "none", "es", "", ""),
        ("<html data-lang='xx'><p lang='it'>", None, None, "", ""), (None, "", None, "", ""), ("", "http://1.2.3.4/", None, "", "1.2.3.4"),
    ]
    rows = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(pages)], "i int, html string, url string")
    got = rows.select("i", lf.declared_in(F.col("html")), *lf.address(F.col("url"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [p[2:] for p in pages]
    html = "<p>one</p><script>var t='</p>';\nx()</script><!-- a <b> --><style>p{}</style>two"
    assert spark.range(1).select(lf.visible(F.lit(html)).alias("t")).first()["t"].split() == ["one", "two"]
