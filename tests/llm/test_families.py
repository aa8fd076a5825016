"""Large families of near copies: no link is lost, and near copies of one text aren't compared in all pairs of blocks."""

import numpy as np
import pytest

from abacist.llm import superminhash


def chained(rng, n: int) -> list[str]:
    """Near copies of a base, and chains that drift away from it, so that families have several components."""
    words = [f"w{i}" for i in range(60)]
    base = [str(w) for w in rng.choice(words, 50)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(int(rng.integers(0, 3)) if i % 3 else int(rng.integers(2, 7))):
            text[int(rng.integers(0, len(text)))] = f"x{rng.integers(0, 40)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(superminhash, "FAMILY_BLOCK", block)
    monkeypatch.setattr(superminhash, "FEW", 3)
    rng = np.random.default_rng(2)
    texts = [t for _ in range(3) for t in chained(rng, 60)]
    texts += texts[:4]
    shingles = superminhash.Shingler(3)
    sets = [set(shingles(t.encode()).tolist()) for t in texts]
    up = superminhash.Forest(len(texts))
    for i, a in enumerate(sets):
        for k in range(i):
            if 100 * len(a & sets[k]) >= 85 * len(a | sets[k]):
                up.unite(i, k)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(rows, 3, 85).collect()}
    assert got == {i: up.root(i) for i in range(len(texts))} and 3 < len(set(got.values())) < 150


def test_one_family_of_near_copies_costs_its_size(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "FAMILY_BLOCK", 16)
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    sent = []
    verified = superminhash._verified
    monkeypatch.setattr(superminhash, "_verified", lambda tasks, *rest: (sent.append(tasks.count()), verified(tasks, *rest))[1])
    rows = spark.createDataFrame([(i, " ".join([*words, f"end{i}"])) for i in rng.permutation(800).tolist()], "doc_id long, text string")
    got = superminhash.near_duplicates(rows, 5, 80).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    assert sum(sent) < 1.1 * 800 + 51  # all pairs of blocks: 800 x 50 rows
