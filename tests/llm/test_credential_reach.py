"""Linking by true distances, against a brute-force comparison of all pairs."""

import re

import numpy as np
import pytest

from abacist.llm import credential_links as links


def brute(text: str) -> str:
    found = [(m.start(), n, k, m.end()) for n, k in enumerate(links.KINDS) for p, group, least in [(links.STRONG | links.WEAK)[k]]
             for m in re.finditer(p.replace("(?i:", "(?ai:"), text) if len(m[group]) >= least]
    near = lambda a, b: b[0] - a[3] <= links.REACH and a[0] - b[3] <= links.REACH
    kept = [a for a in found if all(any(links.ROLES[b[2]] == role and near(a, b) for b in found) for role in links.NEEDS.get(a[2], ()))]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(kept))


def spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["spans"] for r in links.digests(rows).orderBy("doc_id").collect()]


def test_links_do_not_depend_on_alignment(spark):
    body = "user=bob" + " filler" * 50 + " password=hunter2hunter2"
    got = spans(spark, [" " * n + body for n in range(0, 600, 37)])
    assert all(f"account:{n}:{n + 8}" in x for n, x in zip(range(0, 600, 37), got))


@pytest.mark.parametrize("extra,linked", [(0, True), (1, False)])
def test_links_end_at_the_reach(spark, extra, linked):
    gap = " " * (1024 + extra)
    for got in spans(spark, [" " * n + x + "\n" for n in (0, 255) for x in ("user=bob" + gap + "password=hunter2hunter2", "password=hunter2hunter2" + gap + "user=bob")]):
        assert ("account" in got) is linked


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    parts = ["user=bob ", "password=hunter2hunter2 ", "https://db.example.com/x ", "AKIAABCDEFGHIJKL12 ", "aB3" * 13 + "c ", "0123456789abcdef" * 2 + " ", "0123456789abcdef" * 90 + " "]
    filler = [" " * int(n) for n in (1, 40, 300, 700, 1010, 1024, 1500)]
    texts = ["".join(str(rng.choice(x)) for _ in range(int(rng.integers(1, 14))) for x in (parts, filler)) for _ in range(150)]
    texts += ["".join(str(rng.choice(x)) for _ in range(400) for x in (parts[:6], filler)), "", "nothing"]
    assert spans(spark, texts) == [brute(t) for t in texts]


def test_links_name_the_nearest_partner_and_move_with_the_text(spark):
    body = "login=ann x password=hunter2hunter2 https://db.example.com/x AKIAABCDEFGHIJKL12"
    rows = spark.createDataFrame([(n, "é" * n + "\n" + body, 1, "x") for n in (0, 1, 200, 255, 256, 1023, 1025)], "doc_id long, text string, links int, all_spans string")
    for r in links.digests(rows).collect():
        n = r["doc_id"] + 1
        back = re.sub(r"\d+", lambda m: str(int(m[0]) - n), r["links"])
        assert back == "account:0:9>assign:12:35,endpoint:36:60>access:61:79,endpoint:36:60>assign:12:35"
    hidden = links.masked(rows)
    assert hidden.columns == rows.columns
    assert {r["text"] for r in hidden.collect()} == {"é" * r["doc_id"] + "\n[secret] x [secret] [secret] [secret]" for r in rows.collect()}


def test_masking_is_that_of_all_spans(spark):
    rng = np.random.default_rng(1)
    parts = ["user=bob", "password=hunter2hunter2", "token=AKIAABCDEFGHIJKL12", "AKIAABCDEFGHIJKL12", "aB3" * 13 + "c", "0123456789abcdef" * 90, "ü日😀 "]
    filler = ["", " ", "\n" * 3, "x " * 600, "é" * 1024 + " "]
    texts = ["".join(str(rng.choice(x)) for _ in range(int(rng.integers(0, 20))) for x in (parts, filler)) for _ in range(120)]
    texts.append("".join(str(rng.choice(x)) for _ in range(5000) for x in (parts, filler)))  # MBs, thousands of spans
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in links.masked(rows).collect()}
    for n, listed in enumerate(spans(spark, texts)):
        out, at = [], 0
        for _, a, b in (x.split(":") for x in listed.split(",") if x):
            if int(a) >= at:
                out += [texts[n][at : int(a)], "[secret]"]
            at = max(at, int(b))
        assert got[n] == "".join(out) + texts[n][at:]
