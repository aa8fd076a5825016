"""Every stage of the pipeline on hard rows, against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.llm import credential_links, language_fusion

pipeline = pytest.importorskip("corpus_pipeline")
BODY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (3, BODY), (4, BODY + " x"), (4, BODY + " x"), (2, "other words stand here in a row of nine words"), (2, "other words stand here in a row of nine words"),
    (None, BODY), (None, BODY), (None, "nobody else has these words and there is no id"), (None, "nobody else has these words and there is no id"),
    (None, None), (None, None), (None, " \n"), (9, None), (9, None), (10, ""), (11, "password=hunter2hunter2 and more words"), (12, "word " * 40_000),
    (7, "a text of id seven that is unlike the other one"), (7, "another text of id seven, quite different from that"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, row int, _key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 else "s", k, None, 1, 2, "x") for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(3)


def as_rows(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def test_no_documents(spark, docs):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_keep_one_row_of_each_group(spark, docs):
    kept = pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    seven = min(t for i, t in ROWS if i == 7)
    wanted = [(3, BODY), (2, ROWS[3][1]), (None, ROWS[7][1]), (None, None), (None, None), (None, " \n"), (9, None), (10, ""), ROWS[15], ROWS[16], (7, seven)]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def test_language_keeps_what_is_judged_kept(spark):
    rng = np.random.default_rng(0)
    words = {k: ["".join(rng.choice(list(a), 5)) for _ in range(40)] for k, a in (("aa", "abcdef"), ("bb", "uvwxyz"))}
    rows = [(i, " ".join(rng.choice(words[k], 50)), k, "s", 1) for i, k in enumerate(["aa", "bb"] * 30)]
    rows += [(i, t, "aa", None, 1) for i, t in [(100, None), (101, ""), (102, "ab"), (103, "€†‡•…‰" * 40), (None, rows[0][1]), (0, "£¥¢" * 90)]] + rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = language_fusion.identify(docs, language_fusion.fit(docs), F.col("lang"), F.lit(""), F.col("source")).collect()
    keys = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()
    gone = {(r["doc_id"], r["text_key"]) for r in judged if not r["kept"]}
    wanted = sorted(repr(tuple(r)[:5]) for r in keys if (r["doc_id"], r["k"]) not in gone)
    assert as_rows(pipeline.language(spark, docs, "")) == wanted and len(wanted) == 63


def test_secrets_leave_everything_else_alone(spark, docs):
    got = pipeline.secrets(spark, docs, "")
    hide = lambda t: None if t is None else re.sub(credential_links.STRONG["assign"][0], "[secret]", t)
    wanted = []
    for r in docs.collect():
        d = r.asDict()
        d["text"] = hide(d["text"])
        d["n_chars"] = None if d["text"] is None else len(d["text"])
        wanted.append(repr(tuple(d.values())))
    assert got.columns == docs.columns and as_rows(got) == sorted(wanted)


def test_packing_places_every_token_once(spark, docs):
    from tokenizers import Tokenizer

    from abacist.llm.queries import tokenizer_file

    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    wanted = sorted((repr(i), len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ROWS)
    got = pipeline.packing(spark, docs, "").collect()
    assert sum(r["length"] for r in got) == sum(n for _, n in wanted)
    assert sorted(repr(r["doc_id"]) for r in got if r["piece"] == 0) == [i for i, _ in wanted]
    at: dict = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
