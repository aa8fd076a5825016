"""The training-data operators against brute force, libraries and exact round trips, with hard rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacist.llm import (byte_bpe, credential_links, language_fusion, mjpeg_avi, piece_bpe, pstable_ann, sos_packing, superminhash,  # noqa: I001
                         token_files, url_reputation, warc_bundles)
from abacist.llm.queries import RULES, tokenizer_file

LONG = "word lorem ipsum dolor " * 3000
HARD = [
    (0, None), (1, ""), (2, "  "), (3, "one"), (4, "Hello  wörld\n\n\t日本語 \x00 <s> <|endoftext|> 😀 don't"), (5, LONG), (6, "twin text here"),
    (7, "twin text here"), (7, "twin text here"), (None, "no id here at all"), (8, "a b c d e f g h"), (9, "A B c d e f g h"), (10, "x y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "clash") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, content string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_url_rules(spark):
    urls = {
        1: ("https://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"), 2: ("http://x.org/y#z", "x.org", "/y", "org/", "allow"),
        3: ("http://b.com/fr/a", "b.com", "/fr/a", "com/fr/", "allow"), 4: ("no scheme", "", "", None, None), 5: (None, "", "", None, None),
        6: ("http://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"), 7: ("http://notexample.org", "notexample.org", "", None, None),
    }
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in urls.items()] + [(None, "http://n.net/", "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "page_id long, good int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages.select("page_id", "url"), labels, RULES).collect()}
    for i, (_, host, path, rule, verdict) in urls.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("allow" if got[i]["bound"] >= url_reputation.LEAST else "block"))
    assert len(got) == 8
    assert url_reputation.judge(pages.limit(0).select("page_id", "url"), labels, RULES).count() == 0


def test_reputation_shrinks(spark):
    good = [(f"good{i}.com", j, 1) for i in range(20) for j in range(10)]
    bad = [(f"bad{i}.net", j, int(j == 0)) for i in range(20) for j in range(10)]
    rows = [(k, f"http://{h}/{j}", g) for k, (h, j, g) in enumerate(good + bad)] + [(999, "http://new.com/", None), (998, "http://new.net/", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, good int")
    got = {r["page_id"]: r for r in url_reputation.judge(table.select("page_id", "url"), table.select("page_id", "good"), []).collect()}
    assert got[0]["verdict"] == "allow" and got[399]["verdict"] == "block" and got[999]["rate"] > 0.7 > 0.3 > got[998]["rate"]


def test_warc(spark):
    html = {1: "<p>x</p>", 2: None, 3: "", 4: "<p>x</p>", 5: "ü" * 700_000, 6: "<p>y</p>", None: "<p>x</p>"}
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", h, 1) for i, h in html.items()], "page_id long, url string, html string, frame int")
    index = warc_bundles.write(pages)
    got = {r["page_id"]: r for r in warc_bundles.read(index).collect()}
    for i, h in html.items():
        data = (h or "").encode()
        first = min((j for j, g in html.items() if (g or "") == (h or "") and j is not None), default=None)
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == warc_bundles.base32_sha1(data)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    place = index.where("page_id = 6").first()  # one record by its place alone
    head, block, _ = warc_bundles.parse(warc_bundles.BundleReader(place["bundle"]).frame(place["frame"]), place["offset"])
    assert head["WARC-Record-ID"] == f"<{place['record_id']}>" and block.endswith(b"<p>y</p>")
    assert warc_bundles.read(warc_bundles.write(pages.limit(0))).count() == 0


def test_language(spark):
    rng = np.random.default_rng(0)
    words = {"xx": ["alpha", "beton", "carro", "delta"], "yy": ["ßumpf", "köning", "zwoll", "trüb"]}
    rows = [(i, " ".join(rng.choice(words[k], 60)), k, f"{k}.site") for i, k in enumerate(["xx", "yy"] * 150)]
    rows += [(900, None, None, None), (901, "", "xx", "xx.site"), (902, " ".join(rng.choice(words["yy"], 60)), "xx", "xx.site"), (None, " ".join(words["xx"] * 9), None, "n"),
             (903, "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 400))), "xx", "xx.site"), (904, " ".join(rng.choice(words["yy"], 60)), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_id", F.lit(1))
    model = language_fusion.fit(docs.where("doc_id < 200"))  # held out: the others
    judged = language_fusion.identify(docs, model, F.col("lang"), F.lit(None), F.col("source"))
    got = {r["doc_id"]: (r["lang"], r["kept"]) for r in judged.collect()}
    assert all(got[i] == (k, True) for i, k in enumerate(["xx", "yy"] * 150))
    assert got[900] == got[901] == ("und", False) and got[902] == got[904] == ("yy", True) and got[903][1] is False and got[None] == ("xx", True)
    left = language_fusion.filtered(docs, judged)
    assert left.columns == docs.columns and left.count() == len(rows) - 3
    nothing = language_fusion.fit(docs.limit(0))
    assert nothing[0].languages == ["und"] and language_fusion.identify(docs.limit(0), nothing, F.col("lang"), F.lit(""), F.col("source")).count() == 0
    assert language_fusion.identify(docs, nothing, F.col("lang"), F.lit(""), F.col("source")).where("kept").count() == 0


def test_byte_bpe_is_the_library():
    bpe, rng = byte_bpe.ByteBpe(tokenizer_file("byte_bpe_50k.json")), np.random.default_rng(0)
    texts = ["".join(rng.choice(list(" \n\ta1'é.,²日\x1cß"), rng.integers(0, 16))) for _ in range(1500)] + [t or "" for _, t in HARD]
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_token_files(spark, docs, empty):
    path = tokenizer_file("byte_bpe_50k.json")
    bpe, start = byte_bpe.encoder(path), 0
    got = [tuple(r) for r in token_files.read(token_files.write(docs, path, 2)).collect()]
    got.sort(key=lambda r: r[1])
    for (i, text), row in zip(sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0)), got):
        ids = bpe.encode(text or "") + np.array([2], "<u4").tobytes()
        assert row == (i, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert len(got) == len(HARD) and token_files.read(token_files.write(empty, path, 2)).count() == 0


def test_piece_bpe_is_the_library(spark, docs, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    bpe, rng = piece_bpe.PieceBpe(path), np.random.default_rng(0)
    texts = ["".join(rng.choice(list(" \n\ta1'é.▁,日\x00<s²"), rng.integers(0, 16))) for _ in range(1500)]
    encoded, differing = bpe.encode_all(texts)
    assert differing == 0
    for text, ids in zip(texts, encoded):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert "".join(bpe.agenda(text)) == text
    got = piece_bpe.encode_decode(docs, path).collect()
    wanted = sorted((str(i), hashlib.sha256(np.array(ids := bpe.library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(bpe.library.decode(ids).encode()).hexdigest()) for i, t in HARD)
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in got) == wanted
    assert piece_bpe.encode_decode(empty, path).count() == 0


BASE = {"assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}


def test_credentials(spark, docs, empty):
    rng = np.random.default_rng(0)
    parts = ["password=", "Token: ", "api_key='", "AKIA", "AKIAABCDEFGHIJKL12", "0123456789abcdef" * 2, "abc", "secretsecret", " ", "é😀", "=", "hunter2hunter2", "\n", "passwd:", "https://db.example.com/x ", "user=bob "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(400)] + ["x" * 5000 + "password=abcdefgh " * 700, None, "", "password=token: abcdefghij"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in credential_links.digests(rows).collect():
        text, found = texts[r["doc_id"]] or "", []
        for k, (pattern, group, least) in enumerate(BASE.values()):
            found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
        listed = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), repr(text[:200])
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == k for f in found) for k in range(3)]
    assert credential_links.digests(docs).count() == len(HARD) and credential_links.digests(empty).count() == 0


def test_weak_candidates_need_company(spark):
    far = " filler" * 200
    texts = ["user=bob went home", "user=bob password=hunter2hunter2", "see https://db.example.com/x", "AKIAABCDEFGHIJKL12 https://db.example.com/x password=hunter2hunter2",
             "user=bob" + far + "password=hunter2hunter2"]
    got = [r["spans"] for r in credential_links.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == "" and got[2] == "" and got[1].startswith("account:0:8,assign:") and "endpoint:19:" in got[3] and "account" not in got[4]


def test_masking(spark):
    rows = spark.createDataFrame([(1, "é password=hunter2hunter2 end", 1), (2, "clean", 2), (3, None, 3), (4, "token=AKIAABCDEFGHIJKL12", 4)], "doc_id long, text string, base int")
    got = {r["doc_id"]: r["text"] for r in credential_links.masked(rows).collect()}
    assert got == {1: "é [secret] end", 2: "clean", 3: None, 4: "[secret]"} and credential_links.masked(rows).columns == rows.columns


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    center = rng.normal(size=(6, 16))
    vectors = (center[rng.integers(0, 6, 1200)] + 0.6 * rng.normal(size=(1200, 16))).astype("f4")
    vectors[100:400] = vectors[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (None, [1.0] * 16), (5060, [1.0, 2.0])]
    rows[5] = (5, [None] + [1.0] * 15)
    table = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>")
    got = pstable_ann.search(table, F.col("vec_id") % 20 == 0, 20).collect()
    exact = vectors.astype("f8")
    found: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float(exact[r["query_id"]] @ exact[r["vec_id"]])) < 1e-9
    hits = 0
    for q in range(0, 1200, 20):
        score = exact @ exact[q]
        order = [int(i) for i in np.lexsort((np.arange(1200), -np.round(score, 10))) if i not in (q, 5)][:20]
        assert len(found[q]) == 20 and q not in found[q]
        hits += len(set(order) & set(found[q]))
    assert set(found) == set(range(0, 1200, 20)) and hits >= 0.9 * 60 * 20
    assert pstable_ann.search(table.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_neighbours_beside_an_outlying_norm(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1999] *= 8
    v = v.astype("f4").astype("f8")
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in pstable_ann.search(table, F.col("vec_id") % 50 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 2000, 50):
        score = v @ v[q]
        score[q] = -np.inf
        assert len(got[q]) == 20 and len(got[q] & set(np.argsort(-score)[:20].tolist())) >= 19


def test_packing(spark, docs, empty):
    path = tokenizer_file("byte_bpe_50k.json")
    pieces = sos_packing.pieces(docs, path, 0, 256, with_ids=True).cache()
    packed = sos_packing.pack(pieces.drop("ids"), 256).collect()
    assert len(packed) == pieces.count()
    total = sum(len(byte_bpe.encoder(path).encode(t or "")) // 4 + 1 for _, t in HARD)
    assert sum(r["length"] for r in packed) == total
    for _, group in itertools.groupby(sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    long = sorted((r["piece"], r["start"], r["length"]) for r in packed if r["doc_id"] == 5)
    assert all(n == 256 for _, _, n in long[1:]) and [s for _, s, _ in long[1:]] == list(np.cumsum([n for _, _, n in long])[:-1])
    assert sos_packing.pack(sos_packing.pieces(empty, path, 0, 256).drop("ids"), 256).count() == 0
    lengths = np.sort(np.random.default_rng(0).integers(1, 2048, 5000))[::-1]
    _, _, gaps = sos_packing.sum_of_squares(lengths, 2048)
    assert len(gaps) <= 1.06 * lengths.sum() / 2048
    parts = sos_packing.sequences(spark.createDataFrame(packed), pieces).collect()
    assert sum(len(r["ids"]) for r in parts) == 4 * total


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(sos_packing, "GROUP_PIECES", 100)
    n = np.random.default_rng(1).integers(1, 65, 1000)
    rows = spark.createDataFrame([(i, 0, 0, 0, int(x), i, None) for i, x in enumerate(n)], sos_packing.PIECES).drop("ids").cache()
    got = sos_packing.pack(rows, 64)
    used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert got.count() == 1000 and all(r["n"] == r["m"] <= 64 for r in used) and len(used) <= 1.06 * n.sum() / 64


def test_superminhash_estimates():
    rng, errors = np.random.default_rng(0), []
    for size in (3, 40, 400, 4000):
        for _ in range(20):
            u = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            a, b = u[:size], u[size // 3 : size + size // 3]
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((superminhash.superminhash(a) == superminhash.superminhash(b)).mean() - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def brute_groups(texts, words, percent):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    sets = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set() for w in cut]
    up = superminhash.Forest(len(texts))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up.unite(i, j)
    return [len(s) for s in sets], [up.root(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(superminhash, "FAMILY_BLOCK", block)  # a small block splits families
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (30, 60, 120, 300):
        for _ in range(4):
            base = list(rng.choice(vocabulary, size))
            texts.append(" ".join(base))
            for _ in range(12):
                copy = list(base)
                for at in rng.integers(0, size, rng.integers(0, max(2, size // 18))):
                    copy[at] = str(rng.choice(vocabulary))
                texts.append(" ".join(copy))
    texts += [t for _, t in HARD[:6]] + ["same words"] * 40 + [None, "", "SAME words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, roots = brute_groups(texts, 3, 85)
    got = {r["doc_id"]: r for r in superminhash.near_duplicates(rows, 3, 85).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_of_hard_rows(docs, empty):
    got = superminhash.near_duplicates(docs.select("doc_id", "text"), 3, 85).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(HARD) and by[7] == 6 and by[9] == 8 and by[0] == 0 and by[1] == 1 and by[None] is None
    assert superminhash.near_duplicates(empty.select("doc_id", "text"), 3, 85).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    up = superminhash.Forest(500)
    for a, b in links:
        up.unite(a, b)
    got = {r["node"]: r["component"] for r in superminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: up.root(n) for a, b in links for n in (a, b) if a != b}


def test_media(docs, empty):
    for data in (b"", b"x", bytes(range(256)) * 9, b"\0\xff" * 900, b"\xff" * 576):
        payload = mjpeg_avi.padded(data)
        assert len(payload) % 576 == 0 and payload.startswith(data) and mjpeg_avi.unwrap(mjpeg_avi.wrap(payload)).tobytes() == payload
    got = mjpeg_avi.features(mjpeg_avi.media(docs)).cache()
    for r in got.collect():
        texts = [t or "" for i, t in HARD if i == r["doc_id"]]
        data = mjpeg_avi.padded(texts[0].encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[0].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert got.count() == len(HARD) and mjpeg_avi.clips(got).where("n_frames < 1").count() == 0
    assert mjpeg_avi.features(mjpeg_avi.media(empty)).count() == 0


def test_shots():
    rng = np.random.default_rng(0)
    frames = np.concatenate([rng.integers(a, a + 40, (20, 24, 24)) for a in (0, 100, 200)]).astype(np.uint8)
    assert mjpeg_avi.cuts(frames).tolist() == [20, 40]


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and [s[0] for s in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").select("doc_id").collect()]
    _, roots = brute_groups(texts, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for k, i in enumerate(ids) if roots[k] == k] and kept.columns == docs.columns
