"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: a naive Bayes model over hashed byte trigrams, fitted to a bounded sample of each label's rows, so that every
  label has a class, however rare it is and however many there are. Rows are in two folds by their text, and each fold is judged by
  the model of the other, so no row, nor a copy of it, is judged by its own label. Log likelihoods are tempered,
  since neighbouring trigrams aren't independent. A uniform model stands for text in no language (``und``).
* Declared language (markup or metadata): how often each declaration goes with each text language, counted over all other rows.
* Address suffix and host: priors by grouped aggregation of all rows' text posteriors, the host's shrunk to its
  suffix's, the suffix's to that of all rows; a row's own part is taken out of its priors.

Posterior = text likelihood x declaration likelihood x host prior. A row is kept if its best language isn't ``und`` and has
a posterior of at least ``LEAST``. Texts are read once for the scores; everything after works on narrow rows.
Sums are of whole millionths, so they don't depend on the order of rows. ``declared_in`` and ``address`` take declaration, suffix and host
from a page's markup and address.

Null texts count as empty; texts under three bytes have no text evidence and are rejected as ``und``. Null declarations and
hosts give no evidence beyond the prior. Equal rows give equal rows. A label whose rows are all in one fold has no counts for that
fold. Without any labelled row all rows are ``und``. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.llm.url_reputation import DOUBLE_SUFFIXES, host_and_path, site
from abacist.llm.workspace import as_bytes, slices, stored, tidied

#: The classifier's sample: at most so many different rows of each label and fold, those with the smallest hashes.
SAMPLE_ROWS, FOLDS = 2_000, 2
#: Languages counted at once in a task; up to so many, the model is a dense table.
HELD, DENSE = 64, 64
BUCKETS = 1 << 16
NONE = "und"
#: Nats of text evidence per nat of naive Bayes, and the most that it may weigh against any language.
TEMPER, MOST = 1 / 4, 60.0
#: Prior weight of ``und``; strengths of the priors of suffix and host; least posterior of a kept row.
NONE_PRIOR, SUFFIX_STRENGTH, HOST_STRENGTH, LEAST = 0.01, 10.0, 10.0, 0.5
UNIT = 1_000_000
#: Text in no language: every trigram as rare as one in so many. Mixed-language texts stay well above.
UNLIKELY = 10_000.0


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the text's byte trigrams, A-Z lower-cased, digits and white space alike."""
    raw = np.frombuffer(text.translate(_FOLD), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.uint32)
    return (((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)


_FOLD = bytes(ord(" ") if b in b"\t\n\r\v\f0123456789" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class TextModel:
    """Log likelihoods of trigram buckets by language, in whole 1/1024 nats, the last language uniform.

    ``unseen`` has each language's value of a bucket without counts; the others are entries (language, value less
    ``unseen``) in the order of their buckets, from ``first[bucket]`` on.
    """

    def __init__(self, languages: list[str], of: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        """``of, bucket, n``: the number of a language, a bucket and its count there."""
        self.languages = [*languages, NONE]
        total = np.bincount(of, weights=n, minlength=len(languages)) + 0.05 * BUCKETS
        whole = lambda p: np.rint(np.log(p) * 1024).astype(np.int32)
        self.unseen = np.append(whole(0.05 / total), whole(1 / UNLIKELY)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        self.of = of[order].astype(np.int32)
        self.more = whole((n[order] + 0.05) / total[self.of]) - self.unseen[self.of]
        self.first = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.table = None
        if len(languages) <= DENSE:
            self.table = np.tile(self.unseen, (BUCKETS, 1))
            self.table[bucket[order], self.of] += self.more

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """The summed values of the buckets by language."""
        if self.table is not None:
            return self.table[codes].sum(axis=0, dtype=np.int64)
        code, times = np.unique(codes, return_counts=True)
        start, size = self.first[code], self.first[code + 1] - self.first[code]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        # whole numbers below 2**53: exact
        found = np.bincount(self.of[at], weights=self.more[at] * np.repeat(times, size), minlength=len(self.unseen))
        return self.unseen.astype(np.int64) * len(codes) + found.astype(np.int64)

    def scores(self, text: bytes | None) -> list[float] | None:
        """Tempered log likelihoods, the best 0; none for texts without trigrams."""
        total = np.zeros(len(self.languages), dtype=np.int64)
        any_seen = False
        for start in range(0, len(text or b""), 1 << 20):  # a bounded piece at a time; pieces overlap by two bytes
            codes = trigrams(text[start : start + (1 << 20) + 2])
            any_seen |= len(codes) > 0
            total += self.sums(codes)
        if not any_seen:
            return None
        nats = total / 1024 * TEMPER
        return np.maximum(nats - nats.max(), -MOST).tolist()


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame, label: str = "lang") -> list[TextModel]:
    """For each fold the model of the other: at most ``SAMPLE_ROWS`` different rows of each label, all of whose text is read."""
    mixed = F.xxhash64("doc_id", "text", F.lit("language sample")).alias("h")
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    key = F.concat(fold_of(F.col("text")).cast("string"), F.col(label).cast("string"))  # the fold's digit, then the label
    named = rows.select(key.alias("lang"), "text", mixed)
    hashes = stored(named.select("lang", "h").distinct(), "label-hashes")
    # hashes are even: a label's first rows are below twice their share of the range, so no task meets all rows of a label
    sizes = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2 * SAMPLE_ROWS
    nearest = Window.partitionBy("lang").orderBy("h")
    first = hashes.join(F.broadcast(sizes), "lang").where((F.col("n") <= 2 * SAMPLE_ROWS) | share)
    first = first.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= SAMPLE_ROWS)
    last = stored(first.groupBy("lang").agg(F.max("h").alias("last")), "label-samples")
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, dtype=np.int64)
                for start in range(0, len(text), 1 << 20):
                    held[lang] += np.bincount(trigrams(text[start : start + (1 << 20) + 2]), minlength=BUCKETS)
            while len(held) > HELD:
                yield _counts(*held.popitem(), schema)
        for item in held.items():
            yield _counts(*item, schema)

    sample = named.join(F.broadcast(last), "lang").where("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")
    summed = stored(sample.mapInArrow(lambda x: tidied(count(x)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    # a number for each language and bucket seen in it: at most SAMPLE_ROWS rows of each label and fold, whatever the corpus
    table = summed.toArrow()
    languages = sorted({r["lang"][1:] for r in last.select("lang").collect()})
    keys = table.column("lang").to_pylist()
    fold = np.array([int(k[0]) for k in keys], dtype=np.int64)
    number = {k: i for i, k in enumerate(languages)}
    of = np.array([number[k[1:]] for k in keys], dtype=np.int64)
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    return [TextModel(languages, of[fold != f], bucket[fold != f], n[fold != f]) for f in range(FOLDS)]


def declared_in(html: Column) -> Column:
    """The primary subtag of the language that a page's root element declares, lower-cased; null without one."""
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})(?![a-z])""", 1)
    return F.when(found != "", F.lower(found))


def address(url: Column) -> tuple[Column, Column]:
    """Suffix and host of a page's address; empty where it has none."""
    host, _ = host_and_path(url)
    return site(host, DOUBLE_SUFFIXES)[1], host


def visible(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def _counts(lang: str, counts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    seen = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], schema=schema)


def softmax(logs: np.ndarray) -> np.ndarray:
    shifted = np.exp(logs - logs.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Per key the summed millionths of each language, as an array."""
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    parts = grouped.agg(*[F.coalesce(F.sum(F.col("part")[i]), F.lit(0)).alias(f"_{i}") for i in range(n)])
    return parts.select(*keys, F.array(*[F.col(f"_{i}") for i in range(n)]).alias(name))


SCORED = "doc_id long, text_key long, declared string, suffix string, host string, scores array<double>, part array<long>"
JUDGED = "doc_id long, text_key long, lang string, posterior double, kept boolean"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as float64; zeros for nulls."""
    out = np.zeros((len(column), width))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def fused(scores: np.ndarray, own: np.ndarray, whole: np.ndarray, suffix: np.ndarray, host: np.ndarray, stated: np.ndarray, said: np.ndarray, ways: int, none: int) -> np.ndarray:
    """Posteriors of the rows' languages. Counts are millionths of rows; ``own`` is each row's part in them.

    ``stated``: counts of the row's declaration by language, all zero without one; ``said``: of all declarations.
    """
    n = scores.shape[1]
    start = np.full(n, 1 / max(1, n - 1) / (1 + NONE_PRIOR))
    start[none] = NONE_PRIOR / (1 + NONE_PRIOR)
    prior = (whole - own + start * UNIT) / (whole.sum() + UNIT - own.sum(axis=1, keepdims=True))
    for counts, strength in ((suffix, SUFFIX_STRENGTH * UNIT), (host, HOST_STRENGTH * UNIT)):
        left = np.maximum(counts - own, 0)
        prior = (left + strength * prior) / (left.sum(axis=1, keepdims=True) + strength)
    likely = (np.maximum(stated - own, 0) + UNIT / ways) / (np.maximum(said - own, 0) + UNIT)
    likely[stated.sum(axis=1) == 0] = 1
    return softmax(scores + np.log(np.maximum(prior, 1e-12)) + np.log(likely))


def identify(docs: DataFrame, model: list[TextModel], declared: Column, suffix: Column, host: Column) -> DataFrame:
    """``doc_id, text_key, lang, posterior, kept`` of every row. ``text_key`` tells rows of one id apart."""
    names = model[0].languages
    n = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # up to DENSE languages a table of 17 MB, beyond that 8 bytes per language and bucket seen
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("declared", pa.string()), ("suffix", pa.string()),
                        ("host", pa.string()), ("scores", pa.list_(pa.float64())), ("part", pa.list_(pa.int64()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in slices(batches, 2048):
            folds = batch.column("text_key").to_numpy() % FOLDS
            scores = [of[f].scores(t) for f, t in zip(folds, as_bytes(batch.column("text")))]
            parts = [None if s is None else np.rint(softmax(np.array([s]))[0] * UNIT).astype(np.int64) for s in scores]
            kept = [batch.column(f.name) for f in list(schema)[:5]]
            columns = [pa.array(scores, pa.list_(pa.float64())), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], schema=schema)

    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), declared.cast("string").alias("declared"),
        F.coalesce(suffix.cast("string"), F.lit("")).alias("suffix"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), "text",
    )
    scored = stored(rows.mapInArrow(lambda x: tidied(score(x)), SCORED), "language-scores")

    seen = scored.where("scores IS NOT NULL")
    by_host = stored(_sums(seen, ["suffix", "host"], n, "of_host"), "host-languages")
    by_suffix = stored(_sums(by_host.withColumnRenamed("of_host", "part"), ["suffix"], n, "of_suffix"), "suffix-languages")
    by_declared = stored(_sums(seen.where("declared IS NOT NULL"), ["declared"], n, "of_declared"), "declared-languages")
    whole = np.array(_sums(by_suffix.withColumnRenamed("of_suffix", "part"), [], n, "part").first()["part"], dtype=float)
    said = np.array(_sums(by_declared.withColumnRenamed("of_declared", "part"), [], n, "part").first()["part"], dtype=float)
    ways = by_declared.count() + 1
    joined = scored.join(by_host, ["suffix", "host"], "left").join(by_suffix, "suffix", "left").join(by_declared, "declared", "left")
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lang", pa.string()), ("posterior", pa.float64()), ("kept", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = names.index(NONE)
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            parts = [_matrix(batch.column(c), n) for c in ("scores", "part", "of_suffix", "of_host", "of_declared")]
            posterior = fused(parts[0], parts[1], whole, parts[2], parts[3], parts[4], said, ways, none)
            there = batch.column("scores").is_valid().to_numpy(zero_copy_only=False)
            best = np.where(there, posterior.argmax(axis=1), none)
            sure = np.where(there, np.round(posterior.max(axis=1), 6), 0.0)
            columns = [pa.array([names[i] for i in best], pa.string()), pa.array(sure), pa.array((best != none) & (sure >= LEAST))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], schema=out)

    return joined.select("doc_id", "text_key", "scores", "part", "of_suffix", "of_host", "of_declared").mapInArrow(judge, JUDGED)


def filtered(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their own columns only."""
    rejected = stored(judged.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "rejected")
    key = F.xxhash64(F.coalesce("d.text", F.lit("")))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r._id")) & (key == F.col("r._key"))
    return docs.alias("d").join(rejected.alias("r"), same, "left_anti")
