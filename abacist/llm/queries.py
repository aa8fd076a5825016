"""The registered queries ``opN_<name>`` and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.llm.url_reputation import DOUBLE_SUFFIXES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's ``doc_id`` is read as the id of the page that it judges; good: of quality and not toxic."""
    from abacist.llm import url_reputation

    good = F.col("quality") * (1 - F.col("toxic"))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes, RULES)


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import warc_bundles

    return warc_bundles.read(warc_bundles.write(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the declared language is the ``lang`` column, the host the ``source``; they have no address suffix."""
    from abacist.llm import language_fusion

    docs = table(spark, sf_dir, "documents")
    model = language_fusion.fit(docs)
    return language_fusion.identify(docs, model, F.col("lang"), F.lit(""), F.col("source")).drop("text_key")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: declared language from the markup, suffix and host from the address, text models of the documents."""
    from abacist.llm import language_fusion

    model = language_fusion.fit(table(spark, sf_dir, "documents"))
    suffix, host = language_fusion.address(F.col("url"))
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("doc_id"), language_fusion.visible(F.col("html")).alias("text"), "url", language_fusion.declared_in(F.col("html")).alias("declared"))
    return language_fusion.identify(rows, model, F.col("declared"), suffix, host).drop("text_key").withColumnRenamed("doc_id", "page_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import token_files

    manifest = token_files.write(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_files.read(manifest)


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import piece_bpe

    found = piece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digests_only=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import credential_links

    return credential_links.digests(table(spark, sf_dir, "documents"))


def op7_pstable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import pstable_ann

    return pstable_ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import sos_packing
    from abacist.llm.workspace import stored

    docs, file = table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")
    pieces = stored(sos_packing.pieces(docs, file, end_id=0, length=2048).drop("ids"), "pieces")
    return sos_packing.pack(pieces, 2048)


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import superminhash

    return superminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


def op10_mjpeg_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abacist.llm import mjpeg_avi

    return mjpeg_avi.features(mjpeg_avi.media(table(spark, sf_dir, "documents"))).drop("shots", "n_frames", "frames_per_second")


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of the media that ``op10_mjpeg_avi`` stores."""
    from abacist.llm import mjpeg_avi

    return mjpeg_avi.clips(mjpeg_avi.features(mjpeg_avi.media(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_language_fusion": op3_language_fusion,
    "pages_language": pages_language,
    "op4_token_files": op4_token_files,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_credential_links": op6_credential_links,
    "op7_pstable_ann": op7_pstable_ann,
    "op8_sum_of_squares_packing": op8_sum_of_squares_packing,
    "op9_superminhash": op9_superminhash,
    "op10_mjpeg_avi": op10_mjpeg_avi,
    "media_clips": media_clips,
}

_BASE32 = """
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
        ((instr('0123456789abcdef', substr(h, 1 + ((5 * i) // 4)::int, 1)) - 1) * 16
          + greatest(instr('0123456789abcdef', substr(h || '0', 2 + ((5 * i) // 4)::int, 1)) - 1, 0))
        >> (3 - (5 * i) % 4)::int) % 32, 1)), 'string_agg', '')
"""


def _moments(counts: str, parent: str) -> str:
    """Prior strength of the children of each parent, as SQL."""
    return f"""
        SELECT 1 / least(greatest(CASE WHEN sum(room) > 1e-9 THEN (sum(seen) - sum(chance)) / sum(room) ELSE 0.1 END, 0.001), 0.999) - 1 AS m
        FROM (SELECT sum(k * k / n::double) - sum(k) * (sum(k) / sum(n)::double) AS seen,
                     (sum(k) / sum(n)::double) * (1 - sum(k) / sum(n)::double) * (count(*) - 1) AS chance,
                     (sum(k) / sum(n)::double) * (1 - sum(k) / sum(n)::double)
                       * (sum(n) - sum(n * n) / sum(n)::double - (count(*) - 1)) AS room
              FROM {counts} WHERE n > 0 {parent})
    """


ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": f"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
             x AS (SELECT *, string_split(host, '.') AS l, array_to_string(l[-2:], '.') IN {DOUBLE_SUFFIXES} AS two FROM p),
             h AS (SELECT host, array_to_string(CASE WHEN two THEN x.l[-3:] ELSE x.l[-2:] END, '.') AS domain,
                          array_to_string(CASE WHEN two THEN x.l[-2:] ELSE x.l[-1:] END, '.') AS suffix, count(quality * (1 - toxic)) AS n,
                          coalesce(sum(quality * (1 - toxic)), 0) AS k
                   FROM x LEFT JOIN labels l ON l.doc_id = x.page_id GROUP BY 1, 2, 3),
             d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
             s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
             g AS (SELECT (sum(k) + 1) / (sum(n) + 2)::double AS r FROM s),
             ms AS ({_moments("s", "")}), md AS ({_moments("d", "GROUP BY suffix")}), mh AS ({_moments("h", "GROUP BY suffix, domain")}),
             sr AS (SELECT suffix, (k + m * r) / (n + m) AS r FROM s, ms, g),
             dr AS (SELECT domain, suffix, (k + m * r) / (n + m) AS r FROM d JOIN sr USING (suffix), md),
             hr AS (SELECT host, (h.k + m * r) / (h.n + m) AS rate, h.n + m AS weight FROM h JOIN dr USING (domain, suffix), mh),
             ab AS (SELECT host, rate, rate * weight AS a, (1 - rate) * weight AS b, ln(rate / (1 - rate)) AS mode FROM hr),
             cells AS (SELECT *, sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) / 16 AS h, mode + (i - 192) * h AS t FROM ab, range(0, 385) r(i)),
             dens AS (SELECT *, exp(a * (t - mode) - (a + b) * (greatest(t, 0) + ln(1 + exp(-abs(t))) - greatest(mode, 0) - ln(1 + exp(-abs(mode))))) AS w FROM cells),
             upto AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY i) AS upto, 0.05 * sum(w) OVER (PARTITION BY host) AS below FROM dens),
             hb AS (SELECT host, rate, 1 / (1 + exp(-arg_min(t - h / 2 + h * (below - upto + w) / w, i))) AS bound FROM upto WHERE upto >= below GROUP BY ALL),
             r(what, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
             f AS (SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(what, length(rule_host || rule_path)) AS what
                   FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.what, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict,
               round(rate, 6) AS rate, round(bound, 6) AS bound
        FROM p JOIN hb USING (host) LEFT JOIN f USING (page_id)
    """,
    "op2_warc_bundles": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
                          min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM q
    """,
    "op9_superminhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        sh AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END) AS s
               FROM w),
        n AS (SELECT w.doc_id, count(DISTINCT s) AS n_shingles FROM w LEFT JOIN sh USING (doc_id) GROUP BY 1),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                  WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
        SELECT doc_id, n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM n JOIN reach USING (doc_id) GROUP BY doc_id, n_shingles
    """,
}
