"""Secret scans with multipart credential linking.

Strong spans are reported as they are: assigned passwords and tokens, cloud access identifiers, long
hexadecimal strings. Weak candidates, which are common in harmless text, are reported only if
complementary parts co-occur in their scope: a weak identifier needs a secret, a weak secret an identifier, an
endpoint both. A part's scope is the text up to ``REACH`` code points before its start and after its end; parts
that reach into it are joined with it, wherever in the text they are. That interval join sorts the row's parts by
their starts and compares each with the furthest end before it and the nearest start after it, so nothing is
shuffled and no pairs are made; the nearer of the two is its link, that before it if they are as near. Shifting a text shifts spans and links alike.

A pattern's places come from ``split`` and ``regexp_extract_all``, which find the same matches: the lengths of the
parts between and of the matches, summed up (as are the ends and starts) in blocks so that the work stays linear in the number of matches.

Nulls count as empty texts, without spans. Equal rows give equal rows. Columns of ``docs`` keep their names and values. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most code points between two parts that belong together.
REACH = 1_024
_FAR, _NUMBERS = 1 << 62, 1 << 31
_BLOCK = 256  # matches summed together
_CHUNK = 1_024

#: Kinds in the order in which they are listed: (pattern, capture group to measure, its least length).
#: For access and hex the least length is part of the pattern: their runs are maximal, so the matches are the same.
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
WEAK = {
    "account": (r"""\b(?i:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", 1, 3),
    "mixed": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "endpoint": (r"""\b(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s"'<>]{4,}""", 0, 4),
}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "mixed": "secret", "endpoint": "endpoint"}
NEEDS = {"account": ("secret",), "mixed": ("identifier",), "endpoint": ("identifier", "secret")}
KINDS = [*STRONG, *WEAK]


def _running(lengths: Column, add=lambda a, x: a + x, first: int = 0) -> Column:
    """Sums of the numbers before each one, or what another associative ``add`` makes of them."""
    step = lambda held, x: F.struct(add(held["at"], x).alias("at"), F.concat(held["all"], F.array(held["at"])).alias("all"))
    sums = lambda numbers, start: F.aggregate(
        numbers, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all")), step, lambda held: held["all"]
    )
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    of = lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK)
    zero = F.lit(first).cast("bigint")
    totals = F.transform(blocks, lambda b: F.aggregate(of(b), zero, lambda a, x: add(a, x)))
    inner = F.flatten(F.zip_with(blocks, sums(totals, zero), lambda b, start: sums(of(b), start)))
    return F.when(F.size(lengths) > 0, inner).otherwise(F.array().cast("array<bigint>"))


def _located(rows: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """``rows`` (with ``content``) and a column ``kind`` of the pattern's spans, an array of (start, end)."""
    text = F.col("content")
    spans = "array<struct<start:bigint,end:bigint>>"
    found = F.col("_has")
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    nothing = F.array().cast("array<string>")
    out = rows.withColumn("_has", text.rlike(pattern))
    out = out.withColumn("_whole", F.when(found, all_of(0)).otherwise(nothing))
    out = out.withColumn("_part", F.when(found, all_of(group)).otherwise(nothing)) if group else out
    out = out.withColumn("_between", F.when(found, F.split(text, pattern, -1)).otherwise(nothing))
    size = lambda x: F.length(x).cast("bigint")
    out = out.withColumn("_both", F.zip_with(F.slice("_between", 1, F.size("_whole")), "_whole", lambda g, m: size(g) + size(m)))
    out = out.withColumn("_before", F.when(found, _running(F.col("_both"))).otherwise(F.array().cast("array<bigint>")))
    ends = F.zip_with("_before", "_both", lambda a, n: a + n)
    placed = F.zip_with(ends, "_whole", lambda e, m: F.struct((e - size(m)).alias("start"), e.alias("end")))
    if group:
        long_enough = F.zip_with(placed, "_part", lambda s, p: F.when(F.length(p) >= least, s))
        placed = F.filter(long_enough, lambda s: s.isNotNull())
    out = out.withColumn(kind, F.when(found, placed).otherwise(F.array()).cast(spans))
    return out.drop("_has", "_whole", "_part", "_between", "_both", "_before")


def spans(docs: DataFrame) -> DataFrame:
    """``row`` (all of ``docs``), ``text``, and ``base``, ``all_spans`` and ``links``.

    Spans are sorted arrays of (start, number of the kind, end), in code points; links of (weak part, its partner), both spans.
    """
    rows = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"))  # within a struct, no name can clash
    rows = rows.withColumn("content", F.coalesce("text", F.lit("")))
    for kind, (pattern, group, least) in (STRONG | WEAK).items():
        rows = _located(rows, kind, pattern, group, least)
    tagged = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), s["end"].alias("end")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[tagged(k) for k in STRONG])))
    rows = rows.withColumn("_weak", F.concat(*[tagged(k) for k in WEAK]))
    rows = rows.withColumn("_parts", F.when(F.size("_weak") > 0, F.array_sort(F.concat("base", "_weak"))))
    is_of = lambda s, role: s["kind"].isin(*[KINDS.index(k) for k in KINDS if ROLES[k] == role])
    for role in ("identifier", "secret"):
        # a place and the number of its part in one number, so that the running extremes know the part
        ends = F.transform("_parts", lambda s, i: F.when(is_of(s, role), s["end"] * _NUMBERS + i).otherwise(F.lit(-_FAR)))  # noqa: B023
        starts = F.transform(F.reverse("_parts"), lambda s, i: F.when(is_of(s, role), s["start"] * _NUMBERS + F.size("_parts") - 1 - i).otherwise(F.lit(_FAR)))  # noqa: B023
        rows = rows.withColumn("_ends", ends).withColumn("_starts", starts)
        rows = rows.withColumn("_ends", _running(F.col("_ends"), F.greatest, -_FAR))
        rows = rows.withColumn("_starts", F.reverse(_running(F.col("_starts"), F.least, _FAR)))
        place = lambda x: F.shiftright(x, 31)
        before = F.zip_with("_parts", "_ends", lambda s, e: F.struct(F.greatest(s["start"] - place(e), F.lit(0)).alias("far"), F.pmod(e, F.lit(_NUMBERS)).alias("part")))
        after = F.zip_with("_parts", "_starts", lambda s, a: F.struct(F.greatest(place(a) - s["end"], F.lit(0)).alias("far"), F.pmod(a, F.lit(_NUMBERS)).alias("part")))
        nearer = F.zip_with(before, after, lambda b, a: F.when(b["far"] <= a["far"], b).otherwise(a))
        near = F.transform(nearer, lambda x: F.when(x["far"] <= REACH, F.get("_parts", x["part"].cast("int"))))
        rows = rows.withColumn(f"_{role}", near)
    either = F.zip_with("_identifier", "_secret", lambda i, s: F.struct(i.alias("identifier"), s.alias("secret")))
    joined = F.zip_with("_parts", either, lambda s, near: F.struct(s.alias("part"), near.alias("near")))
    linked = lambda x: _all(
        (x["part"]["kind"] != KINDS.index(k)) | _all(x["near"][role].isNotNull() for role in NEEDS[k]) for k in WEAK
    )
    rows = rows.withColumn("_kept", F.when(F.size("_weak") > 0, F.filter(joined, linked)))
    rows = rows.withColumn("all_spans", F.coalesce(F.transform("_kept", lambda x: x["part"]), F.col("base")))
    partners = lambda x: F.array(*[
        F.when(x["part"]["kind"] == KINDS.index(k), F.struct(x["part"].alias("part"), x["near"][role].alias("partner"))) for k in WEAK for role in NEEDS[k]
    ])
    links = F.filter(F.flatten(F.transform("_kept", partners)), lambda x: x.isNotNull())
    rows = rows.withColumn("links", F.coalesce(links, F.array()))
    return rows.select("row", "text", "base", "all_spans", "links")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _named(s: Column) -> Column:
    return F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])


def listed(column: str) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(column, _named), ",")


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; texts without spans and nulls stay as they are.

    Overlapping spans are replaced together. The text is cut once into chunks of ``_CHUNK`` code points, and what is kept is
    put together from them, so the work stays linear in the text and its spans.
    """
    rows = spans(docs)
    found = F.size("all_spans") > 0
    # spans are sorted by start: keep the text from the furthest end so far up to each start
    ends = F.transform("all_spans", lambda s: s["end"].cast("bigint"))
    rows = rows.withColumn("_ends", F.when(found, _running(ends, F.greatest)))
    kept = F.zip_with("_ends", "all_spans", lambda e, s: F.struct(e.alias("a"), s["start"].alias("b")))
    rows = rows.withColumn("_pieces", F.filter(kept, lambda p: p["a"] <= p["b"]))
    rows = rows.withColumn("_chunks", F.when(found, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    rows = rows.withColumn("_tail", F.struct(F.array_max(ends).alias("a"), F.length("text").cast("bigint").alias("b")))

    def piece(p: Column) -> Column:
        first, last = F.floor(p["a"] / _CHUNK).cast("int"), F.floor((p["b"] - 1) / _CHUNK).cast("int")

        def part(i: Column) -> Column:
            low = F.greatest(p["a"] - i * _CHUNK, F.lit(0))
            return F.substring(F.get("_chunks", i), (low + 1).cast("int"), (p["b"] - i * _CHUNK - low).cast("int"))

        return F.when(p["a"] < p["b"], F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise("")

    text = F.concat(F.array_join(F.transform("_pieces", piece), mark), F.lit(mark), piece(F.col("_tail")))
    text = F.when(found, text).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the strong spans, all ``spans``, and ``links``: each weak part and its partner, ``part>partner``, comma-joined."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k)))
    links = F.array_join(F.transform("links", lambda x: F.concat(_named(x["part"]), F.lit(">"), _named(x["partner"]))), ",")
    return spans(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), *[count(k).cast("long").alias(f"n_{k}") for k in STRONG],
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("all_spans").alias("spans"), links.alias("links"),
    )
