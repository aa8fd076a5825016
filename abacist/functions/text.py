"""Parsing of label text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that OCR confuses with digits, and dashes read as minus.
CONFUSED = "OolIi|SsBZzGgq−–—"
MEANT = "00111155822699---"
# Superscript digits, currency signs, multipliers behind a number.
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
CURRENCY = "$€£¥₹"
MULTIPLIERS = {"k": 1e3, "K": 1e3, "m": 1e6, "M": 1e6, "b": 1e9, "B": 1e9, "t": 1e12, "T": 1e12}

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_WHOLE_NUMBER = rf"^\s*{NUMBER}\s*$"


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def safe_number(text: Column) -> Column:
    """A finite double, else null; stricter than a cast, which reads ``1d`` as a number."""
    value = F.when(text.rlike(_WHOLE_NUMBER), F.expr("1")).isNotNull()
    parsed = F.trim(text).try_cast("double")
    return F.when(value & (F.abs(parsed) < float("inf")), parsed)


def first_number(text: Column) -> Column:
    """The first number of the text as a double, null without one."""
    found = F.regexp_extract(text, f"({NUMBER})", 1)
    return F.when(found != "", found).try_cast("double")


def label_number(text: Column) -> Column:
    """Spaces dropped, decimal commas read as points."""
    return first_number(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")))


def digits_corrected(text: Column) -> Column:
    return F.translate(text, CONFUSED, MEANT)


def comma_decimals(text: Column) -> Column:
    """Aggregate: whether most numbers of a group have a comma before one or two last digits."""
    comma = F.sum(F.when(text.rlike(r",\d{1,2}$"), 1).otherwise(0))
    point = F.sum(F.when(text.rlike(r"\.\d{1,2}$"), 1).otherwise(0))
    return comma > point


def robust_number(text: Column, comma_is_decimal: Column) -> Column:
    """OCR confusions corrected, then read in the group's number format."""
    fixed = F.replace(digits_corrected(text), F.lit(" "), F.lit(""))
    european = F.replace(F.replace(fixed, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(fixed, F.lit(","), F.lit(""))
    return first_number(F.when(comma_is_decimal, european).otherwise(plain))


def unit_number(text: Column) -> Column:
    """Struct (value, unit) of a number with currency, percent sign, power of ten or multiplier letter."""
    cleaned = F.regexp_replace(F.trim(text), f"[~≈±{CURRENCY}%, ]", "")
    cleaned = F.translate(F.regexp_replace(cleaned, "[×x]10", "e"), SUPERSCRIPTS, DIGITS)
    value, behind = first_number(cleaned), F.regexp_extract(cleaned, f"{NUMBER}(.*)$", 1)
    factor = F.lit(1.0)
    for letter, by in reversed(MULTIPLIERS.items()):
        factor = F.when(behind.contains(letter), by).otherwise(factor)
    percent = text.contains("%")
    sign = F.regexp_extract(text, f"([{CURRENCY}])", 1)
    unit = F.concat(sign, F.when(percent, "%").otherwise(""))
    return F.struct((value * factor / F.when(percent, 100.0).otherwise(1.0)).alias("value"), F.when(unit != "", unit).alias("unit"))


def cleaned(text: Column) -> Column:
    """Zero-width characters dropped, white space collapsed; in texts with digits O, l and I become digits."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, "[​‌‍﻿]", ""), r"\s+", " "))
    return F.when(out.rlike(r"\d"), F.translate(out, "OlI", "011")).otherwise(out)


def is_numeric(text: Column) -> Column:
    bare = F.regexp_replace(text, r"[,%$\s]", "")
    return F.coalesce(bare.rlike(_WHOLE_NUMBER), F.lit(False))


def in_label_range(value: Column, low: Column, high: Column, slack: float = 0.2) -> Column:
    margin = (high - low) * slack
    return value.between(low - margin, high + margin)


def pie_share(text: Column) -> Column:
    """``25%`` as 0.25; other numbers up to 1 as they are, up to 100 in hundredths, larger ones null. Dashes count as minus."""
    fixed = F.translate(F.trim(text), "−–—", "---")
    percent = F.nullif(F.regexp_extract(fixed, r"^([+-]?\d+\.?\d*)\s*%$", 1), F.lit("")).try_cast("double")
    value = safe_number(fixed)
    return F.coalesce(percent / 100, F.when(value <= 1, value).when(value <= 100, value / 100))


def table_cells(text: Column) -> Column:
    """Rows of cells of a linearised table: lines end with ``<0x0A>`` or a line feed, cells with ``|`` or ``&``."""
    lines = F.filter(F.split(text, r"<0x0A>|\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.transform(F.split(x, r"\||&"), lambda c: F.trim(c)))


def sample_id(*keys: Column) -> Column:
    """First non-empty key: a path's stem, or the text of a number."""
    first = F.coalesce(*[blank_to_null(k.cast("string")) for k in keys])
    return F.regexp_replace(F.regexp_extract(first, r"([^/\\]*)$", 1), r"(?<=.)\.[A-Za-z]\w*$", "")


def validated_number(text: Column, low: Column, high: Column) -> Column:
    """Struct (value, score): corrected reading, scored by kept characters, number pattern and range."""
    fixed = digits_corrected(F.replace(text, F.lit(","), F.lit(".")))
    value = first_number(fixed)
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    kept = F.size(F.array_intersect(chars(text), chars(fixed))) / F.greatest(F.size(F.array_distinct(chars(text))), F.lit(1))
    pattern = F.when(fixed.rlike(_WHOLE_NUMBER), 1.0).otherwise(0.5)
    span = F.greatest(high - low, F.lit(1e-9))
    outside = F.greatest(low - value, value - high, F.lit(0.0)) / span
    return F.struct(value.alias("value"), (kept * pattern * F.exp(-outside)).alias("score"))
