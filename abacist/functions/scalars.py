"""Scalar rules of charts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chart types that have an extractor.
CHART_TYPES = ("bar", "histogram", "line", "scatter", "box", "area", "pie", "heatmap")
ELEMENT_KEYS = {"bar": "bar", "histogram": "bar", "line": "data_point", "scatter": "data_point", "area": "data_point",
                "box": "box", "heatmap": "cell", "pie": "slice"}
CONFIDENCE = {"box": 0.25, "histogram": 0.2}


def chart_type(name: Column) -> Column:
    """Null, empty, unknown or unsupported types count as bar."""
    lowered = F.lower(F.trim(name))
    return F.when(lowered.isin(*CHART_TYPES), lowered).otherwise("bar")


def element_key(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in ELEMENT_KEYS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def least_confidence(kind: Column) -> Column:
    return F.when(kind == "box", CONFIDENCE["box"]).when(kind == "histogram", CONFIDENCE["histogram"]).otherwise(0.4)


def orientation(value: Column) -> Column:
    """``vertical``, ``horizontal`` or ``not_applicable``; anything else is an error."""
    t = F.lower(F.trim(value.cast("string")))
    return (
        F.when(t.isin("v", "vertical", "true", "1"), "vertical")
        .when(t.isin("h", "horizontal", "false", "0"), "horizontal")
        .when(t.isin("n/a", "na", "none", "not_applicable", ""), "not_applicable")
        .otherwise(F.raise_error(F.concat(F.lit("unknown orientation: "), F.coalesce(t, F.lit("null")))).cast("string"))
    )


def scaled(scale: Column, slope: Column, intercept: Column, x: Column) -> Column:
    """A calibration applied: ``linear``, ``ln`` or ``log10`` scale."""
    line = slope * x + intercept
    return F.when(scale == "log10", F.pow(F.lit(10.0), line)).when(scale == "ln", F.exp(line)).otherwise(line)


def calibration_quality(r2: Column, width: Column | None = None) -> Column:
    """By the fit, and by the mean relative width of intervals where it is known: good fits with intervals of 0.15 or wider are ``approximate``."""
    narrow = F.coalesce(width < 0.15, F.lit(True)) if width is not None else F.lit(True)
    known = r2.isNotNull() & ~F.isnan(r2.cast("double"))
    return F.when(~known, "uncalibrated").when((r2 >= 0.85) & narrow, "high").when(r2 >= 0.15, "approximate").otherwise("uncalibrated")


def uncertainty(value: Column, slope: Column, r2: Column, confidence: Column, pixels: float = 1.0) -> Column:
    """Struct (deviation, low, high): pixel error through the scale, widened by a poor fit or a doubtful detection."""
    fit = F.when(r2 > 0, 1 / F.sqrt(F.greatest(r2, F.lit(0.1)))).otherwise(2.0)
    deviation = F.abs(slope) * pixels * fit * F.sqrt(1 / F.greatest(confidence, F.lit(0.3)))
    return F.struct(deviation.alias("deviation"), (value - 1.96 * deviation).alias("low"), (value + 1.96 * deviation).alias("high"))


def nonconformity(truth: Column, predicted: Column, relative: bool, tau: float) -> Column:
    """The error of a prediction; ``relative`` to the truth, or to ``tau`` for small ones."""
    error = F.abs(truth - predicted)
    return error / F.greatest(F.abs(truth), F.lit(tau)) if relative else error


STRATEGIES = ("standard", "vlm", "chart_to_table", "hybrid")


def strategy(mode: Column, confidence: Column, coverage: Column, quality: Column, available: tuple[str, ...] = STRATEGIES) -> Column:
    """The extraction strategy of a chart: an explicit mode, or by the quality signals, among those ``available``. A mode that isn't is an error."""
    if "standard" not in available:
        raise ValueError("the standard strategy must be available")
    doubtful = (confidence < 0.4) & (coverage < 0.3)
    other = next((s for s in ("vlm", "chart_to_table") if s in available), None)
    hybrid = (quality == "uncalibrated") & (coverage >= 0.5) & F.lit("hybrid" in available)
    missing = F.raise_error(F.concat(F.lit("strategy is not available: "), mode)).cast("string")
    auto = F.when(doubtful & F.lit(other is not None), F.lit(other)).when(hybrid, "hybrid").otherwise("standard")
    return F.when(mode == "auto", auto).when(mode.isin(*available), mode).otherwise(missing)
