"""Small Column helpers shared by the operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordinalis.constants import CLASS_CODE, CLASSES, FAIR_DI, FAIR_EOD


def as_double(c: Column) -> Column:
    return c.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL on a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small literal map, NULL for unknown keys."""
    pairs = [F.lit(v) for v in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*pairs), key)


def class_code(label: Column) -> Column:
    return lookup(CLASS_CODE, label)


def class_label(code: Column) -> Column:
    return lookup(dict(enumerate(CLASSES)), code.cast("int"))


def is_yes(c: Column) -> Column:
    """Trimmed, case-free yes / y / true / 1; NULL counts as no."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("yes", "y", "true", "1"), F.lit(False))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Index of the largest of three values, ties to the lower index."""
    return F.when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)


def segment_value(c: Column, numeric: bool) -> Column:
    """Numeric 1/0 flags read Yes/No, everything else is its string."""
    if numeric:
        return F.when(c == 1, "Yes").when(c.isNotNull(), "No")
    return c.cast("string")


def flip(c: Column, v0: Column, v1: Column) -> Column:
    """Swap two values, leave anything else alone."""
    return F.when(c == v0, v1).when(c == v1, v0).otherwise(c)


def ci_text(value: Column, lo: Column, hi: Column) -> Column:
    """`0.355 [0.334, 0.375]`, a dash for an undefined value, no bracket for an undefined interval."""
    point = F.format_string("%.3f", value)
    return (F.when(value.isNull(), F.lit("—"))
            .when(lo.isNull() | hi.isNull(), point)
            .otherwise(F.format_string("%s [%.3f, %.3f]", point, lo, hi)))


def fairness_verdict(di: Column, eod: Column) -> Column:
    fair = di.between(*FAIR_DI) & (F.abs(eod) < FAIR_EOD)
    return F.when(di.isNull() | eod.isNull(), "N/A").when(fair, "fair").otherwise("biased")


def alert_status(value: Column, lo: Column, hi: Column) -> Column:
    return (F.when(value.isNull() | lo.isNull() | hi.isNull(), "no_reference")
            .when(value < lo, "drift_low")
            .when(value > hi, "drift_high")
            .otherwise("in_band"))


def drifting(status: Column) -> Column:
    return status.isin("drift_low", "drift_high")


def utc_instant(c: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever the session time zone is (event-time columns need an instant)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    return F.timestamp_micros(micros)


def utc_wall(c: Column) -> Column:
    """Inverse of `utc_instant`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01").cast("timestamp_ntz"))
