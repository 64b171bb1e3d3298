"""Small scalar expression builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    """min(max(v, lo), hi); null stays null (``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def date_parts(ts: Column, name: str) -> list[Column]:
    """``<name>_year``, ``<name>_month``, ``<name>_day`` of a timestamp."""
    return [F.year(ts).alias(f"{name}_year"),
            F.month(ts).alias(f"{name}_month"),
            F.dayofmonth(ts).alias(f"{name}_day")]


def hist_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin index in [0, bins-1]; last bin closed on the right.

    A constant column (lo == hi) uses the range [v-0.5, v+0.5] like numpy.
    """
    lo2 = F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(lo == hi, hi + F.lit(0.5)).otherwise(hi)
    idx = F.floor((v - lo2) / (hi2 - lo2) * F.lit(bins)).cast("int")
    return F.when(v.isNotNull(), F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1)))


def bin_edges(lo: Column, hi: Column, b: Column, bins: int) -> tuple[Column, Column]:
    """Left and right edge of bin ``b`` (same constant-column rule)."""
    lo2 = F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(lo == hi, hi + F.lit(0.5)).otherwise(hi)
    width = (hi2 - lo2) / F.lit(bins)
    return lo2 + b * width, lo2 + (b + F.lit(1)) * width


def to_text(c: Column, missing: str = "nan", boolean: bool = False) -> Column:
    """Value as text; a missing value becomes the text ``nan``; booleans are
    written True / False (as pandas prints them)."""
    if boolean:
        return F.coalesce(F.when(c, F.lit("True")).when(~c, F.lit("False")), F.lit(missing))
    return F.coalesce(c.cast("string"), F.lit(missing))


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def slug(c: Column) -> Column:
    """trim, lower, runs of other characters -> '-', strip '-', empty -> dataset."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^a-zA-Z0-9_-]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("dataset"))


def band_label(lo: Column, hi: Column) -> Column:
    """Interval label ``(lo, hi]`` for quartile bands."""
    return F.format_string("(%s, %s]", lo.cast("string"), hi.cast("string"))
