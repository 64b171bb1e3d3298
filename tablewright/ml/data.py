"""Training-table helpers: feature selection, target checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.schema import q


def feature_frame(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """The given feature columns, or every column but the target."""
    cols = list(features) if features else [c for c in df.columns if c != target]
    return df.select(*[F.col(q(c)) for c in cols])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target; error when none is left (checked with limit(1))."""
    out = df.dropna(subset=[target])
    if not out.limit(1).count():
        raise ValueError(f"no row has a value in {target}")
    return out


def has_negative(df: DataFrame, target: str) -> bool:
    """Any target value below 0 after a numeric cast."""
    v = F.col(q(target)).cast("string").try_cast("double")
    got = df.agg(F.bool_or(v < 0).alias("neg")).collect()[0]["neg"]
    return bool(got)
