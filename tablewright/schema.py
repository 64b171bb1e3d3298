"""Column classes and null normalisation.

Three classes drive every operator (as in the reference):
numeric (all number types plus boolean), text (strings), and categorical
(everything that is not numeric, so strings, dates and timestamps).
All helpers read ``df.schema`` only; none starts a Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType, T.BooleanType)

# The missing-value tokens of pandas' CSV reader (its documented
# default ``na_values``), matched on the exact field text.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def numeric_cols(df: DataFrame, exclude: tuple | list = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and f.name not in exclude]


def text_cols(df: DataFrame, exclude: tuple | list = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def categorical_cols(df: DataFrame, exclude: tuple | list = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if not is_numeric_type(f.dataType) and f.name not in exclude]


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def as_double(df: DataFrame, c: str) -> Column:
    """Numeric view of a column: booleans become 0/1, floats lose NaN."""
    dt = df.schema[c].dataType
    col = F.col(q(c))
    if isinstance(dt, T.BooleanType):
        return col.cast("int").cast("double")
    col = col.cast("double")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast("double"))
    return col


def is_missing(df: DataFrame, c: str) -> Column:
    """Whether a cell is missing: null, or NaN in a float column."""
    col = F.col(q(c))
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells of float columns as null; other columns as they are."""
    return normalise_nulls(df, tokens=[])


def q(name: str) -> str:
    """Back-quote a column name for use in ``F.col`` / SQL text."""
    return "`" + name.replace("`", "``") + "`"


def normalise_nulls(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """One projection: NaN -> null for float columns, missing tokens -> null
    for string columns.  Later operators then only have to deal with null."""
    toks = MISSING_TOKENS if tokens is None else tokens
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        elif toks and isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)
