"""Helpers shared by the operators: staged tables, free column names, text
batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import checkpoint_dir
from tablewright.sources.tables import table  # noqa: F401  (used by the queries)


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the session's shared checkpoint folder and
    read it back.  Later jobs start from these files, so a lost executor costs
    its running tasks only, and values drawn once (row numbers, partition ids)
    stay as they were written.  ``codec``: Parquet compression other than the
    session's."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Make the session send Python no more than BATCH_BYTES at once (a longer
    single row still goes whole), so a worker's memory doesn't follow the
    number of rows in a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def with_id(df: DataFrame, id_col: str) -> DataFrame:
    """The id as long; a missing id column is an error worth a clear message."""
    if id_col not in df.columns:
        raise ValueError(f"column {id_col} not found among {df.columns}")
    return df


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the id, the text (null: empty) and ``keep``, under fixed names, so that extra
    columns, whatever their names, can't clash."""
    with_id(with_id(df, id_col), text_col)
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *keep)


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column back to back, and where each row begins
    (one more entry than rows)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]: off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch, column: str, limit: int = 1 << 20):
    """Parts of a batch whose ``column`` holds about ``limit`` bytes each, so
    that working memory follows the limit and the longest single text."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, off = flat(col)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_udf(make, kind: str):
    """A column function of a text column, whole Arrow arrays at a time.
    ``make()`` runs once per task and returns array -> array of results."""
    from collections.abc import Iterator

    def run(arrays):
        one = make()
        for arr in arrays:
            batch = pa.record_batch([arr], names=["text"])
            yield pa.concat_arrays([one(part.column(0)) for part in slices(batch, "text")]) if len(arr) else one(arr)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
