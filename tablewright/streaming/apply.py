"""Apply fitted preparation plans and models to streams.

A fitted ``PrepPlan`` holds literals only and a ``PipelineModel`` is a
sequence of projections, so both run unchanged on a streaming DataFrame.  The
batch plan's whole-table distinct becomes a watermark-bounded
``dropDuplicatesWithinWatermark`` when an event-time column is given.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.plans.prep import PrepPlan


def prepare_stream(plan: PrepPlan, stream: DataFrame, event_time: str | None = None,
                   delay: str = "10 minutes") -> DataFrame:
    out = stream
    if plan.options.drop_duplicates and event_time:
        wm = event_time
        if isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
            # watermarks need TIMESTAMP; a derived copy is equal for equal rows
            wm = "_event_time"
            out = out.withColumn(wm, F.col(event_time).cast("timestamp"))
        out = out.withWatermark(wm, delay).dropDuplicatesWithinWatermark()
        if wm != event_time:
            out = out.drop(wm)
    return plan.transform(out, dedupe=False)


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    return model.transform(stream)
