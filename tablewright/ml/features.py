"""Feature pipeline stages that Spark ML lacks in the needed form.

* ``ExactMedianImputer`` -- ``Imputer(strategy="median")`` is approximate;
  this one uses the exact distributed quantile of ``operators.stats``.
* ``ModeImputer`` -- most frequent value (smallest on ties) for any type,
  including strings (``Imputer`` refuses strings).
* ``PopulationScaler`` -- mean 0 and *population* standard deviation 1,
  a zero deviation divides by 1 (``StandardScaler`` uses the sample sd).

Each is an Estimator/Model pair whose fitted values are Params, so pipelines
containing them save and load with ``DefaultParamsWritable``.  Transforms are
single projections of built-in expressions.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.stats import modes, quantiles
from tablewright.schema import as_double, is_numeric_type, q


class _Fitted(Params):
    values = Param(Params._dummy(), "values", "fitted value per input column", typeConverter=TypeConverters.toList)

    def getValues(self):
        return self.getOrDefault(self.values)


class ExactMedianImputerModel(Model, HasInputCols, HasOutputCols, _Fitted,
                              DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        vals = self.getValues()
        return df.withColumns({o: F.coalesce(as_double(df, i), F.lit(v).cast("double"))
                               for i, o, v in zip(self.getInputCols(), self.getOutputCols(), vals)})


class ExactMedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExactMedianImputerModel:
        cols = self.getInputCols()
        med = quantiles(df, cols, [0.5])
        # an all-null column has no median; sklearn drops such a column, we fill 0
        vals = [float(med[c][0.5]) if c in med and med[c][0.5] is not None else 0.0 for c in cols]
        return self._copyValues(ExactMedianImputerModel(values=vals))


class ModeImputerModel(Model, HasInputCols, HasOutputCols, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: F.coalesce(F.col(q(i)).cast("string"), F.lit(v))
                               for i, o, v in zip(self.getInputCols(), self.getOutputCols(), self.getValues())})


class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Categorical values are handled as text from here on (one-hot input)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        m = modes(df, cols)
        vals = [m[c] if m.get(c) is not None else "missing" for c in cols]
        return self._copyValues(ModeImputerModel(values=vals))


class _Scale(Params):
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "population sd (0 -> 1)", typeConverter=TypeConverters.toListFloat)


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, _Scale, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        ms, ss = self.getOrDefault(self.means), self.getOrDefault(self.scales)
        return df.withColumns({o: (as_double(df, i) - F.lit(m)) / F.lit(s)
                               for i, o, m, s in zip(self.getInputCols(), self.getOutputCols(), ms, ss)})


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        aggs = []
        for i, c in enumerate(cols):
            v = as_double(df, c)
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
        row = df.agg(*aggs).collect()[0]
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        scales = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
        return self._copyValues(PopulationScalerModel(means=means, scales=scales))


def split_features(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature lists in schema order."""
    num = [c for c in features if is_numeric_type(df.schema[c].dataType)]
    return num, [c for c in features if c not in num]


def preprocessor(df: DataFrame, features: list[str], output: str = "features") -> Pipeline:
    """numeric: exact median impute -> population scale; categorical: mode
    impute -> one slot per seen level (unseen -> all zeros); assembled into one
    vector.  Refit inside every fold."""
    num, cat = split_features(df, features)
    stages = []
    parts = []
    if num:
        imp = [f"__imp_{i}" for i in range(len(num))]
        sc = [f"__sc_{i}" for i in range(len(num))]
        stages += [ExactMedianImputer(inputCols=num, outputCols=imp), PopulationScaler(inputCols=imp, outputCols=sc)]
        parts += sc
    if cat:
        ci = [f"__cat_{i}" for i in range(len(cat))]
        ix = [f"__idx_{i}" for i in range(len(cat))]
        oh = [f"__oh_{i}" for i in range(len(cat))]
        stages += [ModeImputer(inputCols=cat, outputCols=ci),
                   StringIndexer(inputCols=ci, outputCols=ix, handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=ix, outputCols=oh, dropLast=True)]
        parts += oh
    stages.append(VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


__all__ = ["ExactMedianImputer", "ModeImputer", "PopulationScaler", "preprocessor", "split_features"]
