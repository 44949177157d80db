"""Fitted preprocessing stages for Spark ML pipelines (M1-M4).

* ``MedianIndicatorImputer``: exact median per numeric column fitted on the
  training frame (one distributed, skew-safe pass; see ``quantiles``); missing-indicator columns only for
  columns that had nulls at fit; an all-null column imputes 0.
* ``PopulationScaler``: divide by the population standard deviation (no
  centering); a zero or undefined deviation scales by 1. Indicators are
  scaled too.

Both are plain ``Estimator``/``Model`` stages with JSON-serialisable params,
so a fitted ``PipelineModel`` saves and loads with Spark ML persistence.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import count_if
from shelfcast.operators.quantiles import column_medians

INDICATOR_SUFFIX = "__missing"


class _ColsParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "numeric input columns", TypeConverters.toListString)

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


class MedianIndicatorImputer(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MedianIndicatorImputerModel":
        cols = self.getInputCols()
        row = df.agg(*[count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        exact = column_medians(df, cols)
        medians = [float(exact[c]) if exact[c] is not None else 0.0 for c in cols]
        indicators = [c for i, c in enumerate(cols) if row[f"n{i}"]]
        return MedianIndicatorImputerModel(inputCols=cols, medians=medians, indicatorCols=indicators)


class MedianIndicatorImputerModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)
    indicatorCols = Param(Params._dummy(), "indicatorCols", "columns with nulls at fit", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, medians=None, indicatorCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def indicator_names(self) -> list[str]:
        return [f"{c}{INDICATOR_SUFFIX}" for c in self.getOrDefault(self.indicatorCols)]

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        med = dict(zip(cols, self.getOrDefault(self.medians)))
        ind = self.getOrDefault(self.indicatorCols)
        new = {f"{c}{INDICATOR_SUFFIX}": F.col(c).isNull().cast("double") for c in ind}
        new.update({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in cols})
        return df.withColumns(new)


class PopulationScaler(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        scales = []
        for i in range(len(cols)):
            s = row[f"s{i}"]
            scales.append(float(s) if s is not None and s > 0 else 1.0)
        return PopulationScalerModel(inputCols=cols, scales=scales)


class PopulationScalerModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    scales = Param(Params._dummy(), "scales", "fitted population std (1 when zero)", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        sc = self.getOrDefault(self.scales)
        return df.withColumns({c: F.col(c).cast("double") / F.lit(s) for c, s in zip(cols, sc)})


def fit_preprocessor(
    train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]
) -> tuple["PipelineModel", list[str]]:  # noqa: F821
    """Fit M1-M3 on ``train``; returns the fitted pipeline and the assembled input columns."""
    idx_out = [f"{c}__idx" for c in categorical]
    ohe_out = [f"{c}__ohe" for c in categorical]
    stages = [
        StringIndexer(inputCols=list(categorical), outputCols=idx_out, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx_out, outputCols=ohe_out, dropLast=True),
    ]
    cat_model = Pipeline(stages=stages).fit(train)
    imp_model = MedianIndicatorImputer(inputCols=list(numeric)).fit(train)
    scaled_cols = list(numeric) + imp_model.indicator_names()
    scaler_model = PopulationScaler(inputCols=scaled_cols).fit(imp_model.transform(train))
    assembler = VectorAssembler(inputCols=ohe_out + scaled_cols, outputCol="features")
    from pyspark.ml import PipelineModel

    model = PipelineModel(stages=[*cat_model.stages, imp_model, scaler_model, assembler])
    return model, ohe_out + scaled_cols
