"""Ridge regression by LSQR (M5): a distributed bidiagonalisation, one aggregate an iteration.

Minimises ``|X w + b - y|^2 + alpha |w|^2``; the intercept b is not penalised
and alpha not rescaled. Columns and target are centred implicitly, so sparse
rows stay sparse. The bidiagonalisation (Golub and Kahan, as in Paige and
Saunders' LSQR) does not depend on alpha: one run of it serves every alpha.

Its left vectors have one value a row. They are never stored: each is a known
combination of the target and the columns, kept on the driver as one number and
one vector of the width of X. So a pass needs the rows alone, and sends back
three sums: ``|z|^2``, ``sum z`` and ``X' z``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import drop_written, new_output_path

TOLERANCE = 1e-10
MOST_ITERATIONS = 1000
BLOCK_ROWS = 8192
#: Bytes of a block partition, about: small inputs take few tasks a pass.
PARTITION_BYTES = 8 << 20

_BLOCK_SCHEMA = "rows int, row binary, slot binary, value binary, label binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows by their nonzero values."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            row, slot = np.nonzero(x)
            label = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            parts = row.astype(np.int32), slot.astype(np.int32), x[row, slot], label
            columns = [pa.array([len(x)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
            yield pa.RecordBatch.from_arrays(columns, names=["rows", "row", "slot", "value", "label"])


def _passes(width: int, weights: np.ndarray | None, shift: float, scale: float):
    """One row a task: of z = X weights - shift + scale * label (z = label without weights)
    the sums of z^2, z and X' z, of rows, and of X."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 + 2 * width)
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column("rows")[k].as_py()
                row, slot = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in ("row", "slot"))
                value, label = (np.frombuffer(batch.column(c)[k].as_buffer(), np.float64) for c in ("value", "label"))
                z = label
                if weights is not None:
                    z = np.bincount(row, value * weights[slot], n) - shift + scale * label
                total[:3] += z @ z, z.sum(), n
                total[3 : 3 + width] += np.bincount(slot, value * z[row], width)
                if weights is None:
                    total[3 + width :] += np.bincount(slot, value, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _summed(blocks: DataFrame, width: int, weights: np.ndarray | None = None, shift: float = 0.0, scale: float = 0.0) -> np.ndarray:
    parts = blocks.mapInArrow(_passes(width, weights, shift, scale), "sums binary").toArrow().column("sums")
    arrays = sorted((np.frombuffer(p.as_buffer()) for p in parts), key=lambda a: a.tobytes())
    return np.array([math.fsum(column) for column in zip(*arrays)]) if arrays else np.zeros(3 + 2 * width)


class _Damped:
    """The plane rotations of LSQR for one alpha."""

    def __init__(self, damp: float, v: np.ndarray, alfa: float, beta: float):
        self.damp, self.x, self.w = damp, np.zeros(len(v)), v.copy()
        self.rhobar, self.phibar = alfa, beta
        self.residual, self.done = alfa * beta, alfa * beta == 0
        self.psi2 = self.norm2 = 0.0

    def step(self, v: np.ndarray, alfa: float, beta: float, tolerance: float) -> None:
        self.norm2 += alfa**2 + beta**2 + self.damp**2
        rhobar1 = math.hypot(self.rhobar, self.damp)
        c1, s1 = self.rhobar / rhobar1, self.damp / rhobar1
        psi, self.phibar = s1 * self.phibar, c1 * self.phibar
        rho = math.hypot(rhobar1, beta)
        c, s = rhobar1 / rho, beta / rho
        theta, self.rhobar = s * alfa, -c * alfa
        phi, self.phibar = c * self.phibar, s * self.phibar
        self.x = self.x + (phi / rho) * self.w
        self.w = v - (theta / rho) * self.w
        self.psi2 += psi**2
        # The gradient of the whole objective, against what rounding can tell from none.
        self.residual = alfa * abs(s * phi)
        size = math.sqrt(self.phibar**2 + self.psi2)
        self.done = self.residual <= tolerance * math.sqrt(self.norm2) * max(size, 1e-300)


class Fit(NamedTuple):
    alpha: float
    coefficients: np.ndarray
    intercept: float
    iterations: int


def fit_ridge(
    vectors: DataFrame, alphas: Sequence[float], tolerance: float = TOLERANCE, most: int = MOST_ITERATIONS
) -> list[Fit]:
    """One fit for each alpha on ``features`` (vectors without nulls) and ``label``.

    Without rows all coefficients are 0; a constant target gives 0 and itself as intercept.
    """
    spark = vectors.sparkSession.newSession()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    first = vectors.select(F.size(vector_to_array("features")).alias("n")).first()
    width = first.n if first else 0
    path = new_output_path(spark, "ridge")
    rows = vectors.select(vector_to_array("features").alias("x"), F.col("label").cast("double"))
    rows.mapInArrow(_blocks, _BLOCK_SCHEMA).write.parquet(path)
    stored = spark.read.parquet(path)
    size = stored.agg(F.sum(F.length("value"))).first()[0] or 0
    blocks = stored.repartition(max(1, min(2 * size // PARTITION_BYTES + 1, stored.count()))).persist()
    try:
        sums = _summed(blocks, width)
        (yy, y_sum, n), xy, x_sum = sums[:3], sums[3 : 3 + width], sums[3 + width :]
        if not n:
            return [Fit(a, np.zeros(width), 0.0, 0) for a in alphas]
        mean, y_mean = x_sum / n, y_sum / n
        beta = math.sqrt(max(0.0, yy - n * y_mean**2))
        back = xy - x_sum * y_mean
        alfa = float(np.linalg.norm(back)) / beta if beta else 0.0
        if not beta or alfa <= 1e-14 * math.sqrt(yy):
            return [Fit(a, np.zeros(width), y_mean, 0) for a in alphas]
        v = back / (beta * alfa)
        # The left vector: scale * (label - y_mean) + (X - mean) left
        scale, left = 1 / beta, np.zeros(width)
        runs = [_Damped(math.sqrt(a), v, alfa, beta) for a in alphas]
        iterations = 0
        while iterations < most and not all(r.done for r in runs):
            iterations += 1
            left, scale = v - alfa * left, -alfa * scale
            sums = _summed(blocks, width, left, float(mean @ left) + scale * y_mean, scale)
            beta = math.sqrt(sums[0])
            if beta:
                left, scale = left / beta, scale / beta
                back = (sums[3 : 3 + width] - mean * sums[1]) / beta
                new = back - beta * v
                alfa = float(np.linalg.norm(new))
                v = new / alfa if alfa else new
            else:
                alfa = 0.0
            for run in runs:
                if not run.done:
                    run.step(v, alfa, beta, tolerance)
        return [Fit(a, r.x, float(y_mean - mean @ r.x), iterations) for a, r in zip(alphas, runs)]
    finally:
        blocks.unpersist()
        drop_written(spark, path)


class LinearModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """``prediction`` = intercept + coefficients . ``features``."""

    coefficients = Param(Params._dummy(), "coefficients", "by slot", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "not penalised", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, coefficients=None, intercept=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def numFeatures(self) -> int:
        return len(self.getOrDefault(self.coefficients))

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(c)) for c in self.getOrDefault(self.coefficients)])
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        dot = F.aggregate(products, F.lit(float(self.getOrDefault(self.intercept))), lambda total, p: total + p)
        return df.withColumn("prediction", dot)


class Ridge(Estimator):
    """One fit as a pipeline stage."""

    def __init__(self, alpha: float):
        super().__init__()
        self.alpha = float(alpha)

    def _fit(self, df: DataFrame) -> LinearModel:
        return model_of(fit_ridge(df, [self.alpha])[0])


def model_of(fit: Fit) -> LinearModel:
    return LinearModel(coefficients=fit.coefficients.tolist(), intercept=fit.intercept)


def normal_equations(vectors: DataFrame, fit: Fit) -> DataFrame:
    """(slot, rows, residual, scale) of the fit's normal equations, from the rows by plain aggregates:
    ``sum x (y - prediction) - alpha w``, and ``sum |x (y - prediction)| + alpha |w|`` to hold it against; ``rows`` are those with x other than 0.
    Slot -1 is the intercept's equation."""
    scored = model_of(fit).transform(vectors)
    error = F.col("label") - F.col("prediction")
    x = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    long = scored.select(error.alias("error"), F.posexplode(x).alias("slot", "x")).where("x <> 0")
    sums = long.groupBy("slot").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("x") * F.col("error")).alias("g"), F.sum(F.abs(F.col("x") * F.col("error"))).alias("a"))
    weights = [(k, float(w) * fit.alpha) for k, w in enumerate(fit.coefficients)] + [(len(fit.coefficients), 0.0)]
    known = vectors.sparkSession.createDataFrame(weights, "slot int, pull double")
    joined = known.join(sums, "slot", "left").fillna(0)
    slot = F.when(F.col("slot") == len(fit.coefficients), -1).otherwise(F.col("slot"))
    return joined.select(slot.alias("slot"), "rows", (F.col("g") - F.col("pull")).alias("residual"), (F.col("a") + F.abs("pull")).alias("scale"))
