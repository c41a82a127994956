"""Kernel machines: random Fourier features of the Gaussian kernel before a linear machine."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import gradients
from tidewatch.operators.scans import order_statistics
from tidewatch.operators.scorers import model


#: Rows mapped at once, so that what is computed step by step stays near the core.
CHUNK = 128
#: Taylor coefficients of the sine of a turn's share, for up to a quarter of a turn; the rest is below 1e-15.
SINE = [(-1) ** k * (2.0 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(11)]


def cosines(turns: np.ndarray) -> np.ndarray:
    """Cosine of so many whole turns, in double precision; overwrites its input. ``np.cos`` takes one double at a time on many machines."""
    turns -= np.rint(turns)
    q = np.subtract(0.25, np.abs(turns, out=turns), out=turns)  # the cosine is the sine of what is left to a quarter
    square = q * q
    out = np.full_like(q, SINE[-1])
    for c in SINE[-2::-1]:
        out *= square
        out += c
    out *= q
    return out


class Fourier:
    """A map whose inner products come near ``exp(-gamma * |x - y|^2)``; its size is inputs times ``width``."""

    def __init__(self, inputs: int, gamma: float, width: int = 256, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.turn, self.shift = rng.normal(0.0, np.sqrt(2.0 * gamma), (inputs, width)), rng.uniform(0.0, 2.0 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, turn, shift = np.empty((len(x), len(self.shift))), self.turn / (2.0 * np.pi), self.shift / (2.0 * np.pi)
        for k in range(0, len(x), CHUNK):
            z = x[k:k + CHUNK] @ turn
            z += shift
            np.multiply(cosines(z), np.sqrt(2.0 / len(shift)), out=out[k:k + CHUNK])
        return out


def width_of(df: DataFrame, features: str) -> tuple[int, float]:
    """Number of inputs, and the kernel's usual ``gamma``: one by inputs times the variance of all values."""
    fit = df.agg(Summarizer.mean(F.col(features)).alias("m"), Summarizer.normL2(F.col(features)).alias("s"), F.count("*").alias("n")).first()
    mean = fit["m"].toArray()
    spread = float((fit["s"].toArray() ** 2).sum() / (fit["n"] * len(mean)) - mean.mean() ** 2)
    return len(mean), 1.0 / (len(mean) * spread) if spread > 1e-12 else 1.0


class Hinge(gradients.Net):
    """A plane in the kernel's space and the hinge losses of rows that lie less than 1 on their side of it; ``y`` is 0 or 1."""

    def __init__(self, fourier: Fourier) -> None:
        self.fourier, self.shapes = fourier, [(len(fourier.shift), 1), (1,)]

    def loss(self, flat, x, y):
        mapped, side = self.fourier(x), 2.0 * y - 1.0
        short = 1.0 - side * (mapped @ flat[:-1] + flat[-1])
        pull = np.where(short > 0, -side, 0.0)
        return float(np.maximum(short, 0.0).sum()), np.r_[pull @ mapped, pull.sum()]

    def out(self, flat, x):
        return self.fourier(x) @ flat[:-1] + flat[-1]


class KernelSVCModel(Model, HasFeaturesCol):
    def __init__(self, net: Hinge, flat: np.ndarray, features: str) -> None:
        super().__init__()
        self.net, self.flat = net, flat
        self._set(featuresCol=features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = gradients.outputs(dataset, self.net, self.flat, self.getFeaturesCol(), "_margin")
        raw = array_to_vector(F.array(-F.col("_margin"), F.col("_margin")))
        return rows.withColumns({"rawPrediction": raw, "prediction": (F.col("_margin") > 0).cast("double")}).drop("_margin")


class KernelSVC(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasSeed):
    """Support vector machine of the Gaussian kernel on ``width`` Fourier features; ``gamma`` 0 takes the usual one."""

    gamma = Param(Params._dummy(), "gamma", "inverse width of the kernel", typeConverter=TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "Fourier features", typeConverter=TypeConverters.toInt)

    def __init__(self, *, gamma: float = 0.0, width: int = 256, regParam: float = 0.001, maxIter: int = 100, seed: int = 42, labelCol: str = "label",
                 featuresCol: str = "features") -> None:
        super().__init__()
        self._set(gamma=gamma, width=width, regParam=regParam, maxIter=maxIter, seed=seed, labelCol=labelCol, featuresCol=featuresCol)

    def _fit(self, dataset: DataFrame) -> KernelSVCModel:
        features = self.getFeaturesCol()
        inputs, usual = width_of(dataset, features)
        fourier = Fourier(inputs, self.getOrDefault(self.gamma) or usual, self.getOrDefault(self.width), self.getSeed())
        net, penalty = Hinge(fourier), self.getRegParam()
        # the features of the kernel are made anew in every pass: written, they would take eight times the rows' disk
        rows = gradients.packed(dataset, features, F.col(self.getLabelCol()).cast("double"))

        def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
            n, total, grad = gradients.gradient(rows, net, flat)
            w = np.r_[flat[:-1], 0.0]
            return total / n + 0.5 * penalty * float(w @ w), grad / n + penalty * w

        return KernelSVCModel(net, gradients.minimised(objective, np.zeros(len(fourier.shift) + 1), self.getMaxIter()), features)


@model("kernel_svc")
def kernel_svc(gamma: float = 0.0, width: int = 256, regularization: float = 0.001, iterations: int = 100, seed: int = 42) -> Estimator:
    return KernelSVC(gamma=gamma, width=width, regParam=regularization, maxIter=iterations, seed=seed)


class OneClass(gradients.Net):
    """One-class machine: rows should lie beyond a plane in the kernel's space; a share ``nu`` may not."""

    def __init__(self, fourier: Fourier, nu: float) -> None:
        self.fourier, self.nu, self.shapes = fourier, nu, [(len(fourier.shift), 1), (1,)]

    def loss(self, flat, x, y):
        mapped, w, rho = self.fourier(x), flat[:-1], flat[-1]
        short = rho - mapped @ w
        outside = short > 0
        total = len(x) * (0.5 * float(w @ w) - rho) + float(short[outside].sum()) / self.nu
        return total, np.r_[len(x) * w - outside.astype(float) @ mapped / self.nu, -len(x) + outside.sum() / self.nu]

    def out(self, flat, x):
        return self.fourier(x) @ flat[:-1]


def one_class(train: DataFrame, df: DataFrame, features: str = "features", nu: float = 0.1, gamma: float = 0.0, width: int = 256, steps: int = 60,
              rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Scores of ``df`` by a one-class machine of ``train`` (negative outside) and labels, -1 outside and 1 inside.

    The plane's distance is set last, to the share ``nu`` of the training scores.
    """
    inputs, usual = width_of(train, features)
    net = OneClass(Fourier(inputs, gamma or usual, width, seed), nu)
    flat, _ = gradients.train(train, net, features, steps=steps, rate=rate, seed=seed)
    cut = order_statistics(gradients.outputs(train, net, flat, features), "score", {"t": F.floor((F.col("n") - 1) * nu)}).select("t").scalar()
    rows = gradients.outputs(df, net, flat, features).withColumn("score", F.col("score") - cut)
    return rows.withColumn("anomaly", F.when(F.col("score") < 0, -1).otherwise(1))
