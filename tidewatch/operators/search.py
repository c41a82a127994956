"""Model-based search of settings with Parzen densities of good and bad ones.

After a few random settings, those tried are split by their result. Each setting's values get two densities, one
over the good and one over the rest, as sums of kernels at the values tried; proposals are drawn from the good
one and the draw with the largest ratio of both is tried next. A round proposes several settings at once, which are judged
side by side; within a round a proposal counts as a bad one, so the others of the round keep away from it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame

from tidewatch.operators.learn import LABEL, make_model


@dataclass(frozen=True)
class Range:
    """A setting between two bounds, by its logarithm if ``log``, rounded if ``whole``; or one of ``choices``."""

    low: float = 0.0
    high: float = 1.0
    log: bool = False
    whole: bool = False
    choices: tuple = ()

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def outer(self, inner: float):
        value = min(self.high, max(self.low, math.exp(inner) if self.log else inner))
        return int(round(value)) if self.whole else value

    def draw(self, rng: random.Random):
        return rng.choice(self.choices) if self.choices else self.outer(rng.uniform(self.inner(self.low), self.inner(self.high)))


class Parzen:
    """Density of one setting over the values tried: a kernel at each and one over the whole range."""

    def __init__(self, setting: Range, tried: list) -> None:
        self.setting, self.tried = setting, tried
        if setting.choices:
            self.weights = [(1 + tried.count(c)) / (len(setting.choices) + len(tried)) for c in setting.choices]
            return
        low, high = setting.inner(setting.low), setting.inner(setting.high)
        self.middle = [(low + high) / 2, *map(setting.inner, tried)]
        # a kernel reaches to the farther of its neighbours, within bounds that shrink with the number of values
        order = sorted(range(1, len(self.middle)), key=lambda i: self.middle[i])
        places = [low, *(self.middle[i] for i in order), high]
        least, most = (high - low) / min(100, len(self.middle) + 1), high - low
        self.spread = [max(most, 1e-12)] * len(self.middle)
        for k, i in enumerate(order, 1):
            self.spread[i] = max(1e-12, min(most, max(least, places[k] - places[k - 1], places[k + 1] - places[k])))

    def draw(self, rng: random.Random):
        if self.setting.choices:
            return rng.choices(self.setting.choices, self.weights)[0]
        i = rng.randrange(len(self.middle))
        return self.setting.outer(rng.gauss(self.middle[i], self.spread[i]))

    def log_density(self, value) -> float:
        if self.setting.choices:
            return math.log(self.weights[self.setting.choices.index(value)])
        x = self.setting.inner(value)
        return math.log(sum(math.exp(-0.5 * ((x - m) / s) ** 2) / s for m, s in zip(self.middle, self.spread)) / len(self.middle) + 1e-300)


def propose(space: dict[str, Range], tried: list[tuple[dict, float]], rng: random.Random, start: int = 10, draws: int = 24, good_share: float = 0.25) -> dict:
    """The next setting to try; higher results are better. The first ``start`` are random."""
    if len(tried) < start:
        return {name: r.draw(rng) for name, r in space.items()}
    ranked = sorted(range(len(tried)), key=lambda i: (-tried[i][1], i))
    cut = max(1, math.ceil(good_share * math.sqrt(len(tried)) * 2))
    good, bad = ranked[:cut], ranked[cut:]
    out = {}
    for name, r in space.items():
        better, worse = Parzen(r, [tried[i][0][name] for i in good]), Parzen(r, [tried[i][0][name] for i in bad])
        out[name] = max((better.draw(rng) for _ in range(draws)), key=lambda v: better.log_density(v) - worse.log_density(v))
    return out


def search(space: dict[str, Range], judge: Callable[[list[dict]], list[float]], trials: int = 20, batch: int = 4, seed: int = 42, start: int = 10) -> list[tuple[dict, float]]:
    """Try ``trials`` settings, ``batch`` at a time; ``judge`` gives the results of a batch. Same seed, same proposals.

    Results that are not numbers count as the worst.
    """
    rng, tried = random.Random(seed), []
    while len(tried) < trials:
        round_: list[dict] = []
        for _ in range(min(batch, trials - len(tried))):
            pending = [(s, -math.inf) for s in round_] if len(tried) >= start else []
            round_.append(propose(space, tried + pending, rng, start))
        tried += [(s, -math.inf if math.isnan(x) else float(x)) for s, x in zip(round_, judge(round_))]
    return tried


def model_search(train: DataFrame, name: str, space: dict[str, Range], trials: int = 20, batch: int = 4, folds: int = 3, metric: str = "f1",
                 seed: int = 42) -> tuple[dict, float, Model]:
    """Best settings of a model family by cross-validation, their result, and the model refitted with them on all rows.

    A batch is one cross-validation, whose fits run side by side; all batches have the same folds.
    """
    estimator = make_model(name)

    def judge(settings: list[dict]) -> list[float]:
        maps = [{estimator.getParam(p): v for p, v in s.items()} for s in settings]
        cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, numFolds=folds, parallelism=len(maps), seed=seed,
                            evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName=metric))
        return list(cv.fit(train).avgMetrics)

    best, result = max(search(space, judge, trials, batch, seed, start=min(10, max(1, trials // 2))), key=lambda t: t[1])
    return best, result, estimator.copy({estimator.getParam(p): v for p, v in best.items()}).fit(train)
