"""Named scorers and models: how new ones plug in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.policy import detect, fallback, stage

#: Model name -> factory of an estimator. Fill it with the ``model`` decorator.
MODELS: dict[str, Callable[..., Estimator]] = {}


def model(name: str) -> Callable:
    """Register an estimator factory under a name."""
    def add(factory: Callable[..., Estimator]) -> Callable[..., Estimator]:
        MODELS[name] = factory
        return factory
    return add


def make_model(name: str, **params) -> Estimator:
    if name not in MODELS:
        raise KeyError(f"unknown model {name}; known: {sorted(MODELS)}")
    return MODELS[name](**params)


class ScorerBook:
    """Scorers by name with a default; a scorer is a score column over the input table."""

    def __init__(self) -> None:
        self.scorers: dict[str, Column] = {}
        self.default: str | None = None

    def register(self, name: str, score: Column, default: bool = False) -> None:
        self.scorers[name] = score
        if default or self.default is None:
            self.default = name

    def unregister(self, name: str) -> None:
        if self.scorers.pop(name, None) is not None and self.default == name:
            self.default = next(iter(self.scorers), None)

    def detect(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Score a table; an unknown name gives the no-model answer."""
        chosen = name or self.default
        if chosen not in self.scorers:
            return fallback(df)
        return detect(df.withColumn("_score", self.scorers[chosen]), "_score", chosen).drop("_score")


# --- fixed values: which stage a kind of model belongs to -----------------------------------
STAGE_OF = {"encoder_ensemble": "anomaly", "behavior": "anomaly", "flow_classifier": "classification", "ml": "classification",
            "dl": "classification", "policy": "decision"}


def adapt(kind: str, name: str, score: Column, threshold: Column | float = 0.5, action: Column | None = None) -> Column:
    """Any model's score as a stage result: anomaly scores against their threshold, class
    probabilities against 0.5, policies by their action."""
    where = STAGE_OF.get(kind, "classification")
    if where == "decision":
        return stage(name, where, F.lit(0.0), action.isin("BLOCK", "QUARANTINE"), action=action)
    return stage(name, where, score, score > threshold)


class ColumnStage(Transformer):
    """A pipeline stage that adds one stage-result column."""

    def __init__(self, output: str, result: Column) -> None:
        super().__init__()
        self.output, self.result = output, result

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output, self.result)


class CollectStages(Transformer):
    """Gather the stage columns into the ``results`` array."""

    def __init__(self, columns: list[str]) -> None:
        super().__init__()
        self.columns = columns

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("results", F.array_compact(F.array(*self.columns))).drop(*self.columns)


class StageBuilder:
    """Builds a pipeline of stage results, in the order they are added."""

    def __init__(self) -> None:
        self._stages: list[ColumnStage] = []

    def add(self, kind: str, name: str, score: Column, **options) -> StageBuilder:
        self._stages.append(ColumnStage(f"_stage_{name}", adapt(kind, name, score, **options)))
        return self

    def build(self) -> Pipeline:
        return Pipeline(stages=[*self._stages, CollectStages([s.output for s in self._stages])])
