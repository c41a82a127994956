"""File sources with the reference layouts, fallbacks, and batch scoring jobs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import KDD, PHISHING


def read_features(spark: SparkSession, path: str, schema: T.StructType = PHISHING) -> DataFrame:
    """CSV with a header; the text ``na`` is a missing value in every column."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "na").csv(path)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("na")) for c in texts})


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Headerless connection records with their 43 names."""
    return spark.read.schema(KDD).csv(path, header=False)


def read_first_available(spark: SparkSession, sources: Sequence[tuple[str, dict]], drop: Sequence[str] = ("_id",)) -> DataFrame:
    """The first source that can be read and has rows; ``sources`` are (format, options)."""
    failures = []
    for kind, options in sources:
        options = dict(options)
        schema = options.pop("schema", None)
        try:
            reader = spark.read.format(kind).options(**options)
            rows = (reader.schema(schema) if schema is not None else reader).load()
            if not rows.isEmpty():
                return rows.drop(*drop)
            failures.append(f"{kind}: empty")
        except PySparkException as e:
            failures.append(f"{kind}: {type(e).__name__}")
    raise ValueError("no source could be read: " + "; ".join(failures))


def write_store(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_split(train: DataFrame, test: DataFrame, folder: str) -> tuple[str, str]:
    paths = f"{folder}/train", f"{folder}/test"
    for part, path in zip((train, test), paths):
        write_store(part, path)
    return paths


def load_schema(path: str) -> T.StructType:
    """Schema from a JSON or YAML file: a struct definition, or ``columns`` as a list of
    one-entry maps from name to type."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        content = yaml.safe_load(text)
    else:
        content = json.loads(text)
    if "fields" in content:
        return T.StructType.fromJson(content)
    kinds = {"int64": T.LongType(), "float64": T.DoubleType(), "object": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for entry in content["columns"] for n, k in entry.items()])


def save_model(fitted: Model, path: str) -> None:
    fitted.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_file(spark: SparkSession, source: str, model_path: str, target: str, schema: T.StructType = PHISHING) -> DataFrame:
    """Score a CSV file with a saved pipeline and write the rows with their predictions."""
    from tidewatch.operators.labels import verdict_text

    out = load_model(model_path).transform(read_features(spark, source, schema))
    keep = [f.name for f in schema.fields if f.name in out.columns]
    scored = out.select(*keep, F.col("prediction").cast("int").alias("prediction"), verdict_text(F.col("prediction").cast("int")).alias("verdict"))
    write_store(scored, target)
    return spark.read.parquet(target)
