"""Training-data pipeline over ``documents``: what is toxic, in no language or a near copy goes, secrets are masked, the rest is packed."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tidewatch.llm import jaccard, language, packing, queries, secrets, toxicity  # noqa: E402
from tidewatch.llm.common import materialize, table  # noqa: E402

#: Near duplicates: shingles of five words, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; texts without features stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, out="__score").where("__score < 0.5").select(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts, texts without a letter and those like no learned language go.

    Where no language can be learned all texts with a letter stay. ``lang`` stays as it was.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    found = language.identify(docs, model, docs.columns, out=("__lang", "__score"), reject=True)
    return found.where(found["__lang"] != language.UNKNOWN).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; rows with a null id stay."""
    groups = jaccard.shingle_components(docs, SHINGLE, PERCENT)
    copies = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return jaccard.without(docs, copies).select(*docs.columns)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens."""
    return packing.pack(docs, packing.rank_encoder(public_tokenizers.path(queries.RANKS), queries.SPECIALS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out), ("language", languages), ("near copies", near_copies_out), ("secrets", secrets_masked), ("packing", packed)]

#: The learned stages cannot be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the table that the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
