"""Catalogue of runnable queries: a Spark builder and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewatch.runtime import pin_utc, spread
from tidewatch.sources import views

Builder = Callable[["Tables"], DataFrame]


class Tables:
    """Lazily reads the tables of one data folder and derives the analytic views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        derived = {
            "traffic": lambda: views.traffic(self.events, self.nation),
            "packets": lambda: views.packets(self.events),
            "flows": lambda: views.flows(self.lineitem),
            "phishing": lambda: views.phishing(spread(self.events)),
            "rich_pages": lambda: views.rich_pages(self.pages),
            "urls": lambda: views.urls(self.pages),
            "domain_facts": lambda: views.domain_facts(self.pages),
            "host_lists": lambda: views.host_lists(self.events, self.supplier),
            "predictions": lambda: views.predictions(self.traffic),
            "decisions": lambda: views.decisions(self.traffic),
            "model_scores": lambda: views.model_scores(self.traffic),
        }
        if name in derived:
            return derived[name]()
        if name.startswith("_"):
            raise AttributeError(name)
        return views.table(self.spark, self.sf_dir, name)


@dataclass
class Query:
    build: Builder
    sql: str | None
    covers: str


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query under ``name``; ``covers`` lists the survey rows it exercises."""
    def add(build: Builder) -> Builder:
        assert name not in CATALOG, name
        CATALOG[name] = Query(build, sql, covers)
        return build
    return add


def runner(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(pin_utc(spark), sf_dir))
    return run
