"""All queries of the engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import artifacts, crawl, evaluation, legal, retrieval, rules, store, streams, structure, text, windows  # noqa: F401  they register
from corpusloom.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation of a rule classifier against labelled documents."""
    return QUERIES["eval_rates"](spark, sf_dir)
