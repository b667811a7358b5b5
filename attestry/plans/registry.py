"""All registered queries of the evidence engine, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _name in ("urls_plan", "metrics_plan", "text_plan", "facts_plan", "ledger_plan", "ingest_plan", "dossier_plan", "identity_plan", "assembly_plan", "mentions_plan", "contract_plan", "support_plan", "gate_plan", "grounding_plan"):
    _module = importlib.import_module(f"attestry.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["j2_search_excerpts"](spark, sf_dir)
