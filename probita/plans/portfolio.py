"""Portfolio risk: statistics, payload, assessment and the top cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probita.operators import cases, risk
from probita.operators import transactions as tx
from probita.sources import tables


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    stats = tx.client_statistics(tables.transactions(spark, folder))
    return risk.client_payload(tx.with_statistics(tables.clients(spark, folder), stats))


def assessments(spark: SparkSession, folder: str, details: bool = False) -> DataFrame:
    scored = risk.assess(payloads(spark, folder), details)
    return scored.withColumn("client_id", F.col("customer_id").cast("long"))


def portfolio(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query: the thirty cases with the highest risk."""
    return cases.top_cases(assessments(spark, folder)).select(
        "client_id", "risk_score", "base_score", "risk_level", "confidence_score", "risk_delta", "risk_trend",
        "escalation_floor", "trigger_investigation", "sar_recommended", *risk.COMPONENTS,
        F.array_join("top_reasons", " | ").alias("top_reasons"),
    )
