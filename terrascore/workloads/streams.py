"""Structured Streaming runs over the event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from terrascore.operators.contracts import FieldMapping
from terrascore.plans import roles
from terrascore.session import shared_folder
from terrascore.streaming import loads
from terrascore.workloads import register
from terrascore.workloads.landing import _REVENUE, _SALES, L0

_EVENTS = FieldMapping("shop", "events", "events", dedupe_keys=("event_id",), late_arrivals_days=31)


@register("stream_dedupe", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice and leaves once."""
    twice = loads.read_stream(spark, sf_dir, "events").union(loads.read_stream(spark, sf_dir, "events"))
    kept = loads.stream_dedupe(twice, _EVENTS).select("event_id", "user_id", "event_type", "value")
    return loads.run_to_table(kept, "deduped")


def _curated(spark: SparkSession, sf_dir: str) -> str:
    base = f"{shared_folder(spark)}/terrascore/curated-{uuid.uuid4().hex}"
    l0 = roles.landing_from_events(loads.read_stream(spark, sf_dir, "events"))
    loads.start_curated_load(l0, roles.RULES, f"{base}/sales", f"{base}/revenue", f"{base}/progress").awaitTermination()
    return base


@register("stream_l0_to_l1", f"WITH {L0} {_SALES}")
def stream_l0_to_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(loads.SALES_SCHEMA).parquet(f"{_curated(spark, sf_dir)}/sales")


@register("stream_l0_to_l1_revenue", f"WITH {L0} {_REVENUE}")
def stream_l0_to_l1_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(loads.REVENUE_SCHEMA).parquet(f"{_curated(spark, sf_dir)}/revenue")
