"""Raw to curated load and the profile that suggests its mapping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.operators import changes, curated
from terrascore.session import materialize, spread
from terrascore.sources import landing


@dataclass
class CuratedBatch:
    """Typed rows of one load."""

    parsed: DataFrame
    sales: DataFrame
    revenue: DataFrame

    def stats(self) -> DataFrame:
        return curated.load_stats(self.parsed, self.sales, self.revenue)


def curate(l0: DataFrame, rules: Sequence[landing.FileRule]) -> CuratedBatch:
    # parsed once, then read by both targets and the statistics
    kept = ["id", "source_name", "report_period", "source_file", "rule", "records", "columns"]
    parsed = materialize(landing.with_records(spread(landing.match_rule(l0, rules))).select(*kept), "l0-records")
    ready = parsed.filter(F.size("records") > 0)
    return CuratedBatch(
        parsed,
        curated.map_fields(ready.filter(F.col("rule.target") == "sales"), curated.SALES_FIELDS),
        curated.map_fields(ready.filter(F.col("rule.target") == "revenue"), curated.REVENUE_FIELDS),
    )


def upsert_curated(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The curated table after a batch; the last record of a key wins."""
    fresh = changes.last_wins(batch, curated.KEYS, ["record_no"]).drop("record_no")
    if target is None:
        return fresh
    return changes.upsert_snapshot(target, batch.select(*target.columns, "record_no"), curated.KEYS, ["record_no"])


def profile(l0: DataFrame) -> DataFrame:
    """Roles inferred per landing row, for votes, examples and the suggested mapping."""
    parsed = materialize(landing.sniffed_records(spread(l0)).select("id", "records", "columns"), "l0-records")
    return curated.infer_roles(parsed)
