"""Accessibility index: hubs, nearest hub, distance decay, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.operators import distance
from terrascore.session import materialize


def accessibility_index(
    places: DataFrame, cascade: Sequence[float] = (10_000, 5_000), scale_km: float = 500.0, size: str = "size"
) -> DataFrame:
    """``entity_id, hub_id, hub_name, hub_km, access_raw, access_score`` for every place."""
    known = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    hubs = distance.hub_filter(known, size, cascade)
    near = materialize(distance.nearest_hub(places.select("entity_id", "lat", "lon"), hubs), "nearest-hub")
    scored = distance.accessibility(near, scale_km).drop("lat", "lon")
    if "entity_name" not in places.columns:
        return scored
    names = materialize(scored.select("hub_id").distinct().join(places.select(F.col("entity_id").alias("hub_id"), F.col("entity_name").alias("hub_name")), "hub_id"), "hub-names")
    return scored.join(names, "hub_id", "left")
