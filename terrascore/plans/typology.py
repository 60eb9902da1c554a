"""Typology: complete matrix, components, k-means with a chosen k, named clusters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.operators import learning, summaries
from terrascore.session import materialize


@dataclass
class Typology:
    clusters: DataFrame  # the entity columns, cluster_id, cluster_name
    metrics: DataFrame  # quality per k
    names: DataFrame  # cluster_id, cluster_name


def typology(
    wide: DataFrame,
    codes: Sequence[str],
    ks: Sequence[int] = tuple(range(3, 11)),
    restarts: int = 20,
    components: int = 15,
    bands: Sequence[float] = summaries.LABEL_BANDS,
    pattern: str = summaries.LABEL_PATTERN,
) -> Typology:
    """``wide`` has a complete matrix and ``entity_name, region_name, is_zone, population``."""
    found = learning.pca_components(learning.to_vectors(wide, codes), components)
    scores = materialize(found.scores.select("entity_id", learning.array_to_vector("components").alias("features")), "components")
    metrics, model = learning.kmeans_select(scores, ks, restarts)
    labels = model.transform(scores).select("entity_id", "cluster_id")
    clusters = materialize(wide.join(labels, "entity_id"), "clusters")
    names = summaries.cluster_names(summaries.cluster_descriptors(clusters, pattern), bands)
    return Typology(clusters.join(names, "cluster_id"), metrics, names)


def component_clusters(index: DataFrame, scores: Sequence[str], k: int = 4, restarts: int = 20) -> DataFrame:
    """``entity_id, cluster_id`` from the index components, gaps filled with column means."""
    means = index.agg(F.struct(*[F.avg(c).alias(c) for c in scores]).alias("m")).scalar()
    filled = index.withColumn("_m", means).select("entity_id", *[F.coalesce(F.col(c), F.col(f"_m.{c}")).alias(c) for c in scores])
    vectors = materialize(learning.to_vectors(filled, scores), "component-vectors")
    model = learning.best_kmeans(vectors, k, range(42, 42 + restarts))
    return model.transform(vectors).select("entity_id", "cluster_id")
