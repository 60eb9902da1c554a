"""Principal components, k-means and typology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.functions.numbers import round_half_up
from terrascore.operators import learning, summaries
from terrascore.plans import indicators, roles, typology
from terrascore.session import materialize
from terrascore.workloads import register
from terrascore.workloads.index import index_frame
from terrascore.workloads.reports import PATTERN, SCORES, SIZE_BANDS
from terrascore.workloads.sql import rnd


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.scan(spark, sf_dir, "embeddings")
    return materialize(learning.array_vectors(rows.withColumnRenamed("vec_id", "entity_id"), "embedding", ["entity_id", "label"]), "vectors")


def _components(spark: SparkSession, sf_dir: str) -> learning.Components:
    return learning.pca_components(_vectors(spark, sf_dir), 15)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _components(spark, sf_dir).scores
    return materialize(found.select("entity_id", learning.array_to_vector("components").alias("features")), "components")


@register(
    "standardise",
    f"""WITH cells AS (SELECT vec_id AS entity_id, unnest(range(len(embedding))) AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT entity_id, position, {rnd('(x - avg(x) OVER (PARTITION BY position)) / stddev_pop(x) OVER (PARTITION BY position)')} AS z FROM cells""",
)
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, _, _ = learning.standardise(_vectors(spark, sf_dir))
    cells = scaled.select("entity_id", F.posexplode(learning.vector_to_array("features")).alias("position", "z"))
    return cells.select("entity_id", F.col("position").cast("bigint").alias("position"), round_half_up(F.col("z"), 6).alias("z"))


@register("pca_components")
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _components(spark, sf_dir).scores
    return scores.select("entity_id", F.posexplode("components").alias("component", "score"))


@register("pca_explained")
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).explained()


@register("pca_importance")
def pca_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _components(spark, sf_dir)
    names = [f"x{i:02d}" for i in range(len(found.loadings))]
    return found.importance(names).orderBy(F.desc("importance"), "code")


@register("kmeans_select")
def kmeans_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, _ = learning.kmeans_select(_scores(spark, sf_dir))
    return metrics


@register("kmeans_assign")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    _, model = learning.kmeans_select(scores)
    return model.transform(scores).select("entity_id", "cluster_id")


@register(
    "pca_norms",
    """WITH cells AS (SELECT vec_id AS entity_id, unnest(range(len(embedding))) AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    z AS (SELECT entity_id, (x - avg(x) OVER (PARTITION BY position)) / stddev_pop(x) OVER (PARTITION BY position) AS z FROM cells)
    SELECT entity_id, round(sum(z * z), 4) AS squared FROM z GROUP BY 1""",
)
def pca_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every component kept, the squared scores of a row add up to its standardised squared length."""
    rows = _vectors(spark, sf_dir)
    width = len(rows.select("features").head()[0])
    found = learning.pca_components(rows, width).scores
    squared = F.aggregate("components", F.lit(0.0), lambda total, x: total + x * x)
    return found.select("entity_id", F.round(squared, 4).alias("squared"))


@register(
    "kmeans_balance",
    """WITH cells AS (SELECT vec_id, unnest(range(len(embedding))) AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    c AS (SELECT x - avg(x) OVER (PARTITION BY position) AS d FROM cells)
    SELECT (SELECT count(*) FROM embeddings) AS n_rows, (SELECT round(sum(d * d), 3) FROM c) AS total_squares, 0::BIGINT AS nearer_elsewhere""",
)
def kmeans_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes sum to all rows, squares within and between clusters to all squares, and no row is nearer to another centre."""
    rows = _vectors(spark, sf_dir)
    _, model = learning.kmeans_select(rows)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    labelled = model.transform(rows).select("cluster_id", learning.vector_to_array("features").alias("x"))
    gap = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    gaps = labelled.withColumn("gaps", F.transform(centres, gap)).withColumn("own", F.get("gaps", F.col("cluster_id")))
    away = gaps.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.array_min("gaps") < F.col("own") - 1e-9).alias("nearer_elsewhere"))
    # squares about the mean of a cluster and of the means about the mean of all, column by column
    cells = labelled.select("cluster_id", F.posexplode("x").alias("position", "v"))
    per = cells.groupBy("cluster_id", "position").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("spread"))
    overall = per.groupBy("position").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("all"), F.sum(F.col("n") * F.col("spread")).alias("inside"))
    between = per.join(overall, "position").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), 2)).alias("between"))
    inside = overall.agg(F.sum("inside").alias("within"))
    total = F.round(inside.select("within").scalar() + between.select("between").scalar(), 3)
    return away.select("n_rows", total.alias("total_squares"), "nearer_elsewhere")


_CELLS = """cells AS (SELECT vec_id, label, unnest(range(len(embedding))) AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@register(
    "davies_bouldin",
    f"""WITH {_CELLS}, centres AS (SELECT label, position, avg(x) AS c FROM cells GROUP BY 1, 2),
    gaps AS (SELECT label, vec_id, sqrt(sum((x - c) * (x - c))) AS d FROM cells JOIN centres USING (label, position) GROUP BY 1, 2),
    spreads AS (SELECT label, avg(d) AS s FROM gaps GROUP BY 1),
    apart AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM centres a JOIN centres b ON a.position = b.position AND a.label <> b.label GROUP BY 1, 2),
    worst AS (SELECT i, max((p.s + q.s) / d) AS r FROM apart JOIN spreads p ON p.label = i JOIN spreads q ON q.label = j WHERE d > 0 GROUP BY 1)
    SELECT {rnd('avg(r)')} AS davies_bouldin FROM worst""",
)
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learning.davies_bouldin(_vectors(spark, sf_dir), label="label")
    return out.withColumn("davies_bouldin", round_half_up(F.col("davies_bouldin"), 6))


@register(
    "silhouette",
    f"""WITH flat AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    sums AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS total, count(*) AS n FROM flat a CROSS JOIN flat b GROUP BY 1, 2, 3),
    each AS (SELECT id, max(CASE WHEN label = other THEN n END) AS n, max(CASE WHEN label = other AND n > 1 THEN total / (n - 1) END) AS a,
      min(CASE WHEN label <> other THEN total / n END) AS b FROM sums GROUP BY 1)
    SELECT {rnd('avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END)')} AS silhouette FROM each""",
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = learning.silhouette_euclidean(_vectors(spark, sf_dir), "entity_id", label="label")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@register("typology")
def typology_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, kept = indicators.imputed_matrix(roles.zones(spark, sf_dir), roles.indicator_facts(spark, sf_dir))
    found = typology.typology(wide, kept, bands=SIZE_BANDS, pattern=PATTERN)
    return summaries.cluster_stats(found.clusters).join(found.names, "cluster_id")


@register("typology_members")
def typology_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with its cluster and the name of it."""
    wide, kept = indicators.imputed_matrix(roles.zones(spark, sf_dir), roles.indicator_facts(spark, sf_dir))
    return typology.typology(wide, kept, bands=SIZE_BANDS, pattern=PATTERN).clusters.select("entity_id", "cluster_id", "cluster_name")


@register("component_clusters")
def component_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(index_frame(spark, sf_dir), "index")
    return typology.component_clusters(index, SCORES, k=4)
