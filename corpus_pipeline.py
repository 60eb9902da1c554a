"""A training corpus from raw documents, stage by stage.

Every stage reads what the one before has kept, and its decisions take effect. Rows travel whole: all stages but the last return the
columns of their input, whatever these are. The last returns them with their shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascore.llm.common import Scratch
from terrascore.llm.decontamination import DecontaminationSettings, leaks
from terrascore.llm.mixing import MixingSettings, mix_to_targets
from terrascore.llm.ngram_join import ngram_join
from terrascore.llm.rules import quality_rules
from terrascore.llm.sharding import shards
from terrascore.operators.joins import lookup_join

#: Largest shard in bytes of text.
SHARD_BYTES = 32 << 20
#: Most 8-byte keys that are broadcast.
BROADCAST_KEYS = 1_000_000
#: Sources, languages and topics meet their targets as long as half of the tokens are kept; rare ones do not cost more than that.
MIXING = MixingSettings(least_kept=0.5)
#: Verbatim copies in any case and long passages of an item are leaks too.
LEAKS = DecontaminationSettings(literal=True, least_run=13)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; null and empty texts do not, repeated rows are judged alike."""
    return quality_rules(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the row with the smallest id (of those, the smallest text hash); null ids come last.

    Texts without words are in no group and stay. Rows equal in id and text are one, the one whose columns come first as JSON.
    """
    scratch = Scratch(spark, "near-copies")
    found = scratch.store(ngram_join(docs).where("n_shingles > 0").select("doc_id", "text_key", "component_key"), "found")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    keepers = found.groupBy("component_key").agg(F.min(rank).alias("k"), F.count("*").alias("n"))
    keepers = scratch.store(keepers.select("component_key", F.col("k.doc_id").alias("first_id"), F.col("k.text_key").alias("first_key"), "n"), "keepers")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    key = F.xxhash64("doc_id", "text_key").alias("row_key")
    spare = scratch.store(lookup_join(found, keepers, ["component_key"], "n").where(~is_first).select(key).distinct(), "spare")
    twice = scratch.store(found.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select("row_key"), "twice")

    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("row_key"))
    kept = rows.join(small_side(spare), "row_key", "left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    single = kept.join(small_side(twice), "row_key", "left_anti").select("row")
    once = kept.join(small_side(twice), "row_key", "left_semi").groupBy("row_key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.union(once).select("row.*")


def small_side(keys: DataFrame) -> DataFrame:
    """Keys to be broadcast while there are at most BROADCAST_KEYS of them; beyond that the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked; null and empty texts and an empty benchmark hold no leak."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = Scratch(spark, "leaked").store(leaks(docs, benchmark, LEAKS).select("doc_key").distinct(), "keys")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("doc_key"))
    return rows.join(small_side(leaked), "doc_key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that bring sources, languages and topics to their target shares of the tokens, or as near as MIXING allows."""
    return mix_to_targets(docs, MIXING, carry=True).where("sampled").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard; columns of the input with these names come back with ``input_`` before them.

    Null and empty texts have no bytes and share a shard; repeated rows stay as they are; an empty table has no rows.
    """
    own = ["shard", "shard_depth", "shard_bytes"]
    placed = shards(docs, SHARD_BYTES)
    kept = [F.col(f"row.`{c}`").alias(f"input_{c}" if c in own else c) for c in docs.columns]
    return placed.select(*kept, "shard", F.col("depth").alias("shard_depth"), "shard_bytes")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaked),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]
#: Raking is iterative and the near copies are a transitive closure over all texts; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
