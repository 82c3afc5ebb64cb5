"""Candidates from selected blocks: score, rerank by similarity, keep the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from . import blocking as B
from . import search


def top(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best k per query; equal scores by target id. Adds ``rank`` from 0."""
    by = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col("tid"))
    return hits.withColumn("rank", (F.row_number().over(by) - 1).cast("bigint")).filter(F.col("rank") < k)


def accumulate(blocks: DataFrame, postings: DataFrame, kinds: dict[int, float]) -> DataFrame:
    """Sum of block weights per query and target (in millionths).

    Rows are dealt by query once: the sums, and later rankings within a query, need no further shuffle.
    Blocks are small and their rows many, so the number of partitions is stated (twice that of other
    shuffles, as the planner would drop one that equals the partitioning of the blocks)."""
    scored = blocks.withColumn("w", B.weight(kinds))
    hits = scored.join(postings.withColumnRenamed("entity_id", "tid"), ["country", "type", "key"]).select("qid", "tid", "w")
    parts = 2 * int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartition(parts, "qid").groupBy("qid", "tid").agg(F.sum("w").alias("score"))


def retrieve_base(queries: DataFrame, targets: DataFrame, cap: int = 800, per_family: int = 5, budget: int = 1800, k: int = 80) -> DataFrame:
    """(qid, tid, score, rank) of the baseline."""
    postings = B.base_postings(targets)
    blocks = B.select_base(B.base_lookups(queries), B.block_sizes(postings, cap), per_family, budget)
    return top(accumulate(blocks, postings, K.BASE_WEIGHTS), k)


def retrieve_enhanced(queries: DataFrame, targets: DataFrame, cap: int = 12_000, per_type: int = 8, budget: int = 30_000, first: int = 600, k: int = 160, more=None) -> DataFrame:
    """Enhanced candidates: hits of selected blocks, reranked by weighted similarities of core names and addresses."""
    index = search.build(targets, B.enhanced_keys(more), cap, K.ENHANCED_WEIGHTS)
    return search.search(queries, B.enhanced_asks(more), index, search.smallest_first(per_type, budget), max(first, k), k, (12.0, 8.0, 8.0, 12.0), once=True)


def reverse_retrieve(targets: DataFrame, reference: DataFrame, cap: int = 12_000, per_type: int = 7, budget: int = 12_000, first: int = 120, k: int = 12) -> DataFrame:
    """Competing source-1 records of each target: qid is the target, tid the source-1 record. Run once
    per distinct target, whatever the number of queries it is a candidate of."""
    index = search.build(reference, B.reference_keys(), cap, K.REVERSE_WEIGHTS)
    return search.search(targets, B.reverse_asks(), index, search.smallest_first(per_type, budget), first, k, (15.0, 10.0, 10.0, 20.0))
