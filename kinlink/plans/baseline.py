"""The three life cycles: baseline matching, enhanced matching with trees, training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import blocking as B
from ..operators import context, decide, features, models, retrieval, vectors


def match_baseline(queries: DataFrame, targets: DataFrame, threshold: float = K.LOGISTIC_THRESHOLD, bits: int = 0, **caps) -> DataFrame:
    """(qid, tid, rank, p, chosen): candidates of the baseline, scored by logistic weights, decided by
    threshold and rules."""
    q, t = B.prepare(queries), B.prepare(targets)
    both = features.pairs(retrieval.retrieve_base(q, t, **caps), q, t)
    x = both.select("qid", "tid", "rank", *[c.alias(k) for k, c in features.legacy().items()])
    x = x.withColumn("p", models.logistic())
    chosen = decide.rules({c: F.col(c) for c in features.LEGACY}, F.col("p"), threshold, bits)
    return x.select("qid", "tid", "rank", "p", chosen.alias("chosen"))


def candidates_and_features(queries: DataFrame, targets: DataFrame, **caps) -> DataFrame:
    """The 107 pair features of enhanced candidates."""
    return vectors.enhanced_pairs(queries, targets, **caps)


ALL = [*features.LEGACY, *features.EXTENDED, *features.ADVANCED]
CONTEXT = ["logit", "p", "log_rank", "other_best", "other_second", "other_third", "other_fourth", "other_sum", *[f"other_count_{k}" for k in context.CUTS],
           "same_best", "same_sum", "same_50", "same_90", "opposite_best", "opposite_sum", "opposite_50", "opposite_90", "share", "gap"]
#: The vector of the second model: 107 pair, 23 context, 26 reference features.
FULL = [*ALL, *CONTEXT, *features.REFERENCE]
#: Pairs at or below this logit have no reference features.
GATE = -8.0
RETRIEVAL = ["retrieval_score", "retrieval_rank", "name_frequency"]


def with_context(scored: DataFrame) -> DataFrame:
    """Pair features plus the 23 context features of each candidate in its query."""
    base = scored.select(F.col("qid").alias("q"), F.col("tid").alias("t"), F.when(F.col("tid").startswith("S2-"), 2).otherwise(3).alias("source"), F.col("logit").alias("score"))
    # both dealt by query, one after the other: no join between them
    both = context.by_source(context.loo(base, ["t"]), ["t"]).withColumn("log_rank", F.log1p(F.col("rank").cast("double")))
    return scored.join(both.select(F.col("q").alias("qid"), F.col("t").alias("tid"), *[c for c in CONTEXT if c != "logit"]), ["qid", "tid"])


def with_reference(scored: DataFrame, q: DataFrame, t: DataFrame, pair_model: models.Trees, **caps) -> DataFrame:
    """``scored`` (pairs with ALL and logit) with the 26 reference features: how well other records of
    source 1 fit the target, and how rare what both names share is. All are 0 at or below ``GATE``.

    Competing records are retrieved and compared once per distinct target, then scored once per pair,
    as they are scored with the pair's own retrieval features."""
    gated = scored.filter(F.col("logit") > GATE).select("qid", "tid", "logit", *RETRIEVAL)
    asked = t.join(gated.select(F.col("tid").alias("entity_id")).distinct(), "entity_id", "left_semi")
    compared = vectors.rival_pairs(asked, q, **caps).select(F.col("tid").alias("rival"), F.col("qid").alias("tid"), *[c for c in ALL if c not in RETRIEVAL])
    rows = gated.join(compared, "tid").filter(F.col("rival") != F.col("qid")).withColumnRenamed("logit", "own")
    values = models.scored(rows, pair_model, ALL, "value").select(F.col("qid").alias("q"), F.col("tid").alias("t"), F.col("own").alias("score"), "rival", "value")
    best = context.competitors(values).select(F.col("q").alias("qid"), F.col("t").alias("tid"), *[F.col(c).cast("double").alias(c) for c in ("best_logit", "second_logit", "better", "confident")])

    both = features.pairs(gated.select("qid", "tid", "logit"), q, t)
    numbers = features.name_counts(both, q).select("qid", "tid", "logit", "reference_query_name_count", "reference_target_name_count", *[c.cast("double").alias(k) for k, c in features.reference_numbers().items()])
    made = numbers.join(features.name_evidence(both, q), ["qid", "tid"]).join(best, ["qid", "tid"], "left")
    top = F.coalesce("best_logit", F.lit(-30.0))
    made = made.withColumns({
        "reference_checked": F.lit(1.0), "reference_best_logit": top, "reference_second_logit": F.coalesce("second_logit", F.lit(-30.0)), "reference_logit_margin": F.col("logit") - top,
        "reference_better_count": F.coalesce("better", F.lit(0.0)), "reference_confident_count": F.coalesce("confident", F.lit(0.0)),
    })
    return scored.join(made.select("qid", "tid", *features.REFERENCE), ["qid", "tid"], "left").fillna(0.0, features.REFERENCE)


def second_stage(pairs: DataFrame, q: DataFrame, t: DataFrame, pair_model: models.Trees, **caps) -> DataFrame:
    """Pairs (in files) with ALL, scored by the pair model, with the vector FULL."""
    from ..sources.workspace import kept

    scored = models.scored(pairs, pair_model, ALL)
    if sum(len(leaves) for _, _, leaves in pair_model.trees) > models.FEW:
        scored = kept(scored, "scored")
    return with_reference(with_context(scored), q, t, pair_model, **caps)


def match_trees(pairs: DataFrame, q: DataFrame, t: DataFrame, pair_model: models.Trees, context_model: models.Trees, **caps) -> DataFrame:
    """(qid, tid, rank, score, chosen) by both models and the expected-F0.5 decision; ``pairs`` has ALL and rank,
    ``q`` and ``t`` are the prepared sides."""
    full = second_stage(pairs, q, t, pair_model, **caps)
    final = models.scored(full.drop("score"), context_model, FULL, "score")
    out = decide.expected_f(final.select(F.col("qid").alias("q"), F.col("tid").alias("t"), F.col("rank"), "score"), ["t"])
    return out.select(F.col("q").alias("qid"), F.col("t").alias("tid"), "rank", "score", "chosen")


def labelled(pairs: DataFrame, truth: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``label``; with ``in_baseline`` too where the baseline's candidates are given."""
    if baseline is not None:
        seen = baseline.select("qid", "tid", F.lit(1).alias("b")).distinct()
        pairs = pairs.join(seen, ["qid", "tid"], "left").withColumn("in_baseline", F.coalesce("b", F.lit(0))).drop("b")
    return pairs.join(truth.withColumn("y", F.lit(1)), ["qid", "tid"], "left").withColumn("label", F.coalesce("y", F.lit(0))).drop("y")


def _publish(spark: SparkSession, found: DataFrame, queries: DataFrame, targets: DataFrame, out: str) -> dict:
    from ..operators.validate import WARNINGS, violations
    from ..sources import tsv

    lists = {
        "matching_results.tsv": tsv.id_lists(queries, found.filter("chosen"), "matched_entity_ids"),
        "candidate_pairs.tsv": tsv.id_lists(queries, found, "candidate_entity_ids"),
    }

    def check(stage: str) -> None:
        again = [tsv.read_tsv(spark, f"{stage}/{name}", tsv.T.StructType.fromDDL(f"source1_entity_id string, {column} string"), skip_malformed=False) for name, column in (("matching_results.tsv", "matched_entity_ids"), ("candidate_pairs.tsv", "candidate_entity_ids"))]
        bad = [r for r in violations(*again, queries, targets).collect() if r["rule"] not in WARNINGS]
        if bad:
            raise ValueError(f"outputs break rules: {bad}")

    return tsv.publish(spark, lists, out, check)


def _sources(spark: SparkSession, base: str, split: str, n: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..sources import tsv

    s1, s2, s3 = (tsv.read_tsv(spark, f"{base}/{split}_source{k}.tsv") for k in (1, 2, 3))
    return s1, s1 if n is None else tsv.prefix(s1, n), tsv.union_targets(s2, s3)


def predict(spark: SparkSession, base: str, split: str, out: str, n: int | None = None) -> dict:
    """The baseline from TSV sources to published lists: read, match, check what was written, rename."""
    from ..sources.workspace import kept

    _, queries, targets = _sources(spark, base, split, n)
    return _publish(spark, kept(match_baseline(queries, targets), "matched"), queries, targets, out)


def predict_trees(spark: SparkSession, base: str, split: str, out: str, models_at: str, n: int | None = None, more=None, reverse: dict | None = None, **caps) -> dict:
    """Enhanced matching from TSV sources to published lists: enhanced candidates, pair trees, context and
    competing references, context trees, expected-F0.5 sets. ``models_at`` holds a package of ``training.package``.
    ``more``: further blocks on both sides (``blocking.sound_blocks``)."""
    from ..sources.workspace import kept
    from .training import unpack

    pair_model, context_model = unpack(spark, models_at)
    reference, queries, targets = _sources(spark, base, split, n)
    q, t = kept(B.prepare(reference), "reference"), kept(B.prepare(targets), "targets")
    own = q if n is None else q.join(queries.select("entity_id"), "entity_id", "left_semi")
    pairs = kept(vectors.enhanced_pairs(own, t, more=more, **caps), "pairs")
    found = kept(match_trees(pairs, q, t, pair_model, context_model, **(reverse or {})), "matched")
    return _publish(spark, found, queries, targets, out)
