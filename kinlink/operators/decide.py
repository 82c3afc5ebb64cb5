"""From scores to links: thresholds, expected-F0.5 sets, rules, and sweeps over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import sigmoid
from ..sources.workspace import kept

#: Ranges of scores in a sweep: at most so many rows are ordered in one task.
RANGES = 200


def threshold(df: DataFrame, t: float) -> DataFrame:
    return df.withColumn("chosen", F.col("score") >= t)


def expected_f(df: DataFrame, tie: list[str], keys: list[str] = ("q",), scale: Column | float = 1.0, shift: Column | float = 0.0) -> DataFrame:
    """The prefix of each query's candidates with the highest expected F0.5; the empty set, worth the
    probability that no candidate is true, wins ties, then the shorter prefix."""
    logit = F.col("score") * scale + shift
    df = df.withColumn("p", sigmoid(logit, 50.0))
    q = Window.partitionBy(*keys)
    by = q.orderBy(F.col("score").desc(), *tie)
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.row_number().over(by)
    utility = F.round(1.25 * F.sum("p").over(run) / (k + 0.25 * F.sum("p").over(q)), 12)
    empty = F.round(F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-15)))).over(q)), 12)
    df = df.withColumns({"k": k, "utility": utility, "empty": empty})
    best = F.max(F.struct("utility", (-F.col("k")).alias("nk"))).over(q)
    df = df.withColumn("best", best)
    return df.withColumn("chosen", (F.col("best.utility") > F.col("empty")) & (F.col("k") <= -F.col("best.nk"))).drop("best")


def rules(x: dict[str, Column], p: Column, t: float | Column, bits: int | Column) -> Column:
    """Threshold on p, changed by rules: 1 equal core without target address, 2 other script with equal
    address, 4 conflicting numbers with weak names."""
    on = lambda k: F.lit(True) if isinstance(bits, int) else bits.bitwiseAND(F.lit(k)) != 0
    out = p >= t
    if not isinstance(bits, int) or bits & 1:
        out = out | on(1) & ((x["core_equal"] > 0.5) & (x["target_address_missing"] > 0.5) & (x["name_dice"] > 0.7))
    if not isinstance(bits, int) or bits & 2:
        out = out | on(2) & ((x["script_mismatch"] > 0.5) & (x["address_dice"] >= 0.72) & (x["address_overlap"] >= 0.72) & (x["number_conflict"] < 0.5))
    if not isinstance(bits, int) or bits & 4:
        out = out & ~(on(4) & (x["number_conflict"] > 0.5) & (x["name_dice"] < 0.7) & (x["name_overlap"] < 0.7))
    return out


def f_half(tp: Column, fp: Column, truth: Column) -> Column:
    """F0.5 of one entity; with nothing true, 1 if nothing was predicted."""
    bottom = 1.25 * tp + fp + 0.25 * (truth - tp)
    return F.when(bottom > 0, 1.25 * tp / bottom).otherwise(1.0)


def sweep(df: DataFrame, truth: DataFrame) -> DataFrame:
    """The threshold with the highest macro F0.5 over all entities of ``truth`` (q, truth), exactly: each
    distinct score is tried, equal scores move together, of equal bests the higher threshold wins.

    Per entity the change of F at each of its own scores; changes are summed per score, and the running sum
    over distinct scores is taken range by range. One row: threshold, macro (rounded)."""
    per = df.join(truth, "q").groupBy("q", "truth", "score").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
    run = Window.partitionBy("q").orderBy(F.col("score").desc())
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumns({"tp": F.sum("tp").over(upto), "n": F.sum("n").over(upto)})
    per = per.withColumn("f", f_half(F.col("tp"), F.col("n") - F.col("tp"), F.col("truth")))
    start = F.when(F.col("truth") == 0, 1.0).otherwise(0.0)
    # whole 1e-12 steps: the sum is the same in any order
    step = F.round((F.col("f") - F.coalesce(F.lag("f").over(run), start)) * 1e12).cast("bigint")
    steps = per.withColumn("d", step).groupBy("score").agg(F.sum("d").alias("d"))
    base = truth.agg(F.count("*").alias("n"), F.count(F.when(F.col("truth") == 0, 1)).alias("singles"))
    # ranges of scores: sums of whole ranges run over a few hundred rows, sums inside a range in its own task
    parts = steps.repartitionByRange(RANGES, F.col("score").desc()).withColumn("part", F.spark_partition_id())
    parts = kept(parts, "sweep")
    sums = parts.groupBy("part").agg(F.sum("d").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = parts.withColumn("own", F.sum("d").over(inside)).join(F.broadcast(before), "part").withColumn("total", F.col("own") + F.col("before"))
    best = total.agg(F.max(F.struct("total", "score")).alias("b"), F.max("score").alias("top"))
    none = F.coalesce(F.col("b.total"), F.lit(0)) <= 0
    return best.join(F.broadcast(base)).select(
        F.when(none, F.col("top") + 1e-12).otherwise(F.col("b.score")).alias("threshold"),
        F.round((F.col("singles") + F.when(none, 0).otherwise(F.col("b.total")) / 1e12) / F.col("n"), 6).alias("macro"),
    )


def grid(df: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Macro F0.5 for each threshold of a short list."""
    cells = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    counted = df.join(F.broadcast(cells), F.col("score") >= F.col("threshold")).groupBy("threshold", "q").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
    every = truth.join(F.broadcast(cells)).join(counted, ["threshold", "q"], "left")
    tp, n = F.coalesce("tp", F.lit(0)), F.coalesce("n", F.lit(0))
    return every.groupBy("threshold").agg(F.round(F.avg(f_half(tp, n - tp, F.col("truth"))), 6).alias("macro"))


def scale_shift(df: DataFrame, truth: DataFrame, scales: list[float], shifts: list[float], tie: list[str]) -> DataFrame:
    """Macro F0.5 of expected-F sets for each scale and shift of the logits."""
    cells = df.sparkSession.createDataFrame([(float(a), float(b)) for a in scales for b in shifts], "scale double, shift double")
    chosen = expected_f(df.join(F.broadcast(cells)), tie, ["q", "scale", "shift"], F.col("scale"), F.col("shift")).filter("chosen")
    counted = chosen.groupBy("scale", "shift", "q").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
    every = truth.join(F.broadcast(cells)).join(counted, ["scale", "shift", "q"], "left")
    tp, n = F.coalesce("tp", F.lit(0)), F.coalesce("n", F.lit(0))
    return every.groupBy("scale", "shift").agg(F.round(F.avg(f_half(tp, n - tp, F.col("truth"))), 6).alias("macro"))


def rule_grid(df: DataFrame, truth: DataFrame, thresholds: list[float], bits: list[int] = range(8)) -> DataFrame:
    """Macro F0.5 for each threshold and set of rules; ``df`` has q, label, score (a probability) and the
    legacy features that rules read."""
    cells = df.sparkSession.createDataFrame([(float(t), int(b)) for t in thresholds for b in bits], "threshold double, rules int")
    x = {c: F.col(c) for c in ("core_equal", "target_address_missing", "name_dice", "script_mismatch", "address_dice", "address_overlap", "number_conflict", "name_overlap")}
    chosen = df.select("q", "label", "score", *x).join(F.broadcast(cells)).filter(rules(x, F.col("score"), F.col("threshold"), F.col("rules")))
    counted = chosen.groupBy("threshold", "rules", "q").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
    every = truth.join(F.broadcast(cells)).join(counted, ["threshold", "rules", "q"], "left")
    tp, n = F.coalesce("tp", F.lit(0)), F.coalesce("n", F.lit(0))
    return every.groupBy("threshold", "rules").agg(F.round(F.avg(f_half(tp, n - tp, F.col("truth"))), 6).alias("macro"))
