"""Mixing sources to target weights, by DataFrame functions only.

Words are counted per source, targets are filled by weight under a repetition cap, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal
to the fraction of the rate.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its
own, last in order; rows that repeat a document (same id, same text) share one draw; an empty
table gives an empty mix; if all sizes are 0, all targets are 0 and no copy is emitted. Extra
columns are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table

#: A hot source may hold a third of the rows: its rows meet the plan in so many parts.
SALT = 16
_P = "__mix_"
WORD = r"[^\x20\x09-\x0D]+"


def _measured(docs: DataFrame, key: str, text: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), body))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return [F.regexp_count(body, F.lit(WORD)).cast("bigint").alias(f"{_P}size"), part(1).alias(f"{_P}a"), part(9).alias(f"{_P}b")]


def _drawn(frac: Column, k: Column) -> Column:
    """Whether the draw with seed k takes the extra copy: one digest gives every seed's number."""
    u = F.pmod(F.col(f"{_P}a") + k * F.col(f"{_P}b"), F.lit(1 << 32))
    return u.cast("double") < frac * F.lit(float(1 << 32))


def source_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (1, 2, 3), cap: float = 3.0, seeds: int = 32) -> DataFrame:
    """One row per source: its size, target, whole copies, fraction and the seed of its draws.

    Of ``seeds`` draws, each Bernoulli with the same probability, every source takes the one whose
    words come nearest to its target (first seed of equals): one long document then can't push a
    small source off its target."""
    sized = stored(docs.select(F.col(source).alias("source"), *_measured(docs, key, text)), "mix-sizes")
    # one row per source from here on: the windows without a partition see sources, not documents
    sums = sized.groupBy("source").agg(F.sum(f"{_P}size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sums = sums.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights)))))
    sums = sums.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("r", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    before = Window.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), zero)
    open_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero)
    sums = sums.withColumn("lam", left / open_w)
    # the first source (by room for its weight) that its share doesn't fill sets the level for all
    place = F.row_number().over(Window.orderBy("r", F.col("source").asc_nulls_last()))
    first = sums.withColumn("first", F.when(F.col("r") > F.col("lam"), F.struct(place.alias("n"), F.col("lam"))))
    level = F.min("first").over(whole)["lam"]
    plan = first.withColumn("target", F.coalesce(F.least("cap", F.col("w") * level), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select("source", "source_size", "target", F.floor(rate).alias("copies"), (rate - F.floor(rate)).alias("frac"))
    plan = stored(plan, "mix-plan")
    both = sized.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")))
    tries = [F.sum(F.when(_drawn(F.col("frac"), F.lit(k)), F.col(f"{_P}size")).otherwise(0)).alias(f"k{k}") for k in range(seeds)]
    drawn = both.groupBy("source", "source_size", "target", "copies", "frac").agg(*tries)
    miss = [F.struct(F.abs(F.col(f"k{k}") - F.col("frac") * F.col("source_size")).alias("d"), F.lit(k).alias("k")) for k in range(seeds)]
    best = F.array_min(F.array(*miss))["k"].alias("seed")
    return stored(drawn.select("source", "source_size", "target", "copies", "frac", best), "mix-seeds")


def mix_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with a struct ``mix_plan``: size, source_size, target, copies (how often the mix
    takes the document). The plan has a row per source and meets the documents by a salted
    equi-join; the planner broadcasts it if its stored size is under the session's threshold."""
    plan = source_plan(docs, key, text, source, **options)
    plan = plan.select(*[F.col(c).alias(f"{_P}p_{c}") for c in plan.columns], F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(f"{_P}p_salt"))
    sized = docs.select("*", *_measured(docs, key, text))
    same = F.col(source).eqNullSafe(F.col(f"{_P}p_source")) & (F.pmod(f"{_P}a", F.lit(SALT)) == F.col(f"{_P}p_salt"))
    extra = _drawn(F.col(f"{_P}p_frac"), F.col(f"{_P}p_seed")).cast("bigint")
    copies = F.when(F.col(f"{_P}size") > 0, F.col(f"{_P}p_copies") + extra).otherwise(0)
    out = F.struct(F.col(f"{_P}size").alias("size"), F.col(f"{_P}p_source_size").alias("source_size"), F.col(f"{_P}p_target").alias("target"), copies.cast("bigint").alias("copies"))
    return sized.join(plan, same).select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix_plan"], out.alias("mix_plan"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    counted = mix_counts(docs, **options).filter(F.col("mix_plan.copies") > 0)
    n = F.col("mix_plan.copies")
    return counted.withColumn(f"{_P}copy", F.explode(F.sequence(F.lit(1).cast("bigint"), n))).select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix_plan"])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = F.col("mix_plan")
    return mix_counts(docs).select(
        "doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"), m["copies"].alias("copies")
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS h FROM documents),
drawn AS (SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS a, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS b FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM drawn GROUP BY source),
ranked AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM sums),
capped AS (SELECT *, source_size * CAST(3 AS DOUBLE) AS cap, source_size * CAST(3 AS DOUBLE) / w AS r FROM ranked),
levels AS (SELECT *, row_number() OVER (ORDER BY r, source ASC NULLS LAST) AS n, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lam
  FROM capped WINDOW o AS (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT source, source_size, coalesce(least(cap, w * arg_min(lam, n) FILTER (WHERE r > lam) OVER ()), cap) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM filled),
tries AS (SELECT p.source, k, abs(sum(CASE WHEN CAST((a + k * b) % 4294967296 AS DOUBLE) < (rate - floor(rate)) * 4294967296.0 THEN size ELSE 0 END) - (rate - floor(rate)) * source_size) AS miss
  FROM drawn d JOIN rates p ON d.source IS NOT DISTINCT FROM p.source, range(32) t(k) GROUP BY p.source, rate, source_size, k),
seeds AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, k) AS n FROM tries) WHERE n = 1),
taken AS (SELECT d.doc_id, d.size, p.source_size, p.target,
  CASE WHEN d.size > 0 THEN CAST(floor(p.rate) AS BIGINT) + CASE WHEN CAST((a + s.k * b) % 4294967296 AS DOUBLE) < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END ELSE 0 END AS copies
  FROM drawn d JOIN rates p ON d.source IS NOT DISTINCT FROM p.source JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM taken
"""
