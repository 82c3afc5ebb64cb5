"""Quality rules: heuristic counts and a hashed n-gram log-likelihood ratio; DataFrame functions only.

Words and word pairs are hashed to ``buckets``; two multinomials with add-one smoothing are
estimated, one over trusted documents, one over the whole corpus. The score of a document is the
mean log ratio of its n-grams, in millionths as whole numbers, so that sums don't depend on their
order. A document is kept if no base rule fails it and its score reaches the threshold.

The trusted side is fitted on all documents of quality 1 that aren't toxic, whatever their number; corpus counts cover
every document. Half of the trusted ones, by hash, is counted; the threshold is the ``floor`` quantile of the scores of
the other half, unseen by the counts, less ``margin``.

Defined results: null and empty texts have no words, so they fail the base rule; a text without n-grams scores 0;
with no trusted document all ratios are 0 and only the base rules decide; repeated rows are judged alike; an
empty table gives an empty result; extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, stored, table, words

BUCKETS, FLOOR, MARGIN = 1 << 14, 0.005, 0.05
MICRO = 1_000_000
_P = "__quality_"


def ngrams(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbours, from the words' hashes."""
    n = F.size(hashes)
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(hashes, 2, n), lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"))
    return F.when(n < 2, one).otherwise(F.concat(one, two))


def repeated_words(hashes: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more in the text."""
    n = F.size(hashes)
    zero = F.lit(0).cast("bigint")

    def counted(grams):
        def at(order):
            same = lambda x, i: F.coalesce(F.get(order, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(order, i + 1)["g"] == x["g"], F.lit(False))
            places = F.array_sort(F.transform(F.filter(order, same), lambda x: x["i"]))
            return bound(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda a, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - a, F.lit(3)))), zero, lambda s, x: s + x
                ),
            )

        order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), zero).otherwise(bound(order, at))

    grams = F.transform(F.slice(hashes, 3, n), lambda h, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h))
    return F.when(n < 4, zero).otherwise(bound(grams, counted))


def base_counts(text: Column) -> dict[str, Column]:
    """The counts that need no words as array. ``text`` must not be null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
        "n_dup_lines": bound(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("bigint"),
    }


def _table_of(rows: list, buckets: int, target: float, raw: float) -> Column:
    """log((t + 1) / (T + M)) - log((r + 1) / (R + M)) per bucket, in millionths: ``buckets`` numbers."""
    import math

    shift = math.log(raw + buckets) - math.log(target + buckets)
    values = [round(MICRO * shift)] * buckets
    for b, r, t in rows:
        values[b] = round(MICRO * (math.log(t + 1) - math.log(r + 1) + shift))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def trusted_texts(docs: DataFrame, ids: DataFrame, part: int, key: str, text: str) -> DataFrame:
    """Texts of one half (0 or 1, by hash) of the documents named by ``ids``. A text is dealt out once, and by the
    same plan whatever the number of ids: no table of ids is broadcast."""
    half = lambda c: F.pmod(F.xxhash64(F.lit("half"), c), F.lit(2)) == part
    name = f"{_P}id"
    texts = docs.select(F.col(key).try_cast(ids.schema[name].dataType).alias("k"), F.col(text)).filter(half(F.col("k")))
    return texts.join(ids.filter(half(F.col(name))).hint("merge"), F.col("k") == F.col(name)).select(text)


def judged(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """``docs`` with a struct ``quality``: the base counts, score, base_failed, kept.

    ``trusted`` has a column ``key``; its ids are kept in the shared folder and each half is joined with its texts
    once. The counts reach the driver as at most ``buckets`` rows and return as one literal."""
    hashed = lambda: F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    some = stored(trusted.select(F.col(key).alias(f"{_P}id")).filter(F.col(f"{_P}id").isNotNull()).distinct(), "quality-trusted")
    counted = lambda rows: {r["b"]: r["n"] for r in rows.select(F.explode(bound(hashed(), lambda h: ngrams(h, buckets))).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    whole, good = counted(docs), counted(trusted_texts(docs, some, 0, key, text))
    rows = [(b, n, good.get(b, 0)) for b, n in whole.items()]
    raw, target = sum(r[1] for r in rows), sum(r[2] for r in rows)
    ratios = _table_of(rows if target else [], buckets, target if target else 0, raw if target else 0)

    body = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "quality"]

    def of_hashes(h):
        total = F.aggregate(ngrams(h, buckets), F.lit(0).cast("bigint"), lambda a, b: a + F.get(ratios, b))
        n = F.size(h)
        return F.struct(
            n.cast("bigint").alias("n_words"), repeated_words(h).alias("n_repeat_words"), F.when(n > 0, total / (2 * n - 1) / MICRO).otherwise(0.0).alias("score")
        )

    counts = base_counts(body)
    one = bound(hashed(), of_hashes)
    all_counts = docs.select(*keep, one.alias(f"{_P}w"), *[c.alias(f"{_P}{k}") for k, c in counts.items()], F.col(key).alias(f"{_P}key"))
    w = F.col(f"{_P}w")
    trusted_scores = trusted_texts(docs, some, 1, key, text).select(bound(hashed(), of_hashes)["score"].alias("s"))
    # a histogram in thousandths: the quantile is exact to that step and the same in every run
    steps = sorted((r[0], r[1]) for r in trusted_scores.groupBy(F.floor(F.col("s") * 1000).alias("s")).count().collect())
    threshold, seen = -1e9, 0
    for s, n in steps:
        seen += n
        if seen > floor * sum(x for _, x in steps):
            threshold = s / 1000 - margin
            break
    failed = (w["n_words"] < 50) | (100 * w["n_repeat_words"] > 50 * w["n_words"])
    return all_counts.select(
        *keep,
        F.struct(
            w["n_words"].alias("n_words"), *[F.col(f"{_P}{k}").alias(k) for k in counts], w["n_repeat_words"].alias("n_repeat_words"), w["score"].alias("score"),
            failed.alias("base_failed"), (~failed & (w["score"] >= F.lit(threshold))).alias("kept"),
        ).alias("quality"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    q = F.col("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return judged(docs, trusted).select("doc_id", *[q[n].alias(n) for n in names])
