"""Similarities of two strings, token arrays or number lists, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def grams(s: Column, n: int) -> Column:
    """Runs of n bytes as whole numbers, the k-th run of a kind told from the others by k: shared runs of
    two strings, as multisets, are then shared numbers."""
    h = F.hex(F.encode(s, "UTF-8"))
    codes = let(h, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2 * n + 1, F.lit(2)), lambda i: F.conv(F.substr(x, i, F.lit(2 * n)), 16, 10).cast("bigint")))
    told = let(codes, lambda g: F.transform(g, lambda x, i: x + F.lit(1 << 32) * F.size(F.filter(F.slice(g, F.lit(1), i), lambda y: y == x))))
    return F.when(F.octet_length(s) >= n, told).otherwise(F.array().cast("array<bigint>"))


def dice(a: Column, b: Column, ga: Column, gb: Column) -> Column:
    """Dice similarity of strings with their grams; 1 if equal, 0 if either is empty or too short."""
    total = F.size(ga) + F.size(gb)
    value = 2.0 * F.size(F.array_intersect(ga, gb)) / F.greatest(total, F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(value)


def _dice(a: Column, b: Column, n: int) -> Column:
    return let(grams(a, n), lambda x: let(grams(b, n), lambda y: dice(a, b, x, y)))


def dice3(a: Column, b: Column) -> Column:
    """Dice similarity of the multisets of byte trigrams."""
    return _dice(a, b, 3)


def dice2(a: Column, b: Column) -> Column:
    return _dice(a, b, 2)


def token_overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def token_jaccard(a: Column, b: Column) -> Column:
    return F.when(F.least(F.size(a), F.size(b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def number_overlap(a: Column, b: Column) -> Column:
    pick = lambda v: F.filter(v, lambda t: t.rlike("^[0-9]") & (F.octet_length(t) >= 2))
    return token_overlap(pick(a), pick(b))


def length_ratio(a: Column, b: Column) -> Column:
    most = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(most > 0, F.least(F.octet_length(a), F.octet_length(b)) / most).otherwise(0.0)


def contained(a: Column, b: Column, least: int = 3) -> Column:
    return (F.least(F.octet_length(a), F.octet_length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def digit_subsequence(shorter: Column, longer: Column) -> Column:
    """Whether a shorter run of digits is a subsequence of a longer one."""
    pattern = F.concat(F.lit(".*"), F.regexp_replace(shorter, "([0-9])", "$1.*"))
    return (shorter != "") & (F.length(shorter) < F.length(longer)) & F.regexp(longer, pattern)


def numeric_evidence(a: Column, b: Column) -> dict[str, Column]:
    """Numbers of a that b lacks: how many hold a number of b as subsequence, how many have three
    digits or more, how many fewer."""
    gone = F.array_except(a, b)
    return {
        "omissions": F.size(F.filter(gone, lambda w: F.exists(b, lambda v: digit_subsequence(v, w)))),
        "long": F.size(F.filter(gone, lambda w: F.octet_length(w) >= 3)),
        "short": F.size(F.filter(gone, lambda w: F.octet_length(w) < 3)),
    }


def sigmoid(x: Column, clip: float) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))
