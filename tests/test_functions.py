"""Single values: our own cases and a plain implementation for each kernel."""

import random

import plain as p
import pytest
from pyspark.sql import functions as F

from kinlink.functions import kernels as P
from kinlink.functions import similarity as S
from kinlink.functions import text as X


def table(a, b):
    """Optimal string alignment by the whole table."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_osa_equals_table():
    r = random.Random(5)
    for _ in range(2000):
        a, b = (bytes(r.choice(b"abc") for _ in range(r.randint(1, 10))) for _ in range(2))
        assert P.osa(a, b) == table(a, b)
    assert P.osa(b"ab", b"ba") == 1 and P.osa(b"ca", b"abc") == 3


def test_edit_similarity_reads_192_bytes():
    assert P.edit_similarity("a" * 192 + "x", "a" * 192 + "y") == 1.0
    assert P.edit_similarity("", "a") == 0.0


def test_scripts_sound_alike():
    assert p.sound_words("टाटा स्टील") == p.sound_words("Tata Steel")
    assert p.core_words("École Française SARL") == p.core_words("Ecole Francaise")
    assert p.romanize("दिल्ली") == "dilli"
    assert p.romanize("क‍ष") == "kasha"


def column(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "s,want",
    [("", []), ("  ,, ", []), ("0", ["0"]), ("000", ["0"]), ("007 7", ["7"]), ("B b A", ["a", "b"]), ("École œuf", ["École", "œuf"]), ('say "hi"', ["hi", "say"])],
)
def test_words(spark, s, want):
    assert column(spark, X.words(F.col("s")), s=s) == want
    assert p.words(s) == want


def test_numbers(spark):
    s = "Flat 27K/18K, #00123"
    assert column(spark, X.digit_runs(F.col("s")), s=s) == ["123", "18", "27"]
    assert column(spark, X.first_number(F.col("s")), s="x 0042 7") == "42"
    assert column(spark, X.first_number(F.col("s")), s="none") == ""
    assert column(spark, S.digit_subsequence(F.lit("234"), F.lit("1234"))) is True
    assert column(spark, S.digit_subsequence(F.lit("1235"), F.lit("1234"))) is False


def test_address_phrases_first_only(spark):
    assert column(spark, X.address_words(F.col("s")), s="New York Road, new york") == sorted(["ny", "rd", "new", "york"])
    assert p.address_words("New York Road, new york") == sorted(["ny", "rd", "new", "york"])


@pytest.mark.parametrize("a,b", [("aaaa", "aa"), ("abcabc", "abcab"), ("é", "e"), ("", "x"), ("same", "same"), ("ab", "ba"), ("straße", "strasse")])
def test_dice_is_a_multiset(spark, a, b):
    for n, f in ((2, S.dice2), (3, S.dice3)):
        assert column(spark, f(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(p.dice(a, b, n))


def test_fuzzy_overlap():
    assert P.fuzzy_overlap([], ["a"]) == (0.0, 0)
    mean, lost = P.fuzzy_overlap(["steel", "xy"], ["stele"])
    assert mean == pytest.approx(0.4) and lost == 1
