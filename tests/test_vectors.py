"""Features taken where candidates are found, against the plans that join both records, and edit kernels of many pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions import edits as E
from kinlink.functions import kernels as P
from kinlink.operators import blocking, features, retrieval, vectors
from kinlink.plans import baseline

SCHEMA = "entity_id string, business_name string, business_address string, country string"


def column(values):
    b = [x.encode() for x in values]
    n = np.array([len(x) for x in b], np.int64)
    return E.Strings(np.cumsum(n) - n, n, np.frombuffer(b"".join(b), np.uint8))


@pytest.mark.parametrize("low, high", [(0, 6), (0, 30), (40, 90), (60, 300)])
def test_edits_equal_plain(low, high):
    r = random.Random(high)
    a = ["".join(r.choice("abcdé") for _ in range(r.randint(low, high))) for _ in range(300)]
    b = ["".join(r.choice("abcdé") for _ in range(r.randint(low, high))) if r.random() < 0.5 else "".join(c for c in x if r.random() < 0.9) for x in a]
    assert E.similarity(column(a), column(b)).tolist() == [P.edit_similarity(x, y) for x, y in zip(a, b, strict=True)]
    assert list(zip(*(x.tolist() for x in E.common_ends(column(a), column(b))), strict=True)) == [P.common_ends(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("tokens", [1 << 20, 50, 1])
def test_fuzzy_overlaps_equal_plain(tokens, monkeypatch):
    monkeypatch.setattr(E, "TOKENS", tokens)
    r = random.Random(tokens)
    some = lambda: sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 8))) for _ in range(r.randint(0, 11))})
    ours, theirs = [some() for _ in range(20)], [some() for _ in range(200)]
    q = np.array([r.randrange(20) for _ in theirs])

    def side(v):
        at, text = E.words(column([" ".join(x) for x in v]))
        return at, np.array([hash(w) for x in v for w in x], np.int64), text

    got = E.fuzzy(q, side(ours), side(theirs))
    for i, t in enumerate(theirs):
        f, g = P.fuzzy_overlap(ours[q[i]], t), P.fuzzy_overlap(t, ours[q[i]])
        assert tuple(x[i] for x in got) == (f[0], g[0], f[1], g[1])


def records(spark):
    r = random.Random(7)
    word = lambda: r.choice(["tata", "steel", "stele", "mill", "oak", "x9", "123", "0456", "411001", "gmbh", "टाटा", "स्टील", "é", "émile", "philips", "q" * 70 + r.choice("xyz"), "w" * 200])
    rows = [(f"S{1 + i % 3}-{i // 3}", " ".join(word() for _ in range(r.randint(0, 5))), " ".join(word() for _ in range(r.randint(0, 6))), r.choice("ab")) for i in range(120)]
    rows += [("S1-3", "tata steel mill", "12 oak", "b"), ("S2-4", "tata steel", "12 oak", "a"), (None, "tata steel", "12 oak", "a"), ("S1-77", "tata steel", "12 oak", None), ("S2-77", "", "", "a"), ("S1-5", "tata steel", "", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.filter("entity_id LIKE 'S1%' OR entity_id IS NULL"), df.filter("entity_id NOT LIKE 'S1%' OR entity_id IS NULL")


def same(got, want):
    got, want = (sorted(map(tuple, x.collect())) for x in (got, want))
    assert len(got) == len(want) > 100
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)


def test_enhanced_pairs_are_described_where_they_are_found(spark):
    """The 107 features, by one search and without a join of pairs."""
    s1, t = records(spark)
    caps = {"cap": 60, "per_type": 4, "budget": 150, "first": 20, "k": 9}
    got = baseline.candidates_and_features(s1, t, **caps)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "MapInPandas" not in plan  # name frequencies are joined to queries
    q, p = blocking.prepare(s1), blocking.prepare(t)
    want = features.pair_features(retrieval.retrieve_enhanced(q, p, **caps), q, p)
    assert got.columns == want.columns
    same(got, want)
    names = got.columns[4:]
    same(vectors.enhanced_pairs(s1, t, places=6, **caps), want.select("qid", "tid", "score", "rank", *[F.round(n, 6) for n in names]))


def test_rivals_are_described_where_they_are_found(spark):
    """Competing records with the features of the pair (competing record, target), without a join of pairs."""
    s1, t = records(spark)
    q, p = blocking.prepare(s1), blocking.prepare(t)
    caps = {"cap": 60, "per_type": 4, "budget": 150, "first": 20, "k": 9}
    got = vectors.rival_pairs(p, q, **caps).drop("score", "rank")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInPandas" not in plan
    rivals = retrieval.reverse_retrieve(p, q, **caps).select(F.col("tid").alias("qid"), F.col("qid").alias("tid"))
    none = rivals.withColumns({c: F.lit(0).cast("bigint") for c in ("score", "rank", "frequency")})
    want = features.all_features(features.pairs(none, q, p), ["qid", "tid"])
    same(got, want.select(F.col("tid").alias("qid"), F.col("qid").alias("tid"), *got.columns[2:]))


def test_small_models_score_as_an_expression(spark):
    """The same scores, bit by bit, and no row through Python; a large model still goes through batches."""
    from kinlink.operators import models

    df = spark.range(200).select((F.col("id") / 7).alias("a"), (F.sin("id") / 3).alias("b"))
    small = models.Trees(2, 0.0, 0.3, -0.7, [([0, 1], [9.3, 0.1], [0.1, -0.2, 0.7, 1.1])] * 3)
    large = models.Trees(2, 0.0, 0.3, -0.7, small.trees * 60)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan(models.scored(df, small, ["a", "b"])) and "MapInPandas" in plan(models.scored(df, large, ["a", "b"]))
    assert models.scored(df, small, ["a", "b"]).collect() == models.tree_score(df, small, ["a", "b"]).collect()
