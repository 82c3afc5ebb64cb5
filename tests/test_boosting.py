"""Trees are grown whole: the published settings, and all tasks as one."""

import numpy as np
import pandas as pd

from kinlink.operators import features, models, retrieval, vectors
from kinlink.operators import blocking as B
from kinlink.plans import queries as Q
from kinlink.plans import training
from test_vectors import records


def test_match_trees_trains_with_the_published_settings(spark, monkeypatch):
    said = {}
    for name in ("export", "prepare_reference"):
        monkeypatch.setattr(training, name, lambda *a, **k: None)
    for name in ("train_pair", "train_context"):
        monkeypatch.setattr(training, name, lambda *a, name=name, **k: (said.update({name: k}), None))
    monkeypatch.setattr(Q.fx, "sources", lambda *a: (spark.range(8),) * 3)
    monkeypatch.setattr(Q.fx, "truth", lambda *a: None)
    Q._trained(spark, "")
    assert [said["train_pair"][k] for k in ("trees", "depth", "wait")] == [1800, 7, 150]
    assert [said["train_context"][k] for k in ("trees", "depth", "wait")] == [1000, 6, 120]


def test_tasks_grow_the_trees_of_a_plain_loop(spark):
    r = np.random.default_rng(5)
    x = np.round(r.random((400, 3)), 1).astype(np.float32)
    y = ((x[:, 0] > 0.45) ^ (x[:, 1] > 0.7)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y})).repartition(5)
    model = models.train_trees(df, ["a", "b", "c"], trees=4, depth=2, rate=0.5, l2=2.0)
    z = np.zeros(400)
    for which, border, leaves in model.trees:
        p = 1 / (1 + np.exp(-z))
        g, h, leaf = y - p, p * (1 - p), np.zeros(400, int)
        for level, (f, b) in enumerate(zip(which, border, strict=True)):

            def gain(f, b, leaf=leaf, level=level, g=g, h=h):
                at = leaf | (x[:, f] > np.float32(b)) << level
                return sum(g[at == k].sum() ** 2 / (h[at == k].sum() + 2.0) for k in range(2 << level))

            assert gain(f, b) >= max(gain(i, v) for i in range(3) for v in np.unique(x[:, i])) - 1e-6
            leaf |= (x[:, f] > np.float32(b)) << level
        want = [0.5 * g[leaf == k].sum() / (h[leaf == k].sum() + 2.0) for k in range(4)]
        assert np.allclose(leaves, want, atol=1e-9)
        z += np.array(leaves)[leaf]
    assert len(model.trees) == 4


def test_retrieval_features_are_the_same_to_the_last_bit(spark):
    """Stages hold features of both ways, and ``refresh`` and ``augment`` compare them."""
    s1, t = records(spark)
    caps = {"cap": 60, "per_type": 4, "budget": 150, "first": 20, "k": 9}
    got = vectors.enhanced_pairs(s1, t, **caps).select("qid", "tid", *vectors.RETRIEVAL)
    q, p = B.prepare(s1), B.prepare(t)
    want = features.pair_features(retrieval.retrieve_enhanced(q, p, **caps), q, p).select("qid", "tid", *vectors.RETRIEVAL)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
