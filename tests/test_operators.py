"""Decisions, sweeps, context, budgets, models and files, each against a plain loop."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinlink.operators import blocking, compared, context, decide, evaluate, features, models, retrieval, sampling, validate
from kinlink.plans import baseline, training
from kinlink.sources import tsv


def half(tp, fp, truth):
    bottom = 1.25 * tp + fp + 0.25 * (truth - tp)
    return 1.25 * tp / bottom if bottom else 1.0


def test_entity_f(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 0, 3), (2, 1, 2)], "tp int, fp int, truth int")
    got = [r["f"] for r in rows.select(decide.f_half(F.col("tp"), F.col("fp"), F.col("truth")).alias("f")).collect()]
    assert got == pytest.approx([1, 0, 0, 2.5 / 3.5])


def scored(spark, seed, tie=True):
    r = random.Random(seed)
    rows = [(q, t, 2 + t % 2, round(r.uniform(-3, 3), 1 if tie else 6), int(r.random() < 0.3)) for q in range(20) for t in range(6)]
    return rows, spark.createDataFrame(rows, "q bigint, t bigint, source int, score double, label int")


def test_sweep_equals_brute_force(spark):
    for seed in range(3):
        rows, df = scored(spark, seed)
        truth = {q: sum(x[4] for x in rows if x[0] == q) + (q % 3 == 0) for q in range(20)}

        def macro(t, rows=rows, truth=truth):
            return sum(half(sum(x[4] for x in rows if x[0] == q and x[3] >= t), sum(1 - x[4] for x in rows if x[0] == q and x[3] >= t), truth[q]) for q in truth) / 20

        best = max(sorted({x[3] for x in rows}, reverse=True), key=macro)
        got = decide.sweep(df, spark.createDataFrame(list(truth.items()), "q bigint, truth bigint")).first()
        assert (got["threshold"], got["macro"]) == (best, round(macro(best), 6))


def test_expected_f_equals_loop(spark):
    rows, df = scored(spark, 9)
    got = {(r["q"], r["t"]): r["chosen"] for r in decide.expected_f(df, ["t"]).collect()}
    for q in range(20):
        own = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[3], x[1]))
        p = [1 / (1 + math.exp(-x[3])) for x in own]
        best, k = math.prod(1 - x for x in p), 0
        for i in range(len(p)):
            u = 1.25 * sum(p[: i + 1]) / (i + 1 + 0.25 * sum(p))
            if u > best + 1e-12:
                best, k = u, i + 1
        assert [got[x[0], x[1]] for x in own] == [i < k for i in range(len(own))]


def test_decisions_of_one_query(spark):
    logit = lambda p: math.log(p / (1 - p))
    for ps, want in (([0.1], [False]), ([0.95], [True]), ([0.98, 0.97, 0.01], [True, True, False])):
        df = spark.createDataFrame([(0, i, logit(p)) for i, p in enumerate(ps)], "q int, t int, score double")
        assert [r["chosen"] for r in decide.expected_f(df, ["t"]).orderBy("t").collect()] == want
    assert decide.expected_f(df.limit(0), ["t"]).count() == 0


def test_context_leaves_the_own_candidate_out(spark):
    logit = lambda p: math.log(p / (1 - p))
    df = spark.createDataFrame([(0, 0, 2, logit(0.9)), (0, 1, 2, logit(0.8)), (0, 2, 3, logit(0.2))], "q int, t int, source int, score double")
    a = context.loo(df, ["t"]).orderBy("t").toPandas()
    assert a["other_best"].tolist() == pytest.approx([0.8, 0.9, 0.9]) and a["other_sum"].tolist() == pytest.approx([1.0, 1.1, 1.7])
    b = context.by_source(df, ["t"]).orderBy("t").toPandas()
    assert b["same_best"].tolist() == pytest.approx([0.8, 0.9, 0]) and b["opposite_best"].tolist() == pytest.approx([0.2, 0.2, 0.9])
    alone = context.loo(df.filter("t = 0"), ["t"]).first()
    assert alone["other_best"] == 0 and alone["share"] == pytest.approx(1)
    other = df.unionByName(df.withColumn("q", F.lit(7)).withColumn("score", F.lit(12.0)))
    c = context.loo(other, ["t"]).filter("q = 0").orderBy("t").toPandas()
    assert c["other_sum"].tolist() == pytest.approx(a["other_sum"].tolist())


def test_budgets_equal_loops(spark):
    r = random.Random(3)
    look, size = [], {}
    for q, t, k in itertools.product(range(30), range(1, 6), range(4)):
        key = f"k{r.randint(0, 30)}"
        look.append((f"q{q}", "x", t, key))
        size[t, key] = r.randint(1, 60)
    look = sorted(set(look))
    lookups = spark.createDataFrame(look, "qid string, country string, type int, key string")
    sizes = spark.createDataFrame([("x", t, k, n) for (t, k), n in size.items()], "country string, type int, key string, n bigint")
    got = {tuple(x) for x in blocking.select_sorted(lookups, sizes, 2, 100).select("qid", "type", "key").collect()}
    base = {tuple(x) for x in blocking.select_base(lookups, sizes, 3, 120).select("qid", "type", "key").collect()}
    want, want_base = set(), set()
    for q in {x[0] for x in look}:
        own = sorted((size[x[2], x[3]], x[2], x[3]) for x in look if x[0] == q)
        used, seen = 0, {}
        for n, t, k in own:
            if used + n > 100 or seen.get(t, 0) >= 2:
                continue
            used, seen[t] = used + n, seen.get(t, 0) + 1
            want.add((q, t, k))
        used = 0
        for t in (3, 4, 5, 1, 2):
            for n, _, k in [x for x in own if x[1] == t][:3]:
                if used + n <= 120:
                    used += n
                    want_base.add((q, t, k))
    assert got == want and base == want_base


def test_no_hit_is_dealt_out(spark):
    """Hits are found and reranked where the query's record is: its only exchange is that of the records."""
    rows = [(f"S1-{i}", f"alpha{i % 7} beta{i % 5} gamma", f"{i} oak street", "x") for i in range(40)]
    rows += [("S1-3", "alpha3 beta3 delta", "3 elm street", "x"), (None, "alpha1 beta1 gamma", "1 oak street", "x"), ("S1-99", "alpha1 beta1", "1 oak street", None)]
    p = blocking.prepare(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))
    for found in (retrieval.reverse_retrieve(p, p), retrieval.retrieve_enhanced(p, p)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
        got = found.collect()
        assert {r["qid"] for r in got} <= {f"S1-{i}" for i in range(40)} and all(r["tid"] not in (None, "S1-99") for r in got)
        # both records of an id are queries, and targets, of their own
        assert sum(r["qid"] == "S1-3" and r["tid"] == "S1-3" for r in got) == 4
        own = [r for r in got if r["qid"] == "S1-3"]
        order = sorted(own, key=lambda r: (-r["score"], r["tid"]))
        assert [r["score"] for r in sorted(own, key=lambda r: r["rank"])] == [r["score"] for r in order] and sorted(r["rank"] for r in own) == list(range(len(own)))


def test_pairs_are_compared_where_they_are_found(spark):
    """The baseline's pairs with legacy features and labels, without a join of pairs: equal to the plan that joins them."""
    r = random.Random(5)
    word = lambda: r.choice(["tata", "steel", "mill", "oak", "x9", "123", "0456", "gmbh", "टाटा", "é"])
    rows = [(f"S{1 + i % 3}-{i // 3}", " ".join(word() for _ in range(r.randint(0, 4))), " ".join(word() for _ in range(r.randint(0, 5))), r.choice("ab")) for i in range(90)]
    rows += [("S1-3", "tata steel mill", "12 oak", "b"), ("S2-4", "tata steel", "12 oak", "a"), (None, "tata steel", "12 oak", "a"), ("S1-77", "tata steel", "12 oak", None), ("S2-77", "", "", "a"), ("S1-5", "tata steel", "", "a")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    s1, t = df.filter("entity_id LIKE 'S1%' OR entity_id IS NULL"), df.filter("entity_id NOT LIKE 'S1%' OR entity_id IS NULL")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(20)] + [("S1-3", "S3-3")], "qid string, tid string")
    caps = {"cap": 25, "per_family": 3, "budget": 60, "k": 9}
    got = compared.legacy_pairs(s1, t, truth, **caps)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan  # links are joined to queries
    q, p = blocking.prepare(s1), blocking.prepare(t)
    both = features.pairs(retrieval.retrieve_base(q, p, **caps), q, p)
    want = baseline.labelled(both.select("qid", "tid", "rank", *[c.alias(n) for n, c in features.legacy().items()]), truth).select(got.columns)
    assert got.filter("label = 1").count() and got.filter("name_contained = 1 AND name_equal = 0").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = compared.legacy_pairs(s1, t, truth, places=6, **caps)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.select("qid", "tid", "rank", "label", *[F.round(n, 6) for n in features.LEGACY]).collect()))
    ties = [0.0000005, 0.1234565, 0.4999995, 1 / 3, 2 / 3, 1.0, 0.0000004999]
    again = [x[0] for x in spark.createDataFrame([(x,) for x in ties], "x double").select(F.round("x", 6)).collect()]
    assert compared.rounded(np.array(ties)).tolist() == again


def test_trees_round_trip_and_learn(spark):
    r = np.random.default_rng(0)
    x = r.random((600, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0].astype(float), "b": x[:, 1].astype(float), "c": x[:, 2].astype(float), "label": y}))
    model = models.train_trees(df, ["a", "b", "c"], trees=15, depth=2)
    again = models.Trees.loads(model.dumps())
    assert np.array_equal(model.score(x), again.score(x))
    assert ((model.score(x) > 0) == y).mean() > 0.85
    assert {n for n, k in models.importance(model, ["a", "b", "c"])[:2] if k} == {"a", "b"}
    out = models.tree_score(df, model, ["a", "b", "c"]).toPandas()
    assert np.allclose(out["logit"], model.score(out[["a", "b", "c"]].to_numpy(np.float32)), atol=1e-12)
    few = models.Trees(3, 0.0, 0.5, -1.25, model.trees[:3])
    both = models.tree_score(df, few, ["a", "b", "c"]).withColumn("again", models.tree_column(few, ["a", "b", "c"])).collect()
    assert all(r["again"] == r["logit"] for r in both)


def test_files(spark, tmp_path):
    lines = ["entity_id\tbusiness_name\tbusiness_address\tcountry", 'S2-01\ta "b\t\tFrance\r', "broken", "S2-2\t x \ty\tIndia"]
    (tmp_path / "in.tsv").write_text("\n".join(lines) + "\n", newline="")
    rows = tsv.read_tsv(spark, str(tmp_path / "in.tsv")).collect()
    assert [tuple(r) for r in rows] == [("S2-01", 'a "b', "", "France"), ("S2-2", " x ", "y", "India")]
    with pytest.raises(Exception, match="malformed"):
        tsv.read_tsv(spark, str(tmp_path / "in.tsv"), skip_malformed=False).collect()
    df = spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1,S3-4")], tsv.TRUTH)
    made = tsv.publish(spark, {"m": df}, str(tmp_path / "out"))
    tsv.verify(spark, {"m": str(tmp_path / "out" / "m")}, made)
    back = tsv.read_tsv(spark, str(tmp_path / "out" / "m"), tsv.TRUTH)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        tsv.publish(spark, {"m": df}, str(tmp_path / "out"))

    def refuse(stage):
        raise ValueError("no")

    with pytest.raises(ValueError):
        tsv.publish(spark, {"m": df}, str(tmp_path / "bad"), refuse)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("bad")]


def test_clean_lists_have_no_violation(spark):
    e = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    m = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], tsv.TRUTH)
    c = m.withColumnRenamed("matched_entity_ids", "candidate_entity_ids")
    assert validate.violations(m, c, e).count() == 0


def test_split_is_disjoint_and_sealed(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    parts = sampling.split(df, "k", {"train": 50, "audit": 20}, 1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 50, "audit": 20}
    at = str(tmp_path / "seal")
    s = training.Sealed(spark, at)
    s.choose({"t": 0})
    s.choose({"t": 1})
    with pytest.raises(ValueError):
        s.audit({"t": 0})
    s.audit({"t": 1})
    s = training.Sealed(spark, at)  # a later session knows
    with pytest.raises(PermissionError):
        s.audit({"t": 1})
    with pytest.raises(PermissionError):
        s.choose({"t": 2})
    with pytest.raises(PermissionError):
        evaluate.error_sample(df, df, 3, "audit")


def test_feature_lists():
    assert (len(features.LEGACY), len(features.EXTENDED), len(features.ADVANCED), len(baseline.CONTEXT), len(features.REFERENCE)) == (20, 56, 31, 23, 26)
    assert len(baseline.FULL) == 156 == len(set(baseline.FULL)) and set(features.KERNEL) < set(baseline.ALL)


def test_lookup_names_what_is_missing(spark):
    df = spark.createDataFrame([("S2-1", "a"), ("S2-2", "b")], "entity_id string, business_name string")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "entity_id string")
    assert [r["business_name"] for r in tsv.lookup(df, ids("S2-2", "S2-2")).collect()] == ["b"]
    with pytest.raises(Exception, match="no record of S2-9"):
        tsv.lookup(df, ids("S2-1", "S2-9")).collect()


def test_headers(spark, tmp_path):
    cols = ["source1_entity_id", "matched_entity_ids"]
    for name, text, want in (("a", "source1_entity_id\tmatched_entity_ids\nS1-1\t\n", set()), ("b", "source1_entity_id,matched_entity_ids\n", {"match_header", "match_commas_for_tabs"}), ("c", "S1-1\tS2-1\n", {"match_header"}), ("d", "", {"match_header"})):
        (tmp_path / name).write_text(text)
        assert {r["rule"] for r in validate.header_violations(spark, str(tmp_path / name), cols, "match").collect()} == want


def test_shuffle_and_context_negatives(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    one, two = ([r["k"] for r in sampling.shuffled(df, "k", s).collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) == list(range(50)) and one != two and one == [r["k"] for r in sampling.shuffled(df.repartition(3), "k", 1).collect()]
    rows = spark.createDataFrame([(1, -9.0, 5), (0, -7.0, 5), (0, -9.0, 64), (0, -8.0, 5)], "label int, logit double, number bigint")
    assert sampling.fewer_context_negatives(rows).count() == 3


def test_trees_stop_and_go_on(spark):
    r = np.random.default_rng(1)
    x = r.random((800, 2)).astype(np.float32)
    y = (x[:, 0] > 0.5).astype(int)
    noisy = np.where(r.random(800) < 0.3, 1 - y, y)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0].astype(float), "b": x[:, 1].astype(float), "label": noisy, "half": np.arange(800) % 2}))
    fit, held = df.filter("half = 0"), df.filter("half = 1")
    short = models.train_trees(fit, ["a", "b"], trees=12, depth=2, rate=0.9, validation=held, wait=2)
    assert 0 < len(short.trees) < 12
    on = models.train_trees(fit, ["a", "b"], trees=2, depth=2, start=short)
    assert len(on.trees) == len(short.trees) + 2 and np.allclose(models.Trees(2, 0, 1.0, on.bias, on.trees[: len(short.trees)]).score(x), short.score(x))
    assert models.parity(df.limit(50), short, ["a", "b"]) <= 1e-10
    with pytest.raises(ValueError):
        models.train_trees(fit, ["a"], trees=1, start=short)


def test_logistic_text():
    weights = [round(0.1 * i, 3) for i in range(20)]
    assert models.load_logistic(models.dump_logistic(weights, 0.83, 5)) == (weights, 0.83, 5)
    with pytest.raises(ValueError):
        models.load_logistic("0.5 0\n1 2 3\n")


def test_training_stages_and_prediction(spark, sf, tmp_path):
    """Export, augment, expand, refresh, both models, package, prediction from files: rows and splits hold."""
    from kinlink.plans import fixtures as fx

    s1, s2, s3 = (x.filter("CAST(substr(entity_id, 4) AS INT) < 40") for x in fx.sources(spark, sf))
    targets, truth = s2.unionByName(s3), fx.truth(spark, sf).filter("CAST(substr(qid, 4) AS INT) < 40")
    at = lambda n: str(tmp_path / n)
    tight = {"cap": 60, "per_type": 3, "budget": 250, "first": 30, "k": 10}
    training.export(spark, s1, targets, truth, at("one"), {"train": 12, "context": 8, "tune": 8, "audit": 4}, tight)
    pairs, queries, links = training.read_stage(spark, at("one"))
    assert queries.count() == 32 and set(baseline.ALL) < set(pairs.columns) and links.filter("retrieved = 1").count() == pairs.filter("label = 1").count()
    with pytest.raises(ValueError):
        training.read_stage(spark, at("one"), baseline.FULL)
    training.expand(spark, at("one"), at("two"), s1, targets, truth, 5, caps=tight)
    more, q2, _ = training.read_stage(spark, at("two"))
    assert q2.count() == 37 and q2.exceptAll(queries).select("split").distinct().collect()[0][0] == "train" and pairs.exceptAll(more).count() == 0
    training.refresh(spark, at("one"), at("three"), s1, targets, caps=tight)
    again = training.read_stage(spark, at("three"))[0]
    both = pairs.select("qid", "tid", *baseline.ALL).exceptAll(again.select("qid", "tid", *baseline.ALL))
    assert again.count() == pairs.count() and both.count() == 0
    short = [*features.LEGACY, *features.EXTENDED]
    training._stage(spark, at("short"), pairs.drop(*features.ADVANCED), queries, truth, short)
    training.augment(spark, at("short"), at("long"), s1, targets)
    assert training.read_stage(spark, at("long"))[0].select("qid", "tid", *baseline.ALL).exceptAll(pairs.select("qid", "tid", *baseline.ALL)).count() == 0
    pair_model, said = training.train_pair(spark, at("one"), trees=3, depth=2)
    assert said["trees"] <= 3 and said["macro"] > 0.5
    training.prepare_reference(spark, at("one"), at("full"), s1, targets, pair_model)
    context_model, said = training.train_context(spark, at("full"), trees=2, depth=2)
    assert said["macro"] > 0.5 and models.importance(context_model, baseline.FULL)
    training.package(spark, at("package"), pair_model, context_model, {"rule": "expected_f"})
    for k, rows in enumerate((s1, s2, s3), 1):
        tsv.write_tsv(rows, at(f"test_source{k}.tsv"))
    made = baseline.predict_trees(spark, str(tmp_path), "test", at("out"), at("package"), more=blocking.sound_blocks, **tight)
    assert set(made) == {"matching_results.tsv", "candidate_pairs.tsv"}
    lists = tsv.read_tsv(spark, at("out/matching_results.tsv"), tsv.TRUTH)
    assert lists.count() == 40 and lists.filter("matched_entity_ids <> ''").count() > 20
    baseline.predict(spark, str(tmp_path), "test", at("plain"), n=10)
    assert tsv.read_tsv(spark, at("plain/matching_results.tsv"), tsv.TRUTH).count() == 10
    recall, missed = training.diagnose(retrieval.retrieve_base(blocking.prepare(s1), blocking.prepare(targets)), truth, s1, [1, 20])
    assert recall.count() == 2 and missed.columns[:2] == ["qid", "tid"]
