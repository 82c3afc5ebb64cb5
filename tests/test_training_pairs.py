"""The pairs of a training stage are described where they are found."""

from kinlink.operators import blocking, features, retrieval
from kinlink.plans import training
from test_vectors import records


def test_stage_pairs_are_described_where_they_are_found(spark):
    s1, t = records(spark)
    s1 = s1.filter("entity_id IS NOT NULL").dropDuplicates(["entity_id"]).localCheckpoint()
    t = t.filter("entity_id IS NOT NULL").dropDuplicates(["entity_id"]).localCheckpoint()
    caps, few = {"cap": 60, "per_type": 4, "budget": 150, "first": 20, "k": 9}, {"cap": 25, "per_family": 3, "budget": 60, "k": 9}
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(20)], "qid string, tid string")
    found = training._pairs(s1.select(s1["entity_id"].alias("qid")), s1, t, truth, caps, few)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    q, p = blocking.prepare(s1), blocking.prepare(t)
    hits = retrieval.retrieve_enhanced(q, p, **caps)
    got = sorted(map(tuple, found.select("qid", "tid", "score", "rank").collect()))
    assert got == sorted(map(tuple, hits.collect())) and len(got) > 50
    assert set(features.LEGACY + features.EXTENDED + features.ADVANCED + ["label", "in_baseline", "number"]) <= set(found.columns)
