"""The corpus pipeline: every stage acts, clean documents stay, awkward and empty tables pass."""

import corpus_pipeline as cp

from cases import PASSAGE, ROWS, documents, folder


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in cp.STAGES:
        out = cp.stored(stage(spark, docs, sf), name)
        if name != "mixing":
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[1] > 0.95 * counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3] and counts[5] > 0


def test_copies_from_80_percent_on_go(spark):
    rows = []
    for i in range(30):
        words = [f"v{i}x{j}" for j in range(120)]  # two words of 120 differ: 106 of 126 shingles are shared
        rows += [(2 * i, " ".join(words), "en", "a"), (2 * i + 1, " ".join([*words[:40], "p", *words[41:80], "q", *words[81:]]), "en", "a")]
    assert {r["doc_id"] for r in cp.near_duplicate_stage(spark, documents(spark, rows), "").collect()} == {2 * i for i in range(30)}


def test_awkward_and_empty(spark, tmp_path):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    d = folder(spark, tmp_path / "a", ROWS, benchmark=bench)
    ids = {r["doc_id"] for r in cp.run(spark, d).collect()}
    assert not ids & {2, 3, 4, 5, 8, 9, 11, 12}
    assert cp.run(spark, folder(spark, tmp_path / "b", [], benchmark=bench)).count() == 0
    assert documents(spark).columns == ["doc_id", "text", "lang", "source"]
