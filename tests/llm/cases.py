"""Documents with every awkward row: nulls, empties, a long text, ties, repeats, clashing columns."""

LONG = " ".join(f"w{i % 5003}x" for i in range(30_000))
PASSAGE = " ".join(f"pass{i}" for i in range(60))
PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from all of them in the early morning light of may"

ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n\r ", "fr", None), (None, PROSE + " more", "en", "b"),
    (None, None, "en", "c"), (7, LONG, "en", "a"), (8, "x " + PASSAGE + " y", "de", "é"), (9, "z " + PASSAGE, "de", "Z"), (9, "z " + PASSAGE, "de", "Z"),
    (10, "one two", "fr", "b"), (11, "ONE two", "fr", "b"), (12, "12345 67890", None, "b"), (13, "ñandú 𝄞 été " * 30, "es", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that operators use for their own results or inside.
CLASH = ["size", "target", "kept", "n_words", "n_removed", "score", "node", "spans", "blob", "h", "k", "t", "r", "value", "key", "mix_plan", "pii_spans", "secret_spans", "quality", "lang_pred"]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark):
    from pyspark.sql import functions as F

    return documents(spark).withColumns({c: F.lit(7) for c in CLASH})


def folder(spark, tmp_path, rows=ROWS, **tables):
    """A folder with a documents table, as a query reads it."""
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
