"""Record-linkage tables derived from ``documents``, the same in Spark and in SQL.

Per document d: a clean record S1-d of source 1, an edited copy in source 2 unless 5 divides d, one
in source 3 unless 3 divides d. ``truth`` holds the links. Nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources.tsv import RECORD


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), K.SEPARATOR), lambda t: t != "")
    return docs.select(F.col("doc_id").alias("d"), w.alias("w"), F.coalesce("lang", F.lit("")).alias("country"))


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three sources, columns of ``RECORD``."""
    t = tokens(spark, sf_dir)
    word = lambda i: F.coalesce(F.get("w", F.lit(i - 1)), F.lit(""))
    d = F.col("d")
    plain = F.concat_ws(" ", *[word(i) for i in (1, 2, 3, 4)])
    suffix = F.when(d % 4 == 0, " LLC").when(d % 4 == 1, " Pvt Ltd").when(d % 4 == 2, " Inc").otherwise("")
    number, place = (100 + (d * 37) % 9000).cast("string"), (10000 + (d * 7919) % 90000).cast("string")
    t = t.select(
        "d", "country", "w", F.concat(plain, suffix).alias("name"),
        F.concat(number, F.lit(" "), word(5), F.lit(" "), word(6), F.lit(" Street, "), word(7), F.lit(" "), place).alias("addr"),
    )
    name, addr = F.col("name"), F.col("addr")
    swapped = F.concat(F.substr(name, F.lit(1), F.lit(1)), F.substr(name, F.lit(3), F.lit(1)), F.substr(name, F.lit(2), F.lit(1)), F.substr(name, F.lit(4)))
    name2 = F.when(d % 5 == 2, F.replace(name, F.lit(" LLC"), F.lit(""))).when(d % 5 == 4, swapped).otherwise(name)
    addr2 = F.when(d % 5 == 2, F.replace(addr, F.lit(" Street,"), F.lit(" St,"))).when(d % 5 == 3, F.substr(addr, F.lit(2))).otherwise(addr)
    name3 = F.when(d % 3 == 1, F.array_join(F.reverse(F.slice("w", 1, 4)), " ")).otherwise(name)
    addr3 = F.when(d % 3 == 2, F.lit("")).otherwise(addr)

    def records(rows: DataFrame, k: int, n, a) -> DataFrame:
        return rows.select(F.concat(F.lit(f"S{k}-"), d.cast("string")).alias("entity_id"), n.alias("business_name"), a.alias("business_address"), "country")

    return records(t, 1, name, addr), records(t.filter(d % 5 != 0), 2, name2, addr2), records(t.filter(d % 3 != 0), 3, name3, addr3)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"))
    link = lambda rows, k: rows.select(F.concat(F.lit("S1-"), F.col("d").cast("string")).alias("qid"), F.concat(F.lit(f"S{k}-"), F.col("d").cast("string")).alias("tid"))
    return link(d.filter("d % 5 <> 0"), 2).unionByName(link(d.filter("d % 3 <> 0"), 3))


SOURCES_SQL = f"""
t0 AS (SELECT doc_id AS d, coalesce(lang, '') AS country, list_filter(string_split_regex(coalesce(text, ''), '{K.SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
t1 AS (SELECT d, country, w,
  concat_ws(' ', coalesce(w[1], ''), coalesce(w[2], ''), coalesce(w[3], ''), coalesce(w[4], '')) || CASE d % 4 WHEN 0 THEN ' LLC' WHEN 1 THEN ' Pvt Ltd' WHEN 2 THEN ' Inc' ELSE '' END AS name,
  (100 + (d * 37) % 9000) || ' ' || coalesce(w[5], '') || ' ' || coalesce(w[6], '') || ' Street, ' || coalesce(w[7], '') || ' ' || (10000 + (d * 7919) % 90000) AS addr FROM t0),
s1 AS (SELECT 'S1-' || d AS entity_id, name AS business_name, addr AS business_address, country FROM t1),
s2 AS (SELECT 'S2-' || d AS entity_id,
  CASE d % 5 WHEN 2 THEN replace(name, ' LLC', '') WHEN 4 THEN substr(name, 1, 1) || substr(name, 3, 1) || substr(name, 2, 1) || substr(name, 4) ELSE name END AS business_name,
  CASE d % 5 WHEN 2 THEN replace(addr, ' Street,', ' St,') WHEN 3 THEN substr(addr, 2) ELSE addr END AS business_address, country FROM t1 WHERE d % 5 <> 0),
s3 AS (SELECT 'S3-' || d AS entity_id, CASE WHEN d % 3 = 1 THEN array_to_string(list_reverse(w[1:4]), ' ') ELSE name END AS business_name,
  CASE WHEN d % 3 = 2 THEN '' ELSE addr END AS business_address, country FROM t1 WHERE d % 3 <> 0),
truth AS (SELECT 'S1-' || doc_id AS qid, 'S2-' || doc_id AS tid FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'S1-' || doc_id, 'S3-' || doc_id FROM documents WHERE doc_id % 3 <> 0)
"""


def pseudo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates without a model: each S1 record against the S2 and S3 records of up to four
    neighbours by number; logits from whole numbers. Columns qid, tid, source, score, label."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("q"))
    near = d.select("q", F.explode(F.array(*[F.col("q") + k for k in range(-2, 3)])).alias("t"))
    near = near.join(d.select(F.col("q").alias("t")), "t")
    both = near.select("q", "t", F.explode(F.array(F.lit(2), F.lit(3))).alias("source"))
    both = both.filter(F.when(F.col("source") == 2, F.col("t") % 5 != 0).otherwise(F.col("t") % 3 != 0))
    score = ((F.col("q") * 7919 + F.col("t") * 104729 + F.col("source") * 31) % 2001 - 1000).cast("double") / 125
    return both.select(
        "q", "t", "source", (score + F.when(F.col("q") == F.col("t"), 4.0).otherwise(-2.0)).alias("score"), (F.col("q") == F.col("t")).cast("int").alias("label")
    )


SCORES_SQL = """
near AS (SELECT a.doc_id AS q, b.doc_id AS t FROM documents a JOIN documents b ON b.doc_id BETWEEN a.doc_id - 2 AND a.doc_id + 2),
scores AS (SELECT q, t, source, CAST((q * 7919 + t * 104729 + source * 31) % 2001 - 1000 AS DOUBLE) / 125 + CASE WHEN q = t THEN 4.0 ELSE -2.0 END AS score, CAST(q = t AS INTEGER) AS label
  FROM near, (VALUES (2), (3)) v(source) WHERE CASE WHEN source = 2 THEN t % 5 <> 0 ELSE t % 3 <> 0 END)
"""
