"""Tab-separated sources and sinks of record linkage, and publishing by rename."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, skip_malformed: bool = True) -> DataFrame:
    """Tab-separated lines with a header and no quoting. The last column takes the rest of the line,
    empty fields are empty strings, a trailing carriage return is cut. Lines with too few tabs are
    skipped, or fail the query."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    parts = F.split("value", "\t", len(schema))
    header = "\t".join(schema.names)
    rows = lines.filter(F.col("value") != header).select(parts.alias("p"), "value")
    whole = F.size("p") == len(schema)
    if skip_malformed:
        rows = rows.filter(whole)
    else:
        rows = rows.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), F.col("value"))).cast("boolean")))
    return rows.select(*[F.get("p", F.lit(i)).alias(f.name) for i, f in enumerate(schema)])


def union_targets(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Both noisy sources, with their number and the number in their ids."""
    both = s2.withColumn("source", F.lit(2)).unionByName(s3.withColumn("source", F.lit(3)))
    return both.withColumn("number", id_number(F.col("entity_id")))


def id_number(entity_id: Column) -> Column:
    return F.try_to_number(F.regexp_extract(entity_id, r"^S[0-9]-([0-9]+)$", 1), F.lit("9" * 18)).cast("bigint")


def semi_targets(targets: DataFrame, wanted: DataFrame, key: str = "entity_id") -> DataFrame:
    """Only the wanted rows; the planner broadcasts the ids if their size allows."""
    return targets.join(wanted.select(key).distinct(), key, "left_semi")


def lookup(records: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """The record of every id of ``ids``, each once; an id without a record fails the query."""
    found = ids.select(key).distinct().join(records.withColumn("__there", F.lit(True)), key, "left")
    there = F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no record of "), F.coalesce(F.col(key), F.lit("null")))).cast("boolean"))
    return found.filter(there).drop("__there")


def prefix(df: DataFrame, n: int, key: str = "entity_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def id_lists(entities: DataFrame, links: DataFrame, out: str = "matched_entity_ids") -> DataFrame:
    """One row per entity: its linked ids by rank, joined by commas; empty without links.
    ``links`` has qid, tid and rank."""
    ids = links.groupBy(F.col("qid").alias("source1_entity_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tid"))), lambda x: x["tid"]), ",").alias(out))
    return entities.select(F.col("entity_id").alias("source1_entity_id")).join(ids, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(out, F.lit("")).alias(out))


def explode_ids(lists: DataFrame, column: str) -> DataFrame:
    """(qid, tid) of every listed id."""
    return lists.select(F.col("source1_entity_id").alias("qid"), F.explode(F.filter(F.split(column, ","), lambda t: t != "")).alias("tid"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Plain lines below a header in every file: no quotes, no escapes."""
    rows = df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).alias("value"))
    rows.write.option("lineSep", "\n").text(path)


def publish(spark: SparkSession, frames: dict[str, DataFrame], target: str, check=None) -> dict:
    """Write frames to a staging folder, check them, add a manifest of checksums, rename. Refuses
    a target that exists; a failed check leaves no output."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(target)
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        raise FileExistsError(target)
    stage = f"{target}.{uuid.uuid4().hex}.tmp"
    try:
        for name, df in frames.items():
            write_tsv(df, f"{stage}/{name}")
        if check is not None:
            check(stage)
        made = manifest(spark, {name: f"{stage}/{name}" for name in frames})
        spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.text(f"{stage}/manifest")
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), final):
            raise OSError(f"cannot rename to {target}")
        return made
    except BaseException:
        fs.delete(jvm.org.apache.hadoop.fs.Path(stage), True)
        raise


def manifest(spark: SparkSession, paths: dict[str, str]) -> dict:
    """SHA-256 per output over the sorted checksums of its files."""
    out = {}
    for name, path in sorted(paths.items()):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.sha2("content", 256).alias("h"))
        sums = sorted(r["h"] for r in files.collect())
        out[name] = {"files": len(sums), "sha256": hashlib.sha256("".join(sums).encode()).hexdigest()}
    return out


def verify(spark: SparkSession, paths: dict[str, str], expected: dict) -> None:
    if manifest(spark, paths) != expected:
        raise ValueError("checksums differ from the manifest")
