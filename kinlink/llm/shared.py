"""What the operators of this subpackage share: the shared folder, word rules, native folds."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside this class.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set,
    else, in a local session, a temporary folder that is then set as checkpoint folder; a cluster
    without one is refused, as its machines don't share such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return os.path.dirname(known.rstrip("/"))
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="kinlink-")
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder; ``release`` removes all of them."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete every scratch folder made so far. Call once results are written."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            continue


atexit.register(release)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors and gives
    the planner a measured size."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lens: Column, chunk: int = 256) -> Column:
    """Sums of all earlier elements, per element. Two levels, so that the quadratic cost of
    growing an array stays within ``chunk`` elements."""

    def scan(values, start):
        return F.aggregate(
            values,
            F.struct(start.alias("t"), F.array().cast("array<bigint>").alias("o")),
            lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["o"], F.array(s["t"])).alias("o")),
            lambda s: s["o"],
        )

    zero = F.lit(0).cast("bigint")

    def body(v):
        n = F.size(v)
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")),
            lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)),
        )
        two = bound(
            parts,
            lambda p: bound(
                scan(F.transform(p, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), zero),
                lambda b: F.flatten(F.transform(p, lambda c, i: scan(c, F.get(b, i)))),
            ),
        )
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= chunk, scan(v, zero)).otherwise(two)

    return bound(lens.cast("array<bigint>"), body)
