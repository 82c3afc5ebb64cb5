"""Secret scans with an incremental blob ledger, by DataFrame functions only.

Every version of a text is content-addressed (SHA-256). The ledger, a Parquet folder, holds one
row per blob and rule version with all spans found, so a scan reads only unseen pairs of blob and
rule version; findings are then joined back to every path (document) of the blob.

Defined results: null and empty texts are one blob without findings; copies share one scan; rows
that repeat a document come back as often as they came; an empty table gives an empty result.
Extra columns pass through whatever their names. Very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, scratch, table
from .spans import SPAN, count, found, joined, redacted

#: The rules, in the order of their kinds.
KINDS = ["assign", "access", "hex", "pem", "jwt"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: A private key to its END line; without one over its headers and the run of base64 lines. The body is possessive: linear time.
_BREAK = r"(?:\s|\\[rn])"
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_BREAK}++[A-Za-z0-9+/]++(?:={{1,2}}+|(?![^\r\n])))?+)?+)"
)
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
#: Changes whenever a rule changes; blobs are scanned again for a new version.
RULES = "2026-11.2"

LEDGER = f"blob string, rules string, spans {SPAN}"
_S = "__secret_"


def scan(text: Column) -> Column:
    """All spans of a text by start, then kind.

    ``AKIA`` and hex runs are matched only where they are long enough: a shorter run ends where its
    base match would end, so nothing else can start inside it. Assignments keep their short
    matches until they have taken their place, then the value must have 8 characters."""
    value = lambda m: F.regexp_extract(m, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    parts = [
        found(text, 0, ASSIGN, lambda m: F.length(value(m)) >= 8),
        found(text, 1, ACCESS, needs="AKIA"),
        found(text, 2, HEX),
        found(text, 3, PEM, needs="-----BEGIN "),
        found(text, 4, JWT, needs="eyJ"),
    ]
    order = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.transform(F.array_sort(order), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN)


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", rules: str = RULES) -> int:
    """Scan the blobs of ``docs`` that the ledger lacks for this rule version and append them.
    The append is one job with Spark's commit: a lost executor's tasks run again, and a failed run
    leaves nothing behind. Returns the number of blobs that were new."""
    spark = docs.sparkSession
    seen = read_ledger(spark, ledger).filter(F.col("rules") == rules)
    before = seen.count()
    texts = docs.select(blob(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unseen = texts.join(seen.select("blob"), "blob", "left_anti") if before else texts
    one = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    one.select("blob", F.lit(rules).alias("rules"), scan(F.col("text")).alias("spans")).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger).filter(F.col("rules") == rules).count() - before


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger; one that doesn't exist yet is written empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def scanned(docs: DataFrame, ledger: str, text: str = "text", rules: str = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``, an array of (kind, start, end, value), after bringing the
    ledger up to date. Only blobs with findings are joined back; a blob with very many paths is
    met by one ledger row, and the planner splits such a join."""
    update_ledger(docs, ledger, text, rules)
    hits = read_ledger(docs.sparkSession, ledger).filter((F.col("rules") == rules) & (F.size("spans") > 0))
    hits = hits.select(F.col("blob").alias(f"{_S}blob"), F.col("spans").alias(f"{_S}spans"))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"]
    both = docs.withColumn(f"{_S}own", blob(F.col(text))).join(hits, F.col(f"{_S}own") == F.col(f"{_S}blob"), "left")
    return both.select(*keep, F.coalesce(F.col(f"{_S}spans"), F.array().cast(SPAN)).alias("secret_spans"))


def without_secrets(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind; columns unchanged."""
    out = redacted(F.col(text), F.col("secret_spans"), KINDS)
    return scanned(docs, ledger, text).withColumn(text, out).select(*[F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return scanned(docs, scratch(spark, "secret-ledger")).select(
        "doc_id",
        *[count(spans, k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(spans, KINDS).alias("spans"),
    )
