"""Personal data: patterns, and terms that reveal them by corpus co-occurrence; DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each found value is a
protected entity e. A term t (a word with a letter, without case) of a document that holds e discloses it if
PMI(e; t) >= alpha * IC(e), with IC(e) = log2(D / n(e)) and PMI(e; t) = log2(n(t, e) * D / (n(t) * n(e))),
all counted in documents over the whole corpus (D documents, n(t) with the term, n(t, e) with both,
wherever they stand). Every pair is judged, also one that stands in a single
document: there the rule asks for n(t) <= D ** (1 - alpha), so a rare word discloses and a common
one doesn't. All occurrences of a disclosing term in the documents of its entity become spans of kind
``term``, except those that touch a pattern span; the sanitised text generalises every span to its kind.

Two exact short cuts keep the pairs few. Entities of the same set of documents have the same terms
and are judged as one class (two 64-bit hashes of the set name it). And since n(t, e) <= n(e), a term
of more than n(e) ** alpha * D ** (1 - alpha) documents can't disclose e and meets no class.

Defined results: null and empty texts have no spans; copies of a text count as documents of their
own; very long texts are read whole, in one row of one task; an empty table gives an empty result;
extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, stored, table
from .spans import SPAN, count, found, joined, redacted

#: Kinds in the order in which spans are listed, and their patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of digits (never empty here) of a value up to 255, leading zeros allowed.
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
TERM = r"[\p{L}\p{N}]+"

ALPHA = 0.8
_P = "__pii_"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(d == "", 0).when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(
            (F.try_to_number(d, F.lit("9")).cast("int") * 2).cast("int") - F.when(d >= "5", 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: (a + x).cast("int")) % 10 == 0


def patterns(text: Column) -> Column:
    """Spans of the four patterns, by kind, then start. Failing matches take their place and are
    dropped. The patterns start only where a run of their characters starts, so that long runs
    cost linear time; the matches are those of the plain patterns."""
    return F.concat(
        found(text, 0, EMAIL, needs="@"),
        found(text, 1, IP, lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        found(text, 2, CARD, lambda m: F.length(_digits(m)).between(13, 19) & bound(_digits(m), luhn)),
        found(text, 3, PHONE, lambda m: F.length(_digits(m)).between(9, 15), needs="+"),
    )


def _named(body: Column) -> Column:
    """128 bits of SHA-256 name a text."""
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def _terms(body: Column) -> Column:
    """Distinct terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(body), r"[^\p{L}\p{N}]+")), lambda t: t.rlike(r"\p{L}"))


def disclosed(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``pii_spans``: pattern spans by kind and start, then disclosing terms by start.

    Spans depend on the text alone, so texts with a pattern span are kept once, with their number of
    rows. The count of a term over the corpus is a partial count per task, then one row per term."""
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "pii_spans"]
    found_ = docs.select(body.alias("text")).withColumn("base", patterns(F.col("text"))).filter(F.size("base") > 0)
    holders = found_.groupBy(_named(F.col("text")).alias("blob")).agg(F.count("*").alias("m"), F.first("text").alias("text"), F.first("base").alias("base"))
    holders = stored(holders, "pii-holders")
    total = float(max(docs.count(), 1))

    # entities, by class: the same documents, the same terms
    own = holders.select("blob", "m", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
    sets = own.groupBy("entity").agg(F.sum("m").alias("n_e"), F.bit_xor(F.xxhash64("blob")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "blob")).alias("y"))
    classes = stored(own.join(sets, "entity").select("blob", "m", "n_e", "x", "y").distinct(), "pii-classes")
    most = F.pow(F.col("n_e").cast("double"), F.lit(alpha)) * total ** (1 - alpha) * (1 + 1e-9)
    wide = classes.groupBy("blob").agg(F.max(most).alias("most"))

    # counted before the join: the shuffle carries a row per task and term, however many terms are asked for
    nt = docs.select(F.explode(_terms(body)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    asked = holders.join(wide, "blob").select("blob", "most", F.explode(_terms(F.col("text"))).alias("term"))
    rare = asked.join(nt, "term").filter("n_t <= most").select("blob", "term", "n_t")
    pairs = rare.join(classes, "blob").filter(F.col("n_t") <= most)
    pairs = stored(pairs.select("blob", "term", "m", "n_t", "n_e", "x", "y"), "pii-pairs")
    key = ["term", "n_e", "x", "y"]
    ic = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    telling = pairs.groupBy(*key).agg(F.sum("m").alias("n_te"), F.first("n_t").alias("n_t")).filter(pmi >= ic * alpha).select(*key)
    marked = stored(pairs.join(telling, key, "left_semi").select("blob", "term").distinct(), "pii-terms")

    # where they stand
    free = lambda w: ~F.exists("base", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"]))
    words = holders.join(marked.select("blob").distinct(), "blob", "left_semi").select("blob", F.explode(F.filter(found(F.col("text"), 4, TERM), free)).alias("w"))
    words = words.select("blob", F.lower("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    places = words.join(marked, ["blob", "term"], "left_semi").groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term"))).alias("t"))
    places = places.select("blob", F.transform("t", lambda s: F.struct(F.lit(4).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["term"].alias("value"))).cast(SPAN).alias("terms"))
    spans = holders.select("blob", "base").join(places, "blob", "left")
    spans = stored(spans.select(F.col("blob").alias(f"{_P}of"), F.concat("base", F.coalesce("terms", F.array().cast(SPAN))).alias(f"{_P}spans")), "pii-spans")
    both = docs.select(*keep, _named(body).alias(f"{_P}blob")).join(spans, F.col(f"{_P}blob") == F.col(f"{_P}of"), "left")
    return both.select(*keep, F.coalesce(f"{_P}spans", F.array().cast(SPAN)).alias("pii_spans"))


def sanitised(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span in ``text`` generalised to its kind; columns unchanged."""
    out = redacted(F.col(text), F.col("pii_spans"), KINDS)
    return disclosed(docs, text, **options).withColumn(text, out).select(*[F.col(f"`{c}`") for c in docs.columns if c != "pii_spans"])


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["kind"] < 4)
    return disclosed(docs).select(
        "doc_id",
        *[count(spans, k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(spans, KINDS).alias("spans"),
    )
