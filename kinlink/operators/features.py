"""Features of candidate pairs: 20 legacy, 56 extended, 31 cross-script, 23 context, 26 reference.

Set and multiset features are column expressions; edit distances, fuzzy overlaps and transliteration run
in one Arrow batch function per pair table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as P
from ..functions import similarity as S
from .blocking import THREES, TWOS

# Names in the order of the feature vector.
LEGACY = [
    "const", "name_dice", "name_overlap", "name_jaccard", "address_dice", "address_overlap", "address_jaccard", "number_overlap",
    "name_contained", "name_address_dice", "name_address_overlap", "max_dice", "min_dice", "name_equal", "core_equal",
    "target_address_missing", "number_equal", "number_conflict", "script_mismatch", "script_address",
]
EXTENDED = [
    "core_exact", "core_dice", "core_edit", "core_overlap", "core_jaccard", "core_containment", "core_length_ratio", "name_length_ratio",
    "name_edit", "address_normalized_dice", "address_normalized_edit", "address_normalized_overlap", "address_normalized_jaccard",
    "address_exact", "address_length_ratio", "address_words_overlap", "address_words_dice", "numbers_overlap", "numbers_jaccard",
    "numbers_shared", "numbers_query_only", "numbers_target_only", "numbers_exact", "numbers_query_count", "numbers_target_count",
    "first_number_edit", "first_number_present", "name_fuzzy_query", "name_fuzzy_target", "name_unmatched_query", "name_unmatched_target",
    "core_query_tokens", "core_target_tokens", "address_query_tokens", "address_target_tokens", "query_missing_address", "query_indic",
    "target_indic", "retrieval_score", "retrieval_rank", "name_frequency", "query_name_length", "target_name_length", "same_source",
    "initials_equal", "initials_query_in_target", "initials_target_in_query", "core_bigram", "address_bigram", "street_number_conflict",
    "address_numberless_exact", "postal_shared", "postal_conflict", "name_prefix", "name_suffix", "address_containment",
]
ADVANCED = [
    "roman_exact", "roman_dice", "roman_edit", "roman_overlap", "roman_jaccard", "roman_fuzzy_query", "roman_fuzzy_target", "sound_exact",
    "sound_dice", "sound_edit", "sound_overlap", "sound_jaccard", "sound_fuzzy_query", "sound_fuzzy_target", "sound_missing_query",
    "sound_missing_target", "digits_overlap", "digits_jaccard", "digits_query_only", "digits_target_only", "digits_fuzzy_query",
    "digits_fuzzy_target", "mixed_overlap", "mixed_jaccard", "mixed_fuzzy_query", "mixed_fuzzy_target", "roman_address_dice",
    "roman_address_overlap", "roman_address_jaccard", "sound_query_tokens", "sound_target_tokens",
]

REFERENCE = [
    "reference_checked", "reference_best_logit", "reference_second_logit", "reference_logit_margin", "reference_better_count",
    "reference_confident_count", "reference_query_name_count", "reference_target_name_count", "name_idf_fuzzy_query", "name_idf_fuzzy_target",
    "name_idf_exact_query", "name_idf_exact_target", "name_rarest_query_similarity", "name_rarest_target_similarity",
    "first_digits_length_change", "first_digits_length_ratio", "first_digits_containment", "first_digits_subsequence",
    "first_numeric_distance", "first_numeric_one_apart", "digit_omission_query", "digit_omission_target", "unmatched_long_query_numbers",
    "unmatched_long_target_numbers", "unmatched_short_query_numbers", "unmatched_short_target_numbers",
]

PREPARED = ["business_name", "business_address", "country", "name_words", "addr_raw", "core", "addr", "name_c", "addr_c", "first", "indic", "core_c", "addr_j", "nums", "letters", "postal", "initials", "core_n",
            "roman", "roman_addr", "digits", "mixed", "sound", "roman_c", "roman_addr_j", "letters_j", "sound_j", *[f"{k}_3" for k in THREES], *[f"{k}_2" for k in TWOS]]


def pairs(hits: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with both prepared records, prefixed q_ and t_."""
    side = lambda df, p, k: df.select(F.col("entity_id").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in PREPARED])
    return hits.join(side(queries, "q", "qid"), "qid").join(side(targets, "t", "tid"), "tid")


def _n(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _dice(c: str, n: int) -> Column:
    return S.dice(F.col(f"q_{c}"), F.col(f"t_{c}"), F.col(f"q_{c}_{n}"), F.col(f"t_{c}_{n}"))


def legacy() -> dict[str, Column]:
    q, t = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"t_{c}"))
    nd, ad = _dice("name_c", 3), _dice("addr_c", 3)
    no, nj = S.token_overlap(q("name_words"), t("name_words")), S.token_jaccard(q("name_words"), t("name_words"))
    ao, aj = S.token_overlap(q("addr_raw"), t("addr_raw")), S.token_jaccard(q("addr_raw"), t("addr_raw"))
    sx = q("indic") != t("indic")
    both = (q("first") != "") & (t("first") != "")
    values = [
        F.lit(1.0), nd, no, nj, ad, ao, aj, S.number_overlap(q("addr_raw"), t("addr_raw")), _n(S.contained(q("name_c"), t("name_c"), 6)), nd * ad, no * ao,
        F.greatest(nd, ad), F.least(nd, ad), _n((q("name_c") != "") & (q("name_c") == t("name_c"))), _n((q("core_n") != "") & (q("core_n") == t("core_n"))),
        _n(t("business_address") == ""), _n((q("first") != "") & (q("first") == t("first"))), _n(both & (q("first") != t("first"))), _n(sx), _n(sx) * ad,
    ]
    return dict(zip(LEGACY, values, strict=True))


def extended_sql() -> dict[str, Column]:
    """The extended features that need no edit distance; ``score`` in millionths, ``rank``,
    ``frequency`` (targets of the query's country with its compact core) come with the pair."""
    q, t = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"t_{c}"))
    shared = F.size(F.array_intersect(q("nums"), t("nums")))
    letters = S.token_overlap(q("letters"), t("letters"))
    conflict = (q("first") != "") & (t("first") != "") & (q("first") != t("first"))
    postal = S.token_overlap(q("postal"), t("postal"))
    same = lambda c: _n((q(c) != "") & (q(c) == t(c)))
    inside = lambda a, b: _n((F.octet_length(a) > 1) & F.contains(b, a))
    return {
        "core_exact": same("core_c"), "core_dice": _dice("core_c", 3), "core_overlap": S.token_overlap(q("core"), t("core")), "core_jaccard": S.token_jaccard(q("core"), t("core")),
        "core_containment": _n(S.contained(q("core_c"), t("core_c"))), "core_length_ratio": S.length_ratio(q("core_c"), t("core_c")), "name_length_ratio": S.length_ratio(q("name_c"), t("name_c")),
        "address_normalized_dice": _dice("addr_j", 3), "address_normalized_overlap": S.token_overlap(q("addr"), t("addr")), "address_normalized_jaccard": S.token_jaccard(q("addr"), t("addr")),
        "address_exact": same("addr_j"), "address_length_ratio": S.length_ratio(q("addr_j"), t("addr_j")), "address_words_overlap": letters, "address_words_dice": _dice("letters_j", 3),
        "numbers_overlap": S.token_overlap(q("nums"), t("nums")), "numbers_jaccard": S.token_jaccard(q("nums"), t("nums")), "numbers_shared": _n(shared),
        "numbers_query_only": _n(F.size(q("nums")) - shared), "numbers_target_only": _n(F.size(t("nums")) - shared), "numbers_exact": _n((F.size(q("nums")) > 0) & (q("nums") == t("nums"))),
        "numbers_query_count": _n(F.size(q("nums"))), "numbers_target_count": _n(F.size(t("nums"))), "first_number_present": _n((q("first") != "") & (t("first") != "")),
        "core_query_tokens": _n(F.size(q("core"))), "core_target_tokens": _n(F.size(t("core"))), "address_query_tokens": _n(F.size(q("addr"))), "address_target_tokens": _n(F.size(t("addr"))),
        "query_missing_address": _n(q("business_address") == ""), "query_indic": _n(q("indic")), "target_indic": _n(t("indic")),
        "retrieval_score": F.log1p(F.col("score") / 1e6), "retrieval_rank": F.log1p(F.col("rank").cast("double")), "name_frequency": F.log1p(F.col("frequency").cast("double")),
        "query_name_length": _n(F.octet_length(q("name_c"))), "target_name_length": _n(F.octet_length(t("name_c"))),
        # named so in the vector: whether the target comes from source 2
        "same_source": _n(F.col("tid").startswith("S2-")),
        "initials_equal": same("initials"), "initials_query_in_target": inside(q("initials"), t("core_c")), "initials_target_in_query": inside(t("initials"), q("core_c")),
        "core_bigram": _dice("core_c", 2), "address_bigram": _dice("addr_j", 2),
        "street_number_conflict": _n(conflict & (letters > 0.8)), "address_numberless_exact": same("letters_j"),
        "postal_shared": postal, "postal_conflict": _n((F.size(q("postal")) > 0) & (F.size(t("postal")) > 0) & (postal == 0)),
        "address_containment": _n(S.contained(q("addr_j"), t("addr_j"))),
    }


def advanced_sql() -> dict[str, Column]:
    """The cross-script features that need no edit distance."""
    q, t = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"t_{c}"))
    same = lambda c: _n((q(c) != "") & (q(c) == t(c)))
    shared = F.size(F.array_intersect(q("digits"), t("digits")))
    sets = {f"{k}_{n}": f(q(c), t(c)) for k, c in (("roman", "roman"), ("sound", "sound"), ("digits", "digits"), ("mixed", "mixed"), ("roman_address", "roman_addr")) for n, f in (("overlap", S.token_overlap), ("jaccard", S.token_jaccard))}
    return sets | {
        "roman_exact": same("roman_c"), "roman_dice": _dice("roman_c", 3), "sound_exact": same("sound_j"), "sound_dice": _dice("sound_j", 2), "roman_address_dice": _dice("roman_addr_j", 3),
        "digits_query_only": _n(F.size(q("digits")) - shared), "digits_target_only": _n(F.size(t("digits")) - shared), "sound_query_tokens": _n(F.size(q("sound"))), "sound_target_tokens": _n(F.size(t("sound"))),
    }


#: Edit similarities by the strings compared, and fuzzy overlaps (both means, both numbers of unmatched tokens) by the tokens.
EDITS = {"core_edit": "core_c", "name_edit": "name_c", "address_normalized_edit": "addr_j", "first_number_edit": "first", "roman_edit": "roman_c", "sound_edit": "sound_j"}
FUZZY = {
    "core": ["name_fuzzy_query", "name_fuzzy_target", "name_unmatched_query", "name_unmatched_target"], "roman": ["roman_fuzzy_query", "roman_fuzzy_target"],
    "sound": ["sound_fuzzy_query", "sound_fuzzy_target", "sound_missing_query", "sound_missing_target"], "digits": ["digits_fuzzy_query", "digits_fuzzy_target"],
    "mixed": ["mixed_fuzzy_query", "mixed_fuzzy_target"],
}
KERNEL = [*EDITS, *[n for ns in FUZZY.values() for n in ns], "name_prefix", "name_suffix"]


def kernel_columns(f: pd.DataFrame, query: str = "q_", target: str = "t_") -> dict[str, list]:
    """The features that need edit distances, from columns of both sides. Each distinct pair of
    strings, or of token lists, is compared once per batch."""
    out = {}
    for name, c in EDITS.items():
        out[name] = _once(P.edit_similarity, f[query + c], f[target + c])
    for c, names in FUZZY.items():
        q, t = ([tuple(x) for x in f[side + c]] for side in (query, target))
        one, two = _once(P.fuzzy_overlap, q, t), _once(P.fuzzy_overlap, t, q)
        out |= dict(zip(names, ([float(x[k]) for x in v] for k in (0, 1) for v in (one, two)), strict=False))
    ends = _once(P.common_ends, f[query + "core_c"], f[target + "core_c"])
    return out | {"name_prefix": [x[0] for x in ends], "name_suffix": [x[1] for x in ends]}


def _once(compare, a, b) -> list:
    both = list(zip(a, b, strict=True))
    known = {x: compare(*x) for x in set(both)}
    return [known[x] for x in both]


def kernels(both: DataFrame) -> DataFrame:
    """``both`` (pairs with prepared records and whatever else) with the features of ``KERNEL`` in place
    of the prepared columns, in one pass."""
    need = [f"{p}_{c}" for p in "qt" for c in dict.fromkeys([*EDITS.values(), *FUZZY])]
    keep = [c for c in both.columns if not c.startswith(("q_", "t_"))]
    schema = T.StructType([*both.select(*keep).schema.fields, *[T.StructField(k, T.DoubleType()) for k in KERNEL]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f[keep].assign(**{k: pd.Series(v, index=f.index, dtype="float64") for k, v in kernel_columns(f).items()})[schema.names]

    return both.select(*keep, *need).mapInPandas(run, schema)


def name_frequency(targets: DataFrame) -> DataFrame:
    """Targets per country and compact core."""
    return targets.filter("core_c <> ''").groupBy("country", "core_c").agg(F.count("*").alias("frequency"))


def with_frequency(both: DataFrame, targets: DataFrame) -> DataFrame:
    freq = name_frequency(targets).select(F.col("country").alias("q_country"), F.col("core_c").alias("q_core_c"), "frequency")
    return both.join(freq, ["q_country", "q_core_c"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def all_features(both: DataFrame, keep: list[str]) -> DataFrame:
    """The 107 features of pairs with prepared records, score, rank and frequency, after ``keep``."""
    prepared = [c for c in both.columns if c.startswith(("q_", "t_"))]
    some = both.select(*keep, *[c.alias(k) for k, c in (legacy() | extended_sql() | advanced_sql()).items()], *prepared)
    return kernels(some).select(*keep, *LEGACY, *EXTENDED, *ADVANCED)


def pair_features(hits: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The 107 features of each candidate, in vector order, after qid, tid, score and rank."""
    return all_features(with_frequency(pairs(hits, queries, targets), targets), ["qid", "tid", "score", "rank"])


def name_evidence(both: DataFrame, prepared_reference: DataFrame) -> DataFrame:
    """Per pair (qid, tid) the six columns name_idf_* and name_rarest_*: IDF-weighted fuzzy and exact share of
    the romanised name's words found on the other side, and the similarity of the rarest word (of equal
    ones the first). idf = min(12, ln(1 + N / (1 + df))), df counted over source 1 in the query's country."""
    total = prepared_reference.count()
    df = prepared_reference.select("country", F.explode(F.filter("core", lambda w: F.octet_length(w) >= 3)).alias("w")).groupBy("country", "w").agg(F.count("*").alias("df"))
    schema = "qid string, tid string, country string, side string, w string, i int, s double"

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = []
            for qid, tid, country, q, t in zip(f["qid"], f["tid"], f["q_country"], f["q_roman"], f["t_roman"], strict=True):
                for side, a, b in (("query", q, t), ("target", t, q)):
                    rows += [(qid, tid, country, side, w, i, max((1.0 if w == v else P.edit_similarity(w, v) for v in b), default=0.0)) for i, w in enumerate(a)]
            yield pd.DataFrame(rows, columns=["qid", "tid", "country", "side", "w", "i", "s"])

    words = both.select("qid", "tid", "q_country", "q_roman", "t_roman").mapInPandas(best, schema)
    idf = F.least(F.lit(12.0), F.log1p(F.lit(float(total)) / (1 + F.coalesce("df", F.lit(0)))))
    weighed = words.join(df, ["country", "w"], "left").withColumn("idf", idf)
    mine = lambda side, v: F.when(F.col("side") == side, v)
    made = {}
    for side in ("query", "target"):
        weight = F.sum(mine(side, F.col("idf")))
        made[f"name_idf_fuzzy_{side}"] = F.sum(mine(side, F.col("idf") * F.col("s"))) / weight
        made[f"name_idf_exact_{side}"] = F.sum(mine(side, F.when(F.col("s") == 1, F.col("idf")).otherwise(0.0))) / weight
        made[f"name_rarest_{side}_similarity"] = F.max(mine(side, F.struct("idf", (-F.col("i")).alias("i"), "s")))["s"]
    per = weighed.groupBy("qid", "tid").agg(*[c.alias(k) for k, c in made.items()])
    return both.select("qid", "tid").join(per, ["qid", "tid"], "left").fillna(0.0)


def name_counts(both: DataFrame, prepared_reference: DataFrame) -> DataFrame:
    """``both`` with ln(1 + source-1 records of the country with the same compact core) of both names."""
    n = name_frequency(prepared_reference)
    for side, name in (("q", "query"), ("t", "target")):
        own = n.select(F.col("country").alias(f"{side}_country"), F.col("core_c").alias(f"{side}_core_c"), F.log1p(F.col("frequency").cast("double")).alias(f"reference_{name}_name_count"))
        both = both.join(own, [f"{side}_country", f"{side}_core_c"], "left")
    return both.fillna(0.0, ["reference_query_name_count", "reference_target_name_count"])


def reference_numbers() -> dict[str, Column]:
    """Number features of the reference block: first numbers, and digit runs that one side lacks."""
    a, b = F.col("q_first"), F.col("t_first")
    both = (a != "") & (b != "")
    far = F.least(F.abs(F.coalesce(F.expr("try_cast(q_first AS double)"), F.lit(0.0)) - F.coalesce(F.expr("try_cast(t_first AS double)"), F.lit(0.0))), F.lit(1e12))
    qd, td = F.col("q_digits"), F.col("t_digits")
    q, t = S.numeric_evidence(qd, td), S.numeric_evidence(td, qd)
    zero = lambda c: F.when(both, c).otherwise(0.0)
    return {
        "first_digits_length_change": zero((F.length(b) - F.length(a)).cast("double")), "first_digits_length_ratio": S.length_ratio(a, b),
        "first_digits_containment": zero(_n(F.contains(a, b) | F.contains(b, a))), "first_digits_subsequence": _n(S.digit_subsequence(a, b) | S.digit_subsequence(b, a)),
        "first_numeric_distance": zero(F.log1p(far)), "first_numeric_one_apart": zero(_n(far == 1)),
        "digit_omission_query": _n(q["omissions"]), "digit_omission_target": _n(t["omissions"]), "unmatched_long_query_numbers": _n(q["long"]), "unmatched_long_target_numbers": _n(t["long"]),
        "unmatched_short_query_numbers": _n(q["short"]), "unmatched_short_target_numbers": _n(t["short"]),
    }
