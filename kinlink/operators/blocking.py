"""Inverted-index blocking: key generation, block statistics, block selection under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import similarity as S
from ..functions import text as X

MICRO = 1_000_000


def prepare(records: DataFrame) -> DataFrame:
    """Every normalised form of a record, computed once. What a plan doesn't read isn't computed."""
    n, a = F.col("business_name"), F.col("business_address")
    out = records.withColumns(
        {"name_words": X.words(n), "addr_raw": X.words(a), "core": X.core_words(n), "addr": X.address_words(a), "name_c": X.compact(X.lower_ascii(n)), "addr_c": X.compact(X.lower_ascii(a)),
         "first": X.first_number(a), "indic": X.is_indic(n), "roman": X.core_words(X.romanize(n)), "roman_addr": X.address_words(X.romanize(a)), "digits": X.digit_runs(a)}
    )
    c = F.col
    out = out.withColumns(
        {"core_c": X.compact(X.joined(c("core"))), "addr_j": X.joined(c("addr")), "nums": X.numbers(c("addr")), "letters": X.letters(c("addr")),
         "postal": X.postal(c("addr")), "initials": X.initials(c("core")), "core_n": X.core_name(c("name_words")), "mixed": X.mixed_numbers(c("addr_raw")),
         "sound": X.sound_words(c("roman")), "roman_c": X.compact(X.joined(c("roman"))), "roman_addr_j": X.joined(c("roman_addr"))}
    )
    out = out.withColumns({"letters_j": X.joined(c("letters")), "sound_j": X.joined(c("sound"))})
    # grams of strings that pairs are compared by
    return out.withColumns({f"{k}_3": S.grams(c(k), 3) for k in THREES} | {f"{k}_2": S.grams(c(k), 2) for k in TWOS})


THREES = ["name_c", "addr_c", "core_c", "addr_j", "letters_j", "roman_c", "roman_addr_j"]
TWOS = ["core_c", "addr_j", "sound_j"]


def _keys(parts: list[tuple[int, Column]]) -> Column:
    def tagged(kind: int, values: Column) -> Column:
        return F.transform(values, lambda k: F.struct(F.lit(kind).alias("type"), k.alias("key")))

    return F.array_distinct(F.concat(*[tagged(t, v) for t, v in parts]))


def _postings(prepared: DataFrame, parts: list[tuple[int, Column]], least: int) -> DataFrame:
    return _exploded(prepared, _long_keys(parts, least))


def _long_keys(parts: list[tuple[int, Column]], least: int) -> Column:
    return F.filter(_keys(parts), lambda k: F.octet_length(k["key"]) >= least)


def _exploded(prepared: DataFrame, keys: Column) -> DataFrame:
    return prepared.select("entity_id", "country", F.explode(keys).alias("k")).select("country", F.col("k.type").alias("type"), F.col("k.key").alias("key"), "entity_id")


def base_postings(prepared: DataFrame) -> DataFrame:
    return _exploded(prepared, base_keys())


def base_keys() -> Column:
    """Keys of targets: name words (1), address words (2), whole name (3), adjacent pairs (4, 5)."""
    c = F.col
    whole = F.filter(F.array(c("name_c")), lambda x: F.octet_length(x) >= 4)
    parts = [(1, X.index_words(c("name_words"), 4)), (2, X.index_words(c("addr_raw"), 6)), (3, whole), (4, X.adjacent_pairs(X.pair_words(c("name_words")))), (5, X.adjacent_pairs(X.pair_words(c("addr_raw"))))]
    return _long_keys(parts, 1)


def enhanced_postings(prepared: DataFrame, more=None) -> DataFrame:
    return _exploded(prepared, enhanced_keys(more))


def enhanced_keys(more=None) -> Column:
    """Base keys plus normalised forms (6 to 12). ``more``: a function of the prepared columns that
    returns further (type, key array) pairs, e.g. ``sound_blocks``."""
    c = F.col
    names, addrs = X.index_words(c("name_words"), 4), X.index_words(c("addr_raw"), 6)
    long = lambda v: F.filter(v, lambda w: F.octet_length(w) >= 3)
    parts = [
        (1, names), (2, addrs), (3, F.array(c("name_c"))), (4, X.adjacent_pairs(X.pair_words(c("name_words")))), (5, X.adjacent_pairs(X.pair_words(c("addr_raw")))),
        (6, F.array(c("core_c"))), (7, F.array(c("addr_j"))), (8, F.array(X.consonants(c("core_c")))), (9, F.array_except(long(c("addr")), addrs)),
        (10, X.number_blocks(c("business_address"), c("addr"))), (11, F.array(X.loose_core(c("core")))), (12, F.array_except(long(c("core")), names)),
    ]
    return _long_keys(parts + (more() if more else []), 3)


def sound_blocks() -> list[tuple[int, Column]]:
    """Phonetic keys (13 to 15) for ``more``, on both sides."""
    return X.sound_keys(F.col("sound"))


def reference_postings(prepared: DataFrame) -> DataFrame:
    return _exploded(prepared, reference_keys())


def reference_keys() -> Column:
    """Keys of source 1 for the way back: core words in alphabetical order make the pairs."""
    c = F.col
    long = lambda v: F.filter(v, lambda w: F.octet_length(w) >= 3)
    parts = [(6, F.array(c("core_c"))), (7, F.array(c("addr_j"))), (12, long(c("core"))), (9, long(c("addr"))), (10, X.number_blocks(c("business_address"), c("addr"))), (4, X.adjacent_pairs(c("core")))]
    return _long_keys(parts, 2)


def base_lookups(prepared: DataFrame) -> DataFrame:
    return _exploded(prepared, base_asks()).withColumnRenamed("entity_id", "qid")


def base_asks() -> Column:
    c = F.col
    long = lambda v: F.filter(v, lambda w: F.octet_length(w) >= 3)
    whole = F.filter(F.array(c("name_c")), lambda x: F.octet_length(x) >= 4)
    parts = [(1, long(c("name_words"))), (2, long(c("addr_raw"))), (3, whole), (4, X.all_pairs(X.pair_words(c("name_words")))), (5, X.all_pairs(X.pair_words(c("addr_raw"))))]
    return _long_keys(parts, 1)


def enhanced_lookups(prepared: DataFrame, more=None) -> DataFrame:
    return _exploded(prepared, enhanced_asks(more)).withColumnRenamed("entity_id", "qid")


def enhanced_asks(more=None) -> Column:
    c = F.col
    long = lambda v: F.filter(v, lambda w: F.octet_length(w) >= 3)
    parts = [
        (1, F.concat(long(c("name_words")), long(c("core")))), (2, F.concat(long(c("addr_raw")), long(c("addr")))), (3, F.array(c("name_c"))),
        (4, X.all_pairs(X.pair_words(c("name_words")))), (5, X.all_pairs(X.pair_words(c("addr_raw")))), (6, F.array(c("core_c"))), (7, F.array(c("addr_j"))),
        (8, F.array(X.consonants(c("core_c")))), (9, long(c("addr"))), (10, X.number_blocks(c("business_address"), c("addr"))), (11, F.array(X.loose_core(c("core")))), (12, long(c("core"))),
    ]
    return _long_keys(parts + (more() if more else []), 2)


def reverse_asks() -> Column:
    c = F.col
    long = lambda v: F.filter(v, lambda w: F.octet_length(w) >= 3)
    parts = [(6, F.array(c("core_c"))), (7, F.array(c("addr_j"))), (12, long(c("core"))), (9, long(c("addr"))), (10, X.number_blocks(c("business_address"), c("addr"))), (4, X.all_pairs(c("core")))]
    return _long_keys(parts, 2)


def block_sizes(postings: DataFrame, cap: int) -> DataFrame:
    """Blocks of at most ``cap`` rows. Larger ones go before any posting is joined."""
    return postings.groupBy("country", "type", "key").agg(F.count("*").alias("n")).filter(F.col("n") <= cap)


def select_sorted(lookups: DataFrame, sizes: DataFrame, per_type: int, budget: int) -> DataFrame:
    """Blocks of each query, smallest first (then type, key): at most ``per_type`` of a type, as long as
    the rows so far stay within ``budget``. As sizes ascend, the first block over budget ends the list,
    so a running sum decides like a loop. Only counts are read."""
    found = lookups.join(sizes, ["country", "type", "key"])
    order = ["n", "type", "key"]
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("qid", "type").orderBy("n", "key"))).filter(F.col("r") <= per_type)
    total = F.sum("n").over(Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("total", total).filter(F.col("total") <= budget).select("qid", "country", "type", "key", "n")


def select_base(lookups: DataFrame, sizes: DataFrame, per_family: int = 5, budget: int = 1800) -> DataFrame:
    """The baseline's blocks: per family the ``per_family`` smallest, then families in the order whole
    name, name pairs, address pairs, name words, address words; a block that would pass the budget is
    skipped and later, smaller ones may still fit, which takes a fold."""
    found = lookups.join(sizes, ["country", "type", "key"])
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("qid", "type").orderBy("n", "key"))).filter(F.col("r") <= per_family)
    place = F.array_position(F.array(*[F.lit(t) for t in (3, 4, 5, 1, 2)]), F.col("type")).cast("int")
    rows = ranked.groupBy("qid", "country").agg(F.array_sort(F.collect_list(F.struct(place.alias("f"), "r", "type", "key", "n"))).alias("b"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("ok"))
    taken = F.aggregate(
        F.transform("b", lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"))), start,
        lambda s, x: F.when(s["used"] + x["n"] > budget, s).otherwise(F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["ok"], F.array(x["i"])).alias("ok"))),
        lambda s: s["ok"],
    )
    return rows.select("qid", "country", F.explode(F.transform(taken, lambda i: F.get(F.col("b"), i))).alias("x")).select("qid", "country", "x.type", "x.key", "x.n")


def weight(kinds: dict[int, float]) -> Column:
    """Score of a posting in whole millionths, so that sums don't depend on their order."""
    base = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])
    return F.round(F.element_at(base, F.col("type")) * (1 + F.log1p(800.0 / F.col("n"))) * MICRO).cast("bigint")
