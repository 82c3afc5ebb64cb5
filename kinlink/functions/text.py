"""Normalisation of names and addresses, as expressions over columns.

Strings stand for their UTF-8 bytes wherever a length counts; token arrays are sorted and distinct.
Missing text is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import scripts


def let(value: Column, body) -> Column:
    """``body`` of a value that each row computes once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lower_ascii(s: Column) -> Column:
    return F.translate(s, K.UPPER, K.LOWER)


def is_numeric(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def strip_zeros(t: Column) -> Column:
    """A run of digits without leading zeros; all zeros are one zero."""
    return F.when(t == "", t).otherwise(F.regexp_replace(t, "^0+(?=[0-9])", ""))


def tidy(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def words(s: Column) -> Column:
    raw = F.filter(F.split(lower_ascii(s), K.SEPARATOR), lambda t: t != "")
    return tidy(F.transform(raw, lambda t: F.when(is_numeric(t), strip_zeros(t)).otherwise(t)))


def compact(s: Column) -> Column:
    """Letters a-z, digits and everything beyond ASCII; capitals go, so lower first."""
    return F.regexp_replace(s, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", "")


def first_number(s: Column) -> Column:
    return strip_zeros(F.regexp_extract(s, "[0-9]+", 0))


def digit_runs(s: Column) -> Column:
    return tidy(F.transform(F.regexp_extract_all(s, F.lit("([0-9]+)")), strip_zeros))


def mixed_numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike("[0-9]"))


def numbers(tokens: Column) -> Column:
    return F.filter(tokens, is_numeric)


def letters(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_numeric(t))


def postal(tokens: Column) -> Column:
    return F.filter(numbers(tokens), lambda t: F.octet_length(t).between(5, 6))


def fold_text(s: Column) -> Column:
    accents = "".join(K.ACCENTS.values())
    plain = "".join(k * len(v) for k, v in K.ACCENTS.items())
    out = F.translate(s, accents + K.UPPER, plain + K.LOWER)
    for a, b in K.LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def core_words(s: Column) -> Column:
    kept = F.filter(words(fold_text(s)), lambda t: ~F.array_contains(strings(K.CORE_STOP), t))
    return tidy(F.transform(kept, lambda t: F.when(is_numeric(t), t).otherwise(F.translate(t, "0156", "olsg"))))


def core_name(tokens: Column) -> Column:
    """Plain words without legal forms, each followed by a bar."""
    kept = F.filter(tokens, lambda t: ~F.array_contains(strings(K.LEGAL), t))
    return F.array_join(F.transform(kept, lambda t: F.concat(t, F.lit("|"))), "")


def loose_core(core: Column) -> Column:
    return F.array_join(F.filter(core, lambda t: ~F.array_contains(strings(K.GENERIC), t)), "")


def consonants(s: Column) -> Column:
    return F.translate(s, "aeiou", "")


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _replace_first(s: Column, a: str, b: str) -> Column:
    return let(s, lambda x: F.when(F.contains(x, F.lit(a)), F.overlay(x, F.lit(b), F.instr(x, a), F.lit(len(a)))).otherwise(x))


def address_words(s: Column) -> Column:
    out = fold_text(s)
    for a, b in K.ADDRESS_PHRASES.items():
        out = _replace_first(out, a, b)
    alias = F.create_map(*[F.lit(x) for kv in K.ADDRESS_ALIASES.items() for x in kv])
    kept = F.filter(words(out), lambda t: ~F.array_contains(strings(K.ADDRESS_STOP), t))
    return tidy(F.transform(kept, lambda t: F.coalesce(F.try_element_at(alias, t), t)))


def is_indic(s: Column) -> Column:
    return s.rlike(r"[\x{0900}-\x{0DFF}]")


def by_salience(tokens: Column, least: int, most: int) -> Column:
    """The ``most`` longest tokens of at least ``least`` bytes; a number of 3 digits or more counts
    12 bytes longer; equal ones in alphabetical order."""
    size = lambda t: F.octet_length(t) + F.when(is_numeric(t) & (F.octet_length(t) >= 3), 12).otherwise(0)
    ranked = F.array_sort(F.transform(F.filter(tokens, lambda t: F.octet_length(t) >= least), lambda t: F.struct((-size(t)).alias("r"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda x: x["t"]), 1, most)


def index_words(tokens: Column, most: int) -> Column:
    return by_salience(tokens, 3, most)


def pair_words(tokens: Column) -> Column:
    return by_salience(tokens, 2, 5)


def pair_text(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))


def adjacent_pairs(tokens: Column) -> Column:
    return let(tokens, lambda v: F.transform(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda t, i: pair_text(F.get(v, i), t)))


def all_pairs(tokens: Column) -> Column:
    return let(tokens, lambda v: F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 2, F.greatest(F.size(v), F.lit(1))), lambda b: pair_text(a, b)))))


def number_blocks(address: Column, tokens: Column) -> Column:
    """``number|word``: up to three numbers, the first number of the address before longer ones, with
    up to four of the longest other words."""
    first = first_number(address)

    def of(own):
        every = F.when((own != "") & ~F.array_contains(numbers(tokens), own), F.concat(numbers(tokens), F.array(own))).otherwise(numbers(tokens))
        ns = F.array_sort(F.transform(every, lambda n, i: F.struct((n != own).alias("f"), (-F.octet_length(n)).alias("l"), i.alias("i"), n.alias("t"))))
        ws = F.array_sort(F.transform(F.filter(letters(tokens), lambda w: F.octet_length(w) >= 3), lambda w: F.struct((-F.octet_length(w)).alias("l"), w.alias("t"))))
        return F.flatten(F.transform(F.slice(ns, 1, 3), lambda n: F.transform(F.slice(ws, 1, 4), lambda w: F.concat(n["t"], F.lit("|"), w["t"]))))

    return let(first, of)


def initials(core: Column) -> Column:
    return F.array_join(F.transform(core, lambda t: F.substring(t, 1, 1)), "")


def romanize(s: Column) -> Column:
    """Latin spelling of Brahmic letters; joiners, combining accents and characters of the block
    without a sound vanish. Text without any of these is only folded."""
    c = scripts.classes()
    longer, (letters_, plain) = scripts.sounds()
    out = F.regexp_replace(fold_text(s), c["silent"], "")
    out = F.regexp_replace(out, f"({c['consonant']})(?!{c['taking']})", "$1a")
    for sound, which in longer.items():
        out = F.regexp_replace(out, which, sound)
    return F.when(s.rlike(c["any"]), F.translate(out, letters_, plain)).otherwise(fold_text(s))


def phonetic(s: Column) -> Column:
    """Consonant skeleton of the letters a-z; a doubled sound is written once, but x always adds its two sounds."""
    out = F.regexp_replace(F.replace(s, F.lit("ph"), F.lit("f")), "[^a-z]|[aeiouh]", "")
    out = F.regexp_replace(F.translate(out, "cqwz", "kkvs"), r"([b-wy])\1+", "$1")
    return F.replace(F.replace(out, F.lit("xs"), F.lit("x")), F.lit("x"), F.lit("ks"))


def sound_words(roman: Column) -> Column:
    """Sounds of romanised core words without legal forms."""
    sounds = F.transform(roman, phonetic)
    return tidy(F.filter(sounds, lambda t: (t != "") & ~F.array_contains(strings(K.PHONETIC_LEGAL), t)))


def sound_keys(sound: Column) -> list[tuple[int, Column]]:
    """Phonetic blocks: all sounds (13), each sound (14), pairs of up to eight sounds (15)."""
    pairs_ = F.filter(all_pairs(sound), lambda k: F.octet_length(k) >= 6)
    return [
        (13, F.when(F.size(sound) > 0, F.array(joined(sound))).otherwise(F.array().cast("array<string>"))),
        (14, F.filter(sound, lambda t: F.octet_length(t) >= 3)),
        (15, F.when(F.size(sound) <= 8, pairs_).otherwise(F.array().cast("array<string>"))),
    ]
