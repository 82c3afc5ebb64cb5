"""Latin spelling of nine Brahmic scripts, as replacements over classes of letters.

Unicode names the letters of these scripts alike, so the table is looked up by name: each script, each
form, each sound. A consonant carries an a, which a vowel sign or a virama after it takes away.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Sounds of Brahmic letters by the end of their Unicode names.
VOWELS = {
    "A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "E": "e", "EE": "e", "AI": "ai", "O": "o", "OO": "o", "AU": "au",
    "VOCALIC R": "ri", "VOCALIC RR": "ri", "VOCALIC L": "li", "VOCALIC LL": "li",
}
CONSONANTS = {
    "KA": "k", "KHA": "kh", "GA": "g", "GHA": "gh", "NGA": "n", "CA": "ch", "CHA": "ch", "JA": "j", "JHA": "jh", "NYA": "n",
    "TTA": "t", "TTHA": "th", "DDA": "d", "DDHA": "dh", "NNA": "n", "TA": "t", "THA": "th", "DA": "d", "DHA": "dh", "NA": "n", "NNNA": "n",
    "PA": "p", "PHA": "f", "BA": "b", "BHA": "bh", "MA": "m", "YA": "y", "YYA": "y", "RA": "r", "RRA": "r", "LA": "l", "LLA": "l",
    "LLLA": "l", "VA": "v", "SHA": "sh", "SSA": "sh", "SA": "s", "HA": "h", "QA": "k", "KHHA": "kh", "GHHA": "g", "ZA": "z",
    "DDDHA": "r", "RHA": "r", "FA": "f",
}
SCRIPTS = ["DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM"]
SHADES = ["", "CANDRA ", "SHORT "]
NASALS = ["SIGN ANUSVARA", "SIGN COMBINING ANUSVARA ABOVE", "SIGN COMBINING ANUSVARA ABOVE RIGHT", "SIGN BINDI", "SIGN ADAK BINDI", "TIPPI"]
VIRAMAS = ["SIGN VIRAMA", "SIGN VERTICAL BAR VIRAMA", "SIGN CIRCULAR VIRAMA"]
DIGITS = ["ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE"]
FIRST, LAST = 0x0900, 0x0D7F


def _named(*parts: str) -> str:
    """The character of that name inside the block; empty if there is none."""
    try:
        ch = unicodedata.lookup(" ".join(parts))
    except KeyError:
        return ""
    return ch if FIRST <= ord(ch) <= LAST else ""


@lru_cache(maxsize=1)
def letters() -> dict[str, dict[str, str]]:
    """Per form (alone, consonant, sign, virama) the sound of each character; a consonant's without its a."""
    out: dict[str, dict[str, str]] = {"alone": {}, "consonant": {}, "sign": {}, "virama": {}}
    for script in SCRIPTS:
        for shade in SHADES:
            for tail, sound in VOWELS.items():
                out["alone"][_named(script, "LETTER", shade + tail)] = sound
                out["sign"][_named(script, "VOWEL SIGN", shade + tail)] = sound
            for tail, sound in CONSONANTS.items():
                out["consonant"][_named(script, "LETTER", shade + tail)] = sound
        for value, tail in enumerate(DIGITS):
            out["alone"][_named(script, "DIGIT", tail)] = str(value)
        out["alone"] |= {_named(script, n): "n" for n in NASALS} | {_named(script, "SIGN VISARGA"): "h"}
        out["virama"] |= {_named(script, n): "" for n in VIRAMAS}
    for form in out.values():
        form.pop("", None)
    return out


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Character classes for patterns: ``consonant``, ``taking`` (what takes a consonant's a away),
    ``silent`` (joiners, combining accents and characters of the block without a sound), ``any`` of these."""
    by = letters()
    heard = {c for form in by.values() for c in form}
    silent = "".join(chr(c) for c in range(FIRST, LAST + 1) if chr(c) not in heard) + "‌‍" + "".join(map(chr, range(0x300, 0x370)))
    return {
        "consonant": "[" + "".join(sorted(by["consonant"])) + "]", "taking": "[" + "".join(sorted({**by["sign"], **by["virama"]})) + "]",
        "silent": f"[{silent}]", "any": f"[{chr(FIRST)}-{chr(LAST)}̀-ͯ‌‍]",
    }


@lru_cache(maxsize=1)
def sounds() -> tuple[dict[str, str], tuple[str, str]]:
    """Longer sounds by the class of characters that have them, and a translation of the rest
    (characters, single letters; those beyond the letters vanish)."""
    every = {c: s for form in letters().values() for c, s in form.items()}
    longer = {s: "[" + "".join(sorted(c for c in every if every[c] == s)) + "]" for s in sorted(set(every.values())) if len(s) > 1}
    single = sorted((c for c in every if len(every[c]) == 1), key=lambda c: (every[c], c))
    gone = sorted(c for c in every if not every[c])
    return longer, ("".join(single + gone), "".join(every[c] for c in single))
