"""Normalisation and similarities a character at a time, to hold the expressions against."""

import re
from collections import Counter

from kinlink.functions import constants as K
from kinlink.functions import scripts

RULES = {c: (s + "a" * (form == "consonant"), form) for form, sounds in scripts.letters().items() for c, s in sounds.items()}
_FOLD = str.maketrans({**{x: k for k, v in K.ACCENTS.items() for x in v}, **K.LIGATURES, **dict(zip(K.UPPER, K.LOWER, strict=True))})
_SPLIT = re.compile(K.SEPARATOR)


def fold(s: str) -> str:
    return s.translate(_FOLD)


def words(s: str) -> list[str]:
    out = {t.lstrip("0") or "0" if re.fullmatch("[0-9]+", t) else t for t in _SPLIT.split(s.translate(str.maketrans(K.UPPER, K.LOWER))) if t}
    return sorted(out, key=str.encode)


def core_words(s: str) -> list[str]:
    leet = str.maketrans("0156", "olsg")
    return sorted({t if re.fullmatch("[0-9]+", t) else t.translate(leet) for t in words(fold(s)) if t not in K.CORE_STOP}, key=str.encode)


def address_words(s: str) -> list[str]:
    out = fold(s)
    for a, b in K.ADDRESS_PHRASES.items():
        out = out.replace(a, b, 1)
    return sorted({K.ADDRESS_ALIASES.get(t, t) for t in words(out) if t not in K.ADDRESS_STOP}, key=str.encode)


def romanize(s: str) -> str:
    """Latin spelling: consonants carry an a, which a vowel sign or virama takes away; joiners,
    combining accents and unknown letters of the block vanish."""
    rules, out, carries = RULES, [], False
    for ch in fold(s):
        rule = rules.get(ch)
        if rule:
            text, kind = rule
            if kind in ("sign", "virama") and carries and out:
                out[-1] = out[-1][:-1]
            out.append(text)
            carries = kind == "consonant"
        elif not (ch in "‌‍" or scripts.FIRST <= ord(ch) <= scripts.LAST or 0x300 <= ord(ch) <= 0x36F):
            out.append(ch)
            carries = False
    return "".join(out)


def phonetic(s: str) -> str:
    """Consonant skeleton; a doubled sound is written once, but x always adds its two sounds."""
    z = ""
    for m in re.finditer("ph|[a-z]", s):
        c = {"ph": "f", "c": "k", "q": "k", "w": "v", "z": "s"}.get(m[0], m[0])
        if c == "x":
            z += "ks"
        elif c not in "aeiouh" and z[-1:] != c:
            z += c
    return z


def sound_words(s: str) -> list[str]:
    out = {phonetic(w) for w in core_words(romanize(s))}
    return sorted(out - set(K.PHONETIC_LEGAL) - {""})


def sound_keys(s: str) -> list[tuple[str, int]]:
    """Phonetic blocks: all sounds (13), each sound (14), pairs of up to eight sounds (15)."""
    v = sound_words(s)
    out = [(" ".join(v), 13)] if v else []
    out += [(w, 14) for w in v if len(w) >= 3]
    if len(v) <= 8:
        out += [(f"{a}|{b}", 15) for i, a in enumerate(v) for b in v[i + 1 :] if len(a) + len(b) >= 5]
    return out


def compact(s: str) -> str:
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", "", s)


def dice(a: str, b: str, n: int) -> float:
    x, y = a.encode(), b.encode()
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if min(len(x), len(y)) < n:
        return 0.0
    p, q = (Counter(v[i : i + n] for i in range(len(v) - n + 1)) for v in (x, y))
    return 2.0 * (p & q).total() / (p.total() + q.total())


def overlap(a: list[str], b: list[str]) -> float:
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def jaccard(a: list[str], b: list[str]) -> float:
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
