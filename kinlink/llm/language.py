"""Language identification by prediction with partial matching (PPM).

For each language a variable-order context tree over bytes (orders 0 to 3) is counted on all of its
labelled texts and frozen. The code length of a byte is that of the longest context that has seen it, plus
the escapes from the longer ones (method C: escape d / (n + d), d distinct successors, n in all);
below order 0 stands 1/256. A text's language is the one that codes all of its bytes in the fewest
bits. Lengths are whole 1/1024 bits, so sums are exact.

All labelled text is counted, whatever its size; trees grow with the distinct runs of four bytes alone. Only a caller
that gives ``train_bytes`` gets a sample: per language an equal share of it, chosen by hash of key and text in pieces of
``PIECE`` bytes, in expectation, and the first ``LEAST`` texts by hash. Every text is scored whole.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0, and so is
everything if nothing could be learned; equal code lengths go to the first language by code point;
a null key counts as the empty string; repeated rows are judged alike; an empty table gives an
empty result; extra columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed import chunks
from .shared import table

#: Of a sample: texts are drawn in pieces of so many bytes; every labelled language has at least ``LEAST`` of them, or all its texts.
PIECE, LEAST = 1 << 14, 32
UNIT = 1024
#: Lower case for A-Z, a space for every other ASCII byte; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
START = b"   "
_P = "__lang_"


def remainder(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def grams(folded: bytes) -> np.ndarray:
    """The 4 bytes that end at each byte of a text, as numbers; three spaces stand before it."""
    x = np.frombuffer(START + folded, np.uint8).astype(np.uint32)
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts per gram."""
    g, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return g, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(g)).astype(np.int64)


def _count(batches: Iterator) -> Iterator:
    """Counts of a whole task per language: what is held and sent follows the distinct grams, not the text."""
    held: dict[str, list] = {}
    for rows in chunks(batches, ["lang", "text"]):
        by: dict[str, list] = {}
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            if text:
                by.setdefault(lang, []).append(grams(text.translate(FOLD)))
        for lang, parts in by.items():
            own = held.setdefault(lang, [])
            own.append(np.unique(np.concatenate(parts), return_counts=True))
            if len(own) == 8:
                held[lang] = [_merged(own)]
    for lang, parts in held.items():
        g, n = _merged(parts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g.astype(np.int64)), "n": pa.array(n)})


class Trees:
    """Frozen statistics: complete code lengths of every seen gram, per order and language."""

    def __init__(self, langs: list[str], grams4: list[np.ndarray], counts: list[np.ndarray]):
        self.langs = langs
        self.keys, self.cost, self.escape = [], [], []
        below = np.full((256, len(langs)), 8.0)
        for order in range(4):
            size = 8 * (order + 1)
            mask = np.uint64((1 << size) - 1)
            own = []
            for g, n in zip(grams4, counts, strict=True):
                k, at = np.unique(g.astype(np.uint64) & mask, return_inverse=True)
                own.append((k, np.bincount(at, weights=n, minlength=len(k))))
            keys = np.unique(np.concatenate([k for k, _ in own]))
            contexts = np.unique(keys >> np.uint64(8))
            esc, cost = np.zeros((len(contexts), len(langs))), np.zeros((len(keys), len(langs)))
            under = below[(keys & np.uint64(255)).astype(int)] if order == 0 else self._complete(order - 1, keys & (mask >> np.uint64(8)))
            for i, (k, n) in enumerate(own):
                c = np.searchsorted(contexts, k >> np.uint64(8))
                total, distinct = np.bincount(c, weights=n, minlength=len(contexts)), np.bincount(c, minlength=len(contexts))
                seen = total > 0
                esc[seen, i] = np.log2((total[seen] + distinct[seen]) / distinct[seen])
                cost[:, i] = under[:, i] + esc[np.searchsorted(contexts, keys >> np.uint64(8)), i]
                cost[np.searchsorted(keys, k), i] = np.log2((total + distinct)[c] / n)
            self.keys.append(keys)
            self.cost.append(cost)
            self.escape.append((contexts, esc))
        self.keys32 = self.keys[3].astype(np.uint32)
        self.units = np.rint(self.cost[3] * UNIT).astype(np.int32)

    def _complete(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Code lengths of grams of order + 1 bytes, seen or not."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        have = self.keys[order]
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        hit = have[at] == keys
        out = self.cost[order][at]
        rest = keys[~hit]
        if len(rest):
            contexts, esc = self.escape[order]
            c = np.minimum(np.searchsorted(contexts, rest >> np.uint64(8)), len(contexts) - 1)
            known = contexts[c] == rest >> np.uint64(8)
            lower = self._complete(order - 1, rest & np.uint64((1 << 8 * order) - 1) if order else rest)
            out[~hit] = lower + esc[c] * known[:, None]
        return out

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """Code length of each gram for every language, in units."""
        at = np.minimum(np.searchsorted(self.keys32, g), len(self.keys32) - 1)
        out = self.units[at]
        miss = np.flatnonzero(self.keys32[at] != g)
        if len(miss):
            new, back = np.unique(g[miss], return_inverse=True)
            out[miss] = np.rint(self._complete(3, new.astype(np.uint64)) * UNIT).astype(np.int32)[back]
        return out

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        folded = text.encode("utf-8", "replace").translate(FOLD)
        total = np.zeros(len(self.langs), np.int64)
        g = grams(folded)
        for i in range(0, len(g), 1 << 18):
            total += self.lengths(g[i : i + (1 << 18)]).sum(0, dtype=np.int64)
        best = int(total.argmin())
        # the posterior of a text of at most 64 bytes at this rate, all languages alike before
        bits = (total - total[best]) / UNIT * min(1.0, 64 / len(g))
        return self.langs[best], float(1 / np.exp2(-np.minimum(bits, 1000)).sum())


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_bytes: int | None = None) -> Trees:
    """Count the trees of all languages in ``docs`` (rows with null language or text don't count) on all texts, or
    on about ``train_bytes`` of them."""
    known = docs.select(F.xxhash64(F.lit("language"), F.col(key).cast("string"), text).alias("h"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    known = known.filter("lang IS NOT NULL AND octet_length(text) > 0")
    chosen = known if train_bytes is None else _drawn(known, train_bytes)
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    frame = rows.to_pandas().sort_values(["lang", "gram"])
    langs = sorted(frame["lang"].unique())
    if not langs:
        return _nothing()
    parts = [frame[frame["lang"] == k] for k in langs]
    return Trees(langs, [p["gram"].to_numpy() for p in parts], [p["n"].to_numpy(float) for p in parts])


def _drawn(known: DataFrame, train_bytes: int) -> DataFrame:
    """A sample of about ``train_bytes`` of the texts, in pieces."""
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return known
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_bytes / len(langs) / sizes[k]))])
    # pieces by place: only the drawn ones are cut out of their text
    places = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / PIECE).cast("int"))
    drawn = F.filter(places, lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) < F.col("rate") * float(1 << 30))
    sized = known.withColumns({"rate": F.element_at(rate, F.col("lang")), "places": places})
    by_rate = sized.select("lang", "text", "h", F.explode(drawn).alias("i"))
    # at least so many pieces of every language, however rare: the first by hash of the first pieces of its texts
    few = Window.partitionBy("lang").orderBy("h")
    first = known.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= LEAST).select("lang", "text", "h", F.lit(0).alias("i"))
    piece = F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE))
    return by_rate.unionByName(first).select("lang", "h", "i", piece.alias("text")).groupBy("lang", "h", "i").agg(F.min("text").alias("text"))


def _nothing() -> Trees:
    empty = Trees.__new__(Trees)
    empty.langs = []
    return empty


def identified(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; nothing but the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    at = keep.index(text)

    def judge(batches: Iterator) -> Iterator:
        for batch in batches:
            seen = [shared.value.judge(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.float64())],
                [*[f"c{i}" for i in range(len(keep))], "lang_pred", "lang_score"],
            )

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    out = plain.mapInArrow(judge, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "lang_score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    trees = train(docs.filter(~held))
    return identified(docs.select("doc_id", "text"), trees).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
