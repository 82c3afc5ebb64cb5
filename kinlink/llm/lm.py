"""Language-model scoring: an interpolated modified Kneser-Ney model of order 2 or 3.

Training counts distinct words and word pairs per task, then exactly per shard. Pairs are dealt by
their first word; words so frequent that their pairs would fill a shard are dealt by both. The model
is a set of sorted hash arrays in the shared folder: per word its count, its continuation count (how
many words precede it), the sum of its followers' counts and how many of them were seen once, twice
and more often; per pair its count. Workers memory-map the arrays and look tokens up by binary
search; no worker holds them.

p(w | v) = (c(vw) - D(c(vw)))+ / c(v) + g(v) * p1(w), p1 the same over continuation counts, backed by
1 / (V + 1). Discounts D1, D2, D3+ come from counts of counts, at every order. A text starts after
start marks and ends with an end token. Unseen contexts fall back to the order below.

At order 3 triples are counted first, dealt by the whole triple, so that no context is hot; a pair's
count is then the number of distinct words before it, and contexts of two words are an array of their
own. Order 2 is the default, as triples, nearly all of which are distinct, take several times the input
on disk while they are counted.

Defined results: null and empty texts are the end token alone; repeated rows count as documents of
their own; with no training text every token has probability 1 (V = 0) and base score 0; a null key
counts as the empty string; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed import Hasher, Store, U, chunks, cuts, manifest, shard_of, stir, write_shard
from .language import remainder
from .shared import scratch, stored, table

END, BEGIN = b" end", b" begin"  # no word holds a space
GROUP = 12 << 20
#: Text whose words and pairs one shard, and so one task at a time, may hold. Counts have 64 bits.
SHARD_BYTES = 256 << 20
HOT = 64
#: Types of the columns of ``_followers``.
FOLLOWERS = ["<u4", "<u4", "<u4", "<u8"]


def _tokens(texts: list, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and where each text starts."""
    words = [x.lower().split() if x else [] for x in texts]
    ends = np.cumsum([len(w) + 1 for w in words])
    flat = hasher.of([w for ws in words for w in (*ws, END)])
    return flat, np.append(0, ends[:-1]).astype(np.int64)


def _before(tokens: np.ndarray, starts: np.ndarray, hasher: Hasher) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[starts] = U(hasher[BEGIN])
    return out


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return stir(v * U(0x9E3779B97F4A7C15) + w)


def pair_shard(v: np.ndarray, key: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Hot words: sorted hashes. Their pairs are dealt by the pair, all others by the first word."""
    at = shard_of(v, n)
    if len(hot):
        p = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        is_hot = hot[p] == v
        at[is_hot] = shard_of(key[is_hot], n)
    return at


def discounts(n: list[float]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items seen once, twice, three and four times. One that comes out
    at 0 or less is 0.5, so that every context leaves mass to words it wasn't seen with."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(float(min(d, k)) if d > 0 else 0.5 for d, k in ((d1, 1), (d2, 2), (d3, 3)))


@dataclass
class Model:
    words: Store
    pairs: Store
    large: Store
    hot: np.ndarray
    tokens: int
    vocabulary: int
    continuations: int
    pair_discounts: tuple
    word_discounts: tuple
    rest: float
    triples: Store | None = None
    large_triples: Store | None = None
    contexts: Store | None = None
    triple_discounts: tuple = ()

    @staticmethod
    def _counts(store: Store, large: Store, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, at))
        k, found = key[order], np.zeros(len(key), np.int64)
        ends = np.searchsorted(at[order], np.arange(store.n + 1, dtype=U))
        for i in np.flatnonzero(np.diff(ends)):
            a, b = ends[i], ends[i + 1]
            have, counts = store.shard(int(i))
            if len(have):
                p = np.minimum(np.searchsorted(have, k[a:b]), len(have) - 1)
                c = np.where(have[p] == k[a:b], counts[p], 0).astype(np.int64)
                big = np.flatnonzero(c == 255)
                if len(big):
                    keys, values = large.shard(int(i))
                    c[big] = values[np.searchsorted(keys, k[a:b][big])]
                found[a:b] = c
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, tokens: np.ndarray, starts: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
        """Per text: known tokens, base score, model score."""
        before = _before(tokens, starts, hasher)
        kinds, at = np.unique(np.concatenate([tokens, np.array([hasher[BEGIN]], U)]), return_inverse=True)
        _, (c, cont, n1, n2, n3, whole) = self.words.find(kinds)
        c, cont = c.astype(float), cont.astype(float)
        flat = 1 / (self.vocabulary + 1)
        low = np.full(len(kinds), flat)
        if self.continuations:
            low = np.maximum(cont - _d(cont, self.word_discounts), 0) / self.continuations + self.rest * flat
        d1, d2, d3 = self.pair_discounts
        back = np.where(whole > 0, (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(whole, 1), 1.0)
        w = at[:-1]
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[starts] = at[-1]
        key = pair_key(before, tokens)
        pair = self._counts(self.pairs, self.large, key, pair_shard(before, key, self.hot, self.pairs.n)).astype(float)
        p = np.maximum(pair - _d(pair, self.pair_discounts), 0) / np.maximum(whole[v], 1) + back[v] * low[w]
        if self.triples is not None:
            context = pair_key(_before(before, starts, hasher), before)
            key = pair_key(context, tokens)
            triple = self._counts(self.triples, self.large_triples, key, shard_of(key, self.triples.n)).astype(float)
            kinds, at = np.unique(context, return_inverse=True)
            _, (n1, n2, n3, whole) = self.contexts.find(kinds)
            d1, d2, d3 = self.triple_discounts
            back = np.where(whole > 0, (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(whole, 1), 1.0)
            p = np.maximum(triple - _d(triple, self.triple_discounts), 0) / np.maximum(whole[at], 1) + back[at] * p
        total = self.tokens + self.vocabulary + 1
        base = np.log10((c + 1) / total)
        return [np.add.reduceat((c > 0)[w].astype(np.int64), starts), np.add.reduceat(base[w], starts), np.add.reduceat(np.log10(p), starts)]


def _d(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count ``docs`` and store the model."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3")
    spark = docs.sparkSession
    uri = scratch(spark, "lm")
    texts = docs.select(F.col(text).cast("binary").alias("text"))
    weight = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // (SHARD_BYTES if order == 2 else SHARD_BYTES // 4)))

    def count_words(batches: Iterator) -> Iterator:
        hasher = Hasher()
        for rows in chunks(batches, ["text"], GROUP):
            tokens, starts = _tokens(rows["text"], hasher)
            h, c = np.unique(tokens, return_counts=True)
            h, c = np.append(h, U(hasher[BEGIN])), np.append(c, len(starts))
            order = np.argsort(h)
            yield _dealt(h[order], [c[order].astype(np.uint32)], n, 0)

    def add_words(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        h, c = _summed(parts["data"], ["<u4"])
        write_shard(f"{uri}/counts", int(key[0]), [h, c[0].astype(np.uint64)])
        top = np.argsort(-c[0], kind="stable")[:HOT]
        return pd.DataFrame({"h": h[top].view(np.int64), "c": c[0][top]})

    top = texts.mapInArrow(count_words, "shard int, kind int, data binary").groupBy("shard").applyInPandas(add_words, "h bigint, c bigint").toPandas()
    counts = Store(f"{uri}/counts", n, ["<u8", "<u8"])
    begin = np.int64(np.array([Hasher()[BEGIN]], U).view(np.int64)[0])
    hot = np.sort(top.loc[(top["c"] > max(1, weight // 6 // (4 * n))) | (top["h"] == begin), "h"].to_numpy(np.int64).view(U)) if len(top) else np.zeros(0, U)

    def count_pairs(batches: Iterator) -> Iterator:
        hasher = Hasher()
        for rows in chunks(batches, ["text"], GROUP):
            w, starts = _tokens(rows["text"], hasher)
            v = _before(w, starts, hasher)
            key = pair_key(v, w)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - U(1)))
            c = np.diff(np.append(first, len(key))).astype(np.uint32)
            yield _pair_blobs(v[order][first], w[order][first], c, hot, n)

    def add_pairs(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        v, w, c = _pairs_of(parts["data"])
        keys = pair_key(v, w)
        order = np.argsort(keys)
        keys, c = keys[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - U(1)))
        c, keys = np.add.reduceat(c, first), keys[first]
        v, w = v[order[first]], w[order[first]]
        i = int(key[0])
        write_shard(f"{uri}/pairs", i, [keys, np.minimum(c, 255).astype(np.uint8)])
        write_shard(f"{uri}/large", i, [keys[c >= 255], c[c >= 255].astype(np.uint64)])
        out = []
        kinds, at = np.unique(v, return_inverse=True)
        out.append(_dealt(kinds, _followers(at, c, len(kinds)), n, 1))
        kinds, seen = np.unique(w, return_counts=True)
        out.append(_dealt(kinds, [seen.astype(np.uint32)], n, 2))
        of_counts = np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64)
        out.append(pa.RecordBatch.from_pydict({"shard": pa.array([i], pa.int32()), "kind": pa.array([3], pa.int32()), "data": pa.array([of_counts.tobytes()], pa.binary())}))
        return pa.Table.from_batches(out).to_pandas()

    def add_kinds(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        h, c = counts.shard(i) if i in has_words else (np.zeros(0, U), np.zeros(0, np.uint64))
        cols = [np.zeros(len(h), np.uint64) for _ in range(5)]
        for kind, at, types in ((2, [0], ["<u4"]), (1, [1, 2, 3, 4], FOLLOWERS)):
            keys, sums = _summed(parts["data"][parts["kind"] == kind], types)
            where = np.searchsorted(h, keys)
            for k, s in zip(at, sums, strict=True):
                cols[k][where] = s
        write_shard(f"{uri}/words", i, [h, c, *cols])
        pairs_of = sum((np.frombuffer(b, np.int64) for b in parts["data"][parts["kind"] == 3]), np.zeros(4, np.int64))
        real = h != U(int(begin) & ((1 << 64) - 1))
        cont = cols[0][real]
        row = [int(c[real].sum(dtype=np.int64)), int(real.sum()), int(cont.sum(dtype=np.int64)), *[int((cont == k).sum()) for k in (1, 2, 3, 4)], int((cont > 2).sum()), *map(int, pairs_of), i]
        return pd.DataFrame([row], columns=NAMES)

    NAMES = ["tokens", "vocabulary", "continuations", "w1", "w2", "w3", "w4", "w3p", "p1", "p2", "p3", "p4", "shard"]
    # any token's shard has words; every shard with words has followers or continuations
    has_words = set(range(n))
    for i in set(range(n)) - set(shard_of(top["h"].to_numpy(np.int64).view(U), n).astype(int).tolist() if len(top) else []):
        write_shard(f"{uri}/counts", i, [np.zeros(0, U), np.zeros(0, np.uint64)])
    third = _triples(texts, uri, n, hot) if order == 3 else None
    dealt = texts.mapInArrow(count_pairs, "shard int, data binary") if third is None else third[0]
    sent = dealt.groupBy("shard").applyInPandas(add_pairs, "shard int, kind int, data binary")
    stats = sent.groupBy("shard").applyInPandas(add_kinds, ", ".join(f"{c} bigint" for c in NAMES)).toPandas()
    for name, types in (("pairs", 2), ("large", 2), ("words", 7)):
        _fill(f"{uri}/{name}", n)
    s = stats.sum()
    of_words, of_pairs = discounts([s["w1"], s["w2"], s["w3"], s["w4"]]), discounts([s["p1"], s["p2"], s["p3"], s["p4"]])
    rest = (of_words[0] * s["w1"] + of_words[1] * s["w2"] + of_words[2] * s["w3p"]) / s["continuations"] if s["continuations"] else 1.0
    manifest(uri, {"shards": n, "tokens": int(s["tokens"]), "vocabulary": int(s["vocabulary"])})
    return Model(
        Store(f"{uri}/words", n, ["<u8"] * 7), Store(f"{uri}/pairs", n, ["<u8", "u1"]), Store(f"{uri}/large", n, ["<u8", "<u8"]), hot,
        int(s["tokens"]), int(s["vocabulary"]), int(s["continuations"]), of_pairs, of_words, float(rest), *(third[1:] if third else ()),
    )


def _triples(texts: DataFrame, uri: str, n: int, hot: np.ndarray) -> tuple:
    """Count triples and store their arrays: blobs of pairs with the number of distinct words before
    each, the stores of triples, of their large counts and of contexts, the discounts."""

    def count(batches: Iterator) -> Iterator:
        hasher = Hasher()
        for rows in chunks(batches, ["text"], GROUP):
            w, starts = _tokens(rows["text"], hasher)
            v = _before(w, starts, hasher)
            x = pair_key(_before(v, starts, hasher), v)
            key = pair_key(x, w)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - U(1)))
            c = np.diff(np.append(first, len(key))).astype(np.uint32)
            at = order[first]
            yield _dealt(key[first], [x[at], v[at], w[at], c], n, 0)

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        i, cols = int(key[0]), [[], [], [], [], []]
        for b in parts["data"]:
            m = len(b) // 36
            for k in range(5):
                cols[k].append(np.frombuffer(b, U if k < 4 else np.uint32, m, 8 * m * k))
        keys, x, v, w, c = (np.concatenate(col) for col in cols)
        del cols
        order = np.argsort(keys)
        keys, c = keys[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - U(1)))
        c, keys, at = np.add.reduceat(c, first), keys[first], order[first]
        write_shard(f"{uri}/triples", i, [keys, np.minimum(c, 255).astype(np.uint8)])
        write_shard(f"{uri}/large-triples", i, [keys[c >= 255], c[c >= 255].astype(np.uint64)])
        kinds, own = np.unique(x[at], return_inverse=True)
        contexts = _dealt(kinds, _followers(own, c, len(kinds)), n, 4)
        pair, own, seen = np.unique(pair_key(v[at], w[at]), return_index=True, return_counts=True)
        pairs = _pair_blobs(v[at][own], w[at][own], seen.astype(np.uint32), hot, n)
        pairs = pa.RecordBatch.from_arrays([pairs.column(0), pa.array([0] * pairs.num_rows, pa.int32()), pairs.column(1)], ["shard", "kind", "data"])
        of_counts = np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64)
        told = pa.RecordBatch.from_pydict({"shard": pa.array([i], pa.int32()), "kind": pa.array([3], pa.int32()), "data": pa.array([of_counts.tobytes()], pa.binary())})
        return pa.Table.from_batches([contexts, pairs, told]).to_pandas()

    def add_contexts(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        h, cols = _summed(parts["data"], FOLLOWERS)
        write_shard(f"{uri}/contexts", int(key[0]), [h, *[c.astype(np.uint64) for c in cols]])
        return parts.iloc[:1][["shard"]]

    sent = stored(texts.mapInArrow(count, "shard int, kind int, data binary").select("shard", "data").groupBy("shard").applyInPandas(add, "shard int, kind int, data binary"), "lm-triples")
    sent.filter("kind = 4").groupBy("shard").applyInPandas(add_contexts, "shard int").agg(F.count("*")).collect()
    of_counts = sum((np.frombuffer(r["data"], np.int64) for r in sent.filter("kind = 3").select("data").collect()), np.zeros(4, np.int64))
    for name in ("triples", "large-triples", "contexts"):
        _fill(f"{uri}/{name}", n)
    stores = Store(f"{uri}/triples", n, ["<u8", "u1"]), Store(f"{uri}/large-triples", n, ["<u8", "<u8"]), Store(f"{uri}/contexts", n, ["<u8"] * 5)
    return sent.filter("kind = 0").select("shard", "data"), *stores, discounts(of_counts.tolist())


def _pair_blobs(v: np.ndarray, w: np.ndarray, c: np.ndarray, hot: np.ndarray, n: int) -> pa.RecordBatch:
    """Distinct pairs with their counts, one blob per shard."""
    at = pair_shard(v, pair_key(v, w), hot, n)
    order = np.lexsort((v, at))
    v, w, c, at = v[order], w[order], c[order], at[order]
    ends = np.searchsorted(at, np.arange(n + 1, dtype=U))
    used, blobs = np.flatnonzero(np.diff(ends)), []
    for i in used:
        part = slice(ends[i], ends[i + 1])
        firsts = np.flatnonzero(np.diff(v[part], prepend=v[part][:1] - U(1)))
        runs = np.diff(np.append(firsts, ends[i + 1] - ends[i])).astype(np.uint32)
        head = np.array([len(firsts), ends[i + 1] - ends[i]], np.int64)
        blobs.append(b"".join(x.tobytes() for x in (head, v[part][firsts], runs, w[part], c[part])))
    return pa.RecordBatch.from_pydict({"shard": pa.array(used, pa.int32()), "data": pa.array(blobs, pa.binary())})


def _pairs_of(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vs, ws, cs = [], [], []
    for b in blobs:
        k, m = np.frombuffer(b, np.int64, 2)
        vs.append(np.repeat(np.frombuffer(b, U, k, 16), np.frombuffer(b, np.uint32, k, 16 + 8 * k)))
        ws.append(np.frombuffer(b, U, m, 16 + 12 * k))
        cs.append(np.frombuffer(b, np.uint32, m, 16 + 12 * k + 8 * m))
    return np.concatenate(vs), np.concatenate(ws), np.concatenate(cs)


def _followers(at: np.ndarray, c: np.ndarray, kinds: int) -> list[np.ndarray]:
    """Per context: followers seen once, twice and more often, and the sum of all counts."""
    some = [np.bincount(at, weights=x, minlength=kinds).astype(np.uint32) for x in (c == 1, c == 2, c > 2)]
    whole = np.zeros(kinds, np.uint64)
    np.add.at(whole, at, c.astype(np.uint64))
    return [*some, whole]


def _fill(uri: str, n: int) -> None:
    """Empty files for shards that no task had to write."""
    from .hashed import _filesystem

    store, path = _filesystem(uri)
    if store is None:
        import os

        have = set(os.listdir(path)) if os.path.isdir(path) else set()
    else:
        from pyarrow import fs

        have = {f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))}
    for i in range(n):
        if f"shard-{i:05d}.bin" not in have:
            write_shard(uri, i, [np.zeros(0, U)])


def _dealt(h: np.ndarray, columns: list[np.ndarray], n: int, kind: int) -> pa.RecordBatch:
    """Sorted hashes with their columns, one blob per shard."""
    ends = cuts(h, n)
    used = np.flatnonzero(np.diff(ends))
    blobs = [b"".join(x[ends[i] : ends[i + 1]].tobytes() for x in (h, *columns)) for i in used]
    return pa.RecordBatch.from_pydict({"shard": pa.array(used, pa.int32()), "kind": pa.array([kind] * len(used), pa.int32()), "data": pa.array(blobs, pa.binary())})


def _summed(blobs, types: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Blobs of ``_dealt`` added up by hash."""
    sizes = [np.dtype(t).itemsize for t in types]
    hs, cols = [np.zeros(0, U)], [[np.zeros(0, np.int64)] for _ in types]
    for b in blobs:
        m = len(b) // (8 + sum(sizes))
        at = 8 * m
        hs.append(np.frombuffer(b, U, m))
        for col, t, s in zip(cols, types, sizes, strict=True):
            col.append(np.frombuffer(b, t, m, at))
            at += s * m
    h = np.concatenate(hs)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.diff(h, prepend=h[:1] - U(1)))
    return h[first], [np.add.reduceat(np.concatenate(c)[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for c in cols]


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score (log10 probability; perplexity is
    10 ** (-score / n_tokens)). The text itself isn't sent back."""
    new = ["n_tokens", "n_known", "base_score", "score"]
    rest = [c for c in docs.columns if c != text and c not in new]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(text).cast("binary").alias("text"))
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*plain.schema.fields[:-1], *[T.StructField(c, k) for c, k in zip(new, kinds, strict=True)]])
    k = len(rest)

    def score(batches: Iterator) -> Iterator:
        hasher = Hasher()
        for batch in batches:
            texts, a, out = batch.column(k), 0, [[], [], [], []]
            while a < batch.num_rows:
                b, held, group = a, 0, []
                while b < batch.num_rows and (b == a or held < 4 << 20):
                    group.append(texts[b].as_py())
                    held += len(group[-1] or b"")
                    b += 1
                tokens, starts = _tokens(group, hasher)
                out[0].append(np.diff(np.append(starts, len(tokens))))
                for o, x in zip(out[1:], model.score(tokens, starts, hasher), strict=True):
                    o.append(x)
                a = b
            if out[0]:
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *[pa.array(np.concatenate(o)) for o in out]], [*[f"c{i}" for i in range(k)], *new])

    out = plain.mapInArrow(score, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *new)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 7) == 2
    model = train(docs.filter(~held))
    return scored(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
