"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

A document's set holds its distinct shingles of five words (with fewer words the whole sequence).
Documents of equal sets are one class, met by partial aggregation. Signatures of 150 hashes are
banded, 30 bands of 5: two sets of similarity 0.8 share no band once in 148,000 pairs. Pairs that
share a band are compared batch by batch of 25 hashes; after each batch the posterior of the
similarity (uniform prior) prunes the pair if it can reach the threshold only with a probability
below ``miss``. Survivors are verified on their full sets.

No group is ever expanded into its pairs. (1) Every member of a bucket meets the bucket's smallest
member; links found join components. (2) Only buckets that still hold several components go on:
members outside the bucket's largest component meet all others of other components, in blocks of
some ``block`` members and ``WEIGHT`` shingles, so that a hot bucket is dealt over many tasks and long
documents make small blocks. A block verifies its
survivors on the full sets it holds and returns links alone, never pairs.
No partner or candidate is capped. What is left open is the banding's and the pruning's own
probability of a miss.

Defined results: null and empty texts and texts without a word have an empty set and are linked
with nothing; rows of one id are one node; rows without id join the component of their class and are kept only if no row of it
has an id (component_id is then null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashed import Hasher, Store, U, chunks, shard_of, stir, write_shard
from .shared import scratch, stored, table

#: PERCENT is the contract of op2_neardup; a corpus loses documents from DROP on.
SHINGLE, PERCENT, DROP = 5, 85, 80
BANDS, ROWS, BATCH, MISS, BLOCK = 30, 5, 25, 1e-7, 1024
HASHES = BANDS * ROWS
#: Shingles that the sets of a block hold, and shares into which the members of a bucket are dealt.
WEIGHT, SHARES = 4 << 20, 16
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: Ids that one shard of the candidates, and so one task, may hold.
SHARD_ROWS = 8 << 20
#: Nodes of classes whose rows have no id: above all ids.
NO_ID = 1 << 62


def shingles(words: list[bytes], hasher: Hasher, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    a = hasher.of(words)
    w = min(width, n)
    x = np.full(n - w + 1, w, U)
    for i in range(w):
        x = stir(x + a[i : n - w + 1 + i])
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, U)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return (low >> U(32)).astype("<u4")


def _class(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _node(k1: int) -> int:
    return NO_ID + (k1 & ((1 << 61) - 1))


def bounds(percent: int = PERCENT, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """After each batch: the most matches with which a pair is pruned, -1 for none."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(batch, HASHES + 1, batch):
        prune = -1
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= percent / 100].sum() / p.sum() >= miss:
                break
            prune = m
        out.append(prune)
    return out


def surviving(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (i, j) of rows survive all batches, and their matches."""
    at, same = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, limit in enumerate(limits):
        c = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (sigs[i[at], c] == sigs[j[at], c]).sum(1)
        keep = same > limit
        at, same = at[keep], same[keep]
    return at, same


def _signed(batches: Iterator) -> Iterator:
    hasher = Hasher()
    for rows in chunks(batches, ["doc_id", "h", "text"]):
        out = []
        for text in rows["text"]:
            s = shingles(text.lower().split() if text else [], hasher)
            out.append((len(s), *(_class(s) if len(s) else (None, None)), signature(s).tobytes() if len(s) else None))
        n, k1, k2, sig = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["h"], pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())],
            ["doc_id", "h", "n_shingles", "k1", "k2", "sig"],
        )


def _id_store(nodes: DataFrame, uri: str, shards: int) -> Store:
    """Ids as sorted hash arrays, so that a scan can pick its rows without a shuffle of texts."""

    def put(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        write_shard(uri, int(key[0]), [np.unique(stir(part["node"].to_numpy().view(U)))])
        return part.iloc[:1][["shard"]]

    def deal(batches: Iterator) -> Iterator:
        for b in batches:
            x = np.asarray(b.column(0)).view(U)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(stir(x), shards).astype(np.int32)), b.column(0)], ["shard", "node"])

    done = {r["shard"] for r in nodes.mapInArrow(deal, "shard int, node bigint").groupBy("shard").applyInPandas(put, "shard int").collect()}
    for i in set(range(shards)) - done:
        write_shard(uri, i, [np.zeros(0, U)])
    return Store(uri, shards, ["<u8"])


def _sets(docs: DataFrame, store: Store) -> DataFrame:
    def pick(batches: Iterator) -> Iterator:
        hasher = Hasher()
        for batch in batches:
            ids = batch.column(0).fill_null(0)
            keys = stir(np.asarray(ids).view(U))
            order = np.argsort(keys)
            want = np.zeros(len(keys), bool)
            want[order] = store.find(keys[order])[0]
            want |= np.asarray(batch.column(0).is_null())
            picked = pa.Table.from_batches([batch]).filter(pa.array(want)).to_batches()
            for rows in chunks(picked, ["doc_id", "text"]):
                nodes, sets, sigs = [], [], []
                for i, text in zip(rows["doc_id"], rows["text"], strict=True):
                    s = shingles(text.lower().split() if text else [], hasher)
                    if len(s):
                        nodes.append(_node(_class(s)[0]) if i is None else i)
                        sets.append(s.tobytes())
                        sigs.append(signature(s).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["node", "set", "sig"])

    return docs.mapInArrow(pick, "node bigint, set binary, sig binary")


def _likely(pairs: DataFrame, sigs: DataFrame, limits: list[int]) -> DataFrame:
    """Pairs (a, b) that the batches don't prune."""

    def test(batches: Iterator) -> Iterator:
        for b in batches:
            n = b.num_rows
            if n:
                both = np.frombuffer(b"".join(b.column(2).to_pylist() + b.column(3).to_pylist()), "<u4").reshape(2 * n, HASHES)
                at, _ = surviving(both, np.arange(n), np.arange(n, 2 * n), limits)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["a", "b"])

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a bigint, b bigint")


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    at = np.searchsorted(q, p)
    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def test(batches: Iterator) -> Iterator:
        for b in batches:
            keep = [linked(np.frombuffer(x, U), np.frombuffer(y, U), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a bigint, b bigint")


def _foreign_links(members: DataFrame, labels: DataFrame, sets: DataFrame, limits: list[int], percent: int, block: int) -> DataFrame:
    """Links between different components that share a bucket, each pair tested in its first common band.

    A unit compares its pairs by signature, verifies survivors on their sets, likeliest first, and
    skips pairs whose components a link of the same unit has joined by then. It returns links only:
    fewer than it has members, however many pairs it had to verify."""
    lab = members.join(labels, "node", "left").select("bk", "band", "node", "size", F.coalesce("comp", "node").alias("comp"))
    lab = stored(lab, "near-members")
    sides = lab.groupBy("bk", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    top = F.max(F.struct("n", (-F.col("comp")).alias("c"), "w")).alias("top")
    open_ = sides.groupBy("bk").agg(top, F.sum("n").alias("m"), F.sum("w").alias("w"), F.count("*").alias("k")).filter("k > 1")
    count = lambda n, w: F.ceil(F.greatest(n / block, w / WEIGHT)).cast("int")
    open_ = open_.select("bk", (-F.col("top.c")).alias("big"), count(F.col("top.n"), F.col("top.w")).alias("cg"), count(F.col("m") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("cr"))
    # one row a bucket that is still open, for each share of its members: a hot bucket meets it in many tasks
    open_ = stored(open_, "near-open").select("*", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    at = lab.withColumn("share", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SHARES)).cast("int")).join(open_, ["bk", "share"]).withColumn("r", F.col("comp") != F.col("big"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("r"), F.col("cr")).otherwise(F.col("cg"))).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    # a unit is a block of strays with a block of the largest component (j >= 0) or of strays (j < 0)
    units = F.when(
        F.col("r"),
        F.concat(
            F.transform(span(F.col("cg")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
            F.transform(span(F.col("cr")), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), (-1 - F.greatest(F.col("own"), j)).alias("j"))),
        ),
    ).otherwise(F.transform(span(F.col("cr")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    dealt = at.withColumn("own", own).select("bk", "band", "node", "comp", "r", "own", F.explode(units).alias("u")).select("bk", "band", "node", "comp", "r", "own", "u.i", "u.j")
    rows = dealt.join(sets, "node").select("bk", "i", "j", "band", "node", "comp", "r", "own", "sig", "set")
    rows = rows.repartition("bk", "i", "j").sortWithinPartitions("bk", "i", "j", "node")

    def unit(f: pd.DataFrame, out: list) -> None:
        sigs_ = np.frombuffer(b"".join(f["sig"]), "<u4").reshape(len(f), HASHES)
        full = [np.frombuffer(x, U) for x in f["set"]]
        node, comp, r, own_ = (f[c].to_numpy() for c in ("node", "comp", "r", "own"))
        i, j, band = int(f["i"].iloc[0]), int(f["j"].iloc[0]), int(f["band"].iloc[0])
        left = np.flatnonzero(r & (own_ == i))
        right = np.flatnonzero(~r) if j >= 0 else np.flatnonzero(r & (own_ == -1 - j))
        up: dict = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        step = max(1, 100_000 // max(1, len(right)))
        for k in range(0, len(left), step):
            p, q = (x.ravel() for x in np.meshgrid(left[k : k + step], right, indexing="ij"))
            ok = comp[p] != comp[q]
            if j < 0 and i == -1 - j:
                ok &= p < q
            p, q = p[ok], q[ok]
            s, same = surviving(sigs_, p, q, limits)
            p, q = p[s], q[s]
            shared = (sigs_[p] == sigs_[q]).reshape(-1, BANDS, ROWS).all(2)
            first = shared.argmax(1) == band
            p, q, same = p[first], q[first], same[first]
            for x in np.argsort(-same, kind="stable"):
                a, b = root(int(comp[p[x]])), root(int(comp[q[x]]))
                if a != b and linked(full[p[x]], full[q[x]], percent):
                    up[max(a, b)] = min(a, b)
                    out.append((int(node[p[x]]), int(node[q[x]])))

    def compare(batches: Iterator) -> Iterator:
        held = None
        for batch in batches:
            f = batch.to_pandas()
            f = f if held is None or not len(held) else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            key = f[["bk", "i", "j"]].to_numpy()
            starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
            held, out = f.iloc[starts[-1] :], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                unit(f.iloc[a:b], out)
            yield from told(out)
        if held is not None and len(held):
            out = []
            unit(held, out)
            yield from told(out)

    def told(out: list) -> Iterator:
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, h (xxhash64 of the text), n_shingles, component_id, kept; comp tells
    components without any id apart."""
    spark = docs.sparkSession
    limits = bounds(percent)
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))
    signed = stored(docs.mapInArrow(_signed, "doc_id bigint, h bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"), "near-signed")
    node = F.coalesce(F.min("doc_id"), F.first("k1").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(NO_ID))
    classes = stored(signed.filter("n_shingles > 0").groupBy("k1", "k2").agg(node.alias("node"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size")), "near-classes")
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * ROWS * 4 + 1, ROWS * 4)) for b in range(BANDS)])
    banded = classes.select("node", "size", F.posexplode(bands).alias("band", "bk"))
    buckets = banded.groupBy("bk").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("bk", "pivot")
    # a stored table of buckets, so that the planner can split the other side where a bucket is large
    members = stored(banded.join(stored(buckets, "near-pivots"), "bk"), "near-buckets")
    candidates = stored(members.select("node").distinct(), "near-candidates")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // SHARD_ROWS))
    sets = stored(_sets(docs.select("doc_id", "text"), _id_store(candidates, scratch(spark, "near-ids"), shards)), "near-sets")
    sigs = sets.select("node", "sig")

    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_verified(_likely(stars, sigs, limits), sets, percent), "near-links")
    labels = components(links)
    more = stored(_foreign_links(members.select("bk", "band", "node", "size"), labels, sets, limits, percent, block), "near-links")
    comp = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}c"))
    crossing = more.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    joined = components(crossing)
    # a node without a link so far is its own component
    old = labels.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    single = joined.join(labels.select("node"), "node", "left_anti")
    labels = stored(old.unionByName(single), "near-labels")

    named = classes.select("k1", "k2", "node", "n").join(labels, "node", "left")
    named = stored(named.filter("n > 1 OR comp IS NOT NULL").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("comp", "node").alias("comp")), "near-named")
    own = F.when(F.col("comp").isNull(), F.col("doc_id")).when(F.col("comp") < NO_ID, F.col("comp"))
    out = signed.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return out.select("doc_id", "h", "n_shingles", own.alias("component_id"), "comp").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = DROP, **options) -> DataFrame:
    """``docs`` less all but one row of each component, columns unchanged. The document of the smallest id
    stays; in a component without ids the text of the smallest hash; of rows with the same id and text the
    one that comes first by a hash of all its columns. Rows without a word stay."""
    found = near_duplicates(docs, key, text, percent, **options).filter("n_shingles > 0")
    seen = stored(found.groupBy("doc_id", "h", "component_id", "kept", "comp").agg(F.count("*").alias("n")), "near-verdicts")
    nameless = seen.filter("doc_id IS NULL AND component_id IS NULL")
    first = nameless.groupBy("comp").agg(F.min("h").alias("first"))
    gone = seen.filter(~F.col("kept")).select("doc_id", "h").unionByName(nameless.join(first, "comp").filter("h <> first").select("doc_id", "h"))
    gone = stored(gone.select(F.col("doc_id").alias("__near_id"), F.col("h").alias("__near_h")).distinct(), "near-gone")
    name, hashed = F.col(f"`{key}`").cast("bigint"), F.xxhash64(F.col(f"`{text}`"))
    same = name.eqNullSafe(F.col("__near_id")) & (hashed == F.col("__near_h"))
    left = docs.join(gone, same, "left_anti")
    again = stored(seen.filter("kept AND n > 1").select(F.col("doc_id").alias("__near_id"), F.col("h").alias("__near_h")), "near-again")
    if again.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.join(again, same, "left_semi").groupBy(name.alias("__near_id"), hashed.alias("__near_h")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__near_row"))
    return left.join(again, same, "left_anti").unionByName(once.select("__near_row.*"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=PERCENT).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words),
shingles AS (SELECT doc_id, unnest(g) AS h FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON y.h = x.h AND y.doc_id <> x.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.g) + len(q.g) - n)),
reached AS (SELECT doc_id AS node, doc_id AS other FROM sets UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT node, min(other) AS c FROM reached GROUP BY node) ON node = doc_id
"""
