"""Candidates from a stored index: postings and records of targets lie as arrays in the shared folder, and
queries are answered where they are. No posting, no hit and no pair goes through a shuffle: what is
dealt out are the targets' own keys, once, and the records of the queries.

Targets are numbered in the order of their ids, so equal scores by number are equal scores by id. Blocks are
found by 64 bits of hash of country, type and key. Weights come from Spark as whole millionths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.arrays import Shards, ranges, write
from ..sources.workspace import kept, workspace
from . import blocking as B

#: Records of a shard, and queries answered at once (memory, not results, depends on both).
LOW, TOGETHER = 15, 128
SIZE = 1 << LOW
OUT = "qid string, tid string, score bigint, rank bigint"


def _described() -> list[Column]:
    """What reranking compares, as numbers: sizes, the compact core's hash (0 without), grams and distinct tokens."""
    hashes = lambda c: F.transform(F.array_distinct(c), lambda w: F.xxhash64(w))
    core = F.when(F.col("core_c") != "", F.xxhash64("core_c")).otherwise(F.lit(0))
    return [F.size("core").cast("bigint").alias("n_core"), F.size("addr").cast("bigint").alias("n_addr"), core.cast("bigint").alias("core_h"),
            F.col("core_c_3").alias("grams"), hashes("core").alias("core_set"), hashes("addr").alias("addr_set")]


@dataclass(frozen=True)
class Shape:
    """What is stored of a prepared record: whole numbers, lists of them, strings, and one more if ``text`` names it."""

    single: tuple
    lists: tuple
    described: Callable
    text: str | None = None
    strings: tuple = ()

    def dtypes(self) -> list[str]:
        return ["i8", "i8", "u1", *["i8"] * (1 + len(self.single) + 2 * len(self.lists)), *["i8", "u1"] * (len(self.strings) + bool(self.text))]


RERANKED = Shape(("n_core", "n_addr", "core_h"), ("grams", "core_set", "addr_set"), _described)


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more at the end) and values of a column of lists, or of strings (their bytes)."""
    c = table.column(name).combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    if pa.types.is_string(c.type):
        _, ends, data = c.buffers()
        at = np.frombuffer(ends, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, np.int64)
        return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = np.asarray(c.offsets).astype(np.int64)
    return at - at[0], np.asarray(c.values)[at[0] : at[-1]]


@dataclass
class Index:
    """Postings by block and records by number, in the shared folder."""

    blocks: Shards
    shards: int
    filled: frozenset
    records: Shards
    shape: Shape


def _bytes(values: list) -> list[np.ndarray]:
    """Ends (0 first) and bytes of strings; none for null."""
    values = [x.encode() if x is not None else b"" for x in values]
    return [np.cumsum([0] + [len(x) for x in values]), np.frombuffer(b"".join(values), np.uint8)]


def build(targets: DataFrame, keys: Column, cap: int, kinds: dict[int, float], shape: Shape = RERANKED) -> Index:
    """The index of prepared ``targets``: blocks of at most ``cap`` rows, and the records."""
    spark = targets.sparkSession
    ids = kept(targets.select(F.col("entity_id").alias("id")).distinct().sort("id").withColumn("no", F.monotonically_increasing_id()), "numbers")
    raw = targets.select("entity_id", "business_name", "business_address", "country")
    # raw records are small and what is made of them isn't: they are dealt to a stated number of tasks
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = B.prepare(kept(raw.join(ids, raw["entity_id"].eqNullSafe(ids["id"])).drop("id").repartition(shards, "no"), "numbered"))

    postings = rows.filter("country IS NOT NULL").select("country", "no", F.explode(keys).alias("k")).select(F.xxhash64("country", "k.type", "k.key").alias("h"), F.col("k.type").alias("type"), "no")
    sizes = postings.groupBy("h", "type").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).select("h", "n", B.weight(kinds).alias("w"))
    dealt = postings.select("h", "no").join(sizes, "h").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    blocks, records = workspace(spark, "blocks"), workspace(spark, "records")

    def write_blocks(batches: Iterator) -> Iterator:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        t = pa.Table.from_batches(batches)
        shard, h, n, w, no = (_numpy(t, c) for c in ("shard", "h", "n", "w", "no"))
        for a, z in _runs(shard):
            at = np.flatnonzero(np.concatenate(([True], h[a + 1 : z] != h[a : z - 1])))
            write(blocks, str(shard[a]), [h[a:z][at], at, n[a:z][at], w[a:z][at], no[a:z]])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[a])], pa.int32())})

    filled = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "no").select("shard", "h", "n", "w", "no").mapInArrow(write_blocks, "shard int").collect()

    def write_records(batches: Iterator) -> Iterator:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        t = pa.Table.from_batches(batches)
        no = _numpy(t, "no")
        for a, z in _runs(no >> LOW):
            one = t.slice(a, z - a).combine_chunks()
            at = no[a:z] & (SIZE - 1)
            first = np.searchsorted(at, np.arange(SIZE + 1))
            names = one.column("entity_id").to_pylist()
            known = np.array([x is not None for x in names], np.int64)
            lists = [x for c in (*shape.lists, *shape.strings) for x in _lists(one, c)]
            text = _bytes(one.column("text").to_pylist()) if shape.text else []
            write(records, str(int(no[a]) >> LOW), [first, *_bytes(names), known, *[_numpy(one, c) for c in shape.single], *lists, *text])
            yield pa.RecordBatch.from_pydict({"n": pa.array([z - a], pa.int64())})

    by = F.shiftright("no", LOW)
    text = [F.col(shape.text).alias("text")] if shape.text else []
    rows.select("entity_id", "no", *shape.described(), *text).repartition(by).sortWithinPartitions("no").mapInArrow(write_records, "n bigint").agg(F.sum("n")).collect()
    return Index(Shards(blocks, ["i8"] * 5), shards, frozenset(r["shard"] for r in filled), Shards(records, shape.dtypes()), shape)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, int)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def smallest_first(per_type: int, budget: int) -> Callable:
    """Blocks (n, type, key, place, country), smallest first, as ``blocking.select_sorted`` takes them."""

    def choose(found: list) -> list:
        used, seen, out = 0, {}, []
        for x in sorted(found):
            seen[x[1]] = seen.get(x[1], 0) + 1
            if seen[x[1]] <= per_type:
                used += x[0]
                if used > budget:
                    break
                out.append(x)
        return out

    return choose


def by_family(per_family: int, budget: int) -> Callable:
    """Blocks as ``blocking.select_base`` takes them: per family the smallest, families in order, a block that
    would pass the budget of its country is skipped."""
    order = {t: i for i, t in enumerate((3, 4, 5, 1, 2))}

    def choose(found: list) -> list:
        seen, ranked = {}, []
        for x in sorted(found):
            seen[x[1]] = seen.get(x[1], 0) + 1
            if seen[x[1]] <= per_family:
                ranked.append((order[x[1]], seen[x[1]], x))
        used, out = {}, []
        for _, _, x in sorted(ranked):
            if used.get(x[4], 0) + x[0] <= budget:
                used[x[4]] = used.get(x[4], 0) + x[0]
                out.append(x)
        return out

    return choose


class Members:
    """Which of the numbers that queries hold stand in rows of others."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, at: np.ndarray, values: np.ndarray):
        self.known, place = np.unique(values, return_inverse=True)
        n = len(self.known)
        self.has = np.zeros((len(at) - 1, n + 1), bool)
        self.has[np.repeat(np.arange(len(at) - 1), np.diff(at)), place] = True
        slot = self._slot(self.known)
        self.table = np.full(1 << 16, n, np.int32)
        self.table[slot] = np.arange(n)
        lost = self.table[slot] != np.arange(n)
        self.shared = np.zeros(1 << 16, bool)
        self.shared[slot[lost]] = True
        self.told = np.append(self.known, 0)

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return ((values.view(np.uint64) * self.MIX) >> np.uint64(48)).astype(np.int64)

    def count(self, values: np.ndarray, size: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Per row (``size`` values each, of ``query``) how many of its values the query has."""
        n = len(self.known)
        if not n or not len(values):
            return np.zeros(len(size), np.int64)
        slot = self._slot(values)
        place = self.table[slot]
        again = np.flatnonzero(self.shared[slot])
        place[again] = np.minimum(np.searchsorted(self.known, values[again]), n - 1)
        row = np.repeat(np.arange(len(size)), size)
        hit = self.has[query[row], place] & (self.told[place] == values)
        return np.bincount(row[hit], minlength=len(size))


@dataclass
class Worker:
    index: Index
    choose: Callable
    once: bool
    first: int
    k: int
    weights: tuple[float, float, float, float]

    def run(self, batches: Iterator) -> Iterator:
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            names = t.column("entity_id").to_pylist()
            starts = [i for i, x in enumerate(names) if not i or x != names[i - 1]]
            left = t.slice(starts[-1]) if starts else t
            yield from self._groups(t, starts)
        if left is not None and left.num_rows:
            yield from self._groups(left, [0, left.num_rows])

    def _groups(self, t: pa.Table, starts: list[int]) -> Iterator:
        """Answers to the rows of ``t`` up to the last start; rows of one id are one group."""
        for i in range(0, len(starts) - 1, TOGETHER):
            own = starts[i : i + TOGETHER + 1]
            out = self.answer(t.slice(own[0], own[-1] - own[0]).combine_chunks(), np.array(own) - own[0])
            if out is not None:
                yield out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of blocks (0 if they aren't there) and their places in their shards."""
        size, place = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = h % self.index.shards
        order = np.argsort(shard, kind="stable")
        for a, z in _runs(shard[order]):
            i = order[a:z]
            if int(shard[i[0]]) in self.index.filled:
                have, _, n, _, _ = self.index.blocks[int(shard[i[0]])]
                p = np.minimum(np.searchsorted(have, h[i]), len(have) - 1)
                size[i], place[i] = np.where(have[p] == h[i], n[p], 0), p
        return size, place

    def hits(self, chosen: list, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best targets of the chosen blocks: numbers and summed weights."""
        parts, weights = [], []
        for n, _, _, i, _ in chosen:
            _, start, _, w, no = self.index.blocks[int(h[i]) % self.index.shards]
            a = int(start[place[i]])
            parts.append(no[a : a + n])
            weights.append(w[place[i]])
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = len(parts).bit_length()
        packed = np.concatenate(parts) << bits | np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        packed.sort()
        no, w = packed >> bits, np.array(weights, np.int64)[packed & ((1 << bits) - 1)]
        edge = np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1])))
        no, score = no[edge], np.add.reduceat(w, edge)
        if len(no) > self.first:
            rank = (score.max() - score) << 24 | np.arange(len(no)) if len(no) < 1 << 24 else None
            best = np.sort(np.partition(rank, self.first - 1)[: self.first]) & ((1 << 24) - 1) if rank is not None else np.lexsort((no, -score))[: self.first]
            no, score = no[best], score[best]
        return no, score

    def found(self, t: pa.Table, groups: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per group the hits of its blocks: numbers and summed weights."""
        at, h = _lists(t, "h")
        keys, kinds = t.column("key").combine_chunks(), _lists(t, "type")[1].tolist()
        keys = [x for row in keys.to_pylist() for x in row]
        size, place = self.find(h)
        sizes, found = size.tolist(), [[] for _ in range(len(groups) - 1)]
        country = t.column("country").to_pylist()
        row = np.repeat(np.arange(t.num_rows), np.diff(at))
        group = np.repeat(np.arange(len(groups) - 1), np.diff(groups))[row]
        for i, r, g in zip(np.flatnonzero(size).tolist(), row[size > 0].tolist(), group[size > 0].tolist(), strict=True):
            found[g].append((sizes[i], kinds[i], keys[i], i, country[r]))
        if self.once:
            found = [list({int(h[x[3]]): x for x in reversed(own)}.values()) if groups[g + 1] - groups[g] > 1 else own for g, own in enumerate(found)]
        return [self.hits(self.choose(own), h, place) for own in found]

    def answer(self, t: pa.Table, groups: np.ndarray):
        found = self.best(t, groups)
        if found is None:
            return None
        rows, _, no, score, rank = found
        names = t.column("entity_id").combine_chunks()
        return pa.RecordBatch.from_arrays([names.take(pa.array(rows)), self.names(no), pa.array(score), pa.array(rank)], ["qid", "tid", "score", "rank"])

    def best(self, t: pa.Table, groups: np.ndarray):
        """The best hits of each group: rows of ``t``, groups, numbers, scores and ranks; None without hits."""
        rows, owner, no, score = [], [], [], []
        for g, (a, s) in enumerate(self.found(t, groups)):
            for r in range(groups[g], groups[g + 1]):
                rows.append(np.full(len(a), r))
                owner.append(np.full(len(a), g))
                no.append(a)
                score.append(s)
        rows, owner, no, score = (np.concatenate(x) for x in (rows, owner, no, score))
        if not len(no):
            return None
        rows, owner, no, score = self.reranked(t, rows, owner, no, score)
        order = np.lexsort((no, -score, owner))
        rows, owner, no, score = (x[order] for x in (rows, owner, no, score))
        begin = np.searchsorted(owner, np.arange(len(groups) - 1))
        rank = np.arange(len(owner)) - begin[owner]
        best = rank < self.k
        return rows[best], owner[best], no[best], score[best], rank[best]

    def records(self, no: np.ndarray, only: tuple | None = None) -> tuple[np.ndarray, np.ndarray, dict, dict]:
        """Records of the targets, once each: places in ``no``, places in their shards, numbers, lists and strings (sizes,
        values); of lists and strings those in ``only``."""
        shape = self.index.shape
        ones, kept = len(shape.single), (*shape.lists, *shape.strings)
        order = np.argsort(no, kind="stable")
        pair, place, single, lists = [], [], {c: [] for c in shape.single}, {c: ([], []) for c in kept if only is None or c in only}
        for a, z in _runs(no[order] >> LOW):
            p = order[a:z]
            first, _, _, known, *rest = self.index.records[int(no[p[0]] >> LOW)]
            i = no[p] & (SIZE - 1)
            begin, n = first[i], first[i + 1] - first[i]
            r = ranges(begin, n)
            p = np.repeat(p, n)[known[r] > 0]
            r = r[known[r] > 0]
            pair.append(p)
            place.append(r)
            for c, x in zip(shape.single, rest[:ones], strict=True):
                single[c].append(x[r])
            for c, ends, values in zip(kept, rest[ones::2], rest[ones + 1 :: 2], strict=False):
                if c not in lists:
                    continue
                n = ends[r + 1] - ends[r]
                lists[c][0].append(n)
                lists[c][1].append(values[ranges(ends[r], n)])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(pair), join(place), {c: join(x) for c, x in single.items()}, {c: (join(n), join(v)) for c, (n, v) in lists.items()}

    def compared(self, t: pa.Table, q: np.ndarray, lists: dict) -> tuple[dict, dict, dict]:
        """Of rows ``q`` and the lists of as many targets: shared numbers, sizes of ours, sizes of theirs."""
        shared, ours, theirs = {}, {}, {}
        for c, (n, values) in lists.items():
            at, own = _lists(t, c)
            shared[c], ours[c], theirs[c] = Members(at, own).count(values, n, q), np.diff(at)[q], n
        return shared, ours, theirs

    def reranked(self, t: pa.Table, rows: np.ndarray, owner: np.ndarray, no: np.ndarray, score: np.ndarray) -> tuple:
        """The hits, once per record of the target, with weighted similarities added to their scores."""
        pair, _, theirs, lists = self.records(no, RERANKED.lists)
        q = rows[pair]
        ours = {c: _numpy(t, c)[q] for c in RERANKED.single}
        shared, a_size, b_size = self.compared(t, q, lists)
        total = {c: a_size[c] + b_size[c] for c in shared}
        least = lambda c: np.minimum(ours[c], theirs[c])
        part = lambda c, n: np.where(n > 0, shared[c] / np.maximum(n, 1), 0.0)
        nd = 2.0 * shared["grams"] / np.maximum(total["grams"], 1)
        nd = np.where((ours["core_h"] == 0) | (theirs["core_h"] == 0), 0.0, np.where(ours["core_h"] == theirs["core_h"], 1.0, nd))
        words, addr = part("core_set", least("n_core")), part("addr_set", least("n_addr"))
        a, b, d, e = self.weights
        extra = (a * nd + b * words + d * addr + e * nd * addr) * B.MICRO
        whole = np.floor(extra)
        return rows[pair], owner[pair], no[pair], score[pair] + (whole + (extra - whole >= 0.5)).astype(np.int64)

    def names(self, no: np.ndarray) -> pa.Array:
        """The ids of numbers."""
        order = np.argsort(no, kind="stable")
        data, size, begin, used = [], np.zeros(len(no), np.int64), np.zeros(len(no), np.int64), 0
        for a, z in _runs(no[order] >> LOW):
            p = order[a:z]
            first, ends, text, *_ = self.index.records[int(no[p[0]] >> LOW)]
            r = first[no[p] & (SIZE - 1)]
            n = ends[r + 1] - ends[r]
            data.append(text[ranges(ends[r], n)])
            size[p], begin[p] = n, used + np.cumsum(n) - n
            used += int(n.sum())
        text = np.concatenate(data)[ranges(begin, size)] if data else np.zeros(0, np.uint8)
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.StringArray.from_buffers(len(no), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes()))


def asked(queries: DataFrame, keys: Column, shape: Shape, *more: str) -> DataFrame:
    """Rows that workers answer, records of one id next to each other: keys by type and hash, what is compared, and
    the columns ``more`` of the queries."""
    own = queries.select("entity_id", "business_name", "business_address", "country", *more).filter("entity_id IS NOT NULL")
    tasks = 2 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = B.prepare(own.repartition(tasks, "entity_id").sortWithinPartitions("entity_id"))
    k = F.when(F.col("country").isNull(), F.array().cast("array<struct<type:int,key:string>>")).otherwise(keys)
    text = [F.col(shape.text).alias("text")] if shape.text else []
    rows = rows.select("entity_id", "country", k.alias("k"), *shape.described(), *text, *more)
    hashes = F.transform("k", lambda x: F.xxhash64("country", x["type"], x["key"]))
    return rows.select("entity_id", "country", F.col("k.type").alias("type"), F.col("k.key").alias("key"), hashes.alias("h"), *rows.columns[3:])


def search(queries: DataFrame, keys: Column, index: Index, choose: Callable, first: int, k: int, weights: tuple[float, float, float, float], once: bool = False) -> DataFrame:
    """(qid, tid, score, rank): hits of the chosen blocks, the ``first`` by summed weights, reranked, the best
    ``k``. Records of one id are answered together; ``once``: each of their keys counts once."""
    worker = Worker(index, choose, once, first, k, weights)
    return asked(queries, keys, index.shape).mapInArrow(worker.run, OUT)
