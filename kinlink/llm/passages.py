"""Repeated passages: removal of words that stand in a repeated window of words.

A window is ``width`` consecutive words of one document. Pass 1 hashes every window into a count-min
sketch of two rows: tasks send sparse counts per block of the sketch, blocks are merged apart and
keep one bit per cell, whether its count reached two. As counts are never too low, a window that
occurs twice has both bits. Pass 2 groups exactly (96 bits of hash) only the windows with both bits
and stores the repeated ones as sorted arrays. Pass 3 marks the words they cover.

The sketch has two cells or more for each window expected from the bytes of the input, so the
part of other windows that pass 2 sees stays the same at every size. Sketch and arrays lie in the
shared folder and are memory-mapped; no task holds more than a block or a shard, and a window that
occurs in a third of all documents is one row of each task's counts.

Defined results: null and empty texts have no words and come back with 0 words, an empty text (null
stays null) and nothing removed; texts shorter than a window lose nothing; repeated rows count as
documents of their own, so their passages repeat; an empty table gives an empty result; extra columns
pass through whatever their names. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed import Hasher, Store, U, chunks, cuts, manifest, mapped, stir, write_bytes, write_shard
from .shared import scratch, table

#: Text whose windows one shard, and so one task at a time, may hold.
SHARD_BYTES = 256 << 20

WIDTH = 35
#: Cells of a block of the sketch, as a power of two.
BLOCK = 23
C1, C2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


class Windows:
    """Hashes of all windows of a group of documents."""

    def __init__(self, width: int):
        self.width, self.hasher, self.powers = width, Hasher(), {}

    def _power(self, base: np.uint64, n: int) -> np.ndarray:
        have = self.powers.get(base)
        if have is None or len(have) < n:
            step = np.full(max(n, 1 << 20), base, U)
            step[0] = 1
            have = self.powers[base] = np.multiply.accumulate(step)
        return have[:n]

    def _rolled(self, a: np.ndarray, base: np.uint64) -> np.ndarray:
        inverse = U(pow(int(base), -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(a * self._power(base, len(a)), dtype=U)])
        w = self.width
        return stir((sums[w:] - sums[:-w]) * self._power(inverse, len(a) - w + 1))

    def of(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each window in the words of all documents one after the other, and two hashes."""
        lens = np.array([len(x) for x in docs], np.int64)
        n, w = int(lens.sum()), self.width
        if n < w:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.uint32)
        a = np.concatenate([self.hasher.of(x) for x in docs])
        ends = np.repeat(np.cumsum(lens), lens)[: n - w + 1]
        at = np.flatnonzero(np.arange(w, n + 1) <= ends)
        return at, self._rolled(a, C1)[at], (self._rolled(stir(a), C2)[at] >> U(32)).astype(np.uint32)


def _split(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h if row == 0 else stir(h ^ C2)) >> U(64 - bits)


def _pack(x: np.ndarray) -> bytes:
    """Ascending numbers under 2**32, by their differences, byte planes apart."""
    d = np.diff(x, prepend=x[:1] * 0).astype("<u4")
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(d.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[8:], max_output_size=4 * n + 1), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel(), dtype=np.int64)


class Sketch:
    """Read side of the merged sketch."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.uri, self.bits, self.block, self.open = uri, bits, min(block, bits), {}

    def __reduce__(self):
        return Sketch, (self.uri, self.bits, self.block)

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """For sorted hashes: whether both counts reach two."""
        hit = self._row(_cells(h, 0, self.bits), 0)
        at = np.flatnonzero(hit)
        second = _cells(h[at], 1, self.bits)
        order = np.argsort(second)
        hit[at[order]] = self._row(second[order], 1)
        return hit

    def _row(self, cells: np.ndarray, row: int) -> np.ndarray:
        block = self.block
        ends = np.searchsorted(cells >> U(block), np.arange((1 << (self.bits - block)) + 1, dtype=U))
        out = np.zeros(len(cells), bool)
        for i in np.flatnonzero(np.diff(ends)):
            a, b = ends[i], ends[i + 1]
            if (row, i) not in self.open:
                self.open[row, i] = mapped(self.uri, f"row{row}-{i:06d}.bin")
            c = (cells[a:b] & U((1 << block) - 1)).astype(np.int64)
            out[a:b] = (self.open[row, i][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1
        return out


def _sketch(docs: DataFrame, text: str, width: int, bits: int, uri: str, block: int) -> None:

    def count(batches: Iterator) -> Iterator:
        windows = Windows(width)
        for rows in chunks(batches, ["text"], 12 << 20):
            _, h, _ = windows.of([_split(x) for x in rows["text"]])
            names, blobs, twice = [], [], []
            for row in (0, 1):
                cells = np.sort(_cells(h, row, bits))
                first = np.flatnonzero(np.diff(cells, prepend=cells[:1] - U(1)))
                many = np.diff(np.append(first, len(cells))) > 1
                cells = cells[first]
                ends = np.searchsorted(cells >> U(block), np.arange((1 << (bits - block)) + 1, dtype=U))
                for i in np.flatnonzero(np.diff(ends)):
                    part = slice(ends[i], ends[i + 1])
                    names.append(row << 32 | int(i))
                    blobs.append(_pack(cells[part] & U((1 << block) - 1)))
                    twice.append(_pack(np.flatnonzero(many[part])))
            yield pa.RecordBatch.from_pydict({"block": pa.array(names, pa.int64()), "cells": pa.array(blobs, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << block, np.uint8)
        for cells, twice in zip(parts["cells"], parts["twice"], strict=True):
            c, add = _unpack(cells), None
            add = np.ones(len(c), np.uint8)
            add[_unpack(twice)] = 2
            counts[c] = np.minimum(counts[c] + add, 2)
        name = int(key[0])
        write_bytes(uri, f"row{name >> 32}-{name & 0xFFFFFFFF:06d}.bin", np.packbits(counts >= 2).tobytes())
        return pd.DataFrame({"block": [name], "n": [int((counts >= 2).sum())]})

    sent = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "block bigint, cells binary, twice binary")
    sent.groupBy("block").applyInPandas(merge, "block bigint, n bigint").agg(F.sum("n")).collect()
    # a block that got no cell has no file; readers ask only for blocks of windows that were counted


def _exact(docs: DataFrame, text: str, width: int, sketch: Sketch, uri: str, shards: int) -> Store:
    def candidates(batches: Iterator) -> Iterator:
        windows = Windows(width)
        for rows in chunks(batches, ["text"], 12 << 20):
            _, h, g = windows.of([_split(x) for x in rows["text"]])
            order = np.argsort(h)
            h, g = h[order], g[order]
            keep = sketch.repeated(h)
            h, g = _sorted(h[keep], g[keep])
            first = np.flatnonzero(_first(h, g))
            many = np.diff(np.append(first, len(h))) > 1
            h, g, ends = h[first], g[first], cuts(h[first], shards)
            used = np.flatnonzero(np.diff(ends))
            blobs = [h[ends[i] : ends[i + 1]].tobytes() + g[ends[i] : ends[i + 1]].tobytes() + many[ends[i] : ends[i + 1]].tobytes() for i in used]
            yield pa.RecordBatch.from_pydict({"shard": pa.array(used, pa.int32()), "keys": pa.array(blobs, pa.binary())})

    def group(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        hs, gs, ms = [], [], []
        for b in parts["keys"]:
            n = len(b) // 13
            hs.append(np.frombuffer(b, U, n))
            gs.append(np.frombuffer(b, np.uint32, n, 8 * n))
            ms.append(np.frombuffer(b, bool, n, 12 * n))
        h, g, m = np.concatenate(hs), np.concatenate(gs), np.concatenate(ms)
        order = np.lexsort((g, h))
        h, g, m = h[order], g[order], m[order]
        first = np.flatnonzero(_first(h, g))
        total = np.add.reduceat(1 + m.astype(np.int64), first) if len(first) else first
        first = first[total > 1]
        write_shard(uri, int(key[0]), [h[first], g[first]])
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(first)]})

    sent = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(candidates, "shard int, keys binary")
    done = {r["shard"] for r in sent.groupBy("shard").applyInPandas(group, "shard int, n bigint").collect()}
    for i in set(range(shards)) - done:
        write_shard(uri, i, [np.zeros(0, U), np.zeros(0, np.uint32)])
    manifest(uri, {"shards": shards, "width": width})
    return Store(uri, shards, ["<u8", "<u4"])


def _first(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return new


def _sorted(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys sorted by the first hash get sorted by the second where the first is equal."""
    if len(h) and ((h[1:] == h[:-1]) & (g[1:] < g[:-1])).any():
        order = np.lexsort((g, h))
        return h[order], g[order]
    return h, g


def _known(store: Store, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For keys sorted by h: whether (h, g) is stored."""
    out = np.zeros(len(h), bool)
    ends = cuts(h, store.n)
    for i in np.flatnonzero(np.diff(ends)):
        a, b = ends[i], ends[i + 1]
        have, second = store.shard(int(i))
        p = np.searchsorted(have, h[a:b])
        todo = np.flatnonzero(p < len(have))
        while len(todo):  # further rounds only where two windows share the first hash
            same = have[p[todo]] == h[a:b][todo]
            todo = todo[same]
            ok = second[p[todo]] == g[a:b][todo]
            out[a + todo[ok]] = True
            todo = todo[~ok]
            p[todo] += 1
            todo = todo[p[todo] < len(have)]
    return out


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``text`` reduced to the words no repeated window covers, joined by one space,
    and with ``n_words`` and ``n_removed`` (columns of these names are replaced). Windows are judged on the
    input. ``block``: cells of a block of the sketch, as a power of two."""
    spark = docs.sparkSession
    uri = scratch(spark, "passages")
    size = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    bits = max(16, int(size // 6 * 2).bit_length())
    sketch = Sketch(f"{uri}/sketch", bits, block)
    _sketch(docs, text, width, bits, sketch.uri, sketch.block)
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    store = _exact(docs, text, width, sketch, f"{uri}/repeated", shards)
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    plain = docs.select(*[(F.col(f"`{c}`").cast("binary") if c == text else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(keep)])
    schema = T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    at = keep.index(text)

    def strip(batches: Iterator) -> Iterator:
        windows, names = Windows(width), [*plain_names, "n_words", "n_removed"]
        for batch in batches:
            texts, out = batch.column(at).to_pylist(), []
            a = 0
            while a < len(texts):
                b, held = a, 0
                while b < len(texts) and (b == a or held + len(texts[b] or b"") <= 4 << 20):
                    held += len(texts[b] or b"")
                    b += 1
                out += removed(windows, texts[a:b])
                a = b
            cols = list(batch.columns)
            cols[at] = pa.array([x[0] for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names)

    def removed(windows: Windows, texts: list) -> list:
        docs_words = [_split(x) for x in texts]
        n = sum(map(len, docs_words))
        start, h, g = windows.of(docs_words)
        order = np.argsort(h)
        h, g, start = h[order], g[order], start[order]
        some = sketch.repeated(h)
        h, g, start = h[some], g[some], start[some]
        start = start[_known(store, h, g)]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out, i = [], 0
        for text_, ws in zip(texts, docs_words, strict=True):
            c = covered[i : i + len(ws)]
            i += len(ws)
            lost = int(c.sum())
            kept = ws if not lost else [ws[k] for k in np.flatnonzero(~c)]
            out.append((None if text_ is None else b" ".join(kept), len(ws), lost))
        return out

    plain_names = [f"c{i}" for i in range(len(keep))]
    out = plain.mapInArrow(strip, schema)
    return out.select(*[(F.col(f"c{i}").cast("string") if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(keep)], "n_words", "n_removed")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM d, unnest(range(1, greatest(len(ws) - 33, 1))) AS t(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM r, range(35) AS s(k) WHERE n > 1),
k AS (SELECT d.doc_id, string_agg(ws[p.i], ' ' ORDER BY p.i) AS kept, count(*) AS n FROM d, unnest(range(1, len(ws) + 1)) AS p(i)
  LEFT JOIN c ON c.doc_id = d.doc_id AND c.j = p.i WHERE c.j IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
