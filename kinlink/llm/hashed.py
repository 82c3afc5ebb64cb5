"""Hashing of words in Python workers, and sorted hash arrays in the shared folder.

A store is a folder of shards. Shard i of n holds the keys k (64 bits) with k * n >> 64 == i,
sorted, and columns beside them. Tasks write shards under temporary names and rename them, so a
task that runs again, or twice, leaves the same files. Workers memory-map the shards; where the
shared folder isn't a mounted path, a shard is first copied to an unlinked local file.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Odd, so multiplication modulo 2**64 can be undone.
MIX = U(0x9E3779B97F4A7C15)


class Hasher(dict):
    """Hash of a word, remembered for up to ``limit`` words (memory, not results, depends on it)."""

    def __init__(self, seed: int = 0, limit: int = 300_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U, count=len(words))


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit numbers a key lies in."""
    return ((keys >> U(32)) * U(n)) >> U(32)


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n ranges in sorted keys: range i is keys[cuts[i]:cuts[i + 1]]."""
    return np.searchsorted(shard_of(keys, n), np.arange(n + 1, dtype=U))


def chunks(batches: Iterator, columns: list[str], size: int = 4 << 20) -> Iterator[dict]:
    """Rows of Arrow batches, regrouped so that one group holds about ``size`` characters of text
    (the last column); one longer text is a group of its own."""
    for batch in batches:
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
        n, at = batch.num_rows, 0
        lens = np.asarray(pc.binary_length(cols[columns[-1]]).fill_null(0), dtype=np.int64)
        while at < n:
            run = np.cumsum(lens[at:])
            to = at + max(1, int(np.searchsorted(run, size, side="right")))
            yield {c: v.slice(at, to - at).to_pylist() for c, v in cols.items()}
            at = to


def _filesystem(uri: str):
    if uri.startswith("/") or uri.startswith("file:"):
        return None, uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file:") else uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, name: str, data: bytes) -> None:
    """Write under a temporary name, then rename."""
    store, path = _filesystem(uri)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    if store is None:
        os.makedirs(path, exist_ok=True)
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, f"{path}/{name}")
    else:
        store.create_dir(path, recursive=True)
        with store.open_output_stream(tmp) as f:
            f.write(data)
        store.move(tmp, f"{path}/{name}")


def read_bytes(uri: str, name: str) -> bytes:
    store, path = _filesystem(uri)
    if store is None:
        with open(f"{path}/{name}", "rb") as f:
            return f.read()
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def mapped(uri: str, name: str) -> np.ndarray:
    store, path = _filesystem(uri)
    if store is None:
        path = f"{path}/{name}"
        return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with tempfile.NamedTemporaryFile() as own, store.open_input_stream(f"{path}/{name}") as f:
        while part := f.read(8 << 20):
            own.write(part)
        own.flush()
        return np.memmap(own.name, dtype=np.uint8, mode="r") if os.path.getsize(own.name) else np.zeros(0, np.uint8)


def write_shard(uri: str, i: int, arrays: list[np.ndarray]) -> None:
    """Columns one after the other; their types are those of the store."""
    write_bytes(uri, f"shard-{i:05d}.bin", b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


class Store:
    """Read side: shards are mapped when first asked for."""

    def __init__(self, uri: str, n: int, dtypes: list[str]):
        self.uri, self.n, self.dtypes, self.open = uri, n, [np.dtype(d) for d in dtypes], {}

    def __reduce__(self):
        return Store, (self.uri, self.n, [d.str for d in self.dtypes])

    def shard(self, i: int) -> list[np.ndarray]:
        if i not in self.open:
            raw = mapped(self.uri, f"shard-{i:05d}.bin")
            rows, at, cols = len(raw) // sum(d.itemsize for d in self.dtypes), 0, []
            for d in self.dtypes:
                cols.append(raw[at : at + rows * d.itemsize].view(d))
                at += rows * d.itemsize
            self.open[i] = cols
        return self.open[i]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted keys: whether each is in the store, and the other columns (0 where it isn't)."""
        hit = np.zeros(len(keys), bool)
        out = [np.zeros(len(keys), d) for d in self.dtypes[1:]]
        at = cuts(keys, self.n)
        for i in np.flatnonzero(np.diff(at)):
            a, b = at[i], at[i + 1]
            have, *cols = self.shard(int(i))
            if len(have):
                p = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                ok = have[p] == keys[a:b]
                hit[a:b] = ok
                for o, c in zip(out, cols, strict=True):
                    o[a:b] = np.where(ok, c[p], 0)
        return hit, out


def manifest(uri: str, what: dict) -> None:
    write_bytes(uri, "manifest.json", json.dumps(what, sort_keys=True).encode())
