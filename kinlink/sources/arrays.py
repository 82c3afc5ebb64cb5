"""Arrays in the shared folder: written by tasks, a file per shard, and mapped by those that read them.

A task writes a shard under a temporary name and renames it, so a task that runs again leaves the same
file. Where the shared folder isn't a mounted path, a shard is copied to an unlinked local file first.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


def _filesystem(uri: str):
    if uri.startswith("/") or uri.startswith("file:"):
        return None, uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file:") else uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(uri: str, name: str, arrays: list[np.ndarray]) -> None:
    """A file of arrays: their sizes in bytes, then each, filled up to eight bytes."""
    blobs = [np.ascontiguousarray(a).tobytes() for a in arrays]
    data = np.array([len(b) for b in blobs], np.int64).tobytes() + b"".join(b + bytes(-len(b) % 8) for b in blobs)
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


def _mapped(uri: str, name: str) -> np.ndarray:
    store, path = _filesystem(uri)
    if store is None:
        return np.memmap(f"{path}/{name}", dtype=np.uint8, mode="r").view(np.ndarray)
    with tempfile.NamedTemporaryFile() as own, store.open_input_stream(f"{path}/{name}") as f:
        while part := f.read(8 << 20):
            own.write(part)
        own.flush()
        return np.memmap(own.name, dtype=np.uint8, mode="r").view(np.ndarray)


class Shards:
    """Read side: files of arrays of the given types, mapped when first asked for."""

    def __init__(self, uri: str, dtypes: list[str]):
        self.uri, self.dtypes, self.open = uri, dtypes, {}

    def __reduce__(self):
        return Shards, (self.uri, self.dtypes)

    def __getitem__(self, name) -> list[np.ndarray]:
        if name not in self.open:
            raw = _mapped(self.uri, str(name))
            at, out = 8 * len(self.dtypes), []
            for size, kind in zip(raw[:at].view(np.int64).tolist(), self.dtypes, strict=True):
                out.append(raw[at : at + size].view(kind))
                at += size + -size % 8
            self.open[name] = out
        return self.open[name]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)
