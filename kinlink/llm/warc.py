"""WARC archives: a deterministic sharded writer and a reader.

Pages are range-sorted by id and payload hash into shards, so that an id that many rows share (or the
null id) is dealt over several; a task streams its shards into files that roll at a
compressed size, each record a gzip member of its own. Files are written under temporary names,
renamed when complete and listed in a manifest, which is committed last; the reader opens only
what the manifest lists. Bytes depend on the pages alone: record ids are derived, dates and gzip
headers are fixed. A task that runs again writes the same files.

Of records with equal payloads of at least ``least`` bytes that with the largest page id is the
response, the others are revisits of it. Equality is that of SHA-256; digests in headers are SHA-1.

Defined results: a null html is an empty payload, a null url an empty target; a null page id sorts
first and is a record without page header; pages that repeat id and payload are records of their
own, all responses where they hold the largest id; an empty table gives an empty manifest; extra
columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed import _filesystem
from .shared import scratch, stored, table

DATE = "2026-01-01T00:00:00Z"
LEAST, SHARD_BYTES, ROLL_BYTES, MOST_SHARDS = 1000, 16 << 20, 64 << 20, 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NULL = -(1 << 63)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + z.compress(data) + z.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload_digest: str, payload_bytes: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record. A revisit's block is the HTTP header alone, with the full payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._"),
        "WARC-Payload-Digest": payload_digest, "WARC-Block-Digest": _sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    return _gzip(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def _bounds(pages: DataFrame, total: int, rows: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard bounds, ids with the start of a payload's hash: quantiles of the rows that a hash selects,
    at most some 16 for each shard."""
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))
    if shards == 1 or not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ids = pages.select(F.coalesce("page_id", F.lit(_NULL)).alias("i"), "html").filter(F.pmod(F.xxhash64(F.lit("warc"), "i", "html"), F.lit(1 << 30)) < min(1.0, 16 * shards / rows) * float(1 << 30))
    found = sorted({(r["i"], _start(r["k"])) for r in ids.select("i", F.sha2("html", 256).alias("k")).distinct().collect()})
    cut = sorted({found[k * len(found) // shards] for k in range(1, shards)}) if found else []
    return np.array([i for i, _ in cut], np.int64), np.array([h for _, h in cut], np.uint64)


def _start(k: str) -> int:
    return int(k[:16], 16)


def _place(ids: pa.Array, keys: list[str], bounds: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """The shard of each row: how many bounds aren't above its id and payload hash."""
    x = np.asarray(ids.fill_null(_NULL))
    low, high = (np.searchsorted(bounds[0], x, side=side) for side in ("left", "right"))
    for at in np.flatnonzero(low < high):
        low[at] += np.searchsorted(bounds[1][low[at] : high[at]], np.uint64(_start(keys[at])), side="right")
    return pa.array(low.astype(np.int32))


def _stream(uri: str, name: str):
    store, path = _filesystem(uri)
    if store is None:
        import os

        os.makedirs(path, exist_ok=True)
        return open(f"{path}/{name}", "wb")
    store.create_dir(path, recursive=True)
    return store.open_output_stream(f"{path}/{name}")


def _rename(uri: str, old: str, new: str) -> None:
    store, path = _filesystem(uri)
    if store is None:
        import os

        os.replace(f"{path}/{old}", f"{path}/{new}")
    else:
        store.move(f"{path}/{old}", f"{path}/{new}")


class _Roller:
    """Files of one shard, one after the other."""

    def __init__(self, uri: str, shard: int, roll: int):
        self.uri, self.shard, self.roll, self.seq, self.file, self.done = uri, shard, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.file is not None and self.size + len(data) > self.roll:
            self.close()
        if self.file is None:
            self.name = f"pages-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.tmp = f".{self.name}.{uuid.uuid4().hex}.tmp"
            self.file, self.size, self.records, self.sha = _stream(self.uri, self.tmp), 0, 0, hashlib.sha256()
            body = b"software: kinlink\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
            self._put(_gzip(head.encode() + body + b"\r\n\r\n"))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            _rename(self.uri, self.tmp, self.name)
            self.done.append((self.name, self.size, self.records, self.sha.hexdigest()))
            self.file, self.seq = None, self.seq + 1


def write_archives(pages: DataFrame, uri: str, least: int = LEAST, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``uri``; returns the manifest, one row per file.

    Only small rows (id, SHA-256) meet to find equal payloads; a payload shared by a third of all pages
    is one row of a partial maximum, and the planner splits the join back. Records cross the shuffle
    once, compressed."""
    jvm = pages.sparkSession.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path  # noqa: N806
    final = Path(f"{uri}/manifest")
    fs = final.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(f"{uri}/manifest")
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), body.alias("html"))
    large = stored(pages.filter(F.octet_length("html") >= least).select("page_id", F.sha2("html", 256).alias("k")), "warc-large")
    same = large.groupBy("k").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").select("k", "refers_to")
    refs = large.join(same, "k").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    size = pages.agg(F.sum(F.octet_length("html").cast("bigint")).alias("b"), F.count("*").alias("n")).first()
    bounds = _bounds(pages, size["b"] or 0, size["n"], shard_bytes)
    shards = len(bounds[0]) + 1

    def pack(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, out = batch.column(0), []
            for i, url, html in zip(ids.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = html.encode("utf-8", "replace")
                digest = _sha1(data)
                out.append((hashlib.sha256(data).hexdigest(), url, digest, len(data), record("response", i, url, digest, len(data), data)))
            k, u, g, n, r = map(list, zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([_place(ids, k, bounds), ids, pa.array([1] * len(out), pa.int32()), pa.array(k, pa.string()), pa.nulls(len(out), pa.int64()), pa.array(u, pa.string()), pa.array(g, pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.binary())], names)

    def point(batches: Iterator) -> Iterator:
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([_place(batch.column(0), batch.column(1).to_pylist(), bounds), batch.column(0), pa.array([0] * n, pa.int32()), batch.column(1), batch.column(2), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)

    names = ["shard", "page_id", "part", "k", "refers_to", "url", "digest", "bytes", "record"]
    schema = "shard int, page_id bigint, part int, k string, refers_to bigint, url string, digest string, bytes bigint, record binary"

    def write(batches: Iterator) -> Iterator:
        roller, now, refers = None, object(), None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard, page, part, k, to, url, digest, size, data = row
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield from told(roller)
                    roller, now = _Roller(uri, shard, roll_bytes), object()
                if (page, k) != now:
                    now, refers = (page, k), None
                if part == 0:
                    refers = to
                elif refers is not None:
                    roller.add(record("revisit", page, url, digest, size, b"", refers))
                else:
                    roller.add(data)
        if roller is not None:
            roller.close()
            yield from told(roller)

    def told(roller: _Roller) -> Iterator:
        n, b, r, s = map(list, zip(*roller.done, strict=True))
        yield pa.RecordBatch.from_pydict({"file": n, "bytes": b, "records": r, "sha256": s})

    rows = pages.mapInArrow(pack, schema).unionByName(refs.select("page_id", "k", "refers_to").mapInArrow(point, schema))
    order = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "k", "part", "url")
    stage = f".manifest.{uuid.uuid4().hex}.tmp"
    order.mapInArrow(write, "file string, bytes bigint, records bigint, sha256 string").write.parquet(f"{uri}/{stage}")
    # the manifest makes the archives: files of a run that failed before have no place in it
    if fs.exists(final) or not fs.rename(Path(f"{uri}/{stage}"), final):
        raise FileExistsError(f"{uri}/manifest")
    return spark.read.schema("file string, bytes bigint, records bigint, sha256 string").parquet(f"{uri}/manifest")


def records(data) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of every record of an open gzip stream, member by member."""
    z, raw, text = zlib.decompressobj(31), b"", b""
    while True:
        raw = raw or data.read(1 << 20)
        if not raw:
            break
        text += z.decompress(raw)
        raw = b""
        if z.eof:
            raw, z = z.unused_data, zlib.decompressobj(31)
            head, _, rest = text.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            text = b""


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """The page records of the files that the manifest lists. Digests are computed anew from what
    was read; a block or payload that differs from its header fails the task."""
    files = spark.read.schema("file string").parquet(f"{uri}/manifest")
    own = F.split("file", "[-.]")
    files = files.repartitionById(max(1, min(MOST_SHARDS, files.count())), (F.get(own, F.lit(1)).cast("int") + F.get(own, F.lit(2)).cast("int")))

    def parse(batches: Iterator) -> Iterator:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = _filesystem(uri)
                with open(f"{path}/{name}", "rb") if store is None else store.open_input_stream(f"{path}/{name}") as f:
                    rows = []
                    for head, block in records(f):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        whole = head["WARC-Type"] == "response"
                        if _sha1(block) != head["WARC-Block-Digest"] or whole and (_sha1(payload) != head["WARC-Payload-Digest"] or len(payload) != size):
                            raise ValueError(f"{name}: a digest differs from the record {head['WARC-Record-ID']}")
                        page, to = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), head["WARC-Target-URI"], size, base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(), head["WARC-Type"], to and int(to), payload.decode() if whole else None))
                        if len(rows) == 500:
                            yield shaped(rows)
                            rows = []
                    if rows:
                        yield shaped(rows)

    def shaped(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return files.select("file").mapInArrow(parse, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), uri)
    return read_archives(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, strlen(body) AS n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m
"""
