"""WARC records in ZIP packages, and a reader that ranges into them without extraction.

``write`` puts each task's records into ZIP packages with stored (uncompressed) members: WARC files,
an index of CDXJ lines for each, and a manifest. ``members`` reads a package's central directory
(ZIP64 records included) and says where each stored member lies; ``index`` lists the records;
``read`` fetches just their byte ranges.

Of records with equal payloads the one with the largest id is the response and the others revisit
it; payloads below ``least`` bytes are all responses.

Defined results: a null payload counts as empty; a null id loses against any other, and an empty one is an id; rows that repeat
an id and payload are alike, and responses if the id is the largest; an empty table gives no package;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common
from citeloom.llm.common import materialise, shared_dir, small_batches

#: Bytes of WARC in a package, about, and of records that a reading task fetches at once.
PACKAGE, RANGE = 64 << 20, 4 << 20
DATE = "2020-01-01T00:00:00Z"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- writing -------------------------------------------------------------------------------------


def _urn(page: str | None) -> str:
    """An id in a header: percent-encoded, so that any string comes back; null has a name of its own."""
    return "<urn:nopage>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def _page(urn: str) -> str | None:
    return None if urn == "<urn:nopage>" else unquote(urn[len("<urn:page:") : -1])


def _record(page: str | None, url: str, payload: bytes, size: int, digest: str, refers: str | None) -> bytes:
    kind = "response" if refers is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers is not None:
        head += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Package:
    """A ZIP file written as a stream of stored members; ZIP64 fields where 32 bits don't do."""

    LIMIT = 0xFFFFFFFF

    def __init__(self, out, limit: int = LIMIT):
        self.out, self.at, self.entries, self.limit = out, 0, [], limit

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, at = name.encode(), zlib.crc32(data), self.at
        large = len(data) >= self.limit
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        size = self.LIMIT if large else len(data)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), at))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            wide = [x for x in (size, size, at) if x >= self.limit] if size >= self.limit else [at] if at >= self.limit else []
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            s = self.LIMIT if size >= self.limit else size
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, self.LIMIT if at >= self.limit else at) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if start >= self.limit or size >= self.limit or n >= min(0xFFFF, self.limit):
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, self.LIMIT), self.LIMIT if start >= self.limit else start, 0))


def digests(pages: DataFrame, *, key: str, payload: str) -> DataFrame:
    """digest (hex SHA-1) and last (the largest id) of payloads that stand in two rows or more."""
    hashed = pages.select(F.col(key).alias("key"), _digest(payload).alias("digest"))
    return hashed.groupBy("digest").agg(F.max("key").alias("last"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("last").isNotNull())


def _digest(payload: str) -> Column:
    return F.sha1(F.encode(F.coalesce(payload, F.lit("")), "utf-8"))


def _narrow(bits) -> Callable:
    """Of rows that may repeat a payload (their digest is in the first bitmap), the html of those that may be its response
    (digest and id are in the second); the others' html is not needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [common.in_filter(b, batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)) for b, c in zip(bits.value, ("d", "dk"))]
            batch = batch.filter(pa.array(hit[0]))
            k = batch.schema.get_field_index("html")
            html = pc.if_else(pa.array(hit[1][hit[0]]), batch.column(k), pa.scalar(None, batch.column(k).type))
            yield batch.set_column(k, batch.schema.field(k), html).drop_columns(["d", "dk"])

    return run


def assign(pages: DataFrame, *, key: str, payload: str, url: str, least: int = 0) -> tuple[DataFrame, DataFrame, Broadcast]:
    """(all rows, rows that may repeat a payload with refers, the digests' bitmap). Rows not in the bitmap are responses.

    Only ids and digests are shuffled: html goes along for a repeated payload's one response alone. Digests that hold more
    than a thousandth of the rows (a thousand at most) are broadcast, so that none makes one task large.
    """
    spark = pages.sparkSession
    text = F.coalesce(payload, F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(url, F.lit("")).alias("url"), text.alias("html"), F.octet_length(text).alias("bytes"), _digest(payload).alias("digest"))
    last = materialise(digests(pages, key=key, payload=payload).select("digest", "last", "n", F.xxhash64("digest").alias("d"), F.xxhash64("digest", "last").alias("dk")), "digests")
    bits = spark.sparkContext.broadcast((common.make_filter(last, "d"), common.make_filter(last, "dk")))
    rows = rows.withColumns({"d": F.xxhash64("digest"), "dk": F.xxhash64("digest", "key")})
    kind = dict(pages.dtypes)[key]
    again = rows.mapInArrow(_narrow(bits), f"key {kind}, url string, html string, bytes int, digest string")
    total = pages.count()
    hot = F.broadcast(last.where(F.col("n") * 1000 > total).select("digest", F.col("last").alias("hot")))
    mild = last.where(F.col("n") * 1000 <= total).select("digest", F.col("last").alias("mild"))
    again = again.join(hot, "digest", "left")
    # Rows of hot digests have their id already; the salt keeps them from meeting in the second join.
    salted = again.withColumn("at", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "url").cast("string"))))
    found = salted.join(mild.withColumnRenamed("digest", "at"), "at", "left").withColumn("last", F.coalesce("hot", "mild"))
    refers = F.when((F.col("bytes") >= least) & ~F.col("key").eqNullSafe(F.col("last")), F.col("last"))
    return rows, found.select("key", "url", "html", "bytes", "digest", refers.alias("refers")), bits


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, package: int = PACKAGE) -> DataFrame:
    """One row per package written: path and records. Packages get names of their own, so those of a
    task that is run again don't clash; only those in the result count."""
    rows, again, bits = assign(pages, key=key, payload=payload, url=url, least=least)
    if least:  # short payloads are responses whatever repeats them, so they keep their html
        short = F.col("bytes") < least
        again = again.where(~short)
        rows = rows.withColumn("d", F.when(short, None).otherwise(F.col("d")))
    page = F.col("key").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        warc, lines = io.BytesIO(), []

        def flush():
            if not lines:
                return None
            fs.create_dir(root, recursive=True)
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(path) as out:
                z = Package(out)
                z.add("archive/data.warc", warc.getvalue())
                z.add("indexes/index.cdxj", "".join(sorted(lines)).encode())
                z.add("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc", "bytes": warc.tell()}, {"path": "indexes/index.cdxj"}]}).encode())
                z.close()
            n = len(lines)
            warc.seek(0), warc.truncate(), lines.clear()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

        for batch in small_batches(batches, "html"):
            if "d" in batch.schema.names:  # all rows: those that may repeat a payload come by themselves
                d = batch.column("d")
                alone = ~common.in_filter(bits.value[0], d.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) | d.is_null().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(alone))
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                data, at = _record(r["page"], r["url"].replace("\r", "%0D").replace("\n", "%0A"), (r["html"] or "").encode(), r["bytes"], digest, r["refers"]), warc.tell()
                warc.write(data)
                lines.append(f"{_urn(r['page'])} {DATE} {json.dumps({'url': r['url'], 'digest': 'sha1:' + digest, 'offset': at, 'length': len(data), 'filename': 'data.warc'})}\n")
                if warc.tell() >= package:
                    yield flush()
        if lines:
            yield flush()

    alone = rows.select(page.alias("page"), "url", "html", "bytes", "digest", F.lit(None).cast("string").alias("refers"), "d")
    again = again.select(page.alias("page"), "url", "html", "bytes", "digest", F.col("refers").cast("string").alias("refers"))
    return alone.mapInArrow(run, "path string, records bigint").unionByName(again.mapInArrow(run, "path string, records bigint"))


# --- reading -------------------------------------------------------------------------------------


def directory(file, size: int) -> list[tuple[str, int, int]]:
    """(name, where its data begin, bytes) of each stored member, from the central directory."""

    def at(k: int, n: int) -> bytes:
        file.seek(k)
        return file.read(n)

    base = max(0, size - 65557)
    tail = at(base, size - base)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack("<HII", tail[k + 10 : k + 20])
    if k >= 20 and tail[k - 20 : k - 16] == b"PK\x06\x07":
        (wide,) = struct.unpack("<Q", tail[k - 12 : k - 4])
        n, length, start = struct.unpack("<QQQ", at(wide + 32, 24))
    raw, found, p = at(start, length), [], 0
    for _ in range(n):
        sig, method, csize, usize, ln, le, lc, local = struct.unpack("<4s6xH8xIIHHH8xI", raw[p : p + 46])
        if sig != b"PK\x01\x02":
            raise ValueError("a central directory entry is broken")
        name, extra = raw[p + 46 : p + 46 + ln].decode(), raw[p + 46 + ln : p + 46 + ln + le]
        while len(extra) >= 4:
            tag, m = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                usize = wide.pop(0) if usize == 0xFFFFFFFF else usize
                csize = wide.pop(0) if csize == 0xFFFFFFFF else csize
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + m :]
        p += 46 + ln + le + lc
        if method == 0:
            a, b = struct.unpack("<HH", at(local + 26, 4))  # the local header has lengths of its own
            found.append((name, local + 30 + a + b, csize))
    return found


def index(packages: DataFrame, folder: str) -> DataFrame:
    """One row per range of neighbouring records of about RANGE bytes: path, offset, length, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    found = {name: (a, n) for name, a, n in directory(f, f.size())}
                    base, _ = found["archive/data.warc"]
                    f.seek(found["indexes/index.cdxj"][0])
                    entries = [json.loads(x.split(" ", 2)[2]) for x in f.read(found["indexes/index.cdxj"][1]).decode().split("\n") if x]
                spans: list[list[tuple[int, int]]] = [[]]
                total = 0
                for e in sorted(entries, key=lambda e: e["offset"]):
                    if spans[-1] and total + e["length"] > RANGE:
                        spans.append([])
                        total = 0
                    spans[-1].append((base + e["offset"], e["length"]))
                    total += e["length"]
                yield pa.RecordBatch.from_pydict({"path": [path] * len(spans), "offsets": pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64())), "lengths": pa.array([[n for _, n in s] for s in spans], pa.list_(pa.int64()))})

    return packages.select("path").mapInArrow(run, "path string, offsets array<bigint>, lengths array<bigint>")


def parse_record(data: bytes) -> dict:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    content = body[: int(fields["Content-Length"])]
    return fields | {"payload": content.partition(b"\r\n\r\n")[2]}


def read(ranges: DataFrame, folder: str) -> DataFrame:
    """Each record: page, url, record_type, refers, payload (null for revisits), bytes and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                with fs.open_input_file(r["path"]) as f:
                    for a, n in zip(r["offsets"], r["lengths"]):
                        f.seek(a)
                        x = parse_record(f.read(n))
                        whole, digest = x["WARC-Type"] == "response", x["WARC-Payload-Digest"].removeprefix("sha1:")
                        if whole and base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() != digest:
                            raise ValueError(f"{r['path']}: a payload differs from its digest")
                        refers = _page(x["WARC-Refers-To"]) if "WARC-Refers-To" in x else None
                        rows.append((_page(x["WARC-Record-ID"]), x["WARC-Target-URI"], x["WARC-Type"], refers, x["payload"] if whole else None, len(x["payload"]) if whole else int(x["X-Payload-Length"]), digest))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string()])], names=["page", "url", "record_type", "refers", "payload", "payload_bytes", "payload_digest"])

    return ranges.mapInArrow(run, "page string, url string, record_type string, refers string, payload binary, payload_bytes bigint, payload_digest string")


def round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes pages to packages in the shared folder and reads all records back."""
    spark = pages.sparkSession
    folder = os.path.join(shared_dir(spark), f"packages-{uuid.uuid4().hex}")
    packages = materialise(write(pages, folder, key=key, url=url, payload=payload, least=least), "packages")
    ranges = materialise(index(packages.repartition(spark.sparkContext.defaultParallelism), folder), "ranges")
    kind = dict(pages.dtypes)[key]
    got = read(ranges.repartition(2 * spark.sparkContext.defaultParallelism), folder)
    return got.select(F.col("page").cast(kind).alias(key), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))
