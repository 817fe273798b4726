"""WARC records in ZIP packages: a writer, and a reader that range-reads records without unpacking.

A package holds archive/data.warc.gz (each record a gzip member of its own) and indexes/index.cdxj (a line a record with
its offset and length), both stored, not compressed again. The reader takes the end of the file, follows the end
records to the central directory (ZIP64 or not), finds the two members through it, and reads ranges of records.
Packages are reached through pyarrow's file systems, so the shared folder may be a local mount or an object store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import MAX_BROADCAST_ROWS, join_dealt, materialise, shared_dir, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
#: Archive bytes that a reading task gets, about, where there are more than tasks at once.
TASK_BYTES = 64 << 20
_URN = "urn:page:"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# ---- writing


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header of its response, whose Content-Length is that of the full payload."""
    name = lambda i: f"<{_URN}{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add digest (SHA-1, hex), n_bytes and refers_to: of equal payloads of at least min_bytes the smallest page_id is kept."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    groups = pages.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"), F.min("n_bytes").alias("bytes"))
    shared = materialise(groups.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).drop("bytes"), "shared-payloads")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("original"))
    rows, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # 50 bytes a row; beyond that a shuffled join, where empty payloads may be a third of all pages
    joined = pages.join(F.broadcast(shared.drop("n")), "digest", "left") if rows <= MAX_BROADCAST_ROWS else join_dealt(pages, shared, "digest", "n", total, "left")
    return joined.withColumn("refers_to", F.when(other, F.col("original"))).drop("original")


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) into packages in `folder`; returns (path, size) of each.

    Null html is an empty payload, a null url has no Target-URI, a null page_id an empty id. Rows that repeat a page_id
    are records of their own. A package appears under its name only when whole, so a task that runs again replaces it.
    """
    rows = with_originals(pages, min_bytes)
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("payload"), "digest", "n_bytes", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, (store, at) = TaskContext.get(), open_fs(folder)
        todo = (dict(zip(b.schema.names, row, strict=True)) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, k = next(todo, None), 0
        while row:
            path = f"{at}/part-{context.partitionId():06d}-{k:04d}.zip"
            draft = f"{path}.{context.taskAttemptId()}"
            index, size = [], 0
            with store.open_output_stream(draft) as out, zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED) as package:
                with package.open(_member(DATA), "w", force_zip64=True) as data:
                    while row and size < package_bytes:
                        digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                        payload = (row["payload"] or "").encode("utf-8", "surrogatepass")
                        own = gzip.compress(record(row["page_id"], row["url"], payload, digest, row["n_bytes"], row["refers_to"]), 1, mtime=0)
                        data.write(own)
                        index.append(f"{_URN}{row['page_id']} {json.dumps({'offset': size, 'length': len(own)})}\n")
                        size += len(own)
                        row = next(todo, None)
                package.writestr(_member(INDEX), "".join(index))
            store.move(draft, path)
            info = store.get_file_info(path)
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([info.size], pa.int64())], ["path", "size"])

    store, at = open_fs(folder)
    store.create_dir(at, recursive=True)
    return materialise(rows.mapInArrow(write, "path string, size long"), "warc-packages")


class _Stream:
    """An output stream that can only be written to, as object stores have them."""

    def __init__(self, out):
        self.write, self.flush = out.write, lambda: None


def _member(name: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(name)  # a fixed date: the same rows give the same bytes


# ---- reading


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, offset of the local header, stored size) from a ZIP's central directory; read(offset, length)."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP end record")
    n, cd_size, cd_at = struct.unpack_from("<8xHHII", tail, end)[1:]
    where = tail_at + end
    if 0xFFFF == n or 0xFFFFFFFF in (cd_size, cd_at):
        signature, _, far, _ = struct.unpack("<IIQI", read(where - 20, 20))
        if signature != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        far_end = read(far, 56)
        if far_end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        n, cd_size, cd_at = struct.unpack_from("<32xQQQ", far_end)
    entries, at, central = {}, 0, read(cd_at, cd_size)
    for _ in range(n):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, stored, full, n_name, n_extra, n_comment, offset = struct.unpack_from("<10xH8xIIHHH8xI", central, at)
        name = central[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, x = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # the 64-bit values of those that do not fit, in this order
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, x + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                stored = next(values) if stored == 0xFFFFFFFF else stored
                offset = next(values) if offset == 0xFFFFFFFF else offset
            x += 4 + length
        entries[name] = (method, offset, stored)
        at += 46 + n_name + n_extra + n_comment
    return entries


def locate(read, entries: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    """(offset, size) of a stored member's bytes in the package."""
    method, offset, stored = entries[name]
    if method:
        raise ValueError(f"{name} is compressed; only stored members can be read in part")
    head = read(offset, 30)
    n_name, n_extra = struct.unpack_from("<26xHH", head)
    return offset + 30 + n_name + n_extra, stored


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers with lower-case names, HTTP head, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN)
    return int(number) if number else None


def record_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, lengths) of runs of neighbouring records of about range_bytes, from the packages' indexes."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = open_fs(path)
                rows: list[tuple[int, list[int]]] = []
                with store.open_input_file(at) as f:
                    read = lambda offset, length, f=f: f.read_at(length, offset)
                    entries = directory(read, size)
                    begin, _ = locate(read, entries, DATA)
                    where, length = locate(read, entries, INDEX)
                    for line in read(where, length).decode().splitlines():
                        own = json.loads(line.partition(" ")[2])
                        if not rows or sum_ + own["length"] > range_bytes or own["offset"] != next_:
                            rows.append((begin + own["offset"], []))
                            sum_ = 0
                        rows[-1][1].append(own["length"])
                        sum_, next_ = sum_ + own["length"], own["offset"] + own["length"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["path", "start", "lengths"])

    return packages.select("path", "size").mapInArrow(ranges, "path string, start long, lengths array<int>")


def read_packages(packages: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of packages (path, size), by range reads that are dealt over all tasks.

    payload_bytes and payload_digest are of the payload read; of a revisit, of the full payload, from its header. A
    payload that does not have the digest that its record states is an error. No packages give no records.
    """
    base = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in base.split(", ")] + ["payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = open_fs(path)
                with store.open_input_file(at) as f:
                    data = f.read_at(sum(lengths), start)
                out, place = [], 0
                for n in lengths:
                    headers, http, payload = parse_record(zlib.decompress(data[place : place + n], 31))
                    place += n
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response":
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if digest != stated:
                            raise ValueError(f"{path}: {headers['warc-record-id']} has another payload than stated")
                    else:
                        digest = stated
                        size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                    out.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], _page(headers.get("warc-refers-to")), size, digest, payload))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: 6 + with_payload], names[: 6 + with_payload])

    size = packages.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    at_once = packages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(ceil(size / range_bytes), max(at_once, ceil(size / TASK_BYTES))))
    # a stated number of tasks stays, however few bytes the ranges' own rows have
    ranges = materialise(record_ranges(packages, range_bytes), "warc-ranges")
    return ranges.repartition(tasks, F.xxhash64("path", "start")).mapInArrow(read, base + ", payload binary" * with_payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    packages = write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder, min_bytes=0)
    return read_packages(packages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT hex, min(page_id) AS original, min(strlen(html)) AS n,
        list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (instr('0123456789abcdef', substr(hex, 1 + (5 * i) // 4, 1)) - 1)
          + instr('0123456789abcdef', substr(hex, 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT, 1) FOR i IN range(32)], 'string_agg', '') AS digest
      FROM p GROUP BY hex)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM p JOIN d USING (hex)
"""
