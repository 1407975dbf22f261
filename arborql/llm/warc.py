"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package holds stored (uncompressed) members: archives, archive/*.warc.gz, in which each
record is a gzip member of its own, and an index, indexes/index.cdxj, whose CDXJ lines
(url key, time, JSON) name the archive, offset and length of each record. The reader finds
the end-of-directory record in the file's tail (with the ZIP64 locator and record, where
there is one), walks the central directory, locates all stored archives and all indexes
behind their local headers, and then reads single ranges of records. It also reads
packages of others: any number of archives and indexes, packed or plain records, records
that no index names (their archive is then scanned in pieces), and blocks that are no HTTP
message.

Packages are written under new names, and only those of tasks that succeeded are listed,
so a lost executor or a repeated task leaves no duplicate records.

Defined results: a null html is an empty payload; a null url is written as urn:none; very
long payloads are one record each; an empty table gives no package. Of records with equal
payloads those with the smallest page_id are responses, all others revisit it; a null
page_id is a response only if no row with an id has its payload. Repeated rows are records
each, with record ids of their own; where the response of a payload was repeated, its
revisits name it by page and payload only. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, new_path, small

#: Payloads below this size are never revisits. Packages and archives are closed, and ranges end, at about these sizes.
LEAST_REVISIT, PACKAGE_BYTES, ARCHIVE_BYTES, RANGE_BYTES = 0, 256 << 20, 64 << 20, 1 << 20
INDEX = "indexes/index.cdxj"
_DATE, _PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6f0c0a5e-6f52-4f3e-9d0e-2f6b0f0c2a11")


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if uri.startswith("file:") or "://" not in uri:
        return LocalFileSystem(), urlparse(uri).path if uri.startswith("file:") else uri
    return FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None, payload_digest: str) -> str:
    """The id of the one response of a page and payload."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, alone: bool = True) -> bytes:
    """One response, or revisit of the response refers_to: the HTTP head stays, the payload goes. alone: no other row has the response's page and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, mark = http + payload if refers_to is None else http, digest(payload)
    own = record_id(page_id, mark) if refers_to is None and alone else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Target-URI: {_clean(url) if url else 'urn:none'}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{mark}"]
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, mark)}"] if alone else []
        head += [f"WARC-Refers-To-Date: {_DATE}", f"Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse(raw: bytes) -> dict:
    """A record's header fields, HTTP fields (none if the block is no HTTP message) and payload."""
    cut = raw.index(b"\r\n\r\n")
    warc = _fields(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(warc["content-length"])]
    if not warc.get("content-type", "").startswith("application/http"):
        return {"warc": warc, "http": {}, "payload": block}
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": warc, "http": _fields(http), "payload": payload}


def url_key(url: str | None) -> str:
    """The sorting key of an index line: the host's labels in reverse, then the path."""
    x = urlparse(url or "urn:none") if re.match(r"[a-zA-Z][\w+.-]*://[^\s\[\]]*$", url or "") else None
    host = ",".join(reversed(x.netloc.lower().partition(":")[0].split("."))) if x else ""
    return re.sub(r"\s", "%20", f"{host}){x.path or '/'}" + (f"?{x.query}" if x.query else "")) if x else "urn:none"


# ---------------------------------------------------------------- packages


class PackageWriter:
    """Appends records to one package."""

    def __init__(self, uri: str, archive_bytes: int = ARCHIVE_BYTES):
        self.uri, self.archive_bytes = uri, archive_bytes
        fs, path = _filesystem(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.archives, self.offset, self.size, self.index = None, 0, 0, 0, []

    def add(self, url: str | None, payload_digest: str, raw: bytes) -> None:
        if self.member is None or self.offset >= self.archive_bytes:
            if self.member is not None:
                self.member.close()
            self.archives, self.offset = self.archives + 1, 0
            self.member = self.zip.open(f"archive/data-{self.archives:04}.warc.gz", "w", force_zip64=True)
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = z.compress(raw) + z.flush()
        told = {"url": url, "mime": "text/html", "status": "200", "digest": f"sha1:{payload_digest}", "length": str(len(data)), "offset": str(self.offset), "filename": f"data-{self.archives:04}.warc.gz"}
        self.index.append(f"{url_key(url)} {re.sub('[^0-9]', '', _DATE)} {json.dumps(told)}")
        self.member.write(data)
        self.offset += len(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.member is not None:
            self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as m:
            m.write("".join(f"{x}\n" for x in sorted(self.index)).encode())
        self.zip.close()
        self.sink.close()
        return self.uri, self.size, len(self.index)


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of each stored member, by the central directory of a random access file."""

    def at(pos: int, n: int) -> bytes:
        f.seek(pos)
        return f.read(n)

    start = max(0, size - 22 - 65535)
    tail = at(start, size - start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    shift = start + end - length - offset  # bytes before the first member
    place = start + end - 20
    locator = at(place, 20) if place >= 0 else b""
    if locator[:4] == b"PK\x06\x07":
        (where,) = struct.unpack("<Q", locator[8:16])
        big = at(where, 56)
        if big[:4] != b"PK\x06\x06":  # something stands before the package
            where = place - 56
            big = at(where, 56)
        count, length, offset = (*struct.unpack("<Q", big[32:40]), *struct.unpack("<QQ", big[40:56]))
        shift = where - length - offset
    directory, pos, found = at(offset + shift, length), 0, {}
    for _ in range(count):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain = struct.unpack("<H8xIxxxx", directory[pos + 10 : pos + 28])[0], *struct.unpack("<II", directory[pos + 20 : pos + 28])
        n_name, n_extra, n_comment = struct.unpack("<HHH", directory[pos + 28 : pos + 34])
        (local,) = struct.unpack("<I", directory[pos + 42 : pos + 46])
        name = directory[pos + 46 : pos + 46 + n_name].decode("utf-8")
        extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        while len(extra) >= 4:  # ZIP64: only the fields that overflow, in this order
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        pos += 46 + n_name + n_extra + n_comment
        if method == zipfile.ZIP_STORED:
            head = at(local + shift, 30)
            n1, n2 = struct.unpack("<HH", head[26:30])
            found[name] = local + shift + 30 + n1 + n2, packed
    return found


def index_lines(text: bytes) -> Iterator[tuple[str, int, int]]:
    """File name, offset and length of each CDXJ line."""
    for line in text.splitlines():
        start = line.find(b"{")
        if start >= 0 and not line.startswith(b"!"):
            x = json.loads(line[start:])
            if {"filename", "offset", "length"} <= x.keys():
                yield x["filename"], int(x["offset"]), int(x["length"])


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out = [], None
        for batch in batches:
            for page_id, url, html, refers, alone in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    out = PackageWriter(f"{folder}/{uuid.uuid4().hex}.zip")
                payload = (html.as_py() or "").encode()
                out.add(url.as_py(), digest(payload), record(page_id.as_py(), url.as_py(), payload, refers.as_py(), alone.as_py()))
                if out.size >= PACKAGE_BYTES:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), *(pa.array([x[i] for x in done], pa.int64()) for i in (1, 2))], ["package", "bytes", "records"])

    return write


def _ranges(f, size: int) -> Iterator[tuple[int, int, list[int]]]:
    """Start, bytes and record lengths of the ranges of one package; no lengths for an archive that must be scanned."""
    found = members(f, size)
    archives = {n: x for n, x in found.items() if n.endswith((".warc", ".warc.gz"))}
    by_name = {n.rpartition("/")[2]: n for n in archives}
    records: dict[str, list[tuple[int, int]]] = {n: [] for n in archives}
    for name in sorted(n for n in found if n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
        f.seek(found[name][0])
        text = f.read(found[name][1])
        for file, offset, length in index_lines(zlib.decompress(text, 31) if name.endswith(".gz") else text):
            target = file if file in archives else by_name.get(file.rpartition("/")[2])
            if target is not None:
                records[target].append((offset, length))
    for name, (start, length) in archives.items():
        first: int | None = None
        lengths: list[int] = []
        for offset, n in sorted(set(records[name])):
            if lengths and (offset != first + sum(lengths) or offset + n - first > RANGE_BYTES):
                yield start + first, sum(lengths), lengths
                lengths = []
            if not lengths:
                first = offset
            lengths.append(n)
        if lengths:
            yield start + first, sum(lengths), lengths
        elif length:
            yield start, length, []


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """package -> ranges of whole records, by the package's own indexes."""
    for batch in batches:
        for package in batch.column("package").to_pylist():
            fs, path = _filesystem(package)
            with fs.open_input_file(path) as f:
                rows = list(_ranges(f, f.size()))
            yield pa.RecordBatch.from_arrays([pa.array([package] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["package", "start", "bytes", "lengths"])


def _plain_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records one after another, as they are in plain archives."""
    held = b""
    for piece in pieces:
        held += piece
        while True:
            held = held.lstrip(b"\r\n")
            cut = held.find(b"\r\n\r\n")
            if cut < 0:
                break
            n = cut + 4 + int(_fields(held[:cut])["content-length"])
            if len(held) < n:
                break
            yield held[:n]
            held = held[n:]


def _unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of gzip members one after another."""
    z, done = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            if done:
                z, done = zlib.decompressobj(31), False
            yield z.decompress(piece)
            done, piece = z.eof, z.unused_data if z.eof else b""


def _scan(f, start: int, size: int) -> Iterator[bytes]:
    """The records of a whole archive, read in pieces."""

    def pieces() -> Iterator[bytes]:
        for at in range(0, size, RANGE_BYTES):
            f.seek(start + at)
            yield f.read(min(RANGE_BYTES, size - at))

    f.seek(start)
    packed = f.read(2) == b"\x1f\x8b"
    yield from _plain_records(_unpacked(pieces()) if packed else pieces())


def _records(f, start: int, size: int, lengths: list[int]) -> Iterator[bytes]:
    if not lengths:
        yield from _scan(f, start, size)
        return
    f.seek(start)
    data, pos = f.read(size), 0
    for n in lengths:
        raw = data[pos : pos + n]
        yield zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
        pos += n


_COLUMNS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_id": pa.string()}
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, record_id string, refers_to_id string"


def _row(raw: bytes) -> tuple:
    x = parse(raw)
    w = x["warc"]
    number = lambda k: int(w[k]) if k in w else None
    revisit = w["warc-type"] == "revisit"
    size = int(x["http"].get("content-length", 0)) if revisit else len(x["payload"])
    told = w.get("warc-payload-digest", "").removeprefix("sha1:") or None
    mark = told if revisit else digest(x["payload"])
    return (number("page-id"), size, mark, w["warc-type"], number("refers-to-page-id"), w.get("warc-target-uri", "").strip("<>") or None, None if revisit else x["payload"], w.get("warc-record-id"), w.get("warc-refers-to"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges -> a row for each record."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_COLUMNS.values())], list(_COLUMNS))

    for batch in batches:
        for package, start, size, lengths in zip(*(batch.column(i).to_pylist() for i in range(4))):
            fs, path = _filesystem(package)
            with fs.open_input_file(path) as f:
                rows, held = [], 0
                for raw in _records(f, start, size, lengths):
                    rows.append(_row(raw))
                    held += len(raw)
                    if held >= 8 * RANGE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)


def write_packages(pages: DataFrame, least_revisit: int = LEAST_REVISIT, folder: str | None = None) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html, ...); returns the packages: package, bytes, records."""
    text = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(text.cast("binary")).alias("sha"))
    # Groups of one need no partner: only the others are looked up.
    each = rows.groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    shared = each.groupBy("sha").agg(F.min("page_id").alias("original"), F.min_by("n", "page_id").alias("same"), F.sum("n").alias("n"))
    shared = materialize(shared.where("n > 1").select("sha", "original", F.coalesce(F.col("same") == 1, F.lit(False)).alias("alone")), "equal-payloads")
    refers = F.when((F.octet_length(text) >= least_revisit) & ~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))
    # The id of a response can be told from page and payload only if no other row has both.
    first = F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull()
    alone = F.when(F.col("alone").isNull(), True).otherwise(F.col("alone") & (F.col("refers_to").isNotNull() | first))
    marked = rows.join(small(shared), "sha", "left").withColumn("refers_to", refers).select("page_id", "url", "html", "refers_to", alone.alias("alone"))
    folder = folder or new_path(pages.sparkSession, "warc")
    return materialize(map_arrow(marked, _write(folder), "package string, bytes long, records long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the listed packages (package, and bytes where known): page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, record_id, refers_to_id.

    page_id and refers_to are null for records of other writers.
    """
    ranges = map_arrow(packages.select("package"), _locate, "package string, start long, bytes long, lengths array<long>")
    size = packages.agg(F.sum("bytes")).first()[0] if "bytes" in packages.columns else 0
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, int(size or 0) // (16 << 20))
    return map_arrow(ranges.repartition(tasks), _read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_packages(write_packages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
