"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, one gzip member each, one archive for each task. Of records with
equal payloads of at least 1000 bytes the one with the largest page_id is a response, the others are
revisits without the payload. The index sorts captures by reversed-host URL key, cuts them into
compressed blocks, and keeps beside each index part a sparse directory of the first key of each block.
A reader finds the part, then the block in the part's directory, then the capture in the block, all by
binary search, and reads the block and the record by range. Reading many pages back is one pass in key
order, so that each task keeps to a few parts and blocks.

Archives and index lie below ``spark.checkpoint.dir``, and are reached through pyarrow's file systems. A
task that is run again writes files of its own; the index only names those of tasks that succeeded.

Defined results: a null html is an empty payload. A null url has the key ``)``, and its record names no
target. A null page_id is kept as such, and refers to nothing. Repeated rows are records each; rows equal
in page_id and url are read back one by one. Extra columns are ignored. No pages make an empty index.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attached
from .arrays import tidy
from .scratch import pointed, scratch_path, written

LEAST_SHARED = 1000
BLOCK_LINES = 512
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = 0x7469636B6C6F4F6D << 64  # the upper half of record ids
CAPTURES = "key string, page_id long, file string, at long, size long"


def url_key(url: Column) -> Column:
    """The host reversed and comma-separated, ``)``, path and query: pages of one site sort together."""
    rest = r"^[^:/?#]+://(?:[^@/?#]*@)?"
    host = F.regexp_extract(url, rest + r"([^:/?#]*)", 1)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), path)
    return F.coalesce(F.when(host == "", F.concat(F.lit(")"), url)).otherwise(key), F.lit(")"))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=IDS | page_id & (1 << 64) - 1)}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = value & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if value >> 64 == IDS >> 64 else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def gzipped(data: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def described(pages: DataFrame) -> DataFrame:
    """Pages with key, digest and the page that a revisit refers to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", url_key(F.col("url"))).withColumn("sha1", F.sha1("html"))
    small = written(rows.where(F.octet_length("html") >= LEAST_SHARED).select("page_id", "sha1"), "digests")
    leaders = small.groupBy("sha1").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("sha1", "leader")
    # Few columns meet here; a digest that many pages share is looked up, not gathered.
    revisits = pointed(attached(small, pointed(leaders), "sha1").where("page_id != leader").select(F.col("page_id").alias("of"), F.col("sha1").alias("of_sha1"), "leader").distinct())
    return attached(rows, revisits, (F.col("page_id") == F.col("of")) & (F.col("sha1") == F.col("of_sha1")), "left").select("page_id", "url", "html", "key", "sha1", "leader")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; a row for each capture, stored."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name, at, out = f"pages-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                places = []
                for page_id, url, html, sha1, leader in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "leader")), strict=True):
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = gzipped(record(page_id, url, html.encode(), sha1, leader))
                    out.write(data)
                    places.append((at, len(data)))
                    at += len(data)
                if places:
                    starts, sizes = zip(*places, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), pa.array([name] * len(places)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["key", "page_id", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return written(described(pages).mapInArrow(rows, CAPTURES), "captures")


def _line(key: str, page_id: int | None, file: str, at: int, size: int) -> str:
    return "\t".join((key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n"), "" if page_id is None else str(page_id), file, str(at), str(size)))


def _fields(line: str) -> tuple:
    key, page_id, file, at, size = line.split("\t")
    return place_of(key.replace("\\\\", "\0").replace("\\t", "\t").replace("\\n", "\n").replace("\0", "\\"), int(page_id) if page_id else None), file, int(at), int(size)


def place_of(key: str, page_id: int | None) -> tuple[bytes, int]:
    """How captures are ordered, as Spark orders them: by the key's bytes, then by page_id, null first."""
    return key.encode(), -(1 << 63) - 1 if page_id is None else page_id


def write_index(captures: DataFrame, folder: str) -> list[tuple[tuple[bytes, int], str]]:
    """Writes blocks and directories; returns the first place and the name of each part, one for each task."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name, lines, directory, at, out, first = f"index-{uuid.uuid4().hex}", [], [], 0, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out, first = store.open_output_stream(f"{path}/{name}", compression=None), row[:2]
                lines.append(_line(*row))
                if len(lines) == BLOCK_LINES:
                    at = _block(out, lines, directory, at)
                    lines = []
        if lines:
            at = _block(out, lines, directory, at)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{name}.dir", compression=None) as d:
                d.write(zlib.compress("\n".join(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], ["key", "page_id", "name"])

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    parts = written(ordered.mapInArrow(rows, "key string, page_id long, name string"), "parts").collect()  # one row for each task
    return sorted((place_of(p["key"], p["page_id"]), p["name"]) for p in parts)


def _block(out, lines: list[str], directory: list[str], at: int) -> int:
    data = zlib.compress("\n".join(lines).encode(), 3)
    out.write(data)
    key, page_id = lines[0].split("\t")[:2]
    directory.append(f"{key}\t{page_id}\t-\t{at}\t{len(data)}")
    return at + len(data)


class Reader:
    """Looks captures up and reads their records; holds one directory, one block and a few open archives."""

    MOST_OPEN = 32

    def __init__(self, folder: str, parts: list):
        self.store, self.path = _store(folder)
        self.firsts, self.names = [p[0] for p in parts], [p[1] for p in parts]
        self.part, self.blocks, self.block, self.captures, self.open = None, [], None, [], OrderedDict()

    def _ranged(self, name: str, at: int, size: int) -> bytes:
        f = self.open.pop(name, None) or self.store.open_input_file(f"{self.path}/{name}")
        self.open[name] = f
        if len(self.open) > self.MOST_OPEN:
            self.open.popitem(last=False)[1].close()
        return f.read_at(size, at)

    def _load(self, k: int) -> None:
        if self.part != k:
            with self.store.open_input_stream(f"{self.path}/{self.names[k]}.dir", compression=None) as f:
                self.blocks = [_fields(line) for line in zlib.decompress(f.read()).decode().split("\n")]
            self.part, self.block = k, None

    def capture(self, key: str, page_id: int | None, nth: int = 0) -> tuple:
        """(file, at, size) of the nth capture of this key and page."""
        place = place_of(key, page_id)
        # Equal places never cross parts, but they may cross blocks: start at the block before the first that reaches the place.
        self._load(max(0, bisect.bisect_right(self.firsts, place) - 1))
        b = max(0, bisect.bisect_left(self.blocks, place, key=lambda x: x[0]) - 1)
        while b < len(self.blocks):
            if self.block != b:
                _, _, at, size = self.blocks[b]
                self.captures, self.block = [_fields(line) for line in zlib.decompress(self._ranged(self.names[self.part], at, size)).decode().split("\n")], b
            lo = bisect.bisect_left(self.captures, place, key=lambda x: x[0])
            hi = bisect.bisect_right(self.captures, place, key=lambda x: x[0])
            if nth < hi - lo:
                return self.captures[lo + nth][1:]
            if hi < len(self.captures):
                break
            nth, b = nth - (hi - lo), b + 1
        raise KeyError((key, page_id))

    def record(self, key: str, page_id: int | None, nth: int = 0) -> tuple[dict[str, str], bytes, bytes]:
        return parsed(zlib.decompress(self._ranged(*self.capture(key, page_id, nth)), 31))


def read_back(pages: DataFrame, folder: str, parts: list) -> DataFrame:
    """What the archives say of every page, looked up by its key."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, nth = Reader(folder, parts), None, 0
        for batch in batches:
            out = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nth = nth + 1 if last == (key, page_id) else 0
                last = (key, page_id)
                fields, http, payload = reader.record(key, page_id, nth)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                kind = fields["WARC-Type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"the record of page {page_id} is damaged")
                out.append((page_id, size, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    return wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(rows, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives all pages, indexes them, and reads every page back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    parts = write_index(write_archives(pages, folder), folder)
    return read_back(pages, folder, parts)
