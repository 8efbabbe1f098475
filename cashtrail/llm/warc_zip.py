"""WARC records in stored members of ZIP archives: written through Spark's files, read back by ranges."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch

LEAST_SHARED = 1000         # payloads of fewer bytes are never revisits
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
PAGE = "urn:x-page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# signatures of the ZIP format (fixed values)
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
FULL = 0xFFFFFFFF
TAIL = 65_557               # end record with the longest comment
BATCH_BYTES = 8 << 20
NEAR = 64 << 10             # records closer than this are fetched by one read


# ---- records -------------------------------------------------------------------------------------------------

def _block(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the response named by ``refers_to``, which keeps the HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = re.sub(r"[\r\n]+", " ", url or "")
    headers = {"WARC-Record-ID": f"<{PAGE}{'' if page_id is None else page_id}>", "WARC-Target-URI": url, "WARC-Date": DATE,
               "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type": "application/http;msgtype=response"}
    if refers_to is None:
        return _block("response", headers, http + payload)
    return _block("revisit", headers | {"WARC-Profile": IDENTICAL, "WARC-Refers-To": f"<{PAGE}{refers_to}>"}, http)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(record headers in lower case with ``warc-type``, HTTP head, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    http, _, payload = rest[:int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, http, payload


# ---- archives ------------------------------------------------------------------------------------------------

def _sizes(crc: int, size: int) -> bytes:
    return struct.pack("<III", crc, FULL, FULL) + struct.pack("<HH", 0, 0)


class ArchiveWriter:
    """Streams an archive as parts that each end where a line feed belongs, with that line feed left out.

    Every part becomes one row of Spark's text files, whose writer sets the line feed: records and index lines end in one,
    and the last is the archive's one-byte comment. Sizes follow the data (descriptor and central directory, ZIP64).
    """

    def __init__(self):
        self.offset, self.members, self.lines, self.pending = 0, [], [], b""

    def _open(self, name: str) -> None:
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        head = LOCAL + struct.pack("<HHHHH", 45, 8, 0, 0, 0x21) + struct.pack("<III", 0, FULL, FULL) + struct.pack("<HH", len(name), len(extra)) + name.encode() + extra
        self.members.append({"name": name, "header": self.offset + len(self.pending), "crc": 0, "size": 0})
        self.pending += head

    def _close(self) -> None:
        m = self.members[-1]
        self.pending += DESCRIPTOR + struct.pack("<IQQ", m["crc"], m["size"], m["size"])

    def _part(self, body: bytes) -> bytes:
        out = self.pending + body
        m = self.members[-1]
        m["crc"], m["size"] = zlib.crc32(body, m["crc"]), m["size"] + len(body)
        self.offset, self.pending = self.offset + len(out), b""
        return out[:-1]

    def record(self, raw: bytes, entry: dict) -> bytes:
        if not self.members:
            self._open(DATA)
        at = self.members[-1]["size"]
        self.lines.append(f"{entry['url']} {re.sub(r'[^0-9]', '', DATE)} {json.dumps({'offset': str(at), 'length': str(len(raw)), 'filename': DATA, 'type': entry['type']})}\n")
        return self._part(raw)

    def finish(self) -> Iterator[bytes]:
        self._close()
        self._open(INDEX)
        for line in self.lines:
            yield self._part(line.encode())
        self._close()
        directory, begin = b"", self.offset + len(self.pending)
        for m in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["header"])
            directory += (CENTRAL + struct.pack("<HHHHHH", 45, 45, 8, 0, 0, 0x21) + struct.pack("<III", m["crc"], FULL, FULL)
                          + struct.pack("<HHHHHII", len(m["name"]), len(extra), 0, 0, 0, 0, FULL) + m["name"].encode() + extra)
        n, size = len(self.members), len(directory)
        end64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin)
        locator = LOCATOR + struct.pack("<IQI", 0, begin + size, 1)
        end = END + struct.pack("<HHHHIIH", 0, 0, n, n, FULL, FULL, 1)
        yield self.pending + directory + end64 + locator + end


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def members(read_at: Callable[[int, int], bytes], length: int) -> list[Member]:
    """Members by the central directory at the archive's end, with ZIP64 numbers where the short ones are full."""
    tail_at = max(0, length - TAIL)
    tail = read_at(tail_at, length - tail_at)
    at = tail.rfind(END, 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, begin = struct.unpack_from("<HII", tail, at + 10)
    if FULL in (size, begin) or count == 0xFFFF:
        locator = read_at(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, begin = struct.unpack_from("<QQQ", end64, 32)
    directory, found, p = read_at(begin, size), [], 0
    for _ in range(count):
        if directory[p:p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        stored, plain, n, e, c = struct.unpack_from("<IIHHH", directory, p + 20)
        header, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46:p + 46 + n].decode("utf-8", "replace")
        extra, q = directory[p + 46 + n:p + 46 + n + e], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                plain = wide.pop(0) if plain == FULL and wide else plain
                stored = wide.pop(0) if stored == FULL and wide else stored
                header = wide.pop(0) if header == FULL and wide else header
            q += 4 + width
        found.append(Member(name, method, plain, stored, header))
        p += 46 + n + e + c
    return found


def data_offset(read_at: Callable[[int, int], bytes], member: Member) -> int:
    head = read_at(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    n, e = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + e


def record_ranges(read_at: Callable[[int, int], bytes], length: int) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) of every record that the archive's indexes list in a stored member."""
    found = {m.name: m for m in members(read_at, length)}
    for index in (m for m in found.values() if m.name.startswith("indexes/") and m.method == 0):
        at, left, rest = data_offset(read_at, index), index.size, b""
        starts: dict[str, int] = {}
        while left:
            chunk = read_at(at, min(left, BATCH_BYTES))
            at, left = at + len(chunk), left - len(chunk)
            lines = (rest + chunk).split(b"\n")
            rest = lines.pop()
            for line in lines:
                entry = json.loads(line[line.rindex(b" {"):] if b" {" in line else line)
                member = found.get(entry["filename"]) or found["archive/" + entry["filename"]]
                if member.method != 0:
                    raise ValueError(f"{member.name} is compressed, its records cannot be read by range")
                if member.name not in starts:
                    starts[member.name] = data_offset(read_at, member)
                yield starts[member.name] + int(entry["offset"]), int(entry["length"])


# ---- Spark ---------------------------------------------------------------------------------------------------

def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive per partition, as rows in order."""
    writer, rows, held = ArchiveWriter(), [], 0
    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            raw = page_record(page_id, url, html or b"", digest, refers_to)
            rows.append(writer.record(raw, {"url": re.sub(r"\s+", "%20", url or "-"), "type": "response" if refers_to is None else "revisit"}))
            held += len(raw)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["part"])
                rows, held = [], 0
    if writer.members:
        for part in writer.finish():
            rows.append(part)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["part"])
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["part"])


def with_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, html as bytes, digest, refers_to): of equal payloads the largest page_id is kept whole.

    Payloads are grouped by digest alone; the texts are only read again to be written.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    seen = scratch.keep(rows.select("page_id", "digest", F.octet_length("html").alias("n")).filter(F.col("n") >= LEAST_SHARED), "digests")
    top = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("m")).filter("m > 1 and refers_to is not null").select("digest", "refers_to")
    again = scratch.keep(seen.join(top, "digest").filter("page_id is null or page_id <> refers_to").select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "refers_to").distinct(), "revisits")
    return (rows.join(again, (F.col("digest") == F.col("__d")) & F.col("page_id").eqNullSafe(F.col("__p")), "left")
            .select("page_id", "url", "html", "digest", "refers_to"))


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> None:
    """Pages as ZIP archives of WARC records, one per partition, by Spark's own committed file writes."""
    parts = with_revisits(pages, scratch).mapInArrow(_write, "part binary")
    # the cast keeps the bytes as they are
    parts.select(F.col("part").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _opened(path: str) -> Callable[[int, int], bytes]:
    """Range reads of a file that every executor reaches."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)))
    handle = store.open_input_file(name)
    return lambda offset, n: handle.read_at(n, offset)


def _in_memory(content: bytes) -> Callable[[int, int], bytes]:
    return lambda offset, n: content[offset:offset + n]


def _list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ranges = list(record_ranges(_opened(path), length))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges), pa.string()), pa.array([a for a, _ in ranges], pa.int64()), pa.array([n for _, n in ranges], pa.int64())], ["path", "offset", "length"])


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _fields(raw: bytes, payloads: bool) -> tuple:
    headers, http, payload = parse_record(raw)
    named = lambda key: int(x) if (x := headers.get(key, "").strip("<>").removeprefix(PAGE)) else None
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = headers["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    return named("warc-record-id"), size, digest, kind, named("warc-refers-to"), headers.get("warc-target-uri", ""), payload if payloads and kind == "response" else None


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], [x.split()[0] for x in RECORD.split(", ")])


def _read_ranges(payloads: bool):
    """Rows (path, offset, length) sorted by path and offset; neighbours are fetched together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read_at = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            begin = 0
            while begin < len(rows):
                end, stop = begin + 1, rows[begin][1] + rows[begin][2]
                while (end < len(rows) and rows[end][0] == rows[begin][0] and 0 <= rows[end][1] - stop <= NEAR and rows[end][1] + rows[end][2] - rows[begin][1] <= BATCH_BYTES):
                    stop, end = rows[end][1] + rows[end][2], end + 1
                if rows[begin][0] != path:
                    path = rows[begin][0]
                    read_at = _opened(path)
                first = rows[begin][1]
                data = read_at(first, stop - first)
                yield _rows([_fields(data[o - first:o - first + n], payloads) for _, o, n in rows[begin:end]])
                begin = end

    return run


def _read_whole(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                read_at = _in_memory(content)
                yield _rows([_fields(read_at(o, n), payloads) for o, n in record_ranges(read_at, len(content))])

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of all archives in a folder (see RECORD). Directory and index first, then the records by range, nothing extracted.

    Where only Spark can open the store, archives come whole through its binary file source and the same parser.
    """
    files = spark.read.format("binaryFile").load(folder).filter("length > 0")
    if re.match(r"(file|hdfs|s3[an]?|gs|abfss?):|/", folder):
        ranges = files.select("path", "length").repartition(F.col("path")).mapInArrow(_list_records, "path string, offset long, length long")
        near = ranges.withColumn("__part", F.floor(F.col("offset") / (BATCH_BYTES * 4))).repartition("path", "__part").sortWithinPartitions("path", "offset")
        return near.select("path", "offset", "length").mapInArrow(_read_ranges(payloads), RECORD)
    return files.select("content").mapInArrow(_read_whole(payloads), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page and read all back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Defined results: null html is an empty payload; rows that repeat the largest page_id of a payload are all
    responses; of equal payloads rows without page_id revisit the largest page_id, or are all responses where none has an id;
    a null url is empty; an empty table gives an empty result; columns other than page_id, url and html are not read.
    """
    scratch = Scratch(pages.sparkSession)
    write_archives(pages, scratch.path("archives"), scratch)
    return read_archives(pages.sparkSession, scratch.path("archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip_sql() -> str:
    return f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
t as (select *, case when n >= {LEAST_SHARED} then max(page_id) over (partition by h) end as top from p)
select page_id, n::bigint as payload_bytes, h as payload_digest, case when top is null or top = page_id then 'response' else 'revisit' end as record_type,
  case when top <> page_id or (top is not null and page_id is null) then top end as refers_to from t"""
