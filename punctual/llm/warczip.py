"""WARC records in ZIP packages: written member by member as a stream, read back by ranges.

A package holds two stored (uncompressed) members: archive/data.warc.gz, in which every record is a gzip
member of its own, and indexes/index.cdxj, which has the offset and length of every record. Readers look at the end record and the central directory
(with their ZIP64 forms), locate the members, read the index, and then only ranges of the archive
member: nothing is unpacked. Files are reached through pyarrow.fs at the URI of the shared folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.llm.storage import dealt, new_folder, salted_left_join, stored

#: Fixed values of the ZIP format: signatures of its records, and the value that points to ZIP64 fields.
LOCAL, CENTRAL, END = 0x04034B50, 0x02014B50, 0x06054B50
END64, LOCATOR64, DESCRIPTOR = 0x06064B50, 0x07064B50, 0x08074B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of an archive that are read at once; a longer record is read whole.
RANGE = 4 << 20
_DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return system, path


class ZipStreamWriter:
    """Stored members, one after another, to an output that is never rewound. Sizes are always ZIP64."""

    def __init__(self, out):
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        # Bit 3: sizes and checksum follow the data; bit 11: the name is UTF-8.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)))
        self._put(raw + extra)

    def write(self, data: bytes) -> int:
        """Offset of the data in its member."""
        offset = self.open[2]
        self._put(data)
        self.open[2] += len(data)
        self.open[3] = zlib.crc32(data, self.open[3])
        return offset

    def finish(self) -> None:
        raw, at, size, crc = self.open
        self._put(struct.pack("<IIQQ", DESCRIPTOR, crc, size, size))
        self.members.append(self.open)

    def close(self) -> None:
        start = self.at
        for raw, at, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32)
                + raw + extra
            )
        n, size, end = len(self.members), self.at - start, self.at
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def _range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends within bytes {start} to {start + length}")
    return data


def central_directory(file) -> list[tuple[str, int, int, int, int]]:
    """(name, method, size, stored size, offset of the local header) of every member."""
    total = file.size()
    tail_at = max(0, total - 22 - FULL16)
    tail = _range(file, tail_at, total - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (size, start):
        place = tail_at + at - 20
        if place >= 0:
            locator = struct.unpack("<IIQI", _range(file, place, 20))
            if locator[0] == LOCATOR64:
                end = struct.unpack("<IQHHIIQQQQ", _range(file, locator[2], 56))
                if end[0] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                count, size, start = end[7:10]
    directory, members, at = _range(file, start, size), [], 0
    for _ in range(count):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if head[0] != CENTRAL:
            raise ValueError("no central directory entry")
        method, packed, plain, offset = head[4], head[8], head[9], head[16]
        named, extra, comment = head[10:13]
        name = directory[at + 46 : at + 46 + named].decode("utf-8", "replace")
        fields, k = directory[at + 46 + named : at + 46 + named + extra], 0
        while k + 4 <= len(fields):
            kind, length = struct.unpack_from("<HH", fields, k)
            if kind == 1:
                # Only the values that don't fit their 32-bit place stand here, in this order.
                wide = iter(struct.unpack_from(f"<{length // 8}Q", fields, k + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            k += 4 + length
        members.append((name, method, plain, packed, offset))
        at += 46 + named + extra + comment
    return members


def stored_members(file) -> dict[str, tuple[int, int]]:
    """Start of the data and size of every stored member; compressed members can't be read by ranges."""
    found = {}
    for name, method, size, _, offset in central_directory(file):
        if method == 0:
            head = struct.unpack("<IHHHHHIIIHH", _range(file, offset, 30))
            if head[0] != LOCAL:
                raise ValueError(f"no local header of {name}")
            found[name] = (offset + 30 + head[9] + head[10], size)
    return found


def compressed_archives(file) -> list[str]:
    """Archives that are compressed as members, whose records no range holds."""
    return [name for name, method, *_ in central_directory(file) if method and name.startswith("archive/")]


def record_ranges(file) -> Iterator[tuple[int, int]]:
    """(start, end) in the file of runs of whole records, about RANGE bytes each.

    Offsets come from the index members; an archive that no index names is walked record by record.
    """
    members = stored_members(file)
    places: dict[str, list[tuple[int, int]]] = {}
    for name in sorted(m for m in members if m.startswith("indexes/")):
        start, size = members[name]
        for line in _range(file, start, size).decode().splitlines():
            entry = json.loads(line[line.index("{") :])
            places.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    for name in sorted(m for m in members if m.startswith("archive/")):
        base, size = members[name]
        walk = _walk_gzip if name.endswith(".gz") else _walk
        entries = sorted(places[name]) if name in places else walk(file, base, size)
        first = last = None
        for offset, length in entries:
            if first is not None and (offset != last or last - first >= RANGE):
                yield base + first, base + last
                first = None
            first, last = offset if first is None else first, offset + length
        if first is not None:
            yield base + first, base + last


def _walk(file, base: int, size: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < size:
        head = _range(file, base + at, min(1 << 16, size - at))
        end, fields = _header(head, 0)
        length = end + int(fields["content-length"]) + 4
        yield at, length
        at += length


def _walk_gzip(file, base: int, size: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < size:
        member, end = zlib.decompressobj(31), at
        while not member.eof:
            chunk = _range(file, base + end, min(1 << 16, size - end))
            member.decompress(chunk)
            end += len(chunk)
        end -= len(member.unused_data)
        yield at, end - at
        at = end


def _header(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    return end + 4, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A response, or a revisit that keeps the HTTP header of its response and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if record_id is None else record_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of a range, plain or gzip members: type, ids, target, payload (None for revisits), its length and digest."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while at < len(data):
        body, fields = _header(data, at)
        end = body + int(fields["content-length"])
        content, http = _header(data, body)
        revisit = fields["warc-type"] == "revisit"
        payload = None if revisit else data[content:end]
        digest = fields["warc-payload-digest"].partition(":")[2]
        if not revisit and base32_sha1(payload) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
        yield {
            "record_type": fields["warc-type"],
            "id": _page(fields["warc-record-id"]),
            "target": fields["warc-target-uri"],
            "refers_to": _page(fields.get("warc-refers-to")),
            "payload_bytes": int(http["content-length"]) if revisit else len(payload),
            "payload_digest": digest,
            "payload": payload,
        }
        at = end + 4


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(value) if value.lstrip("-").isdigit() else None


def _writer(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = package = path = None
        index, n = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "refers_to", "revisit")]
            for k in range(batch.num_rows):
                record_id, url, payload, refers_to, revisit = (c[k].as_py() for c in columns)
                if package is None:
                    # A name of its own for every attempt: a lost attempt's file is in no manifest.
                    system, root = _open(folder)
                    system.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.zip"
                    path = f"{folder}/{name}"
                    out = system.open_output_stream(f"{root}/{name}")
                    package = ZipStreamWriter(out)
                    package.begin(ARCHIVE)
                raw = gzip.compress(record_bytes(record_id, url, payload, refers_to, revisit), 1, mtime=0)
                index.append((record_id, package.write(raw), len(raw)))
                n += 1
        if package is not None:
            package.finish()
            package.begin(INDEX)
            for record_id, offset, length in index:
                entry = {"filename": ARCHIVE, "offset": offset, "length": length}
                package.write(f"{record_id} {json.dumps(entry)}\n".encode())
            package.finish()
            package.close()
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0
) -> DataFrame:
    """Write a record per row into packages below folder, one per partition; returns (path, records).

    Of rows with equal payloads of at least `least` bytes that with the smallest id is a response, the
    others are revisits of it; shorter ones are all responses. A NULL payload is empty. Rows that share
    the smallest id are all responses; a NULL id is larger than any other, and rows of a payload that
    has only NULL ids are responses. A NULL url becomes urn:none. An empty table writes nothing.
    """
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload")})
    same = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    same = stored(same.where("n > 1 and first is not null").select("sha", "size", "first"), "equal-payloads")
    rows = salted_left_join(rows, same, ["sha", "size"], "id")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select("id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return stored(rows.mapInArrow(_writer(folder), "path string, records long"), "manifest")


def _locator(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, own = _open(path)
            with system.open_input_file(own) as file:
                if lost := compressed_archives(file):
                    raise ValueError(f"{path}: {', '.join(lost)} is compressed, not stored: its records can't be read")
                found = list(record_ranges(file))
            if found:
                starts, ends = zip(*found)
                yield pa.record_batch(
                    [pa.array([path] * len(found)), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                    names=["path", "start", "end"],
                )


def _reader(with_payload: bool):
    kinds = {"id": pa.int64(), "target": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"payload_bytes": pa.int64(), "payload_digest": pa.string()}
    kinds |= {"payload": pa.binary()} if with_payload else {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                system, own = _open(path)
                with system.open_input_file(own) as file:
                    found = list(parse_records(_range(file, start, end - start)))
                yield pa.record_batch([pa.array([r[n] for r in found], t) for n, t in kinds.items()], names=list(kinds))

    return run


def read_archives(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the packages in the column path: id, target, record_type, refers_to, payload_bytes, payload_digest, payload.

    First the packages are located in (directories and indexes only), then their ranges are dealt out
    and read. A package with a compressed archive is an error. Payloads are checked against their digests. Revisits have a NULL payload; its length and
    digest are those of the payload they stand for.
    """
    ranges = stored(packages.select("path").mapInArrow(_locator, "path string, start long, end long"), "ranges")
    schema = "id long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    return dealt(ranges, ranges.count(), "path", "start").mapInArrow(_reader(with_payload), schema + (", payload binary" if with_payload else ""))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, from archives written of them."""
    manifest = write_archives(pages, new_folder(spark, "archives"))
    records = read_archives(manifest, with_payload=False)
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
