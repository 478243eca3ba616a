"""WARC archives: a writer with identical-payload revisits and a salvage reader.

Writing: Spark finds equal payloads by SHA-1 (small rows only: page, digest,
size), the smallest page id of each becomes the response and the others revisit
it; then every task writes its pages, one gzip member a record, to archives in a
shared folder.  An archive appears by a rename and has a name made from its
partition, so a task that runs again replaces it with the same bytes.

Reading: a record is taken only if its member, header, length and block digest
hold.  After a failed check the reader searches for the next gzip member or
`WARC/1.` line that does hold, goes on from there, and logs the bytes between as
a quarantined gap with the reason.  Inside a member it does the same with the
content, also with what a damaged or cut off member still gives (there a record
needs a block digest); such gaps have the member's place in the archive.

Cases: a null payload is empty; a null URL is written as empty; rows that share
the smallest page id of a payload are all responses; a row without page id is a
revisit of a payload that has one, else a response; no pages, no archives; other
columns are ignored.  A task holds one archive (rolled at `archive_bytes`) or one
record, whichever is more.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalscale.llm.common import cut, join_small, scratch

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 0
PIECE = 1 << 14
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(text: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: the HTTP head, and the payload unless it revisits another page's."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = field(repr=False)


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Bad(ValueError):
    pass


_TOKEN = re.compile(rb"[!-9;-~]+")


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at a position of plain bytes, and where it ends; Bad if any check fails."""
    if not data.startswith(b"WARC/1.", at):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("header without end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not _TOKEN.fullmatch(name) or b"\r" in value or b"\n" in value:
            raise Bad("malformed header line")
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", headers.get("content-length", "")):
        raise Bad("no content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if stop + 4 > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("length does not fit")
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise Bad("block digest differs")
    return Record(headers, block), stop + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A gzip member's content, and where it ends; Bad if it is damaged or cut off."""
    z, out, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not z.eof and pos < len(data):  # piece by piece: what follows a member is handed back as a copy
            out.append(z.decompress(view[pos : pos + PIECE]))
            pos += PIECE
    except zlib.error as e:
        raise Bad(f"gzip: {e}") from None
    if not z.eof:
        raise Bad("gzip: cut off")
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def inflate_some(data: bytes, at: int, size: int | None = None) -> tuple[bytes, int]:
    """What a damaged member gives up to its damage (or `size` bytes of it), and how far it was read."""
    z, out, total, pos, step, view = zlib.decompressobj(31), [], 0, at, PIECE, memoryview(data)
    while not z.eof and pos < len(data) and (size is None or total < size):
        before = z.copy()
        try:
            piece = z.decompress(view[pos : pos + step])
        except zlib.error:
            piece = None
        if step > 1 and (piece is None or size is not None and total + len(piece) >= size):
            z, step = before, 1
            continue
        if piece is None:
            break
        out.append(piece)
        total, pos = total + len(piece), pos + step
    return b"".join(out), min(pos, len(data))


_VERSION = re.compile(rb"WARC/1\.")


def content_records(content: bytes, sound: bool) -> list[tuple[int, int, Record | str]]:
    """Records that hold in a member's content, and the reasons of gaps, with their places; without a sound checksum of the member, records need a digest."""

    def holds(at: int) -> tuple[Record, int]:
        record, end = parse(content, at)
        if not sound and not record.headers.get("warc-block-digest", "").startswith("sha1:"):
            raise Bad("no block digest in a damaged member")
        return record, end

    out, pos, found = [], 0, None
    while pos < len(content):
        try:
            record, end = found or holds(pos)
            out.append((pos, end, record))
            pos, found = end, None
        except Bad as e:
            start, pos = pos, len(content)
            for m in _VERSION.finditer(content, start + 1):
                try:
                    found = holds(m.start())
                except Bad:
                    continue
                pos = m.start()
                break
            out.append((start, pos, str(e)))
    return out


def member_records(data: bytes, at: int) -> tuple[list[tuple[int, int, Record | str]], int, str | None]:
    """What a member's content holds, where the member ends, and how it is damaged, if it is."""
    try:
        content, end = inflate(data, at)
        return content_records(content, True), end, None
    except Bad as e:
        content, end = inflate_some(data, at)
        return content_records(content, False), end, str(e)


_MEMBER = re.compile(rb"\x1f\x8b\x08")


def unit(data: bytes, at: int) -> tuple[list[Record | Gap], int, str | None]:
    """What stands at a position: one plain record, or a member's records that hold and gaps; its end, or for a damaged member where to search on and why."""
    if not data.startswith(b"\x1f\x8b", at):
        record, end = parse(data, at)
        return [record], end, None
    own, end, damage = member_records(data, at)
    held = [stop for _, stop, x in own if isinstance(x, Record)]
    lost = next((start for start, _, x in own if not isinstance(x, Record)), None)
    if damage is not None and held and lost is not None and lost < held[-1]:
        # past the first gap, the damaged member may have run into the next one
        for m in _MEMBER.finditer(data, max(at + 1, inflate_some(data, at, lost)[1])):
            if any(isinstance(x, Record) for _, _, x in member_records(data, m.start())[0]):
                own, end, damage = member_records(data[: m.start()], at)
                held = [stop for _, stop, x in own if isinstance(x, Record)]
                break
    if not held:
        raise Bad(damage or next((x for _, _, x in own), "empty member"))
    reason = None
    if damage is not None:
        reason = f"{damage}, after {held[-1]} bytes of content"
        own = [x for x in own if x[1] <= held[-1]]
        end = max(at + 1, inflate_some(data, at, held[-1])[1])
    return [x if isinstance(x, Record) else Gap(at, end, f"{x}: bytes {a} to {b} of the member") for a, b, x in own], end, reason


_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that hold, in order, and a gap for every run of bytes that belongs to none (for a part of a member, with the member's place)."""
    at, n, found = 0, len(data), None
    while at < n:
        start = at
        try:
            items, at, reason = found or unit(data, at)
        except Bad as e:
            items, at, reason = [], at + 1, str(e)
        found = None
        yield from items
        if reason is None:
            continue
        search, at = at, n
        for m in _NEXT.finditer(data, search):
            try:
                found = unit(data, m.start())
            except Bad:
                continue
            at = m.start()
            break
        yield Gap(start, at, reason)


WRITTEN = "path string, records long, bytes long"


def write_archives(pages: DataFrame, directory: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives and returns their manifest (path, records, bytes)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    small = keyed.select("page_id", "digest", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= min_revisit_bytes)
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = cut(small.drop("bytes").distinct().join(firsts, "digest").where("page_id is null or page_id <> refers_to"), "revisits")
    right = revisits.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    decided = join_small(keyed, right, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left", 120)

    def write(batches):
        target, folder = pafs.FileSystem.from_uri(directory)
        target.create_dir(folder, recursive=True)
        task = TaskContext.get()
        pid, attempt = task.partitionId(), task.taskAttemptId()
        buffer, size, records, number, made = [], 0, 0, 0, []

        def close():
            nonlocal buffer, size, records, number
            if records:
                name = f"{pid:07d}-{number:05d}.warc.gz"
                draft = f"{folder}/.{name}.{attempt}"
                with target.open_output_stream(draft, compression=None) as out:
                    for b in buffer:
                        out.write(b)
                target.move(draft, f"{folder}/{name}")
                made.append((f"{directory}/{name}", records, size))
                buffer, size, records, number = [], 0, 0, number + 1

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                data = member(encode_record(page_id, url, payload, sha1_base32(payload), refers_to))
                buffer.append(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["path", "records", "bytes"])

    return cut(decided.select("page_id", "url", "html", "refers_to").mapInArrow(write, WRITTEN), "manifest")


READ = "kind string, path string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_start long, gap_end long, reason string"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of kind `record` and of kind `gap` from the archives of a manifest (its `path` column)."""
    names = [f.split()[0] for f in READ.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in READ.split(", ")])

    def row(path: str, x: Record | Gap) -> dict:
        if isinstance(x, Gap):
            return {"kind": "gap", "path": path, "gap_start": x.start, "gap_end": x.end, "reason": x.reason}
        h = x.headers
        head, _, payload = x.block.partition(b"\r\n\r\n")
        out = {"kind": "record", "path": path, "page_id": int(h["x-page-id"]) if h.get("x-page-id") else None, "url": h.get("warc-target-uri"), "record_type": h.get("warc-type")}
        if h.get("warc-type") == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            return out | {"payload_bytes": int(length[1]) if length else None, "payload_digest": h.get("warc-payload-digest", "")[5:], "refers_to": int(h["x-refers-to-page-id"]) if h.get("x-refers-to-page-id") else None}
        return out | {"payload_bytes": len(payload), "payload_digest": sha1_base32(payload), "payload": payload if payloads else None}

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, place = pafs.FileSystem.from_uri(path)
                with source.open_input_stream(place, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for x in salvage(data):
                    rows.append(row(path, x))
                    held += len(x.block) if payloads and isinstance(x, Record) else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema=schema)

    n = max(1, min(manifest.count(), 20_000))
    return manifest.select("path").repartition(n, "path").mapInArrow(read, READ)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns the records read back from them."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"), archive_bytes, min_revisit_bytes)
    return read_archives(manifest, payloads=False).where("kind = 'record'")
