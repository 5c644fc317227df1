"""Operator 2: media columns. A Spark data source over folders of ZIP and TAR archives.

Partitions are byte ranges. Planning walks each archive's directory once (the ZIP
central directory, or the chain of TAR headers), several archives at a time, and cuts it
where the members so far hold about RANGE_BYTES: a partition is a slice of the central
directory, or the bytes from one TAR header to another. So a task reads only its own
part of a directory, whatever the archive's size, and streams payloads in offset order
in bounded Arrow batches. A member that fails to read or to match its checksum is tried
again by its offset, without touching the others; when its attempts are spent, its row
has a null payload and the error.

    spark.dataSource.register(MediaSource)
    spark.read.format("media").option("path", folder).load()

Options: path; range_bytes (default 32 MB); batch_bytes (8 MB); attempts (3); mode
"permissive" (default) or "failfast"; payload ("true"), with "false" only directories are
read, as Spark tells a Python source nothing about the columns it needs.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.llm.shared import cut, map_arrow
from tidelog.session import scratch_folder, ship
from tidelog.sources.storage import list_files, open_folder, publish

RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 3
#: Archives whose directories are walked at a time; bytes read of a directory at once.
PLANNERS = 16
_STEP = 1 << 20
_COMPRESSED = tuple(f"{a}{b}" for a in (".tar", ".t") for b in (".gz", ".bz2", ".xz", ".zst", "gz", "bz2", "xz", "zst"))
SCHEMA = "archive string, member string, offset long, size long, crc32 long, media_type string, payload binary, attempts int, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("crc32", pa.int64()), ("media_type", pa.string()), ("payload", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])
_MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"%PDF", "application/pdf"), (b"OggS", "audio/ogg"), (b"ID3", "audio/mpeg"), (b"fLaC", "audio/flac"), (b"\x1f\x8b", "application/gzip"))


def media_type(payload: bytes) -> str:
    """Media type by leading bytes."""
    for magic, name in _MAGIC:
        if payload.startswith(magic):
            return name
    if payload[:4] == b"RIFF":
        return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(payload[8:12], "application/octet-stream")
    if payload[4:8] == b"ftyp":
        return "video/mp4"
    head = payload[:256].lstrip().lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    return "application/octet-stream"


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of its header
    stored: int
    size: int
    crc: int | None
    method: int  # 0 stored, 8 deflated


@dataclass
class Range(InputPartition):
    path: str
    start: int  # in a ZIP of its central directory, in a TAR of its first header
    end: int
    extra: dict[str, str]  # what PAX global headers before it said


class ArchiveError(OSError):
    pass


def zip_directory(f, length: int) -> tuple[int, int, int]:
    """(offset, size, members) of the central directory, ZIP64 fields included."""
    tail_at = max(0, length - 65_557)
    f.seek(tail_at)
    tail = f.read(length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ArchiveError("no central directory")
    count, size, begin = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, begin):
        where = struct.unpack_from("<Q", tail, tail.rfind(b"PK\x06\x07", 0, at) + 8)[0]
        f.seek(where)
        count, size, begin = struct.unpack_from("<QQQ", f.read(56), 32)
    return begin, size, count


def zip_entries(f, start: int, end: int) -> Iterator[tuple[int, int, Member | None]]:
    """(begin, end, member) of the entries of a central directory's slice; None for folders."""
    at, raw, base = start, b"", start
    while at < end:
        if at + 46 > base + len(raw) or at + 46 + sum(struct.unpack_from("<HHH", raw, at - base + 28)) > base + len(raw):
            f.seek(at)
            raw, base = f.read(min(end - at, _STEP)), at
        here = at - base
        if raw[here : here + 4] != b"PK\x01\x02" or len(raw) < here + 46:
            raise ArchiveError("bad central directory entry")
        flags, method, crc, stored, full, n, m, k, offset = struct.unpack_from("<HH4xIIIHHH8xI", raw, here + 8)
        if len(raw) < here + 46 + n + m + k:
            raise ArchiveError("bad central directory entry")
        name = raw[here + 46 : here + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[here + 46 + n : here + 46 + n + m], 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = [v[0] for v in struct.iter_unpack("<Q", extra[e + 4 : e + 4 + width // 8 * 8])]
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            e += 4 + width
        past = at + 46 + n + m + k
        yield at, past, None if name.endswith("/") else Member(name, offset, stored, full, crc, method)
        at = past


def pax_records(body: bytes) -> dict[str, str]:
    out = {}
    while body and body[:1] != b"\0":
        digits, _, rest = body.partition(b" ")
        if not digits.isdigit() or not 0 < int(digits) <= len(body):
            raise ArchiveError("bad PAX record")
        key, _, value = rest[: int(digits) - len(digits) - 1].rstrip(b"\n").partition(b"=")
        out[key.decode()] = value.decode("utf-8", "replace")
        body = body[int(digits) :]
    return out


def _number(field: bytes) -> int:
    if field[0] & 0x80:
        return int.from_bytes(field[1:], "big")
    text = field.strip(b"\0 ")
    if text and not text.isdigit():
        raise ArchiveError("bad number in a header")
    return int(text or b"0", 8)


def tar_entries(f, start: int, end: int, extra: dict[str, str]) -> Iterator[tuple[int, int, Member | None]]:
    """(begin, end, member) along the chain of headers from `start`; None for what is no regular file. Begin is that of the first header that belongs to the member.

    Only headers are read. GNU long names and PAX records are known: a PAX size counts
    before the header's, and global records (`extra`, which is updated) before both lack.
    """
    at, begin, own, long_name = start, start, {}, None
    while at + 512 <= end:
        f.seek(at)
        head = f.read(512)
        if head == bytes(512):
            return
        if sum(head[:148]) + 8 * 32 + sum(head[156:]) != _number(head[148:156]):
            raise ArchiveError(f"bad header at {at}")
        size, kind = _number(head[124:136]), head[156:157]
        if kind in b"LKxg":
            if size > _STEP:
                raise ArchiveError(f"an extended header of {size} bytes at {at}")
            body = f.read(size)
            if kind == b"L":
                long_name = body.split(b"\0")[0].decode("utf-8", "replace")
            elif kind == b"x":
                own = pax_records(body)
            elif kind == b"g":
                extra.update(pax_records(body))
        else:
            if kind == b"S":
                raise ArchiveError(f"a sparse member at {at} is not supported")
            said = extra | own
            size = int(said["size"]) if said.get("size", "").isdigit() else size
            name = said.get("path") or long_name
            if not name:
                prefix = head[345:500].rstrip(b"\0") if head[257:262] == b"ustar" and head[263:265] != b" \0" else b""
                name = ((prefix + b"/" if prefix else b"") + head[:100].split(b"\0")[0]).decode("utf-8", "replace")
            size = size if kind in b"0\x007" or not kind.isdigit() else 0  # links, folders and devices have no bytes
            past = at + 512 + -(-size // 512) * 512
            regular = kind in b"0\x007" and not (kind == b"\0" and name.endswith("/"))  # old archives mark folders so
            yield begin, past, Member(name, at, size, size, None, 0) if regular else None
            own, long_name, begin = {}, None, past
        at += 512 + -(-size // 512) * 512


def entries(f, path: str, start: int, end: int, extra: dict[str, str]) -> Iterator[tuple[int, int, Member | None]]:
    return zip_entries(f, start, end) if is_zip(path) else tar_entries(f, start, end, extra)


def is_zip(path: str) -> bool:
    return path.lower().endswith(".zip")


def plan(fs, path: str, length: int, range_bytes: int) -> list[Range]:
    """The partitions of one archive, by one walk of its directory."""
    try:
        if not length:
            raise ArchiveError("an empty file is no archive")
        with fs.open_input_file(path) as f:
            start, end = 0, length
            if is_zip(path):
                start, size, _ = zip_directory(f, length)
                end = start + size
            out, extra, before, held, at, last = [], {}, {}, 0, start, start
            for begin, past, m in entries(f, path, start, end, extra):
                if held >= range_bytes:
                    out.append(Range(path, at, begin, before))
                    at, held, before = begin, 0, dict(extra)
                held += m.stored if m else 0
                last = past
            return [*out, Range(path, at, last, before)] if last > at else out
    except ArchiveError as e:
        raise ArchiveError(f"{path}: {e}") from e


def read_member(f, m: Member, is_zip: bool) -> bytes:
    """The checked payload of one member."""
    f.seek(m.offset)
    if not is_zip:
        f.seek(m.offset + 512)
        body = f.read(m.stored)
    else:
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ArchiveError("bad member header")
        n, k = struct.unpack_from("<HH", head, 26)
        f.seek(m.offset + 30 + n + k)
        body = f.read(m.stored)
    if len(body) != m.stored:
        raise ArchiveError("the archive ends inside the member")
    if m.method == 8:
        try:
            body = zlib.decompressobj(-15).decompress(body)
        except zlib.error as e:
            raise ArchiveError(str(e)) from e
    elif m.method:
        raise ArchiveError(f"compression method {m.method} is not supported")
    if len(body) != m.size or m.crc is not None and zlib.crc32(body) != m.crc:
        raise ArchiveError("checksum or length does not match")
    return body


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("option path is missing")
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.failfast = options.get("mode", "permissive").lower() == "failfast"
        self.with_payload = options.get("payload", "true").lower() != "false"

    def partitions(self) -> list[Range]:
        found = list_files(self.path, (".zip", ".tar", *_COMPRESSED))
        for path, _ in found:
            if path.lower().endswith(_COMPRESSED):
                raise ArchiveError(f"{path}: an archive compressed as a whole cannot be read by ranges")
        fs, _ = open_folder(self.path)
        with ThreadPoolExecutor(PLANNERS) as pool:
            planned = pool.map(lambda x: plan(fs, *x, self.range_bytes), found)
            return [r for own in planned for r in own] or [Range("", 0, 0, {})]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = open_folder(self.path)
        rows, held, archive = [], 0, part.path.rsplit("/", 1)[-1]
        opened = fs.open_input_file(part.path)
        try:
            members = [m for _, _, m in entries(opened, part.path, part.start, part.end, dict(part.extra)) if m]
            for m in sorted(members, key=lambda m: m.offset):
                payload = error = None
                tries = 0
                while self.with_payload and payload is None and tries < self.attempts:
                    tries += 1
                    try:
                        payload = read_member(opened, m, is_zip(part.path))
                        error = None
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(0.05 * (tries - 1))
                        opened.close()
                        opened = fs.open_input_file(part.path)
                if error and self.failfast:
                    raise ArchiveError(f"{part.path}, {m.name} at {m.offset}: {error}")
                crc = zlib.crc32(payload) if payload is not None else None if self.with_payload else m.crc
                rows.append((archive, m.name, m.offset, m.size, crc, None if payload is None else media_type(payload), payload, tries, error))
                held += 200 + (m.size if payload is not None else 0)
                if held >= self.batch_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
        finally:
            opened.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class MediaSource(DataSource):
    """The "media" format; see the module."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, member, offset, size, crc32, media_type, payload, attempts, error): a row for each member of the .zip and .tar files below `path`, whatever the case of their names' ends.

    Cases: an empty folder gives no rows, a missing one is an error; an empty member has
    an empty payload; members of one name are all returned, told apart by offset; a broken
    member has a null payload, crc32 and media_type and an error (mode failfast raises); an
    archive whose directory cannot be read is an error, so are a file of no bytes, a TAR
    that is compressed as a whole, and GNU sparse members; folders, links and devices
    inside archives are no members; an archive without members gives no rows. With
    payload=false, payload and media_type are null, attempts are 0, and crc32 is that of
    the ZIP directory.
    """
    ship(spark)
    spark.dataSource.register(MediaSource)
    return spark.read.format("media").options(path=path, **options).load()


def write_archives(rows: DataFrame, folder: str, name_col: str, payload_col: str, level: int = 1) -> DataFrame:
    """One ZIP a task of the rows' payloads under their names, in `folder`; returns (archive, members).

    Cases: a null name or null payload writes no member; repeated names are all written;
    a task without members writes no archive; the name's bytes are UTF-8. Archives carry
    ZIP64 fields only where a count or offset needs them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.zip"
        batches = (b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid())) for b in batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with publish(folder, name) as out:
            central, at, count = [], 0, 0

            def put(batch: pa.RecordBatch) -> None:
                nonlocal at, count
                for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = key.encode()
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
                    body = squeeze.compress(payload) + squeeze.flush()
                    crc = zlib.crc32(payload)
                    fields = struct.pack("<HHHHHIII", 20, 0x800, 8, 0, 0x21, crc, len(body), len(payload))
                    out.write(b"PK\x03\x04" + fields + struct.pack("<HH", len(raw), 0) + raw)
                    out.write(body)
                    extra = struct.pack("<HHQ", 1, 8, at) if at >= 0xFFFFFFFF else b""
                    central.append(b"PK\x01\x02" + struct.pack("<H", 45 if extra else 20) + fields + struct.pack("<HHHHHII", len(raw), len(extra), 0, 0, 0, 0, min(at, 0xFFFFFFFF)) + raw + extra)
                    at += 30 + len(raw) + len(body)
                    count += 1

            put(first)
            for b in batches:
                put(b)
            size = sum(map(len, central))
            for c in central:
                out.write(c)
            if count >= 0xFFFF or at + size >= 0xFFFFFFFF:
                out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, at))
                out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, at + size, 1))
            out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["archive", "members"])

    picked = rows.select(F.col(name_col).cast("string").alias("name"), F.col(payload_col).cast("binary").alias("payload"))
    return map_arrow(picked, run, "archive string, members long")


def page_media(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, member, size, media_type, md5, body, error): the pages' bodies through archives in the shared folder.

    Cases: as in write_archives() and read_media(); pages with a null id or null html have no member and so no row.
    """
    folder = scratch_folder(spark, "media")
    named = pages.withColumn("__member", F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")))
    cut(write_archives(named, folder, "__member", "html"))
    found = read_media(spark, folder)
    return found.select(F.regexp_extract("member", r"pages/(-?\d+)\.html", 1).cast("long").alias("page_id"), "member", "size", "media_type", F.md5("payload").alias("md5"), F.decode("payload", "UTF-8").alias("body"), "error")
