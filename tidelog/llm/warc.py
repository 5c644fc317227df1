"""Operator 8: WARC files as a Spark data source.

Partitions are files. Predicates on the record type and headers are pushed down: a
record's headers are parsed first; where a predicate fails, its payload is neither
read (plain files, and gzip members of one record that carry skip lengths) nor kept
(other gzip members, which have to be inflated to find their end). A gzip member may
hold several records, or the whole file.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").option("path", folder).option("record_type", "response").load()

Predicates are options: record_type; header.<name> for any header; min_length and
max_length of the content. With option pushdown=true those of where() are taken too, on
the record type, the typed headers and the content length, if the session has
spark.sql.python.filterPushdown.enabled. That is not the default: Spark 4.1 keeps pushed
filters with the loaded relation, so another query over the same DataFrame without a
filter would miss records. Such a DataFrame is for one query.
"""

from __future__ import annotations

import operator
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from tidelog.llm.shared import cut, map_arrow
from tidelog.session import scratch_folder, ship
from tidelog.sources.storage import list_files, open_folder, publish

BATCH_BYTES = 8 << 20
SCHEMA = "file string, offset long, record_type string, record_id string, target_uri string, date string, content_type string, content_length long, headers map<string,string>, payload binary"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_STEP = 1 << 16


class WarcError(ValueError):
    pass


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header names in lower case -> values; folded lines are joined, later values of a name win."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class Source:
    """Bytes of a record's stream: plain, or one gzip member at a time."""

    def __init__(self, f, at: int, size: int, gz: bool):
        self.f, self.at, self.size, self.gz = f, at, size, gz

    def records(self) -> Iterator[tuple[int, dict[str, str], "Body"]]:
        """(offset, headers, body). The body may be read or not before the next record is asked for."""
        while self.at < self.size:
            start = self.at
            body = Body(self, start)
            head = body.head()
            if head is None and not self.gz:
                return
            while head is not None:
                yield start, head, body
                head = body.head() if body.passed() else None
            self.at = body.finish()


class Body:
    def __init__(self, source: Source, start: int):
        self.s, self.buffer, self.next, self.end, self.inflate, self.eof = source, bytearray(), start, None, None, False
        self.whole, self.read = None, 0  # bytes of the member once inflated, if it tells; bytes of its first header
        if source.gz:
            source.f.seek(start)
            head = source.f.read(12)
            if head[:3] != b"\x1f\x8b\x08":
                raise WarcError(f"no gzip member at {start}")
            self.inflate = zlib.decompressobj(31)
            if head[3] & 4:
                (width,) = struct.unpack_from("<H", head, 10)
                extra, e = source.f.read(width), 0
                while e + 4 <= len(extra):
                    (n,) = struct.unpack_from("<H", extra, e + 2)
                    if extra[e : e + 2] == b"sl" and n == 8:
                        size, self.whole = struct.unpack_from("<II", extra, e + 4)
                        self.end = start + size
                    e += 4 + n

    def more(self) -> bool:
        """Takes in the next bytes; False at the end of the record's stream."""
        if self.eof:
            return False
        self.s.f.seek(self.next)
        limit = _STEP if self.end is None else min(_STEP * 16, self.end - self.next)
        raw = self.s.f.read(max(limit, 0))
        if not raw:
            self.eof = True
            return False
        if self.inflate is None:
            self.next += len(raw)
            self.buffer += raw
            return True
        self.buffer += self.inflate.decompress(raw)
        self.next += len(raw)
        if self.inflate.eof:
            self.next -= len(self.inflate.unused_data)
            self.eof = True
        return True

    def head(self) -> dict[str, str] | None:
        while (cut_at := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > 1 << 20:
                raise WarcError("headers of more than 1 MB")
            if not self.more():
                if self.buffer.strip():
                    raise WarcError("the file ends inside a header")
                return None
        skip = len(self.buffer) - len(self.buffer.lstrip(b"\r\n")) if self.buffer[:1] in (b"\r", b"\n") else 0
        if skip:
            del self.buffer[:skip]
            self.read += skip
            return self.head()
        headers = parse_headers(bytes(self.buffer[:cut_at]))
        del self.buffer[: cut_at + 4]
        self.read += cut_at + 4
        try:
            self.length = int(headers.get("content-length", "0"))
        except ValueError as e:
            raise WarcError("bad Content-Length") from e
        self.taken = self.next - len(self.buffer) if self.inflate is None else 0
        return headers

    def payload(self) -> bytes:
        while len(self.buffer) < self.length:
            if not self.more():
                raise WarcError("the file ends inside a payload")
        return bytes(self.buffer[: self.length])

    def passed(self) -> bool:
        """Goes to the end of the record and says whether its gzip member goes on; not in plain files, nor if the member tells that it ends there."""
        if self.inflate is None or self.whole is not None and self.whole == (self.read + self.length + 4) & 0xFFFFFFFF:
            return False
        self.whole = None
        left = self.length
        while left > len(self.buffer):
            left -= len(self.buffer)
            self.buffer.clear()
            if not self.more():
                raise WarcError("the file ends inside a payload")
        del self.buffer[:left]
        while True:
            del self.buffer[: len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))]
            if self.buffer:
                return True
            if not self.more():
                if not self.inflate.eof:
                    raise WarcError("the file ends inside a gzip member")
                return False

    def finish(self) -> int:
        """Where the next record begins, by as little reading as the format allows."""
        if self.inflate is None:
            return self.taken + self.length + 4
        if self.end is not None:
            return self.end
        while not self.eof:
            self.buffer.clear()
            if not self.more():
                raise WarcError("the file ends inside a gzip member")
        return self.next


class FilePart(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("option path is missing")
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, str, tuple]] = [("in", k[len("header.") :].lower(), (v,)) for k, v in options.items() if k.lower().startswith("header.")]
        if "record_type" in options:
            self.wanted.append(("in", "warc-type", (options["record_type"],)))
        self.lengths: list[tuple[type, int]] = [(kind, int(options[k])) for k, kind in (("min_length", GreaterThanOrEqual), ("max_length", LessThanOrEqual)) if k in options]

    def partitions(self) -> list[FilePart]:
        return [FilePart(p, n) for p, n in list_files(self.path, (".warc", ".warc.gz"))] or [FilePart("", 0)]

    def passes(self, headers: dict[str, str], length: int) -> bool:
        if not all(_COMPARE[kind](length, value) for kind, value in self.lengths):
            return False
        for kind, name, values in self.wanted:
            value = headers.get(name)
            if value is None or kind == "in" and value not in values or kind == "starts" and not value.startswith(values[0]):
                return False
        return True

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = open_folder(self.path)
        name = part.path.rsplit("/", 1)[-1]
        rows, held = [], 0
        with fs.open_input_file(part.path) as f:
            for offset, headers, body in Source(f, 0, part.size, part.path.endswith(".gz")).records():
                if not self.passes(headers, body.length):
                    continue
                payload = body.payload() if self.with_payload else None
                rows.append((name, offset, *(headers.get(_HEADER[c]) for c in ("record_type", "record_id", "target_uri", "date", "content_type")), body.length, list(headers.items()), payload))
                held += 500 + len(payload or b"")
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


class PushingReader(WarcReader):
    """The reader that takes filters from Spark; a reader with this method is refused where the session has filter pushdown off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in _HEADER and isinstance(f, EqualTo):
                self.wanted.append(("in", _HEADER[name], (f.value,)))
            elif name in _HEADER and isinstance(f, In):
                self.wanted.append(("in", _HEADER[name], tuple(f.value)))
            elif name in _HEADER and isinstance(f, StringStartsWith):
                self.wanted.append(("starts", _HEADER[name], (f.value,)))
            elif name in _HEADER and isinstance(f, IsNotNull):
                self.wanted.append(("there", _HEADER[name], ()))
            elif name == "content_length" and type(f) in _COMPARE:
                self.lengths.append((type(f), int(f.value)))
            elif name == "content_length" and isinstance(f, IsNotNull):
                pass  # it always is
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    """The "warc" format; see the module."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown", "false").lower() == "true" else WarcReader)(options)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, offset, record_type, record_id, target_uri, date, content_type, content_length, headers, payload): a row for each record.

    Header names in `headers` are in lower case. With option payload=false payloads are
    null and not decoded; the other options are predicates, see the module.

    Cases: an empty folder or file gives no rows, a missing folder is an error; a header
    that a record lacks is null; of a repeated header the last value counts; an empty
    payload is empty, not null; repeated records are all returned; records of one gzip
    member share its offset; a cut or malformed record is an error that names the fault.
    """
    ship(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, **options).load()


def record(headers: list[tuple[str, str]], payload: bytes, level: int = 1) -> bytes:
    """One WARC/1.1 record as a gzip member that carries its skip lengths."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(payload)}".encode()]
    raw = b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """One .warc.gz a task: a warcinfo record, then for each page a request and a response; returns (file, records).

    Cases: a null id or html writes no records; a null url leaves out the target URI;
    line ends in a url are percent-encoded; a task without pages writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[0] is not None and r[2] is not None)
        first = next(rows, None)
        if first is None:
            return
        count = 1
        with publish(folder, name) as out:
            date = ("WARC-Date", "2024-01-01T00:00:00Z")
            out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:tidelog:file:{name}>"), date, ("Content-Type", "application/warc-fields")], b"software: tidelog\r\n"))
            row = first
            while row is not None:
                page, url, html = row
                target = [] if url is None else [("WARC-Target-URI", _clean(url))]
                host = _clean(url or "").split("://", 1)[-1].split("/", 1)[0]
                out.write(record([("WARC-Type", "request"), ("WARC-Record-ID", f"<urn:tidelog:request:{page}>"), date, *target, ("Content-Type", "application/http; msgtype=request")], f"GET / HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()))
                out.write(record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:tidelog:page:{page}>"), date, *target, ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode()))
                count += 2
                row = next(rows, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["file", "records"])

    return map_arrow(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), run, "file string, records long")


def page_responses(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, status, content_type, n_bytes, md5, html): the pages' responses, read back from WARC files in the shared folder.

    Cases: as in write_pages() and read_warc().
    """
    folder = scratch_folder(spark, "warc")
    cut(write_pages(pages, folder))
    found = read_warc(spark, folder, record_type="response")
    text = F.decode("payload", "UTF-8")
    at = F.instr(text, "\r\n\r\n")
    split = found.select("record_id", "target_uri", text.alias("text"), at.alias("at"))
    body = F.expr("substring(text, at + 4)")
    return split.select(
        F.regexp_extract("record_id", r"page:(-?\d+)>", 1).cast("long").alias("page_id"), F.col("target_uri").alias("url"),
        F.regexp_extract("text", r"^HTTP/\S+ (\d+)", 1).cast("int").alias("status"), F.regexp_extract("text", r"(?i)\r\ncontent-type: ([^;\r]+)", 1).alias("content_type"),
        F.octet_length(body).cast("long").alias("n_bytes"), F.md5(body).alias("md5"), body.alias("html"),
    )
