"""Operators 2 and 8: archives and WARC files written by others, and by this package; broken ones too."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringStartsWith

from tidelog.llm import media, warc
from tidelog.sources import storage as files

MEMBERS = {f"dir/file-{i}-é.bin": bytes([i % 251]) * (i * 137 % 5000) + b"\x89PNG" for i in range(60)} | {"empty": b"", "big": b"RIFF\0\0\0\0WAVE" + b"s" * 3_000_000}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    with zipfile.ZipFile(at / "a.zip", "w") as z:
        for i, (k, v) in enumerate(MEMBERS.items()):
            z.writestr(k, v, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.mkdir("empty-folder")
    (at / "sub").mkdir()
    with tarfile.open(at / "sub" / "b.tar", "w", format=tarfile.PAX_FORMAT) as t:
        for k, v in (MEMBERS | {"long/" * 60 + "name": b"deep"}).items():
            info = tarfile.TarInfo(k)
            info.size = len(v)
            t.addfile(info, io.BytesIO(v))
    return at


@pytest.mark.parametrize("range_bytes", [1 << 30, 100_000])
def test_members_of_archives(spark, folder, range_bytes):
    df = media.read_media(spark, str(folder), range_bytes=range_bytes, batch_bytes=20_000)
    got = {(r.archive, r.member): bytes(r.payload) for r in df.collect()}
    assert got == {("a.zip", k): v for k, v in MEMBERS.items()} | {("b.tar", k): v for k, v in (MEMBERS | {"long/" * 60 + "name": b"deep"}).items()}
    assert df.where("media_type = 'audio/wav'").count() == 2 and df.where("attempts <> 1 or error is not null").isEmpty()


def test_tar_sizes_and_global_records(spark, tmp_path):
    """Sizes in PAX records count, global ones too; links, folders and long link names are passed over."""
    with open(tmp_path / "B.TAR", "wb") as out:
        for name, body in (("x", b"1" * 700), ("y", b"2" * 3), ("", b""), ("z" * 300, b"3" * 513)):
            if not name:
                record = b"20 comment=anything\n"
                head = tarfile.TarInfo("global")
                head.type, head.size = tarfile.XGLTYPE, len(record)
                out.write(head.tobuf(tarfile.USTAR_FORMAT) + record.ljust(512, b"\0"))
                continue
            info = tarfile.TarInfo(name)
            info.pax_headers = {"size": str(len(body))}
            info.size = len(body)
            raw = bytearray(info.tobuf(tarfile.PAX_FORMAT))
            raw[-512 + 124 : -512 + 136] = b"0" * 11 + b"\0"  # the header itself has no size
            raw[-512 + 148 : -512 + 156] = b" " * 8
            raw[-512 + 148 : -512 + 156] = b"%06o\0 " % sum(raw[-512:])
            out.write(raw + body.ljust(-(-len(body) // 512) * 512, b"\0"))
        out.write(bytes(1024))
    with tarfile.open(tmp_path / "c.tar", "w", format=tarfile.GNU_FORMAT) as t:
        for kind, name, target in ((tarfile.DIRTYPE, "d", ""), (tarfile.SYMTYPE, "link", "t" * 200), (tarfile.LNKTYPE, "hard", "h"), (tarfile.REGTYPE, "n" * 150, ""), (tarfile.FIFOTYPE, "f", "")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, target
            t.addfile(info, io.BytesIO(b""))
    with tarfile.open(tmp_path / "B.TAR") as t:
        assert {m.name: m.size for m in t} == {"x": 700, "y": 3, "z" * 300: 513}
    for size in (1, 1 << 20):
        rows = media.read_media(spark, str(tmp_path), range_bytes=size).collect()
        assert {(r.archive, r.member): bytes(r.payload) for r in rows} == {("B.TAR", "x"): b"1" * 700, ("B.TAR", "y"): b"2" * 3, ("B.TAR", "z" * 300): b"3" * 513, ("c.tar", "n" * 150): b""}


class Counted:
    def __init__(self, f):
        self.f, self.reads = f, 0

    def read(self, n):
        self.reads += 1
        return self.f.read(n)

    def __getattr__(self, name):
        return getattr(self.f, name)

    def __enter__(self):
        return self

    def __exit__(self, *how):
        self.f.close()


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_directories_are_read_once(tmp_path, kind, monkeypatch):
    """Reads of headers grow with the members, not with members times ranges; every handle is closed."""
    seen = {}
    for n in (200, 800):
        path = tmp_path / f"{n}.{kind}"
        if kind == "zip":
            with zipfile.ZipFile(path, "w") as z:
                for i in range(n):
                    z.writestr(f"m{i}", bytes(500))
        else:
            with tarfile.open(path, "w") as t:
                for i in range(n):
                    info = tarfile.TarInfo(f"m{i}")
                    info.size = 500
                    t.addfile(info, io.BytesIO(bytes(500)))
        opened = []

        class Local:
            def open_input_file(self, at):
                opened.append(Counted(open(at, "rb")))
                return opened[-1]

        monkeypatch.setattr(media, "open_folder", lambda uri: (Local(), uri))
        for payload in ("false", "true"):
            opened.clear()
            reader = media.MediaReader({"path": str(path), "range_bytes": "5000", "payload": payload})
            parts = reader.partitions()
            rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
            assert len(parts) == n // 10 and len(rows) == n and {r["member"] for r in rows} == {f"m{i}" for i in range(n)}
            assert all((r["payload"] is None) == (payload == "false") for r in rows) and all(f.f.closed for f in opened)
            seen[n, payload] = sum(f.reads for f in opened)
    assert seen[800, "false"] <= 4.2 * seen[200, "false"] and seen[800, "true"] <= 4.2 * seen[200, "true"]


def test_what_is_no_archive(spark, tmp_path):
    for name, raw, said in (("a.zip", b"", "empty file"), ("a.tar", b"", "empty file"), ("a.zip", b"x" * 100, "central directory"), ("a.tar", b"x" * 600, "bad"), ("a.tar.gz", b"x", "compressed as a whole"), ("A.TGZ", b"x", "compressed as a whole")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=said):
            media.read_media(spark, str(tmp_path)).collect()
        (tmp_path / name).unlink()
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    with tarfile.open(tmp_path / "none.tar", "w"):
        pass
    assert media.read_media(spark, str(tmp_path)).collect() == []


def test_a_broken_member_does_not_touch_the_others(spark, folder, tmp_path):
    raw = bytearray((folder / "a.zip").read_bytes())
    with zipfile.ZipFile(folder / "a.zip") as z:
        info = z.infolist()[20]
    at = info.header_offset + 30 + len(info.filename.encode()) + 3
    raw[at] ^= 0xFF
    (tmp_path / "c.zip").write_bytes(raw)
    rows = media.read_media(spark, str(tmp_path)).collect()
    bad = [r for r in rows if r.error]
    assert len(rows) == len(MEMBERS) and [r.member for r in bad] == [info.filename] and bad[0].attempts == media.ATTEMPTS and bad[0].payload is None
    assert all(bytes(r.payload) == MEMBERS[r.member] for r in rows if not r.error)
    with pytest.raises(Exception, match="file-20"):
        media.read_media(spark, str(tmp_path), mode="failfast").collect()


def test_a_member_is_tried_again_by_its_offset(folder, monkeypatch):
    reader = media.MediaReader({"path": str(folder / "a.zip")})
    real, fails = media.read_member, {"dir/file-5-é.bin": 2}

    def flaky(f, m, is_zip):
        if fails.get(m.name, 0):
            fails[m.name] -= 1
            raise OSError("reset")
        return real(f, m, is_zip)

    monkeypatch.setattr(media, "read_member", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["member"]: r["attempts"] for r in rows if r["attempts"] > 1} == {"dir/file-5-é.bin": 3} and len(rows) == len(MEMBERS)


def test_written_archives_are_plain_zip(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", b"x" * i) for i in range(100)] + [(None, b"y"), ("no payload", None)], "name string, payload binary").repartition(3)
    written = media.write_archives(rows, f"file://{tmp_path}/out", "name", "payload").collect()
    assert sum(r.members for r in written) == 100
    found = {}
    for p in (tmp_path / "out").glob("*.zip"):
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None
            found |= {n: z.read(n) for n in z.namelist()}
    assert found == {f"n{i}": b"x" * i for i in range(100)}


def test_a_file_appears_only_when_complete(tmp_path):
    with pytest.raises(RuntimeError), files.publish(f"file://{tmp_path}/f", "x.zip") as out:
        out.write(b"half")
        raise RuntimeError
    assert not (tmp_path / "f" / "x.zip").exists()
    assert files.list_files(f"file://{tmp_path}/f", (".zip",)) == []


def test_missing_and_empty_folders(spark, tmp_path):
    assert media.read_media(spark, str(tmp_path)).collect() == [] and warc.read_warc(spark, str(tmp_path)).collect() == []
    for read in (media.read_media, warc.read_warc):
        with pytest.raises(Exception, match="nowhere"):
            read(spark, str(tmp_path / "nowhere")).collect()


def plain(kind, uri, payload, more=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{uri}>", *([f"WARC-Target-URI: {uri}"] if uri else []), *more, f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


RECORDS = [("warcinfo", "", b"software: x\r\n", ()), ("request", "http://a/1", b"GET /", ()), ("response", "http://a/1", b"HTTP/1.1 200 OK\r\n\r\n" + b"WARC/1.0\r\n" * 9000, ("X-Odd: one", "x-odd: two", "Folded: a", "  b")), ("response", "http://b/2", b"", ()), ("response", "http://b/2", b"", ()), ("metadata", "http://b/2", bytes(range(256)) * 300, ())]


@pytest.fixture(scope="module")
def warcs(tmp_path_factory):
    at = tmp_path_factory.mktemp("warcs")
    parts = [plain(*r) for r in RECORDS]
    (at / "a.warc").write_bytes(b"".join(parts))
    (at / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (at / "c.warc.gz").write_bytes(b"".join(warc.record([("WARC-Type", k), ("WARC-Record-ID", f"<urn:x:{u}>"), *([("WARC-Target-URI", u)] if u else []), *[tuple(m.split(": ", 1)) for m in more if ": " in m]], p) for k, u, p, more in RECORDS))
    return at


def test_records_of_all_forms(spark, warcs):
    rows = warc.read_warc(spark, str(warcs)).collect()
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        got = sorted((r for r in rows if r.file == name), key=lambda r: r.offset)
        assert [(r.record_type, r.target_uri or "", bytes(r.payload)) for r in got] == [(k, u, p) for k, u, p, _ in RECORDS]
        assert got[2].headers["x-odd"] == "two" and [r.content_length for r in got] == [len(p) for _, _, p, _ in RECORDS]
    assert next(r for r in rows if r.file == "a.warc" and r.content_length > 50_000 and r.record_type == "response").headers["folded"] == "a b"


@pytest.mark.parametrize("per_member", [2, 4, len(RECORDS)])
def test_several_records_in_a_gzip_member(spark, tmp_path, per_member):
    """Every record is read, with and without its payload, also if skip lengths are there or members are empty."""
    parts = [plain(*r) for r in RECORDS]
    raw = [b"".join(parts[i : i + per_member]) for i in range(0, len(parts), per_member)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) + gzip.compress(b"") for x in raw))
    skip = lambda b, n: b[:3] + b"\x04" + b[4:10] + struct.pack("<H2sHII", 12, b"sl", 8, len(b) + 14, n) + b[10:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(skip(gzip.compress(x), len(x)) for x in raw))
    for options in ({}, {"payload": "false"}):
        rows = warc.read_warc(spark, str(tmp_path), **options).collect()
        for name in ("a.warc.gz", "b.warc.gz"):
            got = [(r.record_type, r.target_uri or "", r.content_length, r.payload if options else bytes(r.payload)) for r in rows if r.file == name]
            assert got == [(k, u, len(p), None if options else p) for k, u, p, _ in RECORDS]
    assert warc.read_warc(spark, str(tmp_path)).where("record_type = 'metadata'").count() == 2
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw[0] + b"garbage\r\n\r\n"))
    with pytest.raises(Exception, match="WARC"):
        warc.read_warc(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("condition", ["record_type = 'response'", "record_type in ('request', 'metadata')", "target_uri like 'http://b%'", "record_type = 'response' and target_uri = 'http://a/1'", "target_uri is null", "content_length > 100 and record_type <> 'request'"])
def test_predicates(spark, warcs, condition):
    df = warc.read_warc(spark, str(warcs))
    want = sorted((r.file, r.offset) for r in spark.createDataFrame(df.collect(), df.schema).where(condition).collect())
    assert sorted((r.file, r.offset) for r in df.where(condition).collect()) == want and want


def test_unwanted_payloads_are_not_read(warcs):
    """Payloads of other types are never taken in where the format allows to pass them."""
    for name, most in (("a.warc", 0.5), ("c.warc.gz", 1.1)):
        reader = warc.PushingReader({"path": str(warcs / name)})
        left = list(reader.pushFilters([EqualTo(("record_type",), "request"), In(("target_uri",), ("http://a/1", "http://z")), StringStartsWith(("record_id",), "<urn"), EqualTo(("offset",), 1)]))
        assert len(left) == 1
        taken = []
        real = warc.Body.payload
        try:
            warc.Body.payload = lambda self: taken.append(1) or real(self)
            rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        finally:
            warc.Body.payload = real
        assert len(rows) == 1 and taken == [1]


def test_predicates_by_options(spark, warcs):
    """What options ask for is what filters above the scan give; payloads of the rest are not taken in."""
    whole = warc.read_warc(spark, str(warcs))
    n = whole.count()
    for options, sql in (
        ({"record_type": "response"}, "record_type = 'response'"), ({"header.X-Odd": "two"}, "headers['x-odd'] = 'two'"), ({"min_length": 6, "max_length": 100}, "content_length BETWEEN 6 AND 100"), ({"max_length": 0}, "content_length = 0"),
        ({"record_type": "response", "header.WARC-Target-URI": "http://a/1", "min_length": 1}, "record_type = 'response' AND target_uri = 'http://a/1' AND content_length > 0"), ({"record_type": "none"}, "false"),
    ):
        key = lambda df: sorted((r.file, r.offset, r.content_length) for r in df.collect())
        assert key(warc.read_warc(spark, str(warcs), **options)) == key(whole.where(sql)), sql
    assert whole.count() == n  # filters of other queries over one DataFrame leave no trace


def test_filters_that_are_pushed_down(spark, warcs):
    reader = warc.PushingReader({"path": str(warcs)})
    assert list(reader.pushFilters([GreaterThan(("content_length",), 5), LessThanOrEqual(("content_length",), 100), IsNotNull(("content_length",))])) == []
    own = sorted(r["content_length"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())
    assert own and own == sorted(r.content_length for r in warc.read_warc(spark, str(warcs)).where("content_length > 5 AND content_length <= 100").collect())
    assert not hasattr(warc.WarcReader, "pushFilters") or warc.WarcReader.pushFilters is warc.DataSourceReader.pushFilters
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert warc.read_warc(spark, str(warcs), pushdown="true").where("record_type = 'response' AND content_length > 0").count() == 3
        whole = warc.read_warc(spark, str(warcs))
        assert (whole.where("record_type = 'response'").count(), whole.count()) == (9, 3 * len(RECORDS))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_headers_only(spark, warcs):
    df = warc.read_warc(spark, str(warcs), payload="false")
    assert df.count() == 3 * len(RECORDS) and df.where(F.col("payload").isNotNull()).isEmpty()


@pytest.mark.parametrize("raw", [b"garbage\r\n\r\n", plain("response", "u", b"x" * 5000)[:3000], gzip.compress(plain("response", "u", b"x"))[:40] + b"zz"])
def test_broken_files(spark, tmp_path, raw):
    (tmp_path / ("x.warc.gz" if raw[:2] == b"\x1f\x8b" else "x.warc")).write_bytes(raw)
    with pytest.raises(Exception, match=r"WARC|ends inside|gzip|decompress"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_written_files_are_plain_warc(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").repartition(3)
    written = warc.write_pages(pages, f"file://{tmp_path}/w").collect()
    assert sum(r.records for r in written) == 2 * pages.count() + len(written)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert raw.count(b"WARC/1.1\r\n") >= 2 * pages.count()
