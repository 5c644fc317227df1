"""Checksummed frames: magic, length, CRC-32, JSON body. Format "frames" reads folders of .frames files.

A file that ends inside a frame keeps what came before it (a torn tail); a wrong magic
or checksum is an error. Files are read by URI, frame by frame.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.errors import StorageCorrupt
from tidelog.session import ship
from tidelog.sources.storage import list_files, open_folder

MAGIC = b"TLF1"
_HEAD = struct.Struct("<4sII")


def encode(body: bytes) -> bytes:
    return _HEAD.pack(MAGIC, len(body), zlib.crc32(body)) + body


def decode(raw: bytes, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, body) of every whole frame from `start` on."""
    f = io.BytesIO(raw)
    f.seek(start)
    return decode_stream(f, start)


def decode_stream(f: BinaryIO, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """The same of a stream that stands at `at`; one frame is held at a time."""
    while len(head := f.read(_HEAD.size)) == _HEAD.size:
        magic, size, crc = _HEAD.unpack(head)
        if magic != MAGIC:
            raise StorageCorrupt(f"no frame begins at byte {at}")
        body = f.read(size)
        if len(body) < size:
            return
        if zlib.crc32(body) != crc:
            raise StorageCorrupt(f"the frame at byte {at} fails its checksum")
        yield at, body
        at += _HEAD.size + size


class FramesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f, _ in list_files(self.path, (".frames",))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        if partition.value is not None:
            with open_folder(self.path)[0].open_input_stream(partition.value, buffer_size=1 << 20) as f:
                for at, body in decode_stream(f):
                    yield partition.value.rsplit("/", 1)[-1], at, body.decode()


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "file string, offset long, body string"

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options["path"])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(FramesSource)
    return spark.read.format("frames").option("path", path).load()
