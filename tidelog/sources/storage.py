"""Files in shared storage, by URI: listing, ranged reads, and writes that a lost task cannot leave half done."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs

from tidelog.errors import InvalidState, NotFound


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a URI or a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def list_files(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder (or of one file), by path; suffixes in lower case match any case."""
    fs, path = open_folder(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(suffixes) and not f.base_name.startswith("."))


@contextmanager
def publish(uri: str, name: str):
    """A stream whose file appears as `name` only once complete; a second attempt of the same task replaces it by an equal one."""
    fs, folder = open_folder(uri)
    fs.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4()}"
    with fs.open_output_stream(hidden) as out:
        yield out
    fs.move(hidden, f"{folder}/{name}")


class Substrate:
    """Bytes under keys below a folder: what the parts of logs and content-addressed objects are kept in."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.fs, self.root = open_folder(self.uri)

    def _at(self, key: str) -> str:
        if not key or key.startswith("/") or any(p in ("", ".", "..") for p in key.split("/")):
            raise InvalidState(f"{key!r} is no key")
        return f"{self.root}/{key}"

    def _write(self, key: str, body: bytes) -> None:
        folder, _, name = key.rpartition("/")
        with publish(f"{self.uri}/{folder}".rstrip("/"), name) as out:
            out.write(body)

    def exists(self, key: str) -> bool:
        return self.fs.get_file_info(self._at(key)).type == pafs.FileType.File

    def put_if_absent(self, key: str, body: bytes) -> bool:
        """False, and no change, if the key is there."""
        if self.exists(key):
            return False
        self._write(key, body)
        return True

    def overwrite(self, key: str, body: bytes) -> None:
        self._at(key)
        self._write(key, body)

    def get_range(self, key: str, start: int = 0, length: int | None = None) -> bytes:
        """Bytes from `start`; fewer than asked where the object ends. A missing key is an error."""
        if not self.exists(key):
            raise NotFound(f"there is no object {key}")
        with self.fs.open_input_file(self._at(key)) as f:
            f.seek(min(start, f.size()))
            return f.read() if length is None else f.read(length)

    def list_prefix(self, prefix: str) -> list[str]:
        """Keys that begin with a prefix, in order."""
        info = self.fs.get_file_info(self.root)
        if info.type == pafs.FileType.NotFound:
            return []
        folder = f"{self.root}/{prefix.rpartition('/')[0]}".rstrip("/")  # only the part of the tree that can hold it
        found = self.fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        keys = (f.path[len(self.root) + 1 :] for f in found if f.type == pafs.FileType.File and not f.base_name.startswith("."))
        return sorted(k for k in keys if k.startswith(prefix))

    def delete(self, key: str) -> bool:
        """False if the key is not there."""
        if not self.exists(key):
            return False
        self.fs.delete_file(self._at(key))
        return True
