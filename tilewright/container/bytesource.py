"""Positional byte sources and the format's checksum."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


class Bytes:
    """A container in memory."""

    def __init__(self, data: bytes):
        self.data = bytes(data)
        self.size = len(self.data)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise EOFError(f"bytes {at}..{at + n} of {self.size}")
        return self.data[at : at + n]


class LocalFile:
    """A file, read by position; small reads come from a cached block."""

    BLOCK = 1 << 16

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.size = os.fstat(self.file.fileno()).st_size
        self.block, self.start = b"", 0

    def _pread(self, n: int, at: int) -> bytes:
        return os.pread(self.file.fileno(), n, at)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise EOFError(f"bytes {at}..{at + n} of {self.size}")
        if n > self.BLOCK // 2:
            return self._pread(n, at)
        if not self.start <= at or at + n > self.start + len(self.block):
            self.block, self.start = self._pread(self.BLOCK, at), at
        return self.block[at - self.start : at - self.start + n]


class RemoteFile(LocalFile):
    """A file of any store that Arrow's file systems can open."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self.block, self.start = b"", 0

    def _pread(self, n: int, at: int) -> bytes:
        return self.file.read_at(n, at)


def open_source(path: str):
    """A byte source for a path or URI."""
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        return LocalFile(unquote(uri.path) if uri.scheme else path)
    return RemoteFile(path)


def _rot(x: int, k: int) -> int:
    return (x << k | x >> (32 - k)) & 0xFFFFFFFF


def lookup3(data: bytes, initial: int = 0) -> int:
    """Jenkins' lookup3 hash (hashlittle) of the bytes."""
    m = 0xFFFFFFFF
    a = b = c = (0xDEADBEEF + len(data) + initial) & m
    at, left = 0, len(data)
    word = lambda k: int.from_bytes(data[k : k + 4], "little")
    while left > 12:
        a, b, c = (a + word(at)) & m, (b + word(at + 4)) & m, (c + word(at + 8)) & m
        for r in ((4, 0), (6, 1), (8, 2), (16, 0), (19, 1), (4, 2)):
            k, turn = r
            if turn == 0:
                a = ((a - c) & m) ^ _rot(c, k)
                c = (c + b) & m
            elif turn == 1:
                b = ((b - a) & m) ^ _rot(a, k)
                a = (a + c) & m
            else:
                c = ((c - b) & m) ^ _rot(b, k)
                b = (b + a) & m
        at, left = at + 12, left - 12
    if not left:
        return c
    tail = data[at:].ljust(12, b"\0")
    a = (a + int.from_bytes(tail[:4], "little")) & m
    b = (b + int.from_bytes(tail[4:8], "little")) & m
    c = (c + int.from_bytes(tail[8:], "little")) & m
    c = ((c ^ b) - _rot(b, 14)) & m
    a = ((a ^ c) - _rot(c, 11)) & m
    b = ((b ^ a) - _rot(a, 25)) & m
    c = ((c ^ b) - _rot(b, 16)) & m
    a = ((a ^ c) - _rot(c, 4)) & m
    b = ((b ^ a) - _rot(a, 14)) & m
    return ((c ^ b) - _rot(b, 24)) & m
