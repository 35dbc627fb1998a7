"""Metadata parsing: superblock, object headers, links, attributes, chunk indexes, heaps."""

from __future__ import annotations

import itertools
import math
import struct
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from tilewright.container.bytesource import Bytes, lookup3, open_source
from tilewright.container.types import CLASSES, Type, decode

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNLIMITED = (1 << 64) - 1


class FormatError(ValueError):
    """Bytes that are not what the format says, or a version that is not supported."""


class Cursor:
    """Little-endian reads from bytes, with the file's widths of offsets and lengths."""

    def __init__(self, data: bytes, at: int = 0, o: int = 8, ln: int = 8):
        self.data, self.at, self.o, self.l = data, at, o, ln

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("a structure ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def offset(self) -> int | None:
        raw = self.take(self.o)
        return None if raw == b"\xff" * self.o else int.from_bytes(raw, "little")

    def length(self) -> int:
        return self.uint(self.l)

    def expect(self, sign: bytes) -> None:
        if (got := self.take(len(sign))) != sign:
            raise FormatError(f"{sign!r} expected, {got!r} found")

    @property
    def left(self) -> int:
        return len(self.data) - self.at


@dataclass(frozen=True)
class Superblock:
    version: int
    offset_size: int
    length_size: int
    flags: int
    base: int
    extension: int | None
    eof: int
    root: int

    @property
    def serialized_size(self) -> int:
        return 16 + 4 * self.offset_size

    @property
    def has_extension(self) -> bool:
        return self.extension is not None

    @property
    def swmr_write_in_progress(self) -> bool:
        return self.version >= 3 and self.flags & 5 == 5


@dataclass(frozen=True)
class Message:
    type: int
    flags: int
    body: bytes
    order: int | None = None

    @property
    def shared(self) -> bool:
        return bool(self.flags & 2)


MESSAGE_NAMES = ["nil", "dataspace", "link info", "datatype", "old fill value", "fill value", "link", "external files", "layout", "bogus", "group info", "filter pipeline", "attribute", "comment", "old modification time", "shared message table", "continuation", "symbol table", "modification time", "b-tree k", "driver info", "attribute info", "reference count"]


@dataclass
class Header:
    address: int
    flags: int
    times: tuple[int, int, int, int] | None
    messages: list[Message]

    def first(self, kind: int) -> Message | None:
        return next((m for m in self.messages if m.type == kind), None)


@dataclass(frozen=True)
class Link:
    name: str
    kind: str
    address: int | None = None
    target: str | None = None
    file: str | None = None
    order: int | None = None
    charset: str = "ascii"


@dataclass(frozen=True)
class Dataspace:
    kind: str
    dims: tuple[int, ...] = ()
    most: tuple[int | None, ...] | None = None

    @property
    def size(self) -> int:
        return 0 if self.kind == "null" else math.prod(self.dims)


@dataclass(frozen=True)
class Layout:
    kind: str
    data: bytes = b""
    address: int | None = None
    size: int = 0
    chunk: tuple[int, ...] = ()
    index: str = ""
    flags: int = 0
    params: tuple[int, ...] = ()


@dataclass(frozen=True)
class Filter:
    id: int
    name: str
    flags: int
    params: tuple[int, ...]


@dataclass(frozen=True)
class Fill:
    defined: bool
    value: bytes | None = None


@dataclass(frozen=True)
class Attribute:
    name: str
    type: Type
    space: Dataspace
    raw: bytes
    order: int | None = None


@dataclass(frozen=True)
class Chunk:
    scaled: tuple[int, ...]
    address: int | None
    size: int
    mask: int = 0


# -- single messages ----------------------------------------------------------------


def parse_dataspace(body: bytes, ln: int = 8) -> Dataspace:
    c = Cursor(body, ln=ln)
    version, rank, flags = c.uint(1), c.uint(1), c.uint(1)
    if version == 1:
        c.take(5)
        kind = "simple" if rank else "scalar"
    elif version == 2:
        code = c.uint(1)
        if code > 2:
            raise FormatError(f"dataspace kind {code}")
        kind = ("scalar", "simple", "null")[code]
    else:
        raise FormatError(f"dataspace version {version}")
    dims = tuple(c.length() for _ in range(rank))
    most = None
    if flags & 1:
        top = (1 << 8 * ln) - 1
        most = tuple(None if (m := c.length()) == top else m for _ in range(rank))
    return Dataspace(kind, dims, most)


_PADDING, _CHARSET = ("null-term", "null-pad", "space-pad"), ("ascii", "utf-8")


def _pick(names: tuple[str, ...], k: int) -> str:
    return names[k] if k < len(names) else str(k)


def parse_type(c: Cursor) -> Type:
    """A datatype message, from the cursor's place on."""
    head = c.uint(4)
    kind, version, bits, size = head & 15, head >> 4 & 15, head >> 8, c.uint(4)
    if kind >= len(CLASSES):
        raise FormatError(f"datatype class {kind}")
    name = CLASSES[kind]
    order = ">" if bits & 1 else "<"
    if name in ("fixed", "bitfield"):
        offset, precision = c.uint(2), c.uint(2)
        return Type(name, size, order, bool(bits & 8) and name == "fixed", offset, precision)
    if name == "float":
        if bits & 0x41 == 0x40:
            raise FormatError("a float's byte order is not known")
        vax = bits & 0x41 == 0x41
        offset, precision = c.uint(2), c.uint(2)
        geometry = tuple(c.take(4)) + (c.uint(4),)
        return Type(name, size, "vax" if vax else order, True, offset, precision, extra=geometry) if vax else Type(name, size, order, False, offset, precision, extra=geometry)
    if name == "time":
        return Type(name, size, order, precision=c.uint(2))
    if name == "string":
        return Type(name, size, padding=_pick(_PADDING, bits & 15), charset=_pick(_CHARSET, bits >> 4 & 15))
    if name == "opaque":
        return Type(name, size, tag=c.take(bits & 255).split(b"\0", 1)[0].decode("ascii", "replace"))
    if name == "reference":
        return Type(name, size, extra=(bits & 15,))
    if name == "compound":
        members = []
        for _ in range(bits & 0xFFFF):
            start = c.at
            label = _cstring(c)
            if version < 3:
                c.at = start + (c.at - start + 7) // 8 * 8
                at = c.uint(4)
                if version == 1:
                    rank = c.uint(1)
                    c.take(11)
                    dims = [c.uint(4) for _ in range(4)][:rank]
                    own = parse_type(c)
                    if dims:
                        own = Type("array", own.size * math.prod(dims), base=own, dims=tuple(dims))
                    members.append((label, at, own))
                    continue
            else:
                at = c.uint((max(size.bit_length(), 1) + 7) // 8)
            members.append((label, at, parse_type(c)))
        return Type(name, size, members=tuple(members))
    if name == "enum":
        base, names = parse_type(c), []
        for _ in range(bits & 0xFFFF):
            start = c.at
            names.append(_cstring(c))
            if version < 3:
                c.at = start + (c.at - start + 7) // 8 * 8
        return Type(name, size, base=base, members=tuple((n, c.take(base.size)) for n in names))
    if name == "vlen":
        text = bits & 15 == 1
        return Type(name, size, base=parse_type(c), is_string=text, padding=_pick(_PADDING, bits >> 4 & 15), charset=_pick(_CHARSET, bits >> 8 & 15))
    if name == "array":
        rank = c.uint(1)
        if version < 3:
            c.take(3)
        dims = tuple(c.uint(4) for _ in range(rank))
        if version < 3:
            c.take(4 * rank)
        return Type(name, size, base=parse_type(c), dims=dims)
    return Type(name, size, base=parse_type(c))


def _cstring(c: Cursor) -> str:
    end = c.data.find(b"\0", c.at)
    if end < 0:
        raise FormatError("a name does not end")
    return (c.take(end - c.at) + c.take(1))[:-1].decode("utf-8", "replace")


def parse_link(c: Cursor) -> Link:
    if (version := c.uint(1)) != 1:
        raise FormatError(f"link version {version}")
    flags = c.uint(1)
    kind = c.uint(1) if flags & 8 else 0
    order = c.uint(8) if flags & 4 else None
    charset = _pick(_CHARSET, c.uint(1)) if flags & 16 else "ascii"
    name = c.take(c.uint(1 << (flags & 3))).decode("utf-8", "replace")
    if kind == 0:
        return Link(name, "hard", c.offset(), order=order, charset=charset)
    body = c.take(c.uint(2))
    if kind == 1:
        return Link(name, "soft", target=body.decode("utf-8", "replace"), order=order, charset=charset)
    if kind == 64:
        file, _, path = body[1:].partition(b"\0")
        return Link(name, "external", target=path.rstrip(b"\0").decode("utf-8", "replace"), file=file.decode("utf-8", "replace"), order=order, charset=charset)
    raise FormatError(f"link kind {kind}")


_INDEXES = {1: "single", 2: "implicit", 3: "fixed array", 4: "extensible array", 5: "b-tree v2"}


def parse_layout(c: Cursor) -> Layout:
    version, kind = c.uint(1), c.uint(1)
    if version not in (3, 4, 5):
        raise FormatError(f"layout version {version}")
    if kind == 0:
        return Layout("compact", data=c.take(c.uint(2)))
    if kind == 1:
        return Layout("contiguous", address=c.offset(), size=c.length())
    if kind == 3:
        return Layout("virtual")
    if kind != 2:
        raise FormatError(f"layout class {kind}")
    if version == 3:
        rank = c.uint(1)
        address = c.offset()
        return Layout("chunked", address=address, chunk=tuple(c.uint(4) for _ in range(rank)), index="b-tree v1")
    flags, rank, width = c.uint(1), c.uint(1), c.uint(1)
    chunk = tuple(c.uint(width) for _ in range(rank))
    code = c.uint(1)
    if code not in _INDEXES:
        raise FormatError(f"chunk index {code}")
    params: tuple[int, ...] = ()
    if code == 1 and flags & 2:
        params = (c.length(), c.uint(4))
    elif code in (3, 4, 5):
        params = tuple(c.take({3: 1, 4: 5, 5: 6}[code]))
    return Layout("chunked", address=c.offset(), chunk=chunk, index=_INDEXES[code], flags=flags, params=params)


def parse_filters(body: bytes) -> tuple[Filter, ...]:
    c = Cursor(body)
    version, n = c.uint(1), c.uint(1)
    if version not in (1, 2):
        raise FormatError(f"filter pipeline version {version}")
    if version == 1:
        c.take(6)
    out = []
    for _ in range(n):
        kind = c.uint(2)
        named = c.uint(2) if version == 1 or kind >= 256 else 0
        flags, count = c.uint(2), c.uint(2)
        name = c.take(named).split(b"\0", 1)[0].decode("ascii", "replace")
        params = tuple(c.uint(4) for _ in range(count))
        if version == 1 and count % 2:
            c.take(4)
        out.append(Filter(kind, name, flags, params))
    return tuple(out)


def parse_fill(body: bytes) -> Fill:
    c = Cursor(body)
    version = c.uint(1)
    if version in (1, 2):
        c.take(2)
        defined = bool(c.uint(1))
        if version == 2 and not defined:
            return Fill(False)
        n = c.uint(4)
        return Fill(defined, c.take(n) if n else None)
    if version != 3:
        raise FormatError(f"fill value version {version}")
    flags = c.uint(1)
    if flags & 32:
        return Fill(True, c.take(c.uint(4)) or None)
    return Fill(not flags & 16)


def parse_old_fill(body: bytes) -> Fill:
    c = Cursor(body)
    n = c.uint(4)
    return Fill(True, c.take(n) if n else None)


def _bytes_for(n: int) -> int:
    """Bytes that hold numbers up to n."""
    return max(1, (int(n).bit_length() + 7) // 8)


# -- files --------------------------------------------------------------------------


@dataclass
class Container:
    """An opened container; metadata is parsed once and kept."""

    source: object
    _headers: dict[int, Header] = field(default_factory=dict)
    _heaps: dict[int, dict[int, bytes]] = field(default_factory=dict)

    def __post_init__(self):
        head = self.source.read(0, min(self.source.size, 16))
        if head[:8] != SIGNATURE:
            raise FormatError("not a container: the signature is missing")
        version, o, ln = head[8], head[9], head[10]
        if version not in (2, 3):
            raise FormatError(f"superblock version {version}")
        if o not in (4, 8) or ln not in (4, 8):
            raise FormatError(f"offsets of {o} and lengths of {ln} bytes")
        self.o, self.l = o, ln
        raw = self.source.read(0, 16 + 4 * o)
        c = self.cursor(raw, 12)
        base, extension, eof, root = (c.offset() for _ in range(4))
        if lookup3(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
            raise FormatError("superblock checksum mismatch")
        self.superblock = Superblock(version, o, ln, head[11], base or 0, extension, eof, root)

    @classmethod
    def open(cls, path: str) -> Container:
        return cls(open_source(path))

    @classmethod
    def from_bytes(cls, data: bytes) -> Container:
        return cls(Bytes(data))

    def cursor(self, data: bytes, at: int = 0) -> Cursor:
        return Cursor(data, at, self.o, self.l)

    def read(self, at: int, n: int) -> bytes:
        return self.source.read(self.superblock.base + at if hasattr(self, "superblock") else at, n)

    def _some(self, at: int, n: int) -> bytes:
        return self.read(at, min(n, self.source.size - self.superblock.base - at))

    def checked(self, at: int, n: int, sign: bytes) -> Cursor:
        """n bytes with a signature in front and a checksum at the end."""
        raw = self.read(at, n)
        c = self.cursor(raw[:-4])
        c.expect(sign)
        if lookup3(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
            raise FormatError(f"{sign.decode()} checksum mismatch at {at}")
        return c

    # -- object headers --

    def header(self, address: int) -> Header:
        if address not in self._headers:
            self._headers[address] = self._parse_header(address)
        return self._headers[address]

    def _parse_header(self, address: int) -> Header:
        c = self.cursor(self._some(address, 64))
        c.expect(b"OHDR")
        if (version := c.uint(1)) != 2:
            raise FormatError(f"object header version {version}")
        flags = c.uint(1)
        times = tuple(c.uint(4) for _ in range(4)) if flags & 32 else None
        if flags & 16:
            c.take(4)
        size = c.uint(1 << (flags & 3))
        start = c.at
        raw = self.read(address, start + size + 4)
        if lookup3(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
            raise FormatError(f"object header checksum mismatch at {address}")
        messages: list[Message] = []
        todo = self._messages(raw[start:-4], flags, messages)
        while todo:
            at, n = todo.pop(0)
            own = self.checked(at, n, b"OCHK")
            todo += self._messages(own.data[4:], flags, messages)
        return Header(address, flags, times, messages)

    def _messages(self, data: bytes, flags: int, out: list[Message]) -> list[tuple[int, int]]:
        c, more, least = self.cursor(data), [], 6 if flags & 4 else 4
        while c.left >= least:
            kind, size, own = c.uint(1), c.uint(2), c.uint(1)
            order = c.uint(2) if flags & 4 else None
            body = c.take(size)
            if kind == 16:
                b = self.cursor(body)
                more.append((b.offset(), b.length()))
            else:
                out.append(Message(kind, own, body, order))
        return more

    def resolved(self, m: Message, kind: int | None = None) -> bytes:
        """A message's body; a shared one's is in another header."""
        return self._shared(self.cursor(m.body), m.type if kind is None else kind) if m.shared else m.body

    def _shared(self, c: Cursor, kind: int) -> bytes:
        version = c.uint(1)
        place = c.uint(1)
        if version == 1:
            c.take(6)
        elif version not in (2, 3):
            raise FormatError(f"shared message version {version}")
        elif version == 3 and place == 1:
            raise FormatError("shared message heaps are not supported")
        found = self.header(c.offset()).first(kind)
        if found is None:
            raise FormatError("a shared message is missing")
        return self.resolved(found)

    # -- groups --

    def kind(self, address: int) -> str:
        h = self.header(address)
        if h.first(8):
            return "dataset"
        return "datatype" if h.first(3) and not h.first(2) and not h.first(6) else "group"

    def links(self, address: int, by_order: bool = False) -> list[Link]:
        h = self.header(address)
        out = [parse_link(self.cursor(m.body)) for m in h.messages if m.type == 6]
        info = h.first(2)
        if not out and info:
            c = self.cursor(info.body, 1)
            flags = c.uint(1)
            if flags & 1:
                c.take(8)
            heap, tree = c.offset(), c.offset()
            if heap is not None and tree is not None:
                fh = FractalHeap(self, heap)
                out = [parse_link(self.cursor(fh.get(rec[4:]))) for rec in self.tree_v2(tree)[1]]
        if by_order and all(x.order is not None for x in out):
            out.sort(key=lambda x: x.order)
        return out

    def attributes(self, address: int, by_order: bool = False) -> list[Attribute]:
        """Attributes that can be decoded."""
        h, out = self.header(address), []
        bodies = [(m.body, m.order) for m in h.messages if m.type == 12]
        info = h.first(21)
        if info:
            c = self.cursor(info.body, 1)
            flags = c.uint(1)
            if flags & 1:
                c.take(2)
            heap, tree = c.offset(), c.offset()
            if not bodies and heap is not None and tree is not None:
                fh = FractalHeap(self, heap)
                bodies = [(fh.get(rec[:8]), int.from_bytes(rec[9:13], "little")) for rec in self.tree_v2(tree)[1]]
        for body, order in bodies:
            try:
                out.append(self._attribute(body, order))
            except (FormatError, EOFError):
                continue
        if by_order and all(a.order is not None for a in out):
            out.sort(key=lambda a: a.order)
        return out

    def _attribute(self, body: bytes, order: int | None) -> Attribute:
        c = self.cursor(body)
        version, flags = c.uint(1), c.uint(1)
        if version not in (1, 2, 3):
            raise FormatError(f"attribute version {version}")
        sizes = [c.uint(2) for _ in range(3)]
        if version == 3:
            c.take(1)
        wide = [(n + 7) // 8 * 8 if version == 1 else n for n in sizes]
        name, t, space = (c.take(n) for n in wide)
        if version > 1 and flags & 1:
            t = self._shared(self.cursor(t), 3)
        if version > 1 and flags & 2:
            space = self._shared(self.cursor(space), 1)
        t, space = parse_type(self.cursor(t)), parse_dataspace(space, self.l)
        return Attribute(name.split(b"\0", 1)[0].decode("utf-8", "replace"), t, space, c.take(min(c.left, t.size * space.size)), order)

    def value(self, a: Attribute, labels: bool = True):
        """An attribute's value: one for a scalar, else a flat list."""
        got = decode(a.type, a.raw, a.space.size, self.heap_object, labels)
        return got[0] if a.space.kind == "scalar" else got

    # -- datasets --

    def dataset(self, address: int) -> Dataset:
        return Dataset(self, address)

    def walk(self):
        """(path, parent, link, address, kind) of every object, each hard-linked object
        once for each path; a cycle ends where it closes."""
        todo = [("/", None, None, self.superblock.root, (self.superblock.root,))]
        while todo:
            path, parent, link, address, above = todo.pop(0)
            kind = self.kind(address)
            yield path, parent, link, address, kind
            if kind == "group":
                for x in self.links(address):
                    if x.kind == "hard" and x.address not in above:
                        todo.append((path.rstrip("/") + "/" + x.name, path, x, x.address, (*above, x.address)))

    def resolve(self, path: str, depth: int = 32) -> int:
        """The address that a path leads to, over soft links too."""
        steps, at, trail = [s for s in path.split("/") if s and s != "."], self.superblock.root, []
        while steps:
            if self.kind(at) != "group":
                raise KeyError(f"/{'/'.join(trail)} is not a group")
            name = steps.pop(0)
            link = next((x for x in self.links(at) if x.name == name), None)
            if link is None:
                raise KeyError(path)
            if link.kind == "external":
                raise KeyError(f"{path} leads to another file, {link.file}")
            if link.kind == "soft":
                if depth <= 0:
                    raise KeyError(f"{path}: too many soft links")
                depth -= 1
                steps = [s for s in link.target.split("/") if s and s != "."] + steps
                if link.target.startswith("/"):
                    at, trail = self.superblock.root, []
                continue
            at = link.address
            trail.append(name)
        return at

    # -- trees and heaps --

    def tree_v2(self, address: int) -> tuple[int, list[bytes]]:
        """(type, records in order) of a version-2 B-tree."""
        n = 4 + 1 + 1 + 4 + 2 + 2 + 1 + 1 + self.o + 2 + self.l + 4
        c = self.checked(address, n, b"BTHD")
        c.take(1)
        kind, node, size, depth = c.uint(1), c.uint(4), c.uint(2), c.uint(2)
        c.take(2)
        root, top = c.offset(), c.uint(2)
        if root is None or not top:
            return kind, []
        leaf = (node - 10) // size
        most, total, count = [leaf], [leaf], _bytes_for(leaf)
        for k in range(1, depth + 1):
            pointer = self.o + count + (_bytes_for(total[k - 1]) if k > 1 else 0)
            most.append((node - 10 - pointer) // (size + pointer))
            total.append((most[k] + 1) * total[k - 1] + most[k])

        def walk(at: int, n: int, level: int):
            raw = self.read(at, node if level else 6 + n * size + 4)
            c = self.cursor(raw)
            c.expect(b"BTIN" if level else b"BTLF")
            c.take(2)
            records = [c.take(size) for _ in range(n)]
            children = []
            if level:
                for _ in range(n + 1):
                    child = c.offset(), c.uint(count)
                    if level > 1:
                        c.take(_bytes_for(total[level - 1]))
                    children.append(child)
            if lookup3(raw[: c.at]) != int.from_bytes(raw[c.at : c.at + 4], "little"):
                raise FormatError(f"b-tree checksum mismatch at {at}")
            if not level:
                yield from records
                return
            for (a, m), record in itertools.zip_longest(children, records):
                yield from walk(a, m, level - 1)
                if record is not None:
                    yield record

        return kind, list(walk(root, top, depth))

    def heap_object(self, address: int, index: int) -> bytes:
        """An object of a global heap collection."""
        if address not in self._heaps:
            head = self.cursor(self.read(address, 8 + self.l))
            head.expect(b"GCOL")
            head.take(4)
            c, own = self.cursor(self.read(address, head.length())), {}
            c.take(8 + self.l)
            while c.left >= 8 + self.l:
                k = c.uint(2)
                c.take(6)
                n = c.length()
                if not k:
                    break
                own[k] = c.take(n)
                c.take(min(c.left, -n % 8))
            self._heaps[address] = own
        try:
            return self._heaps[address][index]
        except KeyError:
            raise FormatError(f"global heap object {index} at {address} is missing") from None


class FractalHeap:
    """A heap of managed, tiny and huge objects."""

    def __init__(self, file: Container, address: int):
        self.file, o, ln = file, file.o, file.l
        c = file.cursor(file._some(address, 512))
        c.expect(b"FRHP")
        c.take(1)
        self.id_size, filters, flags, self.most_managed = c.uint(2), c.uint(2), c.uint(1), c.uint(4)
        c.take(ln)
        self.huge_tree = c.offset()
        c.take(ln + o + 4 * ln + 4 * ln)
        self.width, self.start, self.most_direct, self.max_bits = c.uint(2), c.length(), c.length(), c.uint(2)
        c.take(2)
        self.root, self.rows = c.offset(), c.uint(2)
        self.pipeline, self.root_size, self.root_mask = (), 0, 0
        if filters:
            self.root_size, self.root_mask = c.length(), c.uint(4)
            self.pipeline = tuple((f.id, f.params) for f in parse_filters(c.take(filters)))
        if lookup3(c.data[: c.at]) != c.uint(4):
            raise FormatError("fractal heap checksum mismatch")
        self.checked = bool(flags & 2)
        self.offset_size = (self.max_bits + 7) // 8
        self.length_size = min(_bytes_for(self.most_direct), _bytes_for(self.most_managed))
        self.direct_rows = (self.most_direct // self.start).bit_length() + 1
        self._huge: dict | None = None

    def row_size(self, row: int) -> int:
        return self.start << max(0, row - 1)

    def get(self, heap_id: bytes) -> bytes:
        kind = heap_id[0] >> 4 & 3
        if kind == 0:
            c = Cursor(heap_id, 1)
            at, n = c.uint(self.offset_size), c.uint(min(self.length_size, c.left))
            return self._managed(at, n)
        if kind == 1:
            if self.id_size <= 18:
                n = (heap_id[0] & 15) + 1
                return heap_id[1 : 1 + n]
            n = ((heap_id[0] & 15) << 8 | heap_id[1]) + 1
            return heap_id[2 : 2 + n]
        return self._huge_object(heap_id)

    def _huge_object(self, heap_id: bytes) -> bytes:
        from tilewright.functions.codecs import decode as undo

        f, c = self.file, self.file.cursor(heap_id, 1)
        if c.left >= f.o + f.l + (4 + f.l if self.pipeline else 0):
            at, n = c.offset(), c.length()
            return undo(f.read(at, n), self.pipeline, c.uint(4)) if self.pipeline else f.read(at, n)
        key = int.from_bytes(heap_id[1 : 1 + min(f.l, c.left)], "little")
        if self._huge is None:
            self._huge = {}
            if self.huge_tree is None:
                raise FormatError("a huge heap object without a tree")
            kind, records = f.tree_v2(self.huge_tree)
            for rec in records:
                r = f.cursor(rec)
                at, n = r.offset(), r.length()
                mask = (r.uint(4), r.length())[0] if kind == 2 else 0
                self._huge[r.length()] = at, n, mask
        at, n, mask = self._huge[key]
        return undo(f.read(at, n), self.pipeline, mask) if self.pipeline else f.read(at, n)

    def _managed(self, at: int, n: int) -> bytes:
        if not self.rows:
            return self._in_block(self.root, self.start if not self.pipeline else None, 0, at, n, self.root_size, self.root_mask)
        return self._below(self.root, self.rows, 0, at, n)

    def _below(self, address: int, rows: int, base: int, at: int, n: int) -> bytes:
        f = self.file
        entry = f.o + (f.l + 4 if self.pipeline else 0)
        direct = min(rows, self.direct_rows)
        raw = f._some(address, 5 + f.o + self.offset_size + self.width * (direct * entry + (rows - direct) * f.o))
        c = f.cursor(raw)
        c.expect(b"FHIB")
        c.take(1 + f.o + self.offset_size)
        start = base
        for row in range(rows):
            size = self.row_size(row)
            for _ in range(self.width):
                child = c.offset()
                stored, mask = (c.length(), c.uint(4)) if self.pipeline and row < self.direct_rows else (0, 0)
                if start <= at < start + size:
                    if child is None:
                        raise FormatError("a heap block is missing")
                    if row < self.direct_rows:
                        return self._in_block(child, size, start, at, n, stored, mask)
                    inner = (size // (self.start * self.width)).bit_length()
                    return self._below(child, inner, start, at, n)
                start += size
        raise FormatError("a heap object lies beyond the heap")

    def _in_block(self, address: int, size: int | None, start: int, at: int, n: int, stored: int, mask: int) -> bytes:
        from tilewright.functions.codecs import decode as undo

        if not self.pipeline:
            if self.file.read(address, 4) != b"FHDB":
                raise FormatError("a heap block has no signature")
            return self.file.read(address + at - start, n)
        block = undo(self.file.read(address, stored), self.pipeline, mask)
        if block[:4] != b"FHDB":
            raise FormatError("a heap block has no signature")
        return block[at - start : at - start + n]


class Dataset:
    """Schema, layout and chunks of a dataset."""

    def __init__(self, file: Container, address: int):
        self.file, self.address = file, address
        h = file.header(address)
        need = {k: h.first(k) for k in (1, 3, 8)}
        if any(m is None for m in need.values()):
            raise FormatError("not a dataset")
        self.space = parse_dataspace(file.resolved(need[1]), file.l)
        self.type = parse_type(file.cursor(file.resolved(need[3])))
        self.layout = parse_layout(file.cursor(need[8].body))
        m = h.first(11)
        self.filters = parse_filters(file.resolved(m)) if m else ()
        new, old = h.first(5), h.first(4)
        self.fill = parse_fill(file.resolved(new)) if new else parse_old_fill(file.resolved(old)) if old else Fill(False)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.space.dims

    @property
    def pipeline(self):
        return tuple((f.id, f.params) for f in self.filters)

    @property
    def chunk_shape(self) -> tuple[int, ...]:
        """The chunk's dimensions, without the trailing one for the element's bytes."""
        chunk, rank = self.layout.chunk, len(self.shape)
        return chunk[:rank] if self.layout.kind == "chunked" else self.shape

    @property
    def chunk_bytes(self) -> int:
        return math.prod(self.chunk_shape) * self.type.size

    def grid(self, most: bool = False) -> tuple[int, ...]:
        """Chunks along each dimension, now or at the greatest extent."""
        dims = self.shape
        if most and self.space.most:
            dims = tuple(d if m is None else m for d, m in zip(self.shape, self.space.most, strict=True))
        return tuple(-(-d // c) if c else 0 for d, c in zip(dims, self.chunk_shape, strict=True))

    def fill_bytes(self) -> bytes:
        """One element of what was never written."""
        return self.fill.value if self.fill.value and len(self.fill.value) == self.type.size else bytes(self.type.size)

    def _whole(self) -> bytes:
        """All bytes of a compact or contiguous dataset, decoded."""
        from tilewright.functions.codecs import decode as undo

        n = self.space.size * self.type.size
        if self.layout.kind == "compact":
            data = self.layout.data
        elif self.layout.address is None:
            return self.fill_bytes() * self.space.size
        else:
            data = self.file.read(self.layout.address, self.layout.size if self.filters else min(n, self.layout.size or n))
        return undo(data, self.pipeline)[:n] if self.filters else data[:n]

    #: Bytes of the blocks of rows in which a contiguous dataset is read.
    BLOCK = 32 << 20

    @property
    def in_rows(self) -> bool:
        """Whether any rows can be read alone: plain contiguous data."""
        return self.layout.kind == "contiguous" and not self.filters and self.layout.address is not None and bool(self.shape)

    @property
    def read_shape(self) -> tuple[int, ...]:
        """The dimensions of what is read at once: a chunk, or of contiguous data a block of rows."""
        if not self.in_rows:
            return self.chunk_shape
        row = max(1, math.prod(self.shape[1:]) * self.type.size)
        return (max(1, min(self.shape[0], self.BLOCK // row)), *self.shape[1:])

    @cached_property
    def by_place(self) -> dict[tuple[int, ...], Chunk]:
        """Stored chunks by their place; the index is read once."""
        return {c.scaled: c for c in self.chunks()}

    def chunks(self) -> list[Chunk]:
        """Stored chunks inside the present extent. A compact or contiguous dataset is
        one chunk."""
        kind = self.layout.kind
        if kind == "virtual":
            raise FormatError("virtual datasets are not supported")
        if kind != "chunked":
            return [Chunk((0,) * len(self.shape), self.layout.address, self.space.size * self.type.size)] if self.space.size else []
        if self.layout.address is None or not self.space.size:
            return []
        grid = self.grid()
        found = {
            "single": self._single, "implicit": self._implicit, "fixed array": self._fixed, "extensible array": self._extensible, "b-tree v1": self._tree_v1, "b-tree v2": self._tree_v2,
        }[self.layout.index]()
        return [c for c in found if c.address is not None and all(s < g for s, g in zip(c.scaled, grid, strict=True))]

    def _single(self):
        size, mask = self.layout.params or (self.chunk_bytes, 0)
        return [Chunk((0,) * len(self.shape), self.layout.address, size, mask)]

    def _place(self, k: int, swizzle: int = 0) -> tuple[int, ...]:
        """The scaled place of the k-th chunk; dimension ``swizzle`` varies slowest."""
        grid = list(self.grid(most=True))
        grid.pop(swizzle)
        out = []
        for n in reversed(grid):
            k, r = divmod(k, n) if n else (0, k)
            out.append(r)
        out.reverse()
        out.insert(swizzle, k)
        return tuple(out)

    def _implicit(self):
        size, total = self.chunk_bytes, math.prod(self.grid(most=True))
        return [Chunk(self._place(k), self.layout.address + k * size, size) for k in range(total)]

    def _elements(self, c: Cursor, n: int, size: int):
        for _ in range(n):
            address = c.offset()
            if size > c.o:
                yield address, c.uint(size - c.o - 4), c.uint(4)
            else:
                yield address, self.chunk_bytes, 0

    def _fixed(self):
        f = self.file
        c = f.checked(self.layout.address, 4 + 4 + f.l + f.o + 4, b"FAHD")
        c.take(2)
        size, page_bits, n, block = c.uint(1), c.uint(1), c.length(), c.offset()
        if block is None:
            return []
        page, head = 1 << page_bits, 6 + f.o
        found = []
        if n <= page:
            c = f.checked(block, head + n * size + 4, b"FADB")
            c.take(2 + f.o)
            found = list(self._elements(c, n, size))
        else:
            pages = -(-n // page)
            bitmap = (pages + 7) // 8
            c = f.checked(block, head + bitmap + 4, b"FADB")
            c.take(2 + f.o)
            bits, at = c.take(bitmap), block + head + bitmap + 4
            for p in range(pages):
                m = min(page, n - p * page)
                if bits[p // 8] >> (7 - p % 8) & 1:
                    found += self._elements(f.cursor(f.read(at, m * size + 4)), m, size)
                else:
                    found += [(None, 0, 0)] * m
                at += page * size + 4
        return [Chunk(self._place(k), *e) for k, e in enumerate(found)]

    def _extensible(self):
        f = self.file
        c = f.checked(self.layout.address, 12 + 6 * f.l + f.o + 4, b"EAHD")
        c.take(2)
        size, max_bits, in_index, least, pointers, page_bits = (c.uint(1) for _ in range(6))
        c.take(4 * f.l)
        top = c.length()
        c.take(f.l)
        index = c.offset()
        if index is None:
            return []
        wide, page = (max_bits + 7) // 8, 1 << page_bits
        n_super = 1 + max_bits - (least.bit_length() - 1)
        direct_super = 2 * (pointers.bit_length() - 1)
        shape = [(1 << u // 2, (1 << (u + 1) // 2) * least) for u in range(n_super)]
        n_direct = sum(b for b, _ in shape[:direct_super])
        raw = f._some(index, 6 + f.o + in_index * size + (n_direct + max(0, n_super - direct_super)) * f.o)
        c = f.cursor(raw)
        c.expect(b"EAIB")
        c.take(2 + f.o)
        found = list(self._elements(c, in_index, size))
        blocks = [c.offset() for _ in range(n_direct)]
        supers = [c.offset() for _ in range(max(0, n_super - direct_super))]

        def data_block(at: int | None, n: int, bits: bytes | None = None):
            if at is None:
                return [(None, 0, 0)] * n
            head = 6 + f.o + wide
            if n <= page:
                c = f.cursor(f.read(at, head + n * size))
                c.expect(b"EADB")
                c.take(2 + f.o + wide)
                return list(self._elements(c, n, size))
            out, place = [], at + head + 4
            for p in range(n // page):
                if bits is None or bits[p // 8] >> (7 - p % 8) & 1:
                    out += self._elements(f.cursor(f.read(place, page * size)), page, size)
                else:
                    out += [(None, 0, 0)] * page
                place += page * size + 4
            return out

        k = 0
        for u in range(min(direct_super, n_super)):
            for _ in range(shape[u][0]):
                if len(found) >= top:
                    break
                found += data_block(blocks[k], shape[u][1])
                k += 1
        for u in range(direct_super, n_super):
            if len(found) >= top:
                break
            at, (n, elements) = supers[u - direct_super], shape[u]
            if at is None:
                found += [(None, 0, 0)] * (n * elements)
                continue
            bitmap = (elements // page + 7) // 8 if elements > page else 0
            c = f.cursor(f.read(at, 6 + f.o + wide + n * (bitmap + f.o)))
            c.expect(b"EASB")
            c.take(2 + f.o + wide)
            bits = [c.take(bitmap) or None for _ in range(n)]
            for b in bits:
                address = c.offset()
                if len(found) < top:
                    found += data_block(address, elements, b)
        most = self.space.most or ()
        free = next((k for k, m in enumerate(most) if m is None), 0)
        return [Chunk(self._place(k, free), *e) for k, e in enumerate(found[:top])]

    def _tree_v1(self):
        f, rank, out = self.file, len(self.layout.chunk), []

        def walk(at: int):
            key = 8 + 8 * rank
            c = f.cursor(f.read(at, 8 + 2 * f.o))
            c.expect(b"TREE")
            if c.uint(1) != 1:
                raise FormatError("not a tree of chunks")
            level, n = c.uint(1), c.uint(2)
            c = f.cursor(f.read(at + 8 + 2 * f.o, n * (key + f.o)))
            for _ in range(n):
                size, mask = c.uint(4), c.uint(4)
                offsets = [c.uint(8) for _ in range(rank)]
                child = c.offset()
                if level:
                    walk(child)
                else:
                    out.append(Chunk(tuple(o // d for o, d in zip(offsets, self.chunk_shape, strict=False)), child, size, mask))

        walk(self.layout.address)
        return out

    def _tree_v2(self):
        f, rank, out = self.file, len(self.shape), []
        kind, records = f.tree_v2(self.layout.address)
        for rec in records:
            c = f.cursor(rec)
            address = c.offset()
            if kind == 11:
                width = len(rec) - f.o - 4 - 8 * rank
                size, mask = c.uint(width), c.uint(4)
            else:
                size, mask = self.chunk_bytes, 0
            out.append(Chunk(tuple(c.uint(8) for _ in range(rank)), address, size, mask))
        return out

    def chunk_data(self, chunk: Chunk) -> bytes:
        """A chunk's elements, filters undone; edge chunks may be stored without filters."""
        from tilewright.functions.codecs import decode as undo

        if self.layout.kind != "chunked":
            return self._whole()
        data = self.file.read(chunk.address, chunk.size)
        partial = any((s + 1) * c > d for s, c, d in zip(chunk.scaled, self.chunk_shape, self.shape, strict=True))
        if self.layout.flags & 1 and partial and self.layout.index != "single":
            return data
        return undo(data, self.pipeline, chunk.mask)

    def read(self, start: tuple[int, ...] | None = None, count: tuple[int, ...] | None = None, fill: bool = True) -> bytes:
        """A rectangle in row-major order; only chunks that it overlaps are read, and of a
        plain contiguous dataset only the rows needed."""
        import numpy as np

        rank, size = len(self.shape), self.type.size
        start = tuple(start) if start is not None else (0,) * rank
        count = tuple(count) if count is not None else tuple(d - s for d, s in zip(self.shape, start, strict=True))
        if len(start) != rank or len(count) != rank:
            raise ValueError(f"a selection of {len(start)} and {len(count)} dimensions, the dataset has {rank}")
        if any(s < 0 or c < 0 or s + c > d for s, c, d in zip(start, count, self.shape, strict=True)):
            raise IndexError(f"{start} + {count} is not inside {self.shape}")
        if self.layout.kind == "virtual":
            raise FormatError("virtual datasets are not supported")
        if self.space.kind == "null" or not math.prod(count):
            return b""
        if not rank:
            return self._whole()
        if self.layout.kind == "contiguous" and not self.filters and self.layout.address is not None:
            row = math.prod(self.shape[1:]) * size
            data = self.file.read(self.layout.address + start[0] * row, count[0] * row)
            cube = np.frombuffer(data, f"V{size}").reshape(count[0], *self.shape[1:])
            return cube[(slice(None), *(slice(s, s + c) for s, c in zip(start[1:], count[1:], strict=True)))].tobytes()
        if self.layout.kind != "chunked":
            cube = np.frombuffer(self._whole(), f"V{size}").reshape(self.shape)
            return cube[tuple(slice(s, s + c) for s, c in zip(start, count, strict=True))].tobytes()
        blank = self.fill_bytes() if fill else bytes(size)
        out = np.frombuffer(bytearray(blank * math.prod(count)), f"V{size}").reshape(count)
        places = [range(a // c, -(-(a + n) // c)) for a, n, c in zip(start, count, self.chunk_shape, strict=True)]
        some = (self.by_place.get(p) for p in itertools.product(*places)) if math.prod(map(len, places)) < len(self.by_place) else self.by_place.values()
        for chunk in some:
            if chunk is None:
                continue
            origin = [s * c for s, c in zip(chunk.scaled, self.chunk_shape, strict=True)]
            low = [max(a, o) for a, o in zip(start, origin, strict=True)]
            high = [min(a + n, o + c, d) for a, n, o, c, d in zip(start, count, origin, self.chunk_shape, self.shape, strict=True)]
            if any(a >= b for a, b in zip(low, high, strict=True)):
                continue
            cube = np.frombuffer(self.chunk_data(chunk), f"V{size}", math.prod(self.chunk_shape)).reshape(self.chunk_shape)
            out[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, start, strict=True))] = cube[tuple(slice(a - o, b - o) for a, b, o in zip(low, high, origin, strict=True))]
        return out.tobytes()

    def values(self, start=None, count=None, labels: bool = False) -> list:
        """The rectangle's elements as Python values, row-major."""
        raw = self.read(start, count)
        return decode(self.type, raw, len(raw) // self.type.size, self.file.heap_object, labels)


@lru_cache(maxsize=64)
def opened(path: str, stamp: int = 0) -> Container:
    """A container that stays open in this process; ``stamp``: its time of change."""
    return Container.open(path)
