"""Building containers: a tree of groups and datasets, laid out as bytes."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np

from tilewright.container.bytesource import lookup3
from tilewright.container.reader import SIGNATURE, _bytes_for
from tilewright.container.types import CLASSES, Type, encode
from tilewright.functions import codecs

UNDEFINED = b"\xff" * 8
u8, u16, u32, u64 = (lambda v, n=n: int(v).to_bytes(n, "little") for n in (1, 2, 4, 8))


def sealed(data: bytes) -> bytes:
    return data + u32(lookup3(data))


@dataclass
class AttributeNode:
    name: str
    type: Type
    values: list
    shape: tuple[int, ...] | None = ()
    committed: str | None = None


@dataclass
class DatasetNode:
    """``values``: row-major elements; ``raw``: their bytes instead (fixed-size types);
    None of both: nothing is stored. ``chunk``: tile shape; None: one block. ``tiles``:
    {scaled: (stored bytes, mask)}, ready to be stored."""

    type: Type
    shape: tuple[int, ...] | None = ()
    values: list | None = None
    raw: bytes | None = None
    chunk: tuple[int, ...] | None = None
    most: tuple[int | None, ...] | None = None
    filters: tuple = ()
    fill: object = None
    compact: bool = False
    early: bool = False
    layout_version: int = 4
    index: str | None = None
    tiles: dict | None = None
    committed: str | None = None
    attributes: list[AttributeNode] = field(default_factory=list)

    def attribute(self, name: str, type: Type, values, shape: tuple[int, ...] | None = (), committed: str | None = None) -> DatasetNode:
        self.attributes.append(AttributeNode(name, type, list(values) if shape != () else [values], shape, committed))
        return self


@dataclass
class SoftLink:
    target: str


@dataclass
class ExternalLink:
    file: str
    target: str


@dataclass
class GroupNode:
    """``dense_links`` and ``dense_attributes``: more than so many are kept in a heap with
    a tree instead of the header. ``ordered``: creation order is kept."""

    children: dict[str, object] = field(default_factory=dict)
    types: dict[str, Type] = field(default_factory=dict)
    attributes: list[AttributeNode] = field(default_factory=list)
    dense_links: int | None = None
    dense_attributes: int | None = None
    ordered: bool = False

    def _add(self, name: str, node):
        if not name or "/" in name or name in self.children or name in self.types:
            raise ValueError(f"{name!r} is no new name")
        self.children[name] = node
        return node

    def group(self, name: str, **options) -> GroupNode:
        return self._add(name, GroupNode(**options))

    def dataset(self, name: str, type: Type, shape: tuple[int, ...] | None = (), values=None, **options) -> DatasetNode:
        return self._add(name, DatasetNode(type, shape, list(values) if values is not None else None, **options))

    def commit(self, name: str, type: Type) -> None:
        if name in self.children or name in self.types:
            raise ValueError(f"{name!r} is no new name")
        self.types[name] = type

    def soft(self, name: str, target: str) -> None:
        self._add(name, SoftLink(target))

    def external(self, name: str, file: str, target: str) -> None:
        self._add(name, ExternalLink(file, target))

    attribute = DatasetNode.attribute


# -- messages -----------------------------------------------------------------------


def dataspace(shape: tuple[int, ...] | None, most: tuple[int | None, ...] | None = None) -> bytes:
    if shape is None:
        return bytes((2, 0, 0, 2))
    out = bytes((2, len(shape), int(most is not None), int(bool(shape)))) + b"".join(map(u64, shape))
    return out + b"".join(UNDEFINED if m is None else u64(m) for m in most) if most is not None else out


_PADDING, _CHARSET = ("null-term", "null-pad", "space-pad"), ("ascii", "utf-8")


def datatype(t: Type) -> bytes:
    kind, version, bits, body = CLASSES.index(t.kind), 1, 0, b""
    big = int(t.order == ">")
    if t.kind in ("fixed", "bitfield"):
        bits, body = big | 8 * t.signed, u16(t.offset) + u16(t.precision or 8 * t.size)
    elif t.kind == "float":
        geometry = {2: (10, 5, 0, 10, 15), 4: (23, 8, 0, 23, 127), 8: (52, 11, 0, 52, 1023)}
        if t.size not in geometry:
            raise ValueError(f"a float of {t.size} bytes")
        at, n, low, width, bias = geometry[t.size]
        bits = big | 0x20 | (8 * t.size - 1) << 8
        body = u16(0) + u16(8 * t.size) + bytes((at, n, low, width)) + u32(bias)
    elif t.kind == "time":
        bits, body = big, u16(t.precision)
    elif t.kind == "string":
        bits = _PADDING.index(t.padding) | _CHARSET.index(t.charset) << 4
    elif t.kind == "opaque":
        tag = t.tag.encode()[:247]
        body = tag + b"\0" * (-len(tag) % 8)
        bits = len(body)
    elif t.kind == "reference":
        bits, body = (t.extra or (0,))[0], b""
    elif t.kind == "compound":
        version, bits = 3, len(t.members)
        width = (max(t.size.bit_length(), 1) + 7) // 8
        body = b"".join(n.encode() + b"\0" + int(o).to_bytes(width, "little") + datatype(m) for n, o, m in t.members)
    elif t.kind == "enum":
        version, bits = 3, len(t.members)
        body = datatype(t.base) + b"".join(n.encode() + b"\0" for n, _ in t.members) + b"".join(v for _, v in t.members)
    elif t.kind == "vlen":
        bits = int(t.is_string) | _PADDING.index(t.padding) << 4 | _CHARSET.index(t.charset) << 8
        body = datatype(t.base)
    elif t.kind == "array":
        version, body = 3, bytes((len(t.dims),)) + b"".join(map(u32, t.dims)) + datatype(t.base)
    elif t.kind == "complex":
        version, body = 5, datatype(t.base)
    return bytes((version << 4 | kind,)) + int(bits).to_bytes(3, "little") + u32(t.size) + body


def filters(pipeline) -> bytes:
    out = bytes((2, len(pipeline)))
    for kind, params in pipeline:
        name = codecs.NAMES.get(kind, "").encode() + b"\0" if kind >= 256 else b""
        out += u16(kind) + (u16(len(name)) if kind >= 256 else b"") + u16(int(kind == codecs.LZF)) + u16(len(params)) + name + b"".join(map(u32, params))
    return out


def fill_value(t: Type, fill, early: bool, incremental: bool) -> bytes:
    flags = (1 if early else 3 if incremental else 2) | 2 << 2
    if fill is None:
        return bytes((3, flags))
    raw = fill if isinstance(fill, bytes) else encode(t, [fill])
    return bytes((3, flags | 32)) + u32(len(raw)) + raw


def link(name: str, node, address: int | None, order: int | None) -> bytes:
    raw = name.encode()
    width = 0 if len(raw) < 256 else 1 if len(raw) < 65536 else 2
    soft, external = isinstance(node, SoftLink), isinstance(node, ExternalLink)
    out = bytes((1, width | 4 * (order is not None) | 8 * (soft or external) | 16))
    if soft or external:
        out += u8(1 if soft else 64)
    if order is not None:
        out += u64(order)
    out += b"\1" + len(raw).to_bytes(1 << width, "little") + raw
    if soft:
        return out + u16(len(node.target.encode())) + node.target.encode()
    if external:
        body = b"\0" + node.file.encode() + b"\0" + node.target.encode() + b"\0"
        return out + u16(len(body)) + body
    return out + u64(address)


def choose_index(shape, chunk, most, filtered: bool, early: bool) -> str:
    """The chunk index that fits: how many dimensions can grow decides first."""
    free = sum(m is None for m in most or ())
    if free > 1:
        return "b-tree v2"
    if free == 1:
        return "extensible array"
    if all(d <= c for d, c in zip(shape, chunk, strict=True)):
        return "single"
    return "implicit" if early and not filtered else "fixed array"


# -- the file -----------------------------------------------------------------------


class GlobalHeap:
    """Variable-length objects, in collections of bounded size. A collection's place is
    known when it begins, for nothing else is laid out until it is flushed."""

    MOST_BYTES, MOST_OBJECTS = 1 << 20, 65_000

    def __init__(self, builder: Builder):
        self.builder, self.body, self.n = builder, bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.n and (len(self.body) + len(data) > self.MOST_BYTES or self.n >= self.MOST_OBJECTS):
            self.flush()
        self.n += 1
        self.body += u16(self.n) + u16(1) + u32(0) + u64(len(data)) + data + b"\0" * (-len(data) % 8)
        return len(self.builder.out) + -len(self.builder.out) % 8, self.n

    def flush(self) -> None:
        if self.n:
            free = max(16, 4096 - 16 - len(self.body))
            self.body += u16(0) + u16(0) + u32(0) + u64(free) + b"\0" * (free - 16)
            self.builder.put(b"GCOL" + bytes((1, 0, 0, 0)) + u64(16 + len(self.body)) + bytes(self.body))
        self.body, self.n = bytearray(), 0


class Builder:
    """Lays a tree out in one buffer. ``times``: the four header times, or None."""

    def __init__(self, root: GroupNode, times: tuple[int, int, int, int] | None = None, superblock_version: int = 3):
        self.out = bytearray(48)
        self.times, self.committed = times, {}
        address = self.group(root, "")
        head = SIGNATURE + bytes((superblock_version, 8, 8, 0)) + u64(0) + UNDEFINED + u64(len(self.out)) + u64(address)
        self.out[:48] = sealed(head)

    def put(self, data: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def header(self, messages: list[tuple[int, bytes, int]], flags: int = 0) -> int:
        body = b"".join(u8(kind) + self._short(len(data)) + u8(own) + (u16(k) if flags & 4 else b"") + data for k, (kind, data, own) in enumerate(messages))
        flags |= 2 | (32 if self.times else 0)
        return self.put(sealed(b"OHDR" + bytes((2, flags)) + (b"".join(map(u32, self.times)) if self.times else b"") + u32(len(body)) + body))

    @staticmethod
    def _short(n: int) -> bytes:
        if n > 65535:
            raise ValueError(f"a header message of {n} bytes; the most is 65535")
        return u16(n)

    def group(self, node: GroupNode, path: str) -> int:
        links = []
        for name, t in node.types.items():
            self.committed[name] = self.committed[f"{path}/{name}"] = self.header([(3, datatype(t), 0)])
            links.append((name, None, self.committed[f"{path}/{name}"]))
        for name, child in node.children.items():
            address = self.group(child, f"{path}/{name}") if isinstance(child, GroupNode) else self.dataset(child, path) if isinstance(child, DatasetNode) else None
            links.append((name, child, address))
        bodies = [(name, link(name, child, address, k if node.ordered else None)) for k, (name, child, address) in enumerate(links)]
        flags = 3 * node.ordered
        messages: list[tuple[int, bytes, int]] = []
        if node.dense_links is not None and len(bodies) > node.dense_links:
            heap, ids = self.fractal_heap([b for _, b in bodies], 7)
            names = self.tree_v2(5, 11, sorted((u32(lookup3(n.encode())) + i for (n, _), i in zip(bodies, ids, strict=True)), key=lambda r: int.from_bytes(r[:4], "little")))
            order = u64(self.tree_v2(6, 15, [u64(k) + i for k, i in enumerate(ids)])) if node.ordered else b""
            messages.append((2, bytes((0, flags)) + (u64(len(bodies)) if node.ordered else b"") + u64(heap) + u64(names) + order, 0))
        else:
            messages.append((2, bytes((0, flags)) + (u64(len(bodies)) if node.ordered else b"") + UNDEFINED + UNDEFINED + (UNDEFINED if node.ordered else b""), 0))
            messages += [(6, b, 0) for _, b in bodies]
        messages.append((10, bytes((0, 0)), 0))
        messages += self.attribute_messages(node.attributes, node.dense_attributes, node.ordered)
        return self.header(messages, 4 | 8 if node.ordered else 0)

    def attribute_messages(self, nodes: list[AttributeNode], dense: int | None, ordered: bool) -> list[tuple[int, bytes, int]]:
        bodies = [(a.name, self.attribute(a)) for a in nodes]
        if dense is None or len(bodies) <= dense:
            return [(12, b, 0) for _, b in bodies]
        heap, ids = self.fractal_heap([b for _, b in bodies], 8)
        records = [i + u8(0) + u32(k) + u32(lookup3(n.encode())) for k, ((n, _), i) in enumerate(zip(bodies, ids, strict=True))]
        names = self.tree_v2(8, 17, sorted(records, key=lambda r: int.from_bytes(r[-4:], "little")))
        order = u64(self.tree_v2(9, 13, [r[:13] for r in records])) if ordered else b""
        return [(21, bytes((0, 3 * ordered)) + (u16(len(bodies)) if ordered else b"") + u64(heap) + u64(names) + order, 0)]

    def attribute(self, a: AttributeNode) -> bytes:
        name = a.name.encode() + b"\0"
        shared = a.committed is not None
        t = bytes((3, 2)) + u64(self.committed[a.committed]) if shared else datatype(a.type)
        space = dataspace(a.shape)
        return bytes((3, int(shared))) + u16(len(name)) + u16(len(t)) + u16(len(space)) + b"\1" + name + t + space + self.elements(a.type, a.values)

    def elements(self, t: Type, values: list) -> bytes:
        """The values' bytes; variable-length ones go to heap collections in front."""
        heap = GlobalHeap(self)
        raw = encode(t, values, heap.add)
        heap.flush()
        return raw

    def fractal_heap(self, objects: list[bytes], id_size: int) -> tuple[int, list[bytes]]:
        """(address, heap ids): one direct block as large as needed."""
        max_bits = 32 if id_size == 7 else 40
        head = 5 + 8 + (max_bits + 7) // 8
        size = 1 << max(9, (head + sum(map(len, objects)) - 1).bit_length())
        header_at = len(self.out) + (-len(self.out) % 8)
        n_header = 4 + 1 + 2 + 2 + 1 + 4 + 12 * 8 + 2 + 8 + 8 + 2 + 2 + 8 + 2 + 4
        block_at = header_at + n_header + (-n_header % 8)
        body, ids = bytearray(b"FHDB\0" + u64(header_at) + bytes((max_bits + 7) // 8)), []
        most = max(4096, size)
        width = min(_bytes_for(max(size, 65536)), _bytes_for(most))
        for data in objects:
            ids.append((b"\0" + len(body).to_bytes((max_bits + 7) // 8, "little") + len(data).to_bytes(width, "little")).ljust(id_size, b"\0"))
            body += data
        header = b"FRHP\0" + u16(id_size) + u16(0) + u8(0) + u32(most) + u64(0) + UNDEFINED + u64(size - len(body)) + UNDEFINED + u64(size) + u64(size) + u64(0) + u64(len(objects)) + bytes(32)
        header += u16(4) + u64(size) + u64(max(size, 65536)) + u16(max_bits) + u16(1) + u64(block_at) + u16(0)
        assert len(header) + 4 == n_header
        assert self.put(sealed(header)) == header_at
        assert self.put(bytes(body).ljust(size, b"\0")) == block_at
        return header_at, ids

    def tree_v2(self, kind: int, size: int, records: list[bytes], node: int = 2048) -> int:
        leaf = (node - 10) // size
        most, total, count = [leaf], [leaf], _bytes_for(leaf)
        while total[-1] < len(records):
            pointer = 8 + count + (_bytes_for(total[-1]) if len(total) > 1 else 0)
            most.append((node - 10 - pointer) // (size + pointer))
            total.append((most[-1] + 1) * total[-1] + most[-1])

        def build(own: list[bytes], level: int) -> tuple[int, int, int]:
            if not level:
                return self.put(sealed(b"BTLF\0" + u8(kind) + b"".join(own)).ljust(node, b"\0")), len(own), len(own)
            parts = max(2, -(-(len(own) + 1) // (total[level - 1] + 1)))
            cuts = [round(k * (len(own) + 1) / parts) - 1 for k in range(parts + 1)]
            children = [build(own[a + 1 : b], level - 1) for a, b in itertools.pairwise(cuts)]
            keys = [own[c] for c in cuts[1:-1]]
            body = b"BTIN\0" + u8(kind) + b"".join(keys)
            for address, n, below in children:
                body += u64(address) + n.to_bytes(count, "little") + (below.to_bytes(_bytes_for(total[level - 1]), "little") if level > 1 else b"")
            return self.put(sealed(body).ljust(node, b"\0")), len(keys), len(own)

        depth = len(total) - 1
        root, n, _ = build(records, depth) if records else (None, 0, 0)
        return self.put(sealed(b"BTHD\0" + u8(kind) + u32(node) + u16(size) + u16(depth) + bytes((100, 40)) + (UNDEFINED if root is None else u64(root)) + u16(n) + u64(len(records))))

    # -- datasets --

    def dataset(self, node: DatasetNode, path: str) -> int:
        t, shape = node.type, node.shape
        n = 0 if shape is None else math.prod(shape)
        raw = node.raw
        if raw is None and node.values is not None:
            if len(node.values) != n:
                raise ValueError(f"{len(node.values)} values for {n} elements")
            raw = self.elements(t, node.values)
        if raw is not None and len(raw) != n * t.size:
            raise ValueError(f"{len(raw)} bytes for {n} elements of {t.size}")
        chunked = node.chunk is not None and bool(shape)
        messages = [(1, dataspace(shape, node.most), 0)]
        messages.append((3, bytes((3, 2)) + u64(self.committed.get(f"{path}/{node.committed}", self.committed.get(node.committed))), 2) if node.committed else (3, datatype(t), 0))
        messages.append((5, fill_value(t, node.fill, node.early or node.compact, chunked), 0))
        if chunked:
            messages.append((8, self.chunked(node, raw), 0))
            if node.filters:
                messages.append((11, filters(node.filters), 0))
        elif node.compact:
            data = raw or b""
            messages.append((8, bytes((4, 0)) + self._short(len(data)) + data, 0))
        else:
            messages.append((8, bytes((4, 1)) + (u64(self.put(raw)) if raw else UNDEFINED) + u64(n * t.size), 0))
        messages += self.attribute_messages(node.attributes, None, False)
        return self.header(messages)

    def chunked(self, node: DatasetNode, raw: bytes | None) -> bytes:
        shape, chunk, size = node.shape, node.chunk, node.type.size
        if len(chunk) != len(shape) or any(c < 1 for c in chunk):
            raise ValueError(f"chunks of {chunk} for {shape}")
        tiles = node.tiles
        if tiles is None:
            tiles = encoded_tiles(raw, node) if raw is not None else {}
        index = node.index or ("b-tree v1" if node.layout_version == 3 else choose_index(shape, chunk, node.most, bool(node.filters), node.early))
        most = tuple(d if m is None else m for d, m in zip(shape, node.most or shape, strict=True))
        grid = [-(-d // c) for d, c in zip(most, chunk, strict=True)]
        free = next((k for k, m in enumerate(node.most or ()) if m is None), 0) if index == "extensible array" else 0

        def linear(scaled) -> int:
            order = [free, *(k for k in range(len(grid)) if k != free)]
            k = 0
            for d in order:
                k = k * grid[d] + scaled[d]
            return k

        chunk_bytes = math.prod(chunk) * size
        if index == "implicit":
            blank = encode(node.type, [node.fill or 0]) if node.fill is not None else bytes(size)
            whole = b"".join(tiles[s][0] if s in tiles else blank * math.prod(chunk) for s in np.ndindex(*grid))
            placed, base = {}, self.put(whole) if tiles or node.early else None
        else:
            placed, base = {s: (self.put(data), len(data), mask) for s, (data, mask) in sorted(tiles.items())}, None
        width = max(_bytes_for(x) for x in (*chunk, size))
        dims = b"".join(int(x).to_bytes(width, "little") for x in (*chunk, size))
        flags = 2 if index == "single" and node.filters else 0
        head = bytes((4, 2, flags, len(chunk) + 1, width)) + dims
        wide = min(8, 1 + (chunk_bytes.bit_length() - 1 + 8) // 8)
        entry = lambda e: (UNDEFINED if e is None else u64(e[0])) + ((e[1] if e else 0).to_bytes(wide, "little") + u32(e[2] if e else 0) if node.filters else b"")
        esize = 8 + (wide + 4 if node.filters else 0)
        if index == "b-tree v1":
            return bytes((3, 2, len(chunk) + 1)) + (u64(self.tree_v1(placed, chunk, shape)) if placed else UNDEFINED) + b"".join(u32(x) for x in (*chunk, size))
        if index == "single":
            e = placed.get((0,) * len(shape))
            return head + b"\1" + (u64(e[1] if e else 0) + u32(e[2] if e else 0) if flags else b"") + (u64(e[0]) if e else UNDEFINED)
        if index == "implicit":
            return head + b"\2" + (u64(base) if base else UNDEFINED)
        by_place = {linear(s): e for s, e in placed.items()}
        if index == "fixed array":
            return head + b"\3" + u8(10) + (u64(self.fixed_array([by_place.get(k) for k in range(math.prod(grid))], entry, esize, bool(node.filters))) if placed else UNDEFINED)
        if index == "extensible array":
            top = max(by_place, default=-1) + 1
            return head + b"\4" + bytes((32, 4, 4, 16, 10)) + (u64(self.extensible_array([by_place.get(k) for k in range(top)], entry, esize, bool(node.filters))) if placed else UNDEFINED)
        records = [entry(e) + b"".join(map(u64, s)) for s, e in sorted(placed.items())]
        return head + b"\5" + u32(2048) + bytes((100, 40)) + (u64(self.tree_v2(11 if node.filters else 10, esize + 8 * len(shape), records)) if placed else UNDEFINED)

    def fixed_array(self, entries: list, entry, esize: int, filtered: bool, page_bits: int = 10) -> int:
        page = 1 << page_bits
        header_at = len(self.out) + (-len(self.out) % 8)
        block_at = header_at + 32
        self.put(sealed(b"FAHD\0" + bytes((int(filtered), esize, page_bits)) + u64(len(entries)) + u64(block_at)).ljust(32, b"\0"))
        head = b"FADB\0" + u8(int(filtered)) + u64(header_at)
        if len(entries) <= page:
            body = sealed(head + b"".join(map(entry, entries)))
        else:
            pages = [entries[k : k + page] for k in range(0, len(entries), page)]
            bits = np.packbits([1] * len(pages)).tobytes()
            body = sealed(head + bits) + b"".join(sealed(b"".join(map(entry, p))) for p in pages)
        assert self.put(body) == block_at
        return header_at

    def extensible_array(self, entries: list, entry, esize: int, filtered: bool, max_bits: int = 32, in_index: int = 4, least: int = 16, pointers: int = 4, page_bits: int = 10) -> int:
        client, wide, page = u8(int(filtered)), (max_bits + 7) // 8, 1 << page_bits
        header_at = self.put(bytes(12 + 48 + 8 + 4))
        n_super, direct = 1 + max_bits - (least.bit_length() - 1), 2 * (pointers.bit_length() - 1)
        at, blocks, supers = in_index, [], []

        def data_block(own: list, start: int, n: int) -> int:
            own = own + [None] * (n - len(own))
            head = b"EADB\0" + client + u64(header_at) + start.to_bytes(wide, "little")
            if n <= page:
                return self.put(sealed(head + b"".join(map(entry, own))))
            return self.put(sealed(head) + b"".join(sealed(b"".join(map(entry, own[k : k + page]))) for k in range(0, n, page)))

        for u in range(n_super):
            n_blocks, n = 1 << u // 2, (1 << (u + 1) // 2) * least
            own, start = [], at - in_index
            for _ in range(n_blocks):
                own.append(u64(data_block(entries[at : at + n], at - in_index, n)) if at < len(entries) else UNDEFINED)
                at += n
            if u < direct:
                blocks += own
            elif own[0] == UNDEFINED:
                supers.append(UNDEFINED)
            else:
                bits = b"".join((b"\xff" * ((n // page + 7) // 8)) for _ in own) if n > page else b""
                supers.append(u64(self.put(sealed(b"EASB\0" + client + u64(header_at) + start.to_bytes(wide, "little") + bits + b"".join(own)))))
            if at >= len(entries) and u >= direct:
                supers += [UNDEFINED] * (n_super - u - 1)
                break
        first = entries[:in_index] + [None] * (in_index - len(entries[:in_index]))
        index_at = self.put(sealed(b"EAIB\0" + client + u64(header_at) + b"".join(map(entry, first)) + b"".join(blocks) + b"".join(supers)))
        stats = b"".join(map(u64, (0, 0, 0, 0, len(entries), len(entries))))
        header = sealed(b"EAHD\0" + client + bytes((esize, max_bits, in_index, least, pointers, page_bits)) + stats + u64(index_at))
        self.out[header_at : header_at + len(header)] = header
        return header_at

    def tree_v1(self, placed: dict, chunk, shape, fan: int = 64) -> int:
        rank = len(chunk)
        key = lambda s, n, mask: u32(n) + u32(mask) + b"".join(u64(a * c) for a, c in zip(s, chunk, strict=True)) + u64(0)
        size = 24 + fan * 8 + (fan + 1) * (16 + 8 * rank)
        rows = [(key(s, n, mask), at) for s, (at, n, mask) in sorted(placed.items())]
        end = key(tuple(-(-d // c) for d, c in zip(shape, chunk, strict=True)), 0, 0)
        level = 0
        while True:
            parts = [rows[k : k + fan] for k in range(0, len(rows), fan)]
            start = len(self.out) + (-len(self.out) % 8)
            step = size + (-size % 8)
            above = []
            for k, part in enumerate(parts):
                left = u64(start + (k - 1) * step) if k else UNDEFINED
                right = u64(start + (k + 1) * step) if k + 1 < len(parts) else UNDEFINED
                last = parts[k + 1][0][0] if k + 1 < len(parts) else end
                body = b"TREE" + bytes((1, level)) + u16(len(part)) + left + right + b"".join(q + u64(a) for q, a in part) + last
                above.append((part[0][0], self.put(body.ljust(size, b"\0"))))
            if len(above) == 1:
                return above[0][1]
            rows, level = above, level + 1


def encoded_tiles(raw: bytes, node: DatasetNode) -> dict[tuple[int, ...], tuple[bytes, int]]:
    """{scaled: (stored bytes, mask)} of all tiles; edges are padded with the fill value."""
    size = node.type.size
    cube = np.frombuffer(raw, f"V{size}").reshape(node.shape)
    blank = encode(node.type, [node.fill]) if node.fill is not None and not isinstance(node.fill, bytes) else node.fill or bytes(size)
    out = {}
    for scaled in np.ndindex(*(-(-d // c) for d, c in zip(node.shape, node.chunk, strict=True))):
        own = cube[tuple(slice(s * c, (s + 1) * c) for s, c in zip(scaled, node.chunk, strict=True))]
        if own.shape != tuple(node.chunk):
            whole = np.frombuffer(bytearray(blank * math.prod(node.chunk)), f"V{size}").reshape(node.chunk)
            whole[tuple(slice(0, n) for n in own.shape)] = own
            own = whole
        out[scaled] = codecs.encode(own.tobytes(), node.filters)
    return out


def build(root: GroupNode, times=None, superblock_version: int = 3) -> bytes:
    """The container's bytes."""
    return bytes(Builder(root, times, superblock_version).out)
