import math
import struct

import numpy as np
import pytest

from tilewright.container import reader as R
from tilewright.container import types as T
from tilewright.container.bytesource import lookup3
from tilewright.container.reader import Container, FormatError
from tilewright.container.writer import GroupNode, build, choose_index
from tilewright.functions import codecs as C
from tilewright.operators import render

I4 = T.integer(4)


def opened(fill, **options):
    root = GroupNode()
    fill(root)
    return Container.from_bytes(build(root, **options))


LAYOUTS = [
    ("single", (10, 10), (10, 10), dict(filters=((1, (6,)),))), ("single", (3,), (4,), {}),
    ("fixed array", (10, 10), (5, 5), dict(filters=((2, (4,)), (1, (6,)), (3, ())))),
    ("fixed array", (3000,), (1,), {}), ("fixed array", (2500,), (1,), dict(filters=((3, ()),))),
    ("implicit", (7, 5), (4, 3), dict(early=True)),
    *(("extensible array", (k * 5,), (5,), dict(most=(None,))) for k in (1, 3, 15, 25, 100, 700, 5000)),
    ("extensible array", (6, 40), (2, 3), dict(most=(6, None), filters=((1, (1,)),))),
    ("extensible array", (150_000,), (1,), dict(most=(None,))),
    *(("b-tree v2", (k, 2), (1, 2), dict(most=(None, None))) for k in (1, 200, 9000)),
    ("b-tree v2", (6, 4), (3, 2), dict(most=(None, None), filters=((1, (6,)),))),
    *(("b-tree v1", (k,), (1,), dict(layout_version=3)) for k in (1, 3, 300, 9000)),
    ("b-tree v1", (7, 5), (4, 3), dict(layout_version=3, filters=((32000, ()),))),
    ("single", (8,), (8,), dict(filters=((6, C.scaleoffset_params(8, 4, True)),))),
    ("single", (8,), (8,), dict(filters=((5, C.nbit_params(8, 4, 0, 20, 0)),))),
]


@pytest.mark.parametrize("index,shape,chunk,options", LAYOUTS)
def test_chunk_indexes(index, shape, chunk, options):
    values = list(range(math.prod(shape)))
    d = (c := opened(lambda r: r.dataset("x", I4, shape, values, chunk=chunk, **options))).dataset(c.resolve("/x"))
    assert d.layout.index == index and d.chunk_shape == chunk
    assert len(d.chunks()) == math.prod(-(-a // b) for a, b in zip(shape, chunk, strict=True))
    assert d.values() == values
    cube = np.array(values).reshape(shape)
    start = tuple(n // 3 for n in shape)
    count = tuple(max(1, n // 2) for n in shape)
    count = tuple(min(k, n - s) for k, n, s in zip(count, shape, start, strict=True))
    assert d.values(start, count) == cube[tuple(slice(s, s + k) for s, k in zip(start, count, strict=True))].ravel().tolist()


def test_slabs_read_only_what_they_overlap():
    c = opened(lambda r: r.dataset("x", I4, (40, 40), list(range(1600)), chunk=(10, 10)))
    d = c.dataset(c.resolve("/x"))
    seen = []
    d.chunk_data = lambda chunk, own=d.chunk_data: (seen.append(chunk.scaled), own(chunk))[1]
    d.read((12, 5), (10, 10))
    assert sorted(seen) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    for bad in (((0,), (1,)), ((0, 0, 0), (1, 1, 1))):
        with pytest.raises(ValueError):
            d.read(*bad)
    with pytest.raises(IndexError):
        d.read((35, 0), (6, 1))
    assert d.read((0, 0), (0, 5)) == b""


def test_element_types():
    point = T.compound(("color", T.enum(I4, RED=0, GREEN=1)), ("coords", T.array(I4, 3)), ("id", T.integer(4, order=">")))

    def fill(r):
        r.dataset("names", T.vlen_string(), (4,), ["hello", "world", "", "variable-length"])
        r.dataset("seq", T.vlen(I4), (3,), [[10, 20], [100, 200, 300, 400], []])
        r.dataset("deep", T.vlen(T.vlen_string()), (2,), [["a", "bc"], []])
        r.dataset("be", T.integer(4, order=">"), (6,), [1, 256, 65536, -1, 1000000, 0])
        r.dataset("rec", point, (2,), [{"color": 0, "coords": [1, 2, 3], "id": 100}, {"color": 7, "coords": [4, 5, 6], "id": 200}], chunk=(1,))
        r.dataset("cx", T.complex_(), (2,), [{"re": 1.0, "im": 2.0}, {"re": 3.0, "im": -4.0}])
        r.dataset("bits", T.integer(2, signed=False, precision=10, offset=2), (2,), [400, 5 << 2])
        r.dataset("grid", T.array(T.floating(4), 2, 2), (1,), [[[1.0, 2.0], [3.0, 4.0]]])
        r.dataset("opaque", T.Type("opaque", 3, tag="t"), (2,), [b"abc", b"de"])
        r.dataset("pad", T.fixed_string(6, "space-pad"), (2,), ["ab", "cdefgh"])
        r.dataset("u8", T.integer(8, signed=False), (1,), [2**64 - 1])

    c = opened(fill)
    got = lambda n, **k: c.dataset(c.resolve(n)).values(**k)
    assert got("names") == ["hello", "world", "", "variable-length"]
    assert got("seq") == [[10, 20], [100, 200, 300, 400], []]
    assert got("deep") == [["a", "bc"], []]
    assert got("be") == [1, 256, 65536, -1, 1000000, 0]
    assert got("rec", labels=True) == [{"color": "RED", "coords": [1, 2, 3], "id": 100}, {"color": "7", "coords": [4, 5, 6], "id": 200}]
    assert got("cx")[1] == {"re": 3.0, "im": -4.0}
    assert got("bits") == [100, 5]
    assert got("grid") == [[[1.0, 2.0], [3.0, 4.0]]]
    assert got("opaque") == [b"abc", b"de\0"] and got("pad") == ["ab", "cdefgh"] and got("u8") == [2**64 - 1]
    assert T.swap_to(point, T.encode(point, [{"color": 0, "coords": [1, 2, 3], "id": 9}]), ">").hex() == "00000000" "00000001" "00000002" "00000003" "00000009"


def test_fill_values_and_spaces():
    def fill(r):
        r.dataset("never", I4, (6,), None, chunk=(4,), fill=-999)
        r.dataset("flat", I4, (3,), None, fill=5)
        r.dataset("plain", I4, (3,), None, chunk=(2,))
        r.dataset("null", I4, None)
        r.dataset("one", I4, (), [7])
        r.dataset("small", T.integer(2), (4,), [1, 2, 3, 4], compact=True)

    c = opened(fill)
    d = lambda n: c.dataset(c.resolve(n))
    assert d("never").values() == [-999] * 6 and set(d("never").read(fill=False)) == {0}
    assert d("flat").values() == [5] * 3 and d("plain").values() == [0] * 3
    assert d("null").values() == [] and d("one").values() == [7] and d("small").values((1,), (2,)) == [2, 3]
    assert R.parse_old_fill(bytes.fromhex("0400000019fcffff")) == R.Fill(True, bytes.fromhex("19fcffff"))
    assert R.parse_old_fill(bytes(4)) == R.Fill(True, None)


def test_tree_links_and_attributes():
    def fill(r):
        r.commit("mine", I4)
        r.dataset("data", I4, (2,), [5, 6], committed="mine").attribute("scale", I4, 42, committed="mine")
        g = r.group("many", dense_attributes=3, dense_links=4, ordered=True)
        for k in range(300):
            g.group(f"child_{k:04d}_padding").group("in")
        for k in range(40):
            g.attribute(f"attr_{k:02d}", I4, k * 100)
        o = r.group("ordered", ordered=True)
        for n in ("charlie", "alpha", "bravo"):
            o.group(n)
        g.soft("up", "child_0007_padding/in")
        r.soft("abs", "/many/up")
        r.soft("loop", "/loop")
        r.external("x", "o.h5", "/y")

    c = opened(fill, times=(1, 2, 3, 4))
    many = c.resolve("/many")
    assert len(c.links(many)) == 301 and [x.name for x in c.links(many, by_order=True)][:2] == ["child_0000_padding", "child_0001_padding"]
    assert [c.value(a) for a in c.attributes(many, by_order=True)] == [k * 100 for k in range(40)]
    assert [x.name for x in c.links(c.resolve("/ordered"), by_order=True)] == ["charlie", "alpha", "bravo"]
    assert c.resolve("/abs") == c.resolve("/many/child_0007_padding/in")
    assert c.kind(c.resolve("/mine")) == "datatype" and c.dataset(c.resolve("/data")).values() == [5, 6]
    assert c.value(c.attributes(c.resolve("/data"))[0]) == 42
    for bad in ("/loop", "/x", "/nothing", "/data/below"):
        with pytest.raises(KeyError):
            c.resolve(bad)
    assert c.header(c.superblock.root).times == (1, 2, 3, 4)
    text = "\n".join(render.info(c))
    assert "/data: int32 little-endian (2), contiguous" in text and "x -> o.h5:/y" in text
    tree = render.to_json(c)
    assert tree["children"]["data"]["data"] == [5, 6] and tree["children"]["loop"] == {"kind": "soft link", "target": "/loop"}


def test_bad_files():
    good = build(GroupNode())
    assert Container.from_bytes(good).superblock.serialized_size == 48
    with pytest.raises(FormatError):
        Container.from_bytes(b"x" + good[1:])
    with pytest.raises(FormatError):
        Container.from_bytes(good[:8] + b"\0" + good[9:])
    with pytest.raises(FormatError):
        Container.from_bytes(good[:20] + b"\1" + good[21:])
    broken = bytearray(good)
    broken[-1] ^= 1
    c = Container.from_bytes(bytes(broken))
    with pytest.raises(FormatError):
        c.links(c.superblock.root)
    with pytest.raises(EOFError):
        c.read(len(good), 1)
    for bad in (dict(shape=(3,), values=[1]), dict(shape=(3,), values=[1, 2, 3], chunk=(0,))):
        with pytest.raises(ValueError):
            opened(lambda r, bad=bad: r.dataset("x", I4, **bad))
    root = GroupNode()
    root.group("a")
    with pytest.raises(ValueError):
        root.group("a")


def test_single_messages():
    head = lambda kind, version, bits, size, props=b"": bytes((version << 4 | kind,)) + bits.to_bytes(3, "little") + struct.pack("<I", size) + props
    parse = lambda b: R.parse_type(R.Cursor(b))
    i4 = head(0, 1, 8, 4, struct.pack("<HH", 0, 32))
    assert parse(i4).signed and parse(head(1, 1, 0x41 | 0x20, 4, bytes(12))).order == "vax"
    with pytest.raises(FormatError):
        parse(head(1, 1, 0x40, 4, bytes(12)))
    with pytest.raises(FormatError):
        parse(head(13, 1, 0, 4))
    v2 = head(6, 2, 1, 4, b"abc\0\0\0\0\0" + struct.pack("<I", 0) + i4)
    v1 = head(6, 1, 1, 16, b"abcdefg\0" + struct.pack("<I", 0) + bytes([2]) + bytes(11) + struct.pack("<4I", 2, 2, 0, 0) + i4)
    v3 = head(6, 3, 1, 70_000, b"abc\0" + (1).to_bytes(3, "little") + i4)
    assert parse(v2).members[0][0] == "abc" and parse(v1).members[0][2].dims == (2, 2) and parse(v3).members[0][1] == 1
    enum = head(8, 1, 2, 4, i4 + b"RED\0\0\0\0\0" + b"GREEN\0\0\0" + struct.pack("<2i", 0, 1))
    assert [n for n, _ in parse(enum).members] == ["RED", "GREEN"]
    array2 = head(10, 2, 0, 24, bytes([2, 0, 0, 0]) + struct.pack("<4I", 2, 3, 0, 1) + i4)
    assert parse(array2).dims == (2, 3) and parse(array2).base.size == 4
    one = R.parse_filters(bytes([1, 1]) + bytes(6) + struct.pack("<4H", 1, 8, 0, 1) + b"deflate\0" + struct.pack("<2I", 6, 0))
    assert one[0] == R.Filter(1, "deflate", 0, (6,))
    two = R.parse_filters(bytes([2, 2]) + struct.pack("<4H", 32000, 4, 1, 0) + b"lzf\0" + struct.pack("<3H", 3, 0, 0))
    assert [f.id for f in two] == [32000, 3]
    assert R.parse_dataspace(bytes([1, 0, 0, 0, 0, 0, 0, 0])).kind == "scalar" and R.parse_dataspace(bytes([2, 0, 0, 2])).size == 0
    with pytest.raises(FormatError):
        R.Cursor(b"x").expect(b"y")
    assert lookup3(b"abc") != lookup3(b"abd")


def test_index_choice():
    assert choose_index((10,), (10,), None, False, False) == "single"
    assert choose_index((11,), (10,), None, False, True) == "implicit"
    assert choose_index((11,), (10,), None, True, True) == "fixed array"
    assert choose_index((5,), (10,), (None,), False, False) == "extensible array"
    assert choose_index((5, 5), (10, 10), (None, None), False, False) == "b-tree v2"


def test_filtered_heap():
    """A heap whose blocks are compressed, laid out by hand."""
    data = b"FHDB\0" + struct.pack("<Q", 0) + bytes(4) + b"hello heap"
    block = C.encode(data.ljust(512, b"\0"), [(1, (6,))])[0]
    message = bytes([2, 1]) + struct.pack("<3H", 1, 0, 1) + struct.pack("<I", 6)
    head = b"FRHP\0" + struct.pack("<HHBI", 7, len(message), 0, 4096) + bytes(8) + b"\xff" * 8 + bytes(8) + b"\xff" * 8 + bytes(64)
    head += struct.pack("<HQQHH", 4, 512, 65536, 32, 1) + struct.pack("<QH", 2048, 0) + struct.pack("<QI", len(block), 0) + message
    head += struct.pack("<I", lookup3(head))
    raw = bytearray(build(GroupNode()).ljust(4096, b"\0"))
    raw[1024 : 1024 + len(head)] = head
    raw[2048 : 2048 + len(block)] = block
    heap = R.FractalHeap(Container.from_bytes(bytes(raw)), 1024)
    assert heap.get(b"\0" + struct.pack("<IH", 17, 10)) == b"hello heap"
    assert heap.get(bytes([0x12]) + b"xyz") == b"xyz"
    assert [heap.row_size(k) for k in range(4)] == [512, 512, 1024, 2048] and heap.direct_rows == 9
