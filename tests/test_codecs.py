import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.container.bytesource import lookup3
from tilewright.functions import codecs as C


def test_lookup3():
    assert lookup3(b"") == 0xDEADBEEF
    assert lookup3(b"Four score and seven years ago") == 0x17770551


def test_known_vectors():
    assert C.unshuffle(bytes([1, 5, 2, 6, 3, 7, 4, 8]), 4) == bytes(range(1, 9))
    assert C.nbit_decode(bytes([0xAB, 0xCD]), [8, 0, 4, 1, 1, 0, 4, 0]) == bytes([10, 11, 12, 13])
    assert C.nbit_decode(b"xyz", [8, 1, 3, 1, 1, 0, 8, 0]) == b"xyz"
    chunk = struct.pack("<IB", 3, 8) + struct.pack("<q", 1000) + bytes(8) + bytes([0x05, 0x30])
    assert np.frombuffer(C.scaleoffset_decode(chunk, [2, 0, 4, 0, 4, 1, 0, 0]), "<i4").tolist() == [1000, 1001, 1002, 1003]


def slow_fletcher(data: bytes) -> int:
    one = two = 0
    for k in range(0, len(data), 2):
        word = data[k] << 8 | (data[k + 1] if k + 1 < len(data) else 0)
        one = (one + word) % 65535 or (65535 if one + word else 0)
        two = (two + one) % 65535 or (65535 if two + one else 0)
    return two << 16 | one


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_fletcher32(data):
    assert C.fletcher32(data) == slow_fletcher(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from([1, 2, 4, 8, 3]))
def test_byte_filters_come_back(data, size):
    for pipeline in ([(2, (size,))], [(1, (6,))], [(3, ())], [(32000, ())], [(2, (size,)), (1, (9,)), (3, ())]):
        stored, mask = C.encode(data, pipeline)
        assert C.decode(stored, pipeline, mask) == data


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=60), st.booleans(), st.sampled_from([0, 1]))
def test_scaleoffset_integers(values, filled, order):
    raw = np.array(values, ">i4" if order else "<i4").tobytes()
    fill = struct.pack("<i", values[0] if values else 0) if filled else None
    params = C.scaleoffset_params(len(values), 4, True, order, fill=fill)
    assert C.scaleoffset_decode(C.scaleoffset_encode(raw, params), params) == raw


def test_scaleoffset_wide_and_float():
    raw = np.array([0, 2**64 - 1, 5], "<u8").tobytes()
    p = C.scaleoffset_params(3, 8, False)
    assert C.scaleoffset_decode(C.scaleoffset_encode(raw, p), p) == raw
    x = np.array([1.25, -3.5, 100.125], "<f8")
    p = C.scaleoffset_params(3, 8, True, scale=3)
    assert np.allclose(np.frombuffer(C.scaleoffset_decode(C.scaleoffset_encode(x.tobytes(), p), p)), x, atol=6e-4)


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("size,precision,offset", [(1, 5, 0), (2, 10, 3), (4, 32, 0), (4, 11, 7), (8, 40, 2)])
def test_nbit(order, size, precision, offset):
    v = (np.random.default_rng(1).integers(0, 1 << precision, 50, dtype=np.uint64) << np.uint64(offset)).astype(f"{'>' if order else '<'}u{size}")
    p = C.nbit_params(50, size, order, precision, offset)
    assert C.nbit_decode(C.nbit_encode(v.tobytes(), p), p) == v.tobytes()


def test_nbit_compound_and_array():
    # two members: an array of two 12-bit numbers, and two whole bytes
    params = [0, 0, 2, 3, 6, 2, 0, 2, 4, 1, 2, 0, 12, 0, 4, 4, 2]
    raw = struct.pack("<HH2s", 0x123, 0xABC, b"xy") + struct.pack("<HH2s", 0xFFF, 0, b"zz")
    assert C.nbit_decode(C.nbit_encode(raw, params), params) == raw


def test_masks_and_errors():
    stored, _ = C.encode(b"abcdabcd", [(2, (4,)), (1, (6,))])
    assert C.decode(C.shuffle(b"abcdabcd", 4), [(2, (4,)), (1, (6,))], mask=2) == b"abcdabcd"
    assert C.decode(stored, [(2, (4,)), (1, (6,))]) == b"abcdabcd"
    with pytest.raises(C.CodecError):
        C.decode(b"1234567", [(3, ())])
    with pytest.raises(C.CodecError):
        C.decode(b"", [(4, ())])
    with pytest.raises(C.CodecError):
        C.decode(b"not zlib", [(1, ())])
    small, mask = C.encode(os.urandom(3), [(32000, ())])
    assert mask == 1 and C.decode(small, [(32000, ())], mask) == small
