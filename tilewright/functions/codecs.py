"""Chunk filters, on NumPy buffers.

A pipeline is a list of (id, parameters). Encoding applies it in order, decoding in
reverse; a set bit k of a chunk's filter mask means that filter k was not applied.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

DEFLATE, SHUFFLE, FLETCHER32, SZIP, NBIT, SCALEOFFSET, LZF = 1, 2, 3, 4, 5, 6, 32000
NAMES = {DEFLATE: "deflate", SHUFFLE: "shuffle", FLETCHER32: "fletcher32", SZIP: "szip", NBIT: "nbit", SCALEOFFSET: "scaleoffset", LZF: "lzf"}
Pipeline = Sequence[tuple[int, Sequence[int]]]


class CodecError(ValueError):
    """A chunk that its filters cannot decode, or a filter that is not supported."""


# -- shuffle ------------------------------------------------------------------------


def shuffle(data: bytes, size: int) -> bytes:
    """Byte k of every element together; a tail shorter than an element stays as it is."""
    n = len(data) // size if size > 1 else 0
    if n < 2:
        return data
    body = np.frombuffer(data, np.uint8, n * size)
    return body.reshape(n, size).T.tobytes() + data[n * size :]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size if size > 1 else 0
    if n < 2:
        return data
    body = np.frombuffer(data, np.uint8, n * size)
    return body.reshape(size, n).T.tobytes() + data[n * size :]


# -- fletcher32 ---------------------------------------------------------------------


def fletcher32(data: bytes) -> int:
    """Fletcher's checksum over big-endian 16-bit words, an odd last byte as a high one."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.int64)
    n = len(words)
    one = int(words.sum())
    # the weights are taken modulo 65535 too, so that no product overflows
    two = int((words * ((n - np.arange(n)) % 65535) % 65535).sum()) if n else 0
    any_two = bool(words.any())
    fold = lambda s, some: (s - 1) % 65535 + 1 if some else 0
    return fold(two, any_two) << 16 | fold(one, one > 0)


def _unfletcher(data: bytes) -> bytes:
    if len(data) < 4:
        raise CodecError("a checksummed chunk has four bytes at least")
    body, want = data[:-4], struct.unpack("<I", data[-4:])[0]
    if fletcher32(body) != want:
        raise CodecError("fletcher32 checksum mismatch")
    return body


# -- bit strings --------------------------------------------------------------------


def _take_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, the highest first, as unsigned numbers."""
    out = np.zeros(len(bits), np.uint64)
    for k in range(bits.shape[1]):
        out = (out << np.uint64(1)) | bits[:, k].astype(np.uint64)
    return out


def _give_bits(values: np.ndarray, width: int) -> np.ndarray:
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)


# -- n-bit --------------------------------------------------------------------------


def _nbit_fields(params: Sequence[int], at: int, base: int) -> tuple[list, int, int]:
    """[(place, size, order, precision, offset)] of one element; precision 0: whole bytes."""
    kind, size = params[at], params[at + 1]
    if kind == 1:
        return [(base, size, *params[at + 2 : at + 5])], at + 5, size
    if kind == 4:
        return [(base, size, 0, 0, 0)], at + 2, size
    if kind == 2:
        own, end, inner = _nbit_fields(params, at + 2, 0)
        return [(base + k * inner + p, *rest) for k in range(size // inner) for p, *rest in own], end, size
    if kind == 3:
        out, end = [], at + 3
        for _ in range(params[at + 2]):
            own, end, _ = _nbit_fields(params, end + 1, base + params[end])
            out += own
        return out, end, size
    raise CodecError(f"unknown n-bit class {kind}")


def nbit_params(n: int, size: int, order: int, precision: int, offset: int) -> list[int]:
    """Parameters for n plain integers; order: 0 little-, 1 big-endian."""
    return [8, int(precision == 8 * size and not offset), n, 1, size, order, precision, offset]


def nbit_decode(data: bytes, params: Sequence[int]) -> bytes:
    if params[1]:
        return data
    n = params[2]
    fields, _, size = _nbit_fields(params, 3, 0)
    widths = [f[3] or 8 * f[1] for f in fields]
    total = sum(widths)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * total).reshape(n, total) if n else np.zeros((0, total), np.uint8)
    out, at = np.zeros((n, size), np.uint8), 0
    for (place, width, order, precision, offset), k in zip(fields, widths, strict=True):
        own, at = bits[:, at : at + k], at + k
        if not precision:
            out[:, place : place + width] = np.packbits(own, axis=1)
            continue
        raw = (_take_bits(own) << np.uint64(offset)).astype(">u8" if order else "<u8").view(np.uint8).reshape(n, 8)
        out[:, place : place + width] = raw[:, 8 - width :] if order else raw[:, :width]
    return out.tobytes()


def nbit_encode(data: bytes, params: Sequence[int]) -> bytes:
    if params[1]:
        return data
    n = params[2]
    fields, _, size = _nbit_fields(params, 3, 0)
    rows = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    parts = []
    for place, width, order, precision, offset in fields:
        own = rows[:, place : place + width]
        if not precision:
            parts.append(np.unpackbits(own, axis=1))
            continue
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 8 - width :] = own if order else own[:, ::-1]
        parts.append(_give_bits(wide.view(">u8").ravel().astype(np.uint64) >> np.uint64(offset), precision))
    return np.packbits(np.concatenate(parts, axis=1).ravel()).tobytes() if n else b""


# -- scale-offset -------------------------------------------------------------------


def scaleoffset_params(n: int, size: int, signed: bool, order: int = 0, scale: int | None = None, fill: bytes | None = None) -> list[int]:
    """scale: decimal digits kept of floats; None: integers."""
    filled = [0] * 12
    if fill:
        filled = list(struct.unpack("<12I", fill.ljust(48, b"\0")))
    return [2 if scale is None else 0, scale or 0, n, 0 if scale is None else 1, size, int(signed), order, int(fill is not None), *filled]


def _int_type(params: Sequence[int]) -> np.dtype:
    return np.dtype(f"{'>' if params[6] else '<'}{'i' if params[5] else 'u'}{params[4]}")


def _fill_of(params: Sequence[int], kind: np.dtype):
    if len(params) < 9 or not params[7]:
        return None
    raw = struct.pack(f"<{len(params) - 8}I", *params[8:])
    return np.frombuffer(raw, kind.newbyteorder("<"), 1)[0]


def scaleoffset_encode(data: bytes, params: Sequence[int]) -> bytes:
    n, size = params[2], params[4]
    if params[3]:
        kind = np.dtype(f"{'>' if params[6] else '<'}f{size}")
        raw = np.frombuffer(data, kind, n).astype(np.float64)
        fill = _fill_of(params, kind)
        real = np.ones(n, bool) if fill is None else raw != fill
        least = raw[real].min() if real.any() else 0.0
        steps = np.rint(raw * 10.0 ** params[1]) - np.rint(least * 10.0 ** params[1])
        values = np.where(real, steps, 0).astype(np.uint64)
        low = np.array(least, kind.newbyteorder("<")).tobytes().ljust(8, b"\0")
    else:
        raw = np.frombuffer(data, _int_type(params), n).astype(object if size == 8 else np.int64)
        fill = _fill_of(params, _int_type(params))
        real = np.ones(n, bool) if fill is None else np.array(raw != int(fill), bool)
        least = int(raw[real].min()) if real.any() else 0
        values = np.where(real, raw - least, 0).astype(np.uint64)
        low = struct.pack("<q" if params[5] else "<Q", least)
    most = int(values[real].max()) if real.any() else 0
    bits = int(most + (fill is not None)).bit_length()
    if bits >= 8 * size:
        return struct.pack("<IB", 8 * size, 8) + low + b"\0" * 8 + data
    if fill is not None:
        values[~real] = (1 << bits) - 1
    packed = np.packbits(_give_bits(values, bits).ravel()).tobytes() if bits else b""
    return struct.pack("<IB", bits, 8) + low + b"\0" * 8 + packed


def scaleoffset_decode(data: bytes, params: Sequence[int]) -> bytes:
    n, size = params[2], params[4]
    bits, width = struct.unpack_from("<IB", data)
    low, body = data[5 : 5 + width], data[21:]
    if bits >= 8 * size:
        return body[: n * size]
    packed = np.unpackbits(np.frombuffer(body, np.uint8), count=n * bits).reshape(n, bits) if bits and n else np.zeros((n, 0), np.uint8)
    values = _take_bits(packed)
    if params[3]:
        kind = np.dtype(f"{'>' if params[6] else '<'}f{size}")
        fill = _fill_of(params, kind)
        least = float(np.frombuffer(low, f"<f{size}", 1)[0])
        out = values / 10.0 ** params[1] + least
    else:
        kind = _int_type(params)
        fill = _fill_of(params, kind)
        least = np.frombuffer(low.ljust(8, b"\0"), "<i8" if params[5] else "<u8", 1)[0]
        with np.errstate(over="ignore"):
            out = (values + np.array(least).astype(np.uint64)).astype(f"{'i' if params[5] else 'u'}8")
    if fill is not None:
        full = (1 << bits) - 1
        out = np.where(values == np.uint64(full), fill, out) if bits else np.where(np.zeros(n, bool), fill, out)
    return out.astype(kind).tobytes()


# -- LZF ----------------------------------------------------------------------------


def lzf_decode(data: bytes, size: int | None = None) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = len(out) - ((control & 31) << 8 | data[at]) - 1
        at += 1
        if back < 0:
            raise CodecError("an LZF reference points before the start")
        length += 2
        if back + length <= len(out):
            out += out[back : back + length]
        else:
            run = bytes(out[back:])
            out += (run * (length // len(run) + 1))[:length]
    if size is not None and len(out) != size:
        raise CodecError(f"LZF gave {len(out)} bytes instead of {size}")
    return bytes(out)


def lzf_encode(data: bytes) -> bytes:
    out, seen, at, plain, n = bytearray(), {}, 0, 0, len(data)

    def literals(end: int) -> None:
        for k in range(plain, end, 32):
            run = data[k : min(k + 32, end)]
            out.append(len(run) - 1)
            out.extend(run)

    while at + 3 <= n:
        key = data[at : at + 3]
        before = seen.get(key, -1)
        seen[key] = at
        if before < 0 or at - before > 8192:
            at += 1
            continue
        length, most = 3, min(264, n - at)
        while length < most and data[before + length] == data[at + length]:
            length += 1
        literals(at)
        back, short = at - before - 1, length - 2
        if short < 7:
            out += bytes((short << 5 | back >> 8, back & 255))
        else:
            out += bytes((7 << 5 | back >> 8, short - 7, back & 255))
        for k in range(at + 1, min(at + length, n - 2)):
            seen[data[k : k + 3]] = k
        at += length
        plain = at
    literals(n)
    return bytes(out)


# -- pipelines ----------------------------------------------------------------------


def _encode(kind: int, data: bytes, params: Sequence[int]) -> bytes:
    if kind == DEFLATE:
        return zlib.compress(data, params[0] if params else 6)
    if kind == SHUFFLE:
        return shuffle(data, params[0] if params else 1)
    if kind == FLETCHER32:
        return data + struct.pack("<I", fletcher32(data))
    if kind == NBIT:
        return nbit_encode(data, params)
    if kind == SCALEOFFSET:
        return scaleoffset_encode(data, params)
    if kind == LZF:
        return lzf_encode(data)
    raise CodecError(f"filter {NAMES.get(kind, kind)} is not supported")


def _decode(kind: int, data: bytes, params: Sequence[int]) -> bytes:
    if kind == DEFLATE:
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise CodecError(str(e)) from e
    if kind == SHUFFLE:
        return unshuffle(data, params[0] if params else 1)
    if kind == FLETCHER32:
        return _unfletcher(data)
    if kind == NBIT:
        return nbit_decode(data, params)
    if kind == SCALEOFFSET:
        return scaleoffset_decode(data, params)
    if kind == LZF:
        return lzf_decode(data, params[2] if len(params) > 2 else None)
    raise CodecError(f"filter {NAMES.get(kind, kind)} is not supported")


def encode(data: bytes, pipeline: Pipeline) -> tuple[bytes, int]:
    """(stored bytes, filter mask). LZF output that is not smaller is left out."""
    mask = 0
    for k, (kind, params) in enumerate(pipeline):
        done = _encode(kind, data, params)
        if kind == LZF and len(done) >= len(data):
            mask |= 1 << k
        else:
            data = done
    return data, mask


def decode(data: bytes, pipeline: Pipeline, mask: int = 0) -> bytes:
    for k, (kind, params) in reversed(list(enumerate(pipeline))):
        if not mask >> k & 1:
            data = _decode(kind, data, params)
    return data
