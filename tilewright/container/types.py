"""Element types: the container's classes, their NumPy and Spark forms, and decoding."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CLASSES = ("fixed", "float", "time", "string", "bitfield", "opaque", "compound", "reference", "enum", "vlen", "array", "complex")


@dataclass(frozen=True)
class Type:
    """One element type. ``order``: '<' or '>'. members: (name, offset, Type) of a
    compound, (name, raw value) of an enum."""

    kind: str
    size: int
    order: str = "<"
    signed: bool = False
    offset: int = 0
    precision: int = 0
    padding: str = "null-term"
    charset: str = "ascii"
    base: Type | None = None
    dims: tuple[int, ...] = ()
    members: tuple = ()
    tag: str = ""
    is_string: bool = False
    extra: tuple = field(default=(), compare=False)

    def describe(self) -> dict:
        """A plain form, for JSON."""
        out: dict = {"class": self.kind, "size": self.size}
        if self.kind in ("fixed", "float", "bitfield", "time"):
            out |= {"order": "little" if self.order == "<" else "big"}
        if self.kind == "fixed":
            out |= {"signed": self.signed} | ({"precision": self.precision, "offset": self.offset} if (self.precision, self.offset) != (8 * self.size, 0) else {})
        if self.kind == "string" or self.is_string:
            out |= {"padding": self.padding, "charset": self.charset}
        if self.kind == "vlen":
            out |= {"string": self.is_string}
        if self.base:
            out["base"] = self.base.describe()
        if self.kind == "array":
            out["dims"] = list(self.dims)
        if self.kind == "compound":
            out["members"] = [{"name": n, "offset": o, "type": t.describe()} for n, o, t in self.members]
        if self.kind == "enum":
            out["members"] = [{"name": n, "value": int(decode(self.base, v, 1)[0])} for n, v in self.members]
        if self.tag:
            out["tag"] = self.tag
        return out


def integer(size: int, signed: bool = True, order: str = "<", precision: int | None = None, offset: int = 0) -> Type:
    return Type("fixed", size, order, signed, offset, 8 * size if precision is None else precision)


def floating(size: int = 8, order: str = "<") -> Type:
    return Type("float", size, order, precision=8 * size)


def fixed_string(size: int, padding: str = "null-pad", charset: str = "utf-8") -> Type:
    return Type("string", size, padding=padding, charset=charset)


def vlen_string(charset: str = "utf-8") -> Type:
    return Type("vlen", 16, base=Type("string", 1, charset=charset), is_string=True, charset=charset)


def vlen(base: Type) -> Type:
    return Type("vlen", 16, base=base)


def array(base: Type, *dims: int) -> Type:
    return Type("array", base.size * int(np.prod(dims)), base=base, dims=tuple(dims))


def compound(*members: tuple[str, Type], size: int | None = None, offsets: list[int] | None = None) -> Type:
    at, out = 0, []
    for k, (name, t) in enumerate(members):
        at = offsets[k] if offsets else at
        out.append((name, at, t))
        at += t.size
    return Type("compound", size or at, members=tuple(out))


def enum(base: Type, /, **members: int) -> Type:
    return Type("enum", base.size, base=base, members=tuple((n, encode(base, [v])) for n, v in members.items()))


def complex_(size: int = 16, order: str = "<") -> Type:
    return Type("complex", size, base=floating(size // 2, order))


def numpy_dtype(t: Type) -> np.dtype | None:
    """The NumPy type that reads elements in place; None where there is none."""
    if t.kind == "fixed" and t.size in (1, 2, 4, 8):
        return np.dtype(f"{t.order}{'i' if t.signed else 'u'}{t.size}")
    if t.kind == "float" and t.order != "vax" and t.size in (2, 4, 8):
        return np.dtype(f"{t.order}f{t.size}")
    if t.kind == "enum":
        return numpy_dtype(t.base)
    return None


def spark_type(t: Type, labels: bool = False) -> str:
    """The Spark type of one element. Unsigned integers take the next wider type."""
    if t.kind == "enum":
        return "string" if labels else spark_type(t.base)
    if t.kind == "fixed" and t.size in (1, 2, 4, 8):
        return {(1, 1): "tinyint", (2, 1): "smallint", (4, 1): "int", (8, 1): "bigint", (1, 0): "smallint", (2, 0): "int", (4, 0): "bigint", (8, 0): "decimal(20,0)"}[t.size, int(t.signed)]
    if t.kind == "float" and t.order != "vax" and t.size in (2, 4, 8):
        return "double" if t.size == 8 else "float"
    if t.kind == "string" or t.kind == "vlen" and t.is_string:
        return "string"
    if t.kind == "vlen":
        return f"array<{spark_type(t.base, labels)}>"
    if t.kind == "array":
        return "array<" * len(t.dims) + spark_type(t.base, labels) + ">" * len(t.dims)
    if t.kind == "compound":
        return "struct<" + ",".join(f"`{n}`:{spark_type(m, labels)}" for n, _, m in t.members) + ">"
    if t.kind == "complex":
        return f"struct<re:{spark_type(t.base)},im:{spark_type(t.base)}>"
    return "binary"


def trim(raw: bytes, padding: str = "null-term") -> str:
    """A fixed string without its padding; spaces are only dropped where they pad."""
    if padding == "null-term":
        raw = raw.split(b"\0", 1)[0]
    raw = raw.rstrip(b"\0")
    if padding == "space-pad":
        raw = raw.rstrip(b" ")
    return raw.decode("utf-8", "replace")


def decode(t: Type, raw: bytes, n: int, heap=None, labels: bool = False) -> list:
    """n elements as Python values, in their Spark form. heap(address, index) gives a
    variable-length object; order and nesting are followed everywhere."""
    if t.kind == "enum":
        values = decode(t.base, raw, n)
        if not labels:
            return values
        names = {int(decode(t.base, v, 1)[0]): name for name, v in t.members}
        return [names.get(v, str(v)) for v in values]
    dtype = numpy_dtype(t)
    if dtype is not None:
        out = np.frombuffer(raw, dtype, n)
        if t.kind == "fixed" and (t.offset or t.precision < 8 * t.size):
            wide = out.astype(np.uint64) >> np.uint64(t.offset) & np.uint64((1 << t.precision) - 1)
            if t.signed:
                sign = np.uint64(1 << (t.precision - 1))
                wide = ((wide ^ sign).astype(np.int64) - np.int64(1 << (t.precision - 1))) if t.precision < 64 else wide.astype(np.int64)
            out = wide
        return out.tolist()
    cells = [raw[k * t.size : (k + 1) * t.size] for k in range(n)]
    if t.kind == "string":
        return [trim(c, t.padding) for c in cells]
    if t.kind == "array":
        m = int(np.prod(t.dims))
        flat = decode(t.base, raw[: n * t.size], n * m, heap, labels)
        for d in reversed(t.dims):
            flat = [flat[k : k + d] for k in range(0, len(flat), d)] if d else []
        return flat
    if t.kind == "compound":
        parts = [decode(m, b"".join(c[o : o + m.size] for c in cells), n, heap, labels) for _, o, m in t.members]
        names = [name for name, _, _ in t.members]
        return [dict(zip(names, row, strict=True)) for row in zip(*parts, strict=True)] if parts else [{} for _ in cells]
    if t.kind == "complex":
        flat = decode(t.base, raw[: n * t.size], 2 * n)
        return [{"re": a, "im": b} for a, b in zip(flat[::2], flat[1::2], strict=True)]
    if t.kind == "vlen":
        out = []
        for c in cells:
            length, address, index = int.from_bytes(c[:4], "little"), int.from_bytes(c[4:-4], "little"), int.from_bytes(c[-4:], "little")
            empty = not length or not address or address == (1 << 8 * (len(c) - 8)) - 1
            data = b"" if empty else heap(address, index)
            if t.is_string:
                out.append(data[:length].rstrip(b"\0").decode("utf-8", "replace"))
            else:
                out.append([] if empty else decode(t.base, data, min(length, len(data) // t.base.size), heap, labels))
        return out
    return [bytes(c) for c in cells]


def encode(t: Type, values: list, heap=None) -> bytes:
    """The bytes of elements; heap(data) stores a variable-length object and gives
    (address, index)."""
    dtype = numpy_dtype(t)
    if dtype is not None:
        return np.array(values, dtype).tobytes() if len(values) else b""
    if t.kind == "compound":
        cells = np.zeros((len(values), t.size), np.uint8)
        for name, at, m in t.members:
            cells[:, at : at + m.size] = np.frombuffer(encode(m, [v[name] for v in values], heap), np.uint8).reshape(len(values), m.size)
        return cells.tobytes()
    out = []
    for v in values:
        if t.kind == "string":
            data = (v or "").encode()[: t.size]
            out.append(data.ljust(t.size, b" " if t.padding == "space-pad" else b"\0"))
        elif t.kind == "array":
            flat = v
            for _ in t.dims[1:]:
                flat = [y for x in flat for y in x]
            out.append(encode(t.base, flat, heap))
        elif t.kind == "complex":
            out.append(encode(t.base, [v["re"], v["im"]]))
        elif t.kind == "vlen":
            data = v.encode() if t.is_string else encode(t.base, list(v), heap)
            if not data:
                out.append(bytes(16))
            else:
                address, index = heap(data)
                length = len(data) if t.is_string else len(v)
                out.append(length.to_bytes(4, "little") + address.to_bytes(8, "little") + index.to_bytes(4, "little"))
        else:
            out.append(bytes(v).ljust(t.size, b"\0")[: t.size])
    return b"".join(out)


def swap_to(t: Type, raw: bytes, order: str = "<") -> bytes:
    """The same elements in another byte order, inside arrays and compounds too."""
    n = len(raw) // t.size if t.size else 0
    if t.kind in ("fixed", "float", "enum"):
        own = t.base.order if t.kind == "enum" else t.order
        return raw if own == order or t.size < 2 else np.frombuffer(raw, np.uint8, n * t.size).reshape(n, t.size)[:, ::-1].tobytes()
    if t.kind in ("array", "complex"):
        return swap_to(t.base, raw, order)
    if t.kind == "compound":
        out = bytearray(raw)
        for k in range(n):
            for _, at, m in t.members:
                a = k * t.size + at
                out[a : a + m.size] = swap_to(m, raw[a : a + m.size], order)
        return bytes(out)
    return raw
