"""Text and JSON of containers, as Column expressions or rows of text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.container.reader import Container, Dataset
from tilewright.sources.arrays import plain


def json_float(c: Column) -> Column:
    """A float as JSON text: special values as strings."""
    return F.when(F.isnan(c), F.lit('"NaN"')).when(c == float("inf"), F.lit('"Infinity"')).when(c == float("-inf"), F.lit('"-Infinity"')).otherwise(c.cast("string"))


def json_unsigned(c: Column) -> Column:
    """A whole number as JSON text: beyond 2^53 as a string."""
    return F.when(c > 2**53, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))


def hex_bytes(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def trim_nul(c: Column) -> Column:
    """Trailing NULs dropped, spaces kept."""
    return F.rtrim(c, F.lit("\0"))


def type_text(t: dict) -> str:
    kind = t["class"]
    if kind == "fixed":
        return f"{'int' if t['signed'] else 'uint'}{8 * t['size']} {t['order']}-endian"
    if kind == "float":
        return f"float{8 * t['size']} {t['order']}-endian"
    if kind == "string":
        return f"string({t['size']}) {t['charset']} {t['padding']}"
    if kind == "vlen":
        return "string" if t["string"] else f"sequence of {type_text(t['base'])}"
    if kind == "array":
        return f"{type_text(t['base'])} {t['dims']}"
    if kind == "compound":
        return "{" + ", ".join(f"{m['name']} @{m['offset']}: {type_text(m['type'])}" for m in t["members"]) + "}"
    if kind == "enum":
        return f"enum of {type_text(t['base'])} {{" + ", ".join(f"{m['name']} = {m['value']}" for m in t["members"]) + "}"
    if kind == "complex":
        return f"complex of {type_text(t['base'])}"
    return f"{kind}({t['size']})"


def space_text(d: Dataset) -> str:
    if d.space.kind != "simple":
        return d.space.kind
    most = d.space.most or d.shape
    return "(" + ", ".join(f"{n}" if m == n else f"{n}/{'unlimited' if m is None else m}" for n, m in zip(d.shape, most, strict=True)) + ")"


def layout_text(d: Dataset) -> str:
    names = " + ".join(f.name or {1: "deflate", 2: "shuffle", 3: "fletcher32", 4: "szip", 5: "n-bit", 6: "scale-offset", 32000: "lzf"}.get(f.id, str(f.id)) for f in d.filters)
    own = f"chunked {list(d.chunk_shape)} by {d.layout.index}" if d.layout.kind == "chunked" else d.layout.kind
    return own + (f", {names}" if names else "")


def info(c: Container, preview: int = 5) -> Iterator[str]:
    """The structure of a container, a line for each object and attribute."""
    s = c.superblock
    yield f"superblock {s.version}, offsets {s.offset_size}, lengths {s.length_size}"
    for path, _, _, address, kind in c.walk():
        indent = "  " * (path.count("/") if path != "/" else 0)
        if kind == "dataset":
            d = c.dataset(address)
            yield f"{indent}{path}: {type_text(d.type.describe())} {space_text(d)}, {layout_text(d)}"
            if preview:
                yield f"{indent}  = {json.dumps(plain(first_values(d, preview)), ensure_ascii=False)}"
        else:
            yield f"{indent}{path}: {kind}"
        for a in c.attributes(address):
            yield f"{indent}  @{a.name} = {json.dumps(plain(c.value(a)), ensure_ascii=False)}"
        if kind == "group":
            for x in c.links(address):
                if x.kind != "hard":
                    yield f"{indent}  {x.name} -> {x.file + ':' if x.file else ''}{x.target}"


def first_values(d: Dataset, n: int) -> list:
    """The first n elements in row-major order; only the chunks that hold them are read."""
    if not d.space.size:
        return []
    if not d.shape:
        return d.values(labels=True)[:n]
    count, left = [1] * len(d.shape), n
    for k in range(len(d.shape) - 1, -1, -1):
        count[k] = min(d.shape[k], left)
        left = -(-left // d.shape[k])
    return d.values((0,) * len(count), tuple(count), labels=True)[:n]


def to_json(c: Container, path: str = "/", values: bool = True) -> dict:
    """A group or dataset as JSON can hold it; what can't be decoded gives a ``*_error``."""

    def attributes(address: int) -> dict:
        return {a.name: plain(c.value(a)) for a in c.attributes(address)}

    def one(address: int, above: tuple[int, ...]) -> dict:
        out: dict = {"kind": c.kind(address)}
        if own := attributes(address):
            out["attributes"] = own
        if out["kind"] == "dataset":
            try:
                d = c.dataset(address)
                out |= {"type": d.type.describe(), "shape": list(d.shape), "layout": layout_text(d)}
                if values:
                    out["data"] = plain(d.values(labels=True))
            except (ValueError, EOFError, KeyError) as e:
                out["data_error"] = str(e)
        elif out["kind"] == "group":
            children = {}
            for x in c.links(address):
                if x.kind != "hard":
                    children[x.name] = {"kind": f"{x.kind} link", "target": x.target} | ({"file": x.file} if x.file else {})
                elif x.address in above:
                    children[x.name] = {"kind": "cycle"}
                else:
                    try:
                        children[x.name] = one(x.address, (*above, x.address))
                    except (ValueError, EOFError, KeyError) as e:
                        children[x.name] = {"open_error": str(e)}
            out["children"] = children
        return out

    at = c.resolve(path)
    return one(at, (at,))
