"""The ``tilewright`` data source: containers as DataFrames, and DataFrames as containers.

Reading: ``spark.read.format("tilewright").option("view", v).load(path)``; path is a
container, or a folder or pattern of them. Views: cells (default), tiles, chunks,
datasets, objects, links, attributes, table. ``dataset``: the path inside, for cells and
tiles. Metadata is read once on the driver; a task reads only the byte ranges of its
chunks. Comparisons on d0, d1, ... skip chunks before any task starts.

Writing: each task writes one container with the rows that it has; no data go through
the driver. Columns become one-dimensional datasets under /table, in chunks. The view
``table`` reads them back, only the columns that are asked for with ``columns``.
"""

from __future__ import annotations

import glob
import itertools
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from tilewright.container.reader import Chunk, Container, Dataset, FormatError
from tilewright.container.types import Type, compound, decode, integer, floating, numpy_dtype, spark_type, vlen, vlen_string
from tilewright.container.writer import GroupNode, build

CATALOG = {
    "files": "file string, version int, offset_size int, length_size int, flags int, size bigint, root bigint, has_extension boolean, swmr_write_in_progress boolean",
    "objects": "file string, path string, parent string, name string, kind string, address bigint, atime timestamp, mtime timestamp, ctime timestamp, btime timestamp, creation_order bigint, position bigint",
    "links": "file string, parent string, name string, kind string, target_path string, target_file string, address bigint, creation_order bigint, charset string, position bigint, resolved bigint",
    "attributes": "file string, path string, name string, ord bigint, type_json string, shape array<bigint>, raw binary, value_json string",
    "datasets": "file string, path string, type_json string, shape array<bigint>, max_shape array<bigint>, layout string, chunk_shape array<bigint>, index_kind string, filters array<struct<id:int,name:string,flags:int,params:array<bigint>>>, fill_defined boolean, fill binary",
    "chunks": "file string, path string, scaled array<bigint>, address bigint, stored_size bigint, filter_mask bigint",
    "messages": "file string, path string, position bigint, type int, name string, flags int, size bigint, creation_order bigint",
}


def files_of(path: str) -> list[str]:
    """The containers of a file, folder or pattern, in order of their names."""
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        local = unquote(uri.path) if uri.scheme else path
        if os.path.isdir(local):
            return sorted(p for p in glob.glob(f"{glob.escape(local)}/*") if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
        return sorted(glob.glob(local)) or [local]
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type == fs.FileType.Directory:
        head = path[: -len(inner)] if path.endswith(inner) else ""
        return sorted(head + f.path for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith((".", "_")))
    return [path]


# -- JSON of values -----------------------------------------------------------------


def plain(v):
    """A value as JSON can hold it: large numbers and special floats as strings, bytes as
    lower-case hex."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return str(v) if v > 2**53 else v
    if isinstance(v, float):
        return v if math.isfinite(v) else "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, bytes):
        return "0x" + v.hex()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v]


def _json(v) -> str:
    return json.dumps(plain(v), ensure_ascii=False, separators=(",", ":"))


# -- partitions ---------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    """Some chunks of one dataset of one file, or the rows of a catalog view."""

    file: str
    address: int | None = None
    chunks: tuple[Chunk, ...] = ()

    def __init__(self, file: str, address: int | None = None, chunks: tuple[Chunk, ...] = ()):
        super().__init__(None)
        self.file, self.address, self.chunks = file, address, chunks


def catalog_rows(view: str, file: str) -> Iterator[tuple]:
    """The rows of a catalog view for one container."""
    from datetime import datetime, timezone

    c = Container.open(file)
    if view == "files":
        s = c.superblock
        yield file, s.version, s.offset_size, s.length_size, s.flags, c.source.size, s.root, s.has_extension, s.swmr_write_in_progress
        return
    for k, (path, parent, link, address, kind) in enumerate(c.walk()):
        if view == "objects":
            times = [datetime.fromtimestamp(t, timezone.utc) if t else None for t in c.header(address).times or (0,) * 4]
            yield file, path, parent, link.name if link else "", kind, address, *times, link.order if link else None, k
        elif view == "links" and kind == "group":
            for n, x in enumerate(c.links(address)):
                yield file, path, x.name, x.kind, x.target, x.file, x.address, x.order, x.charset, n, _leads_to(c, path, x)
        elif view == "attributes":
            for n, a in enumerate(c.attributes(address, by_order=True)):
                yield file, path, a.name, n, json.dumps(a.type.describe(), separators=(",", ":")), list(a.space.dims), a.raw, _json(c.value(a))
        elif view == "messages":
            from tilewright.container.reader import MESSAGE_NAMES

            for n, m in enumerate(c.header(address).messages):
                yield file, path, n, m.type, MESSAGE_NAMES[m.type] if m.type < len(MESSAGE_NAMES) else "unknown", m.flags, len(m.body), m.order
        elif kind == "dataset":
            d = c.dataset(address)
            if view == "datasets":
                most = [-1 if m is None else m for m in d.space.most] if d.space.most else None
                yield file, path, json.dumps(d.type.describe(), separators=(",", ":")), list(d.shape), most, d.layout.kind, list(d.chunk_shape) if d.layout.kind == "chunked" else None, d.layout.index or None, [(f.id, f.name, f.flags, list(f.params)) for f in d.filters], d.fill.defined, d.fill.value
            elif view == "chunks" and d.layout.kind == "chunked":
                for x in d.chunks():
                    yield file, path, list(x.scaled), x.address, x.size, x.mask


def _leads_to(c: Container, parent: str, link) -> int | None:
    """The address of the object that a link leads to, soft ones followed; None: nowhere in this container."""
    try:
        return link.address if link.kind == "hard" else c.resolve(f"{parent.rstrip('/')}/{link.name}")
    except KeyError:
        return None


def _arrow(values, kind: pa.DataType) -> pa.Array:
    if pa.types.is_decimal(kind):
        from decimal import Decimal

        return pa.array([Decimal(int(v)) for v in values], kind)
    if isinstance(values, np.ndarray):
        return pa.array(values).cast(kind, safe=False)
    return pa.array(values, kind)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.wanted = options, schema
        self.view, self.path = options.get("view", "cells"), options["path"]
        self.bounds: dict[int, tuple[int, int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of dimensions narrow the chunks; Spark still tests every row."""
        for f in filters:
            if self.view == "cells" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0][:1] == "d" and f.attribute[0][1:].isdigit() and isinstance(f.value, int):
                k, v = int(f.attribute[0][1:]), f.value
                low, high = self.bounds.get(k, (0, 1 << 62))
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, v + 1 - isinstance(f, LessThan))
                self.bounds[k] = (low, high)
            yield f

    def _ranges(self, d: Dataset) -> list[range]:
        """The chunks inside the bounds, along each dimension."""
        out = []
        for k, (c, n) in enumerate(zip(d.read_shape, d.shape, strict=True)):
            low, high = self.bounds.get(k, (0, n))
            low, high = max(0, low), min(n, high)
            out.append(range(low // c, -(-high // c)) if low < high else range(0))
        return out

    def partitions(self) -> list[InputPartition]:
        """Chunks in groups of about ``partition_bytes``; a slab that meets no chunk gives
        one empty part."""
        files = files_of(self.path)
        if self.view not in ("cells", "tiles"):
            return [Part(f) for f in files]
        most, out = int(self.options.get("partition_bytes", 32 << 20)), []
        missing = self.options.get("missing", "fill")
        for f in files:
            c = Container.open(f)
            d = c.dataset(c.resolve(self.options.get("dataset", "/data")))
            found = d.by_place if not d.in_rows else {s: Chunk(s, d.layout.address, 0) for s in itertools.product(*self._ranges(d))}
            if missing != "skip" and d.space.size:
                chunks = (found.get(s) or Chunk(s, None, 0) for s in itertools.product(*self._ranges(d)))
            else:
                ranges = self._ranges(d)
                chunks = (x for x in found.values() if all(s in r for s, r in zip(x.scaled, ranges, strict=True)))
            group, size = [], 0
            for x in chunks:
                group.append(x)
                size += max(math.prod(d.read_shape) * d.type.size, 1)
                if size >= most:
                    out.append(Part(f, d.address, tuple(group)))
                    group, size = [], 0
            if group:
                out.append(Part(f, d.address, tuple(group)))
        return out or [Part(files[0])]

    def read(self, partition: Part):
        if self.view in CATALOG:
            yield from catalog_rows(self.view, partition.file)
        elif self.view == "table":
            yield from read_table(partition.file, self.wanted)
        elif partition.address is not None:
            yield from self._cells(partition)

    def _cells(self, part: Part):
        from pyspark.sql.pandas.types import to_arrow_schema

        c = Container.open(part.file)
        d = c.dataset(part.address)
        schema = to_arrow_schema(self.wanted)
        labels = self.options.get("labels", "false") == "true"
        rank, shape, chunk = len(d.shape), d.shape, d.read_shape
        dtype = numpy_dtype(d.type) if not (labels and d.type.kind == "enum") and not (d.type.kind == "fixed" and (d.type.offset or d.type.precision < 8 * d.type.size)) else None
        blank = bytes(d.type.size) if self.options.get("missing") == "zero" else d.fill_bytes()
        for x in part.chunks:
            origin = [s * n for s, n in zip(x.scaled, chunk, strict=True)]
            extent = [min(n, m - o) for n, m, o in zip(chunk, shape, origin, strict=True)]
            low = [max(0, self.bounds[k][0] - o) if k in self.bounds else 0 for k, o in enumerate(origin)]
            high = [min(e, self.bounds[k][1] - o) if k in self.bounds else e for k, (e, o) in enumerate(zip(extent, origin, strict=True))]
            if any(a >= b for a, b in zip(low, high, strict=True)):
                continue
            if d.in_rows:
                # only the rows inside the bounds
                low, high, origin = [0] * rank, [b - a for a, b in zip(low, high, strict=True)], [o + a for o, a in zip(origin, low, strict=True)]
                raw, own = d.read(tuple(origin), tuple(high)), high
            else:
                raw, own = d.chunk_data(x) if x.address is not None or d.layout.kind != "chunked" else blank * math.prod(chunk), chunk
            n = math.prod(own)
            if self.view == "tiles":
                cube = np.frombuffer(raw, f"V{d.type.size}", n).reshape(own)[tuple(slice(0, e) for e in extent)].tobytes()
                values = np.frombuffer(cube, dtype) if dtype is not None else decode(d.type, cube, math.prod(extent), c.heap_object, labels)
                flat = _arrow(values.astype(dtype.newbyteorder("=")) if dtype is not None else values, schema.field("values").type.value_type)
                yield pa.RecordBatch.from_arrays([pa.array([list(v)], pa.list_(pa.int64())) for v in (x.scaled, origin, extent)] + [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], schema=schema)
                continue
            cube = np.frombuffer(raw, f"V{d.type.size}", n).reshape(own)[tuple(slice(a, b) for a, b in zip(low, high, strict=True))]
            own = [b - a for a, b in zip(low, high, strict=True)]
            total, data = math.prod(own), cube.tobytes()
            for at in range(0, total, 1 << 16):
                m = min(1 << 16, total - at)
                cells = data[at * d.type.size : (at + m) * d.type.size]
                values = np.frombuffer(cells, dtype).astype(dtype.newbyteorder("=")) if dtype is not None else decode(d.type, cells, m, c.heap_object, labels)
                places = np.unravel_index(np.arange(at, at + m), own) if rank else ()
                columns = [pa.array(p.astype(np.int64) + o + a) for p, o, a in zip(places, origin, low, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, _arrow(values, schema.field("value").type)], schema=schema)


# -- tables -------------------------------------------------------------------------


def read_table(file: str, wanted: StructType):
    """The rows of /table: a batch for each chunk, of the wanted columns only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    c = Container.open(file)
    schema = to_arrow_schema(wanted)
    table = {x.name: x.address for x in c.links(c.resolve("/table"))}
    sets = {f.name: (c.dataset(table[f.name]), c.dataset(table["?" + f.name]) if "?" + f.name in table else None) for f in schema}
    rows = {d.shape[0] for d, _ in sets.values()}
    step = min((d.chunk_shape[0] for d, _ in sets.values()), default=1)
    if len(rows) > 1:
        raise FormatError("columns of different lengths")
    for at in range(0, max(rows, default=0), max(step, 1)):
        n = min(step, max(rows) - at)
        columns = []
        for f in schema:
            d, some = sets[f.name]
            values = d.values((at,), (n,))
            if some is not None:
                values = [v if ok else None for v, ok in zip(values, some.values((at,), (n,)), strict=True)]
            if _nested(f.type):
                values = [_from_element(v, f.type) for v in values]
            if pa.types.is_boolean(f.type):
                values = [None if v is None else bool(v) for v in values]
            if pa.types.is_timestamp(f.type) or pa.types.is_date(f.type):
                columns.append(pa.array(values, pa.int64() if pa.types.is_timestamp(f.type) else pa.int32()).cast(f.type))
            elif pa.types.is_decimal(f.type):
                from decimal import Decimal

                columns.append(pa.array([None if v is None else Decimal(v) for v in values], f.type))
            else:
                columns.append(pa.array(values, f.type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def element_type(kind: pa.DataType) -> Type:
    """The element type that holds a column."""
    sizes = {pa.int8(): 1, pa.int16(): 2, pa.int32(): 4, pa.int64(): 8}
    if kind in sizes:
        return integer(sizes[kind])
    if pa.types.is_float32(kind) or pa.types.is_float64(kind):
        return floating(4 if pa.types.is_float32(kind) else 8)
    if pa.types.is_boolean(kind):
        return integer(1, signed=False)
    if pa.types.is_timestamp(kind):
        return integer(8)
    if pa.types.is_date(kind):
        return integer(4)
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_decimal(kind):
        return vlen_string()
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return vlen(integer(1, signed=False))
    if pa.types.is_list(kind):
        return vlen(element_type(kind.value_type))
    if pa.types.is_struct(kind):
        return compound(*((f.name, element_type(f.type)) for f in kind))
    if pa.types.is_map(kind):
        return vlen(compound(("key", element_type(kind.key_type)), ("value", element_type(kind.item_type))))
    raise ValueError(f"no element type for {kind}")


def _to_element(v, kind: pa.DataType):
    """A Python value of a column as its element type holds it."""
    if v is None:
        raise ValueError(f"a null inside a list, struct or map can't be stored ({kind})")
    if pa.types.is_decimal(kind):
        return str(v)
    if pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        return pa.scalar(v, kind).cast(pa.int64() if pa.types.is_timestamp(kind) else pa.int32()).as_py()
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return list(v)
    if pa.types.is_list(kind):
        return [_to_element(x, kind.value_type) for x in v]
    if pa.types.is_struct(kind):
        return {f.name: _to_element(v[f.name], f.type) for f in kind}
    if pa.types.is_map(kind):
        return [{"key": _to_element(k, kind.key_type), "value": _to_element(x, kind.item_type)} for k, x in v]
    return v


def _from_element(v, kind: pa.DataType):
    """The Python value of a column for an element; None stays."""
    if v is None:
        return None
    if pa.types.is_boolean(kind):
        return bool(v)
    if pa.types.is_decimal(kind):
        from decimal import Decimal

        return Decimal(v)
    if pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        return pa.scalar(v, pa.int64() if pa.types.is_timestamp(kind) else pa.int32()).cast(kind).as_py()
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return bytes(v)
    if pa.types.is_list(kind):
        return [_from_element(x, kind.value_type) for x in v]
    if pa.types.is_struct(kind):
        return {f.name: _from_element(v[f.name], f.type) for f in kind}
    if pa.types.is_map(kind):
        return [(_from_element(x["key"], kind.key_type), _from_element(x["value"], kind.item_type)) for x in v]
    return v


def _nested(kind: pa.DataType) -> bool:
    return pa.types.is_nested(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind)


def _blank(t: Type):
    """A value that stands where a column is null."""
    if t.is_string:
        return ""
    return [] if t.kind == "vlen" else {n: _blank(m) for n, _, m in t.members} if t.kind == "compound" else 0


def _fixed(t: Type) -> bool:
    """Whether an element's bytes are its whole value."""
    return t.kind != "vlen" and not t.is_string and all(_fixed(m) for _, _, m in (t.members if t.kind == "compound" else ()))


def table_node(batches: list[pa.RecordBatch], schema: pa.Schema, chunk: int, filters: tuple = ()) -> GroupNode:
    """A root group with /table. Columns with nulls have a companion of flags; only
    fixed-size columns are filtered, with their own element size for the shuffle."""
    root, table = GroupNode(), pa.Table.from_batches(batches, schema)
    group, n = root.group("table"), table.num_rows
    for f in schema:
        t, column = element_type(f.type), table[f.name].combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks or [pa.array([], f.type)])
        if pa.types.is_timestamp(f.type) or pa.types.is_date(f.type):
            column = column.cast(pa.int64() if pa.types.is_timestamp(f.type) else pa.int32())
        blank = _blank(t)
        if _nested(f.type):
            values = [blank if v is None else _to_element(v, f.type) for v in column.to_pylist()]
        else:
            values = [blank if v is None else str(v) if pa.types.is_decimal(f.type) else v for v in column.to_pylist()]
        own = tuple((k, (t.size,) if k == 2 else p) for k, p in filters) if _fixed(t) else ()
        group.dataset(f.name, t, (n,), values, chunk=(max(1, min(chunk, n)),), filters=own)
        if column.null_count:
            group.dataset("?" + f.name, integer(1, signed=False), (n,), [int(v is not None) for v in column.to_pylist()], chunk=(max(1, min(chunk, n)),))
    return root


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class Writer(DataSourceArrowWriter):
    """Each task writes containers of its own, of about ``file_bytes`` of rows each, under
    names that no other attempt has, so it holds no more than that at a time; the commit
    gives the files their names, an abort removes them."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        uri = urlparse(options["path"])
        if uri.scheme not in ("", "file"):
            raise ValueError("containers are written to file paths that driver and executors share")
        self.path, self.schema, self.overwrite = unquote(uri.path) if uri.scheme else options["path"], schema, overwrite
        self.chunk, self.file_bytes = int(options.get("chunk", 4096)), int(options.get("file_bytes", 64 << 20))
        level = int(options.get("deflate", 0))
        self.filters = (((2, (1,)),) if options.get("shuffle", "false") == "true" else ()) + (((1, (level,)),) if level else ()) + (((3, ()),) if options.get("fletcher32", "false") == "true" else ())

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark.sql.pandas.types import to_arrow_schema

        os.makedirs(f"{self.path}/_temporary", exist_ok=True)
        files, rows, own, size = [], 0, [], 0

        def flush() -> None:
            schema = own[0].schema if own else to_arrow_schema(self.schema)
            files.append(f"{self.path}/_temporary/{uuid.uuid4().hex}")
            with open(files[-1], "wb") as out:
                out.write(build(table_node(own, schema, self.chunk, self.filters)))

        for batch in batches:
            rows += batch.num_rows
            own.append(batch)
            size += batch.nbytes
            if size >= self.file_bytes:
                flush()
                own, size = [], 0
        if own or not files:
            flush()
        return Written(files, rows)

    def commit(self, messages: list[Written | None]) -> None:
        old = [] if not self.overwrite else files_of(self.path) if os.path.isdir(self.path) else []
        run = uuid.uuid4().hex[:12]
        for k, f in enumerate(f for m in messages if m for f in m.files):
            os.replace(f, f"{self.path}/part-{k:05d}-{run}.h5")
        for f in old:
            os.remove(f)
        self._tidy()

    def abort(self, messages: list[Written | None]) -> None:
        for f in (f for m in messages if m for f in m.files):
            if os.path.exists(f):
                os.remove(f)
        self._tidy()

    def _tidy(self) -> None:
        folder = f"{self.path}/_temporary"
        if os.path.isdir(folder) and not os.listdir(folder):
            os.rmdir(folder)


class Tilewright(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright"

    def schema(self) -> str:
        view = self.options.get("view", "cells")
        if view in CATALOG:
            return CATALOG[view]
        c = Container.open(files_of(self.options["path"])[0])
        if view == "table":
            raise ValueError("the view table needs a schema: .schema(...)")
        d = c.dataset(c.resolve(self.options.get("dataset", "/data")))
        value = spark_type(d.type, self.options.get("labels", "false") == "true")
        if view == "tiles":
            return f"scaled array<bigint>, origin array<bigint>, extent array<bigint>, values array<{value}>"
        if view == "cells":
            return ", ".join([*(f"d{k} bigint" for k in range(len(d.shape))), f"value {value}"])
        raise ValueError(f"no view {view}")

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)

    def streamReader(self, schema: StructType):  # noqa: N802
        from tilewright.streaming.growing import GrowingReader

        return GrowingReader(dict(self.options), schema)


def register(spark) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tilewright)
