"""Registered queries of the array engine and their SQL equivalents.

The arrays come from tables: embeddings is a float array [N, 64], part.p_size an int
vector, events an enumeration and a vector, region and nation a tree of groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.container import types as T
from tilewright.functions import codecs, dims
from tilewright.operators import blobs, render, tiles
from tilewright.sources import arrays
from tilewright.sources.scratch import scratch

I4 = T.integer(4)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as cells d0, d1, value."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("p", "value")).select("d0", F.col("p").cast("long").alias("d1"), "value")


CELLS = "(SELECT vec_id AS d0, unnest(range(64)) AS d1, unnest(embedding) AS value FROM embeddings)"
TREE = "(SELECT '/' || r_name AS path, '/' AS parent, r_name AS name FROM region UNION ALL SELECT '/' || r_name || '/' || n_name, '/' || r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
P_SIZES = "(SELECT p_partkey // 256 AS chunk, p_partkey % 256 AS i, p_size AS v FROM part)"


# -- coordinates --------------------------------------------------------------------


@query(f"SELECT d0, d1, value FROM {CELLS}")
def cells_2d(spark, sf_dir):
    return _stored_cells(spark, sf_dir)


@query(f"SELECT d0, d1, d0 * 64 + d1 AS position FROM {CELLS}")
def linear_index(spark, sf_dir):
    return cells(spark, sf_dir).select("d0", "d1", dims.linearize(["d0", "d1"], [1, 64]).alias("position"))


@query("SELECT event_id, event_id // 35 AS c0, event_id // 5 % 7 AS c1, event_id % 5 AS c2 FROM events")
def delinearize(spark, sf_dir):
    a, b, c = dims.delinearize("event_id", [1 << 40, 7, 5])
    return table(spark, sf_dir, "events").select("event_id", a.alias("c0"), b.alias("c1"), c.alias("c2"))


@query("SELECT o_orderkey AS d0, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 350")
def hyperslab_1d(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("value"))
    return dims.hyperslab(o, [100], [250])


@query(f"SELECT d0, d1, value FROM {CELLS} WHERE d0 BETWEEN 100 AND 149 AND d1 BETWEEN 5 AND 11")
def hyperslab_2d(spark, sf_dir):
    return dims.hyperslab(cells(spark, sf_dir), [100, 5], [50, 7])


@query(f"SELECT d0, d1, d2, value FROM (SELECT d0, d1 // 8 AS d1, d1 % 8 AS d2, value FROM {CELLS}) WHERE d0 BETWEEN 10 AND 39 AND d1 BETWEEN 2 AND 4 AND d2 BETWEEN 1 AND 5")
def hyperslab_3d(spark, sf_dir):
    c = cells(spark, sf_dir).select("d0", dims.chunk_of("d1", 8).alias("d1"), dims.local_of("d1", 8).alias("d2"), "value")
    return dims.hyperslab(c, [10, 2, 1], [30, 3, 5])


@query(f"SELECT d0, d1, value FROM {CELLS} WHERE false")
def hyperslab_empty(spark, sf_dir):
    return dims.hyperslab(cells(spark, sf_dir), [3, 3], [0, 5])


GRID = "(SELECT a.range * 7 + b.range AS chunk, a.range AS c0, b.range AS c1 FROM range(4) a, range(7) b)"


@query(f"SELECT chunk, c0, c1 FROM {GRID}")
def chunk_grid(spark, sf_dir):
    return dims.chunk_grid(spark, [500, 64], [128, 10])


@query(f"SELECT chunk, greatest(0, least(c0 * 128 + 128, 500) - c0 * 128) AS e0, greatest(0, least(c1 * 10 + 10, 64) - c1 * 10) AS e1 FROM {GRID}")
def chunk_extent(spark, sf_dir):
    return dims.chunk_grid(spark, [500, 64], [128, 10]).select("chunk", dims.chunk_extent("c0", 128, 500).alias("e0"), dims.chunk_extent("c1", 10, 64).alias("e1"))


@query(f"""SELECT * FROM (SELECT chunk, greatest(c0 * 128, 100) AS s0, greatest(0, least(c0 * 128 + 128, 150) - greatest(c0 * 128, 100)) AS n0,
greatest(c1 * 10, 5) AS s1, greatest(0, least(c1 * 10 + 10, 12) - greatest(c1 * 10, 5)) AS n1 FROM {GRID}) WHERE n0 > 0 AND n1 > 0""")
def chunk_overlap(spark, sf_dir):
    (s0, n0), (s1, n1) = dims.overlap("c0", 128, 100, 50, 500), dims.overlap("c1", 10, 5, 7, 64)
    return dims.chunk_grid(spark, [500, 64], [128, 10]).select("chunk", s0.alias("s0"), n0.alias("n0"), s1.alias("s1"), n1.alias("n1")).where("n0 > 0 and n1 > 0")


@query(f"SELECT d0 // 128 AS c0, d1 // 10 AS c1, count(*) AS n, min(value) AS least, max(value) AS most FROM {CELLS} GROUP BY 1, 2")
def chunk_assignment(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.groupBy(dims.chunk_of("d0", 128).alias("c0"), dims.chunk_of("d1", 10).alias("c1")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"""WITH g AS (SELECT DISTINCT chunk FROM {P_SIZES}), f AS (SELECT chunk, unnest(range(256)) AS i FROM g)
SELECT f.chunk, sum(coalesce(v, 0) * (f.i + 1))::BIGINT AS weighted, count(*) AS n, list(coalesce(v, 0) ORDER BY f.i)[1:3] AS head FROM f LEFT JOIN {P_SIZES} p ON p.chunk = f.chunk AND p.i = f.i GROUP BY f.chunk""")
def tiles_1d(spark, sf_dir):
    rows = _p_tiles(spark, sf_dir)
    weighted = F.aggregate(F.transform("values", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("chunk", weighted.alias("weighted"), F.size("values").cast("long").alias("n"), F.slice("values", 1, 3).alias("head"))


def _p_tiles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = p.agg(F.max("p_partkey")).first()[0] + 1
    return tiles.to_tiles(p.select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("value")), [n], [256])


@query(f"SELECT d0, d1, value FROM {CELLS}")
def tiles_roundtrip(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return tiles.from_tiles(tiles.to_tiles(cells(spark, sf_dir), [n, 64], [128, 10]), [n, 64], [128, 10])


@query(f"SELECT chunk, 4096 + chunk * 5120 AS address, 5120::BIGINT AS stored_size FROM {GRID}")
def implicit_addresses(spark, sf_dir):
    """Chunks of an array that was laid out early and never written: one after another."""

    def make(root, rows):
        root.dataset("data", T.floating(4), (500, 64), None, chunk=(128, 10), early=True)

    c = spark.read.format("tilewright").option("view", "chunks").load(_one_container(spark.range(1), make))
    first = Window.partitionBy("path")
    return c.select((F.col("scaled")[0] * 7 + F.col("scaled")[1]).alias("chunk"), (F.col("address") - F.min("address").over(first) + 4096).alias("address"), "stored_size")


_CASES = "(VALUES (0, 1, false, true), (0, 9, false, true), (0, 9, true, true), (0, 9, false, false), (1, 9, true, false), (1, 1, false, false), (2, 9, false, true))"


@query(f"SELECT free, chunks, filtered, early, CASE WHEN free > 1 THEN 'b-tree v2' WHEN free = 1 THEN 'extensible array' WHEN chunks = 1 THEN 'single' WHEN early AND NOT filtered THEN 'implicit' ELSE 'fixed array' END AS kind FROM {_CASES} t(free, chunks, filtered, early)")
def index_choice(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {_CASES.replace('(VALUES', 'VALUES')[:-1]} AS t(free, chunks, filtered, early)")
    return rows.withColumn("kind", dims.index_kind(F.col("free"), F.col("chunks"), F.col("filtered"), F.col("early")))


def _sparse(spark, sf_dir, fill):
    p = table(spark, sf_dir, "part")
    stored = p.where("p_size > 25").select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("value"))
    return dims.fill_missing(stored, p.select(F.col("p_partkey").alias("d0")), ["d0"], "value", fill)


@query("SELECT p_partkey AS d0, CASE WHEN p_size > 25 THEN p_size ELSE -999 END AS value FROM part")
def fill_value(spark, sf_dir):
    return _sparse(spark, sf_dir, -999)


@query("SELECT p_partkey AS d0, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS value FROM part")
def unallocated_zero(spark, sf_dir):
    return _sparse(spark, sf_dir, 0)


# -- filters ------------------------------------------------------------------------


def _stored_bytes(spark, sf_dir, pipeline):
    return tiles.encode_tiles(_p_tiles(spark, sf_dir), I4, pipeline)


FULL = f"(SELECT f.chunk, f.i, coalesce(p.v, 0)::INT AS v FROM (SELECT chunk, unnest(range(256)) AS i FROM (SELECT DISTINCT chunk FROM {P_SIZES})) f LEFT JOIN {P_SIZES} p ON p.chunk = f.chunk AND p.i = f.i)"


@query(f"SELECT chunk, lower(string_agg(printf('%02x', (v >> (8 * k)) & 255), '' ORDER BY k, i)) AS stored FROM {FULL}, (SELECT unnest(range(4))::INT AS k) GROUP BY chunk")
def shuffle_bytes(spark, sf_dir):
    return _stored_bytes(spark, sf_dir, [(codecs.SHUFFLE, [4])]).select("chunk", F.lower(F.hex("data")).alias("stored"))


@query(f"""WITH w AS (SELECT chunk, 2 * i + k AS pos, CASE WHEN k = 0 THEN (v & 255) * 256 + ((v >> 8) & 255) ELSE ((v >> 16) & 255) * 256 + ((v >> 24) & 255) END AS w FROM {FULL}, (SELECT unnest(range(2)) AS k)),
s AS (SELECT chunk, sum(w)::BIGINT AS a, sum(w * (512 - pos))::BIGINT AS b FROM w GROUP BY chunk)
SELECT chunk, CASE WHEN b = 0 THEN 0 ELSE (b - 1) % 65535 + 1 END * 65536 + CASE WHEN a = 0 THEN 0 ELSE (a - 1) % 65535 + 1 END AS checksum FROM s""")
def fletcher32(spark, sf_dir):
    return _stored_bytes(spark, sf_dir, [(codecs.FLETCHER32, [])]).select("chunk", dims.number_at("data", F.length("data") - 3, 4).alias("checksum"))


def _there_and_back(spark, sf_dir, pipeline):
    full = _p_tiles(spark, sf_dir)
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    back = tiles.decode_tiles(tiles.encode_tiles(full, T.integer(4), pipeline), T.integer(4), pipeline)
    return tiles.from_tiles(back, [n], [256]).select("d0", "value")


_BACK = "SELECT p_partkey AS d0, p_size AS value FROM part"


@query(_BACK)
def deflate_roundtrip(spark, sf_dir):
    return _there_and_back(spark, sf_dir, [(codecs.SHUFFLE, [4]), (codecs.DEFLATE, [6]), (codecs.FLETCHER32, [])])


@query(_BACK)
def lzf_roundtrip(spark, sf_dir):
    return _there_and_back(spark, sf_dir, [(codecs.SHUFFLE, [4]), (codecs.LZF, [])])


@query(_BACK)
def nbit_roundtrip(spark, sf_dir):
    return _there_and_back(spark, sf_dir, [(codecs.NBIT, codecs.nbit_params(256, 4, 0, 6, 0))])


@query(_BACK)
def scaleoffset_roundtrip(spark, sf_dir):
    return _there_and_back(spark, sf_dir, [(codecs.SCALEOFFSET, codecs.scaleoffset_params(256, 4, True))])


@query("SELECT * FROM (VALUES ('02616263', 'abc'), ('026162632002', 'abcabc'), ('0061e00200', 'aaaaaaaaaaaa')) t(stream, decoded)")
def lzf_literal(spark, sf_dir):
    rows = spark.createDataFrame([("02616263",), ("026162632002",), ("0061e00200",)], "stream string")

    def undo(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codecs.lzf_decode(bytes.fromhex(x)).decode() for x in b.column(0).to_pylist()])], ["stream", "decoded"])

    return rows.mapInArrow(undo, "stream string, decoded string")


@query(f"SELECT chunk, min(v) AS least, max(v) - min(v) AS span, length(ltrim(bin(max(v) - min(v)), '0')) AS bits FROM {FULL} GROUP BY chunk")
def scaleoffset_params(spark, sf_dir):
    rows = _stored_bytes(spark, sf_dir, [(codecs.SCALEOFFSET, codecs.scaleoffset_params(256, 4, True))])
    p = _p_tiles(spark, sf_dir).select("chunk", (F.array_max("values") - F.array_min("values")).alias("span"))
    return rows.join(p, "chunk").select("chunk", dims.number_at("data", F.lit(6), 8).cast("int").alias("least"), "span", dims.number_at("data", F.lit(1), 4).alias("bits"))


@query(f"SELECT p.chunk, i AS place, v - least AS residual FROM {FULL} p JOIN (SELECT chunk, min(v) AS least FROM {FULL} GROUP BY chunk) m ON m.chunk = p.chunk")
def scaleoffset_residuals(spark, sf_dir):
    params = codecs.scaleoffset_params(256, 4, True)
    rows = _stored_bytes(spark, sf_dir, [(codecs.SCALEOFFSET, params)])
    back = tiles.decode_tiles(rows, T.integer(4), [(codecs.SCALEOFFSET, params)])
    least = F.array_min("values")
    return back.select("chunk", F.posexplode(F.transform("values", lambda x: x - least)).alias("place", "residual")).withColumn("place", F.col("place").cast("long"))


@query(f"SELECT chunk, string_agg(lpad(ltrim(bin(v), '0'), 6, '0'), '' ORDER BY i) AS bits FROM {FULL} GROUP BY chunk")
def nbit_pack(spark, sf_dir):
    rows = _stored_bytes(spark, sf_dir, [(codecs.NBIT, codecs.nbit_params(256, 4, 0, 6, 0))])
    digits = F.transform(F.sequence(F.lit(1), F.length("data")), lambda k: F.lpad(F.bin(F.conv(F.hex(F.substring("data", k, F.lit(1))), 16, 10).cast("long")), 8, "0"))
    return rows.select("chunk", F.array_join(digits, "").alias("bits"))


# -- element types ------------------------------------------------------------------


@query("SELECT p_partkey, lower(printf('%02x%02x%02x%02x', (p_size >> 24) & 255, (p_size >> 16) & 255, (p_size >> 8) & 255, p_size & 255)) AS big FROM part")
def byte_swap(spark, sf_dir):
    t = T.integer(4)

    def swap(batches):
        for b in batches:
            raw = T.swap_to(t, T.encode(t, b.column("p_size").to_pylist()), ">")
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pa.array([raw[k : k + 4].hex() for k in range(0, len(raw), 4)])], ["p_partkey", "big"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(swap, "p_partkey long, big string")


@query("SELECT event_id, event_type AS label FROM events")
def enum_labels(spark, sf_dir):
    names = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    t = T.enum(T.integer(1 if len(names) < 128 else 2 if len(names) < 1 << 15 else 4), **{n: k for k, n in enumerate(names)})

    def label(batches):
        for b in batches:
            raw = T.encode(t, b.column("code").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(T.decode(t, raw, len(raw), labels=True))], ["event_id", "label"])

    code = F.array_position(F.array(*map(F.lit, names)), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select("event_id", code.alias("code")).mapInArrow(label, "event_id long, label string")


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' ELSE CAST(p_size AS VARCHAR) END AS label FROM part")
def enum_unknown(spark, sf_dir):
    """Codes without a member are shown as numbers."""

    def make(root, rows):
        root.dataset("data", T.compound(("key", T.integer(8)), ("size", T.enum(I4, ONE=1, TWO=2))), (len(rows),), [{"key": k, "size": s} for k, s in rows.itertuples(index=False)], chunk=(700,))

    path = _one_container(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make)
    return spark.read.format("tilewright").option("labels", "true").load(path).select(F.col("value.key").alias("p_partkey"), F.col("value.size").alias("label"))


@query("SELECT p_partkey, p_size AS size, p_retailprice AS price, p_brand AS brand FROM part")
def compound_project(spark, sf_dir):
    t = T.compound(("key", T.integer(8)), ("size", T.integer(4, order=">")), ("price", T.floating(8)), ("brand", T.fixed_string(16)))

    def there_and_back(batches):
        for b in batches:
            rows = [{"key": k, "size": s, "price": p, "brand": x} for k, s, p, x in zip(*(b.column(c).to_pylist() for c in ("p_partkey", "p_size", "p_retailprice", "p_brand")), strict=True)]
            got = T.decode(t, T.encode(t, rows), len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([g["key"] for g in got]), pa.array([g["size"] for g in got], pa.int32()), pa.array([g["price"] for g in got]), pa.array([g["brand"] for g in got])], ["p_partkey", "size", "price", "brand"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand").mapInArrow(there_and_back, "p_partkey long, size int, price double, brand string")


@query("SELECT * FROM (VALUES ('color', 0, 4), ('coords', 4, 12), ('id', 16, 4)) t(member, place, bytes)")
def compound_offsets(spark, sf_dir):
    t = T.compound(("color", T.integer(4)), ("coords", T.array(T.integer(4), 3)), ("id", T.integer(4)))
    return spark.createDataFrame([(n, o, m.size) for n, o, m in t.members], "member string, place int, bytes int")


@query("SELECT vec_id, g.range AS part, embedding[g.range * 8 + 1 : g.range * 8 + 8] AS items FROM embeddings, range(8) g")
def array_type(spark, sf_dir):
    """Elements that are arrays of eight numbers."""

    def make(root, rows):
        raw = np.stack(rows.sort_values("vec_id")["embedding"].to_numpy()).astype("<f4").tobytes()
        root.dataset("data", T.array(T.floating(4), 8), (len(rows), 8), None, raw=raw, chunk=(100, 3))

    path = _one_container(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), make)
    return spark.read.format("tilewright").load(path).select(F.col("d0").alias("vec_id"), F.col("d1").alias("part"), F.col("value").alias("items"))


@query("SELECT vec_id, g.range AS k, embedding[2 * g.range + 1] AS re, embedding[2 * g.range + 2] AS im FROM embeddings, range(32) g")
def complex_pairs(spark, sf_dir):
    """Each two numbers as one complex element."""

    def make(root, rows):
        raw = np.stack(rows.sort_values("vec_id")["embedding"].to_numpy()).astype("<f4").tobytes()
        root.dataset("data", T.complex_(8), (len(rows), 32), None, raw=raw, chunk=(100, 32), filters=((codecs.DEFLATE, (1,)),))

    path = _one_container(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), make)
    return spark.read.format("tilewright").load(path).select(F.col("d0").alias("vec_id"), F.col("d1").alias("k"), "value.re", "value.im")


@query("SELECT event_id, (event_id * 977 & 255)::SMALLINT AS u8, (event_id * 977 & 65535)::INT AS u16, event_id * 9770011 & 4294967295 AS u32 FROM events")
def unsigned_wrap(spark, sf_dir):
    """Unsigned members of one, two and four bytes, little- and big-endian, in a folder of containers."""
    from tilewright.container.writer import GroupNode

    def make(rows):
        t = T.compound(("id", T.integer(8)), ("u8", T.integer(1, signed=False)), ("u16", T.integer(2, signed=False, order=">")), ("u32", T.integer(4, signed=False)))
        values = [{"id": k, "u8": k * 977 & 255, "u16": k * 977 & 65535, "u32": k * 9770011 & 0xFFFFFFFF} for k in rows["event_id"].tolist()]
        root = GroupNode()
        root.dataset("data", t, (len(values),), values, chunk=(999,))
        yield root

    path = _containers(table(spark, sf_dir, "events").select("event_id"), "event_id", make)
    return spark.read.format("tilewright").load(path).select(F.col("value.id").alias("event_id"), "value.u8", "value.u16", "value.u32")


@query("SELECT p_partkey, rtrim(p_brand || '  ' || repeat(chr(0), 3), chr(0)) AS nul_trimmed, rtrim(p_brand || '  ', ' ') AS space_trimmed FROM part")
def string_padding(spark, sf_dir):
    raw = F.concat("p_brand", F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", render.trim_nul(F.concat(raw, F.lit("\0\0\0"))).alias("nul_trimmed"), F.rtrim(raw).alias("space_trimmed"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '\"NaN\"' WHEN event_id % 5 = 1 THEN '\"Infinity\"' WHEN event_id % 5 = 2 THEN '\"-Infinity\"' ELSE CAST(CAST(event_id % 7 AS DOUBLE) AS VARCHAR) END AS json FROM events")
def float_json(spark, sf_dir):
    k = F.col("event_id") % 5
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise((F.col("event_id") % 7).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", render.json_float(v).alias("json"))


@query("SELECT event_id, CASE WHEN event_id * 9007199254740 > 9007199254740992 THEN '\"' || (event_id * 9007199254740) || '\"' ELSE CAST(event_id * 9007199254740 AS VARCHAR) END AS json FROM events")
def u64_json(spark, sf_dir):
    """Exact for all ids; over 1,024,000 the product doesn't fit the SQL's 64 bits."""
    product = F.col("event_id").cast("decimal(20,0)") * 9007199254740
    return table(spark, sf_dir, "events").select("event_id", render.json_unsigned(product).alias("json"))


@query("SELECT n_nationkey, '0x' || lower(hex(encode(n_name))) AS hex FROM nation")
def hex_bytes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", render.hex_bytes(F.col("n_name").cast("binary")).alias("hex"))


# -- through containers -------------------------------------------------------------


def _written(df: DataFrame, spark: SparkSession, parts: int = 4, **options) -> str:
    arrays.register(spark)
    path = scratch(spark)
    df.repartition(parts).write.format("tilewright").mode("append").options(**options).save(path)
    return path


def _table_of(spark, path, schema):
    return spark.read.format("tilewright").schema(schema).option("view", "table").load(path)


@query("SELECT doc_id, length(text) AS n, sha256(text) AS digest FROM documents")
def vlen_strings(spark, sf_dir):
    path = _written(table(spark, sf_dir, "documents").select("doc_id", "text"), spark)
    return _table_of(spark, path, "doc_id long, text string").select("doc_id", F.length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT l_orderkey, list(l_linenumber::BIGINT ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey")
def vlen_sequence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("lines"))
    return _table_of(spark, _written(rows, spark), "l_orderkey long, lines array<long>")


@query("SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN NULL ELSE n_name END AS v FROM nation")
def vlen_empty(spark, sf_dir):
    v = F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 2, F.col("n_name"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), v.alias("v"))
    return _table_of(spark, _written(rows, spark, 2), "k long, v string")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem")
def container_table(spark, sf_dir):
    """lineitem through containers: shuffle, deflate and checksums on the numbers."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    path = _written(rows, spark, shuffle="true", deflate="4", fletcher32="true")
    return _table_of(spark, path, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz")


@query("SELECT p_partkey, p_size AS size, p_brand AS brand, lower(hex(encode(p_brand))) AS bytes, p_size + 1 AS next FROM part")
def container_nested(spark, sf_dir):
    """Struct, binary and map columns through containers of a few kilobytes."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("s"), F.col("p_brand").cast("binary").alias("b"), F.create_map(F.lit("next"), F.col("p_size") + 1).alias("m"))
    t = _table_of(spark, _written(rows, spark, 2, file_bytes="4096"), "p_partkey long, s struct<size:int,brand:string>, b binary, m map<string,int>")
    return t.select("p_partkey", "s.size", "s.brand", F.lower(F.hex("b")).alias("bytes"), F.col("m")["next"].alias("next"))


def _embedding_container(spark, sf_dir, **options) -> str:
    """embeddings as one container /data [N, 64] in tiles of 128 x 10: tiles are encoded by
    tasks, and one task lays them out. Its size is checked: one file holds a bounded array."""
    import os

    from tilewright.container.writer import DatasetNode, GroupNode, build

    arrays.register(spark)
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    if n * 64 * 4 > 64 << 20:
        raise ValueError("an array over 64 MB is written as a folder of containers")
    grid = [-(-n // 128), 7]
    pipeline = options.get("filters", ())
    stored = tiles.encode_tiles(tiles.to_tiles(cells(spark, sf_dir), [n, 64], [128, 10]), T.floating(4), pipeline)
    path = scratch(spark)

    def lay_out(batches):
        got = {}
        for b in batches:
            for k, data, mask in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), b.column("mask").to_pylist(), strict=True):
                got[divmod(k, 7)] = (data, mask)
        if got:
            root = GroupNode()
            root.children["data"] = DatasetNode(T.floating(4), (n, 64), chunk=(128, 10), tiles=got, **options)
            root.children["data"].attribute("units", T.vlen_string(), "none")
            os.makedirs(path, exist_ok=True)
            with open(f"{path}/embeddings.h5", "wb") as out:
                out.write(build(root, times=(1700000000,) * 4))
            yield pa.RecordBatch.from_arrays([pa.array([len(got)], pa.int64())], ["n"])

    made = stored.coalesce(1).mapInArrow(lay_out, "n long").collect()
    assert made[0].n == grid[0] * grid[1]
    return f"{path}/embeddings.h5"


def _stored_cells(spark, sf_dir) -> DataFrame:
    return spark.read.format("tilewright").load(_embedding_container(spark, sf_dir))


def _content(spark, path: str) -> DataFrame:
    """(path, content) of containers."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


@query(f"SELECT d0, d1, value FROM {CELLS} WHERE d0 BETWEEN 100 AND 149 AND d1 BETWEEN 5 AND 11")
def container_slab(spark, sf_dir):
    """The rectangle of hyperslab_2d out of a container with an implicit index; the
    comparisons on d0 and d1 leave the chunks that it overlaps."""
    path = _embedding_container(spark, sf_dir, early=True)
    return dims.hyperslab(spark.read.format("tilewright").load(path), [100, 5], [50, 7])


@query(f"SELECT d0, d1, value FROM {CELLS} WHERE d0 BETWEEN 200 AND 299 AND d1 >= 60")
def container_slab_filtered(spark, sf_dir):
    path = _embedding_container(spark, sf_dir, filters=((codecs.SHUFFLE, (4,)), (codecs.DEFLATE, (4,)), (codecs.FLETCHER32, ())))
    return spark.read.format("tilewright").load(path).where("d0 >= 200 and d0 < 300 and d1 >= 60")


@query("SELECT a.range * 128 AS o0, b.range * 10 AS o1, least(128, (SELECT max(vec_id) + 1 FROM embeddings) - a.range * 128) AS e0, least(10, 64 - b.range * 10) AS e1 FROM range((SELECT max(vec_id) // 128 + 1 FROM embeddings)) a, range(7) b")
def container_tiles(spark, sf_dir):
    path = _embedding_container(spark, sf_dir, most=(None, None), filters=((codecs.DEFLATE, (1,)),))
    t = spark.read.format("tilewright").option("view", "tiles").load(path)
    return t.select(*(F.col(c)[k].alias(f"{c[0]}{k}") for c in ("origin", "extent") for k in (0, 1)))


@query("SELECT '/data' AS path, [max(vec_id) + 1, 64] AS shape, [-1, 64]::BIGINT[] AS max_shape, 'chunked' AS layout, [128, 10]::BIGINT[] AS chunk_shape, 'extensible array' AS index_kind FROM embeddings")
def container_datasets(spark, sf_dir):
    path = _embedding_container(spark, sf_dir, most=(None, 64))
    return spark.read.format("tilewright").option("view", "datasets").load(path).select("path", "shape", "max_shape", "layout", "chunk_shape", "index_kind")


@query("SELECT a.range AS c0, b.range AS c1, 5120::BIGINT AS stored_size, 0::BIGINT AS filter_mask FROM range((SELECT max(vec_id) // 128 + 1 FROM embeddings)) a, range(7) b")
def container_chunks(spark, sf_dir):
    path = _embedding_container(spark, sf_dir)
    c = spark.read.format("tilewright").option("view", "chunks").load(path)
    return c.select(F.col("scaled")[0].alias("c0"), F.col("scaled")[1].alias("c1"), "stored_size", "filter_mask")


@query("SELECT * FROM (VALUES ('/data', 'units', 0::BIGINT, '\"none\"')) t(path, name, ord, value_json)")
def container_attributes(spark, sf_dir):
    return spark.read.format("tilewright").option("view", "attributes").load(_embedding_container(spark, sf_dir)).select("path", "name", "ord", "value_json")


@query("SELECT * FROM (VALUES ('/', 'group', NULL), ('/data', 'dataset', '/')) t(path, kind, parent)")
def container_objects(spark, sf_dir):
    return spark.read.format("tilewright").option("view", "objects").load(_embedding_container(spark, sf_dir)).select("path", "kind", "parent")


MOST_ROWS = 2_000_000


def _one_container(df: DataFrame, make) -> str:
    """A container that make(root, rows as a pandas frame) fills, laid out by one task. The
    rows are counted first: one file holds a bounded table."""
    import os

    from tilewright.container.writer import GroupNode, build

    spark = df.sparkSession
    arrays.register(spark)
    if df.count() > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows are written as a folder of containers")
    path = scratch(spark)

    def lay_out(key: tuple, rows):
        import pandas as pd

        root = GroupNode()
        make(root, rows.drop(columns="one"))
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/one.h5", "wb") as out:
            out.write(build(root))
        return pd.DataFrame({"n": [len(rows)]})

    df.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lay_out, "n long").collect()
    return f"{path}/one.h5"


ROWS_EACH = 1 << 18


def _containers(df: DataFrame, key: str, make) -> str:
    """A folder of containers, of about ROWS_EACH rows each, for any number of rows. Tasks lay
    them out, each with a range of the key and the rows of one container at a time: make(rows
    as a pandas frame) yields root groups. Files of failed attempts stay in _temporary."""
    import os
    import uuid

    from tilewright.container.writer import build

    arrays.register(df.sparkSession)
    path, most = scratch(df.sparkSession), ROWS_EACH

    def written(rows):
        os.makedirs(f"{path}/_temporary", exist_ok=True)
        for root in make(rows):
            name = f"{uuid.uuid4().hex}.h5"
            with open(f"{path}/_temporary/{name}", "wb") as out:
                out.write(build(root))
            yield name

    def lay_out(frames):
        import pandas as pd

        held, n = [], 0
        for rows in frames:
            held.append(rows)
            n += len(rows)
            if n >= most:
                yield pd.DataFrame({"name": list(written(pd.concat(held, ignore_index=True)))})
                held, n = [], 0
        if n:
            yield pd.DataFrame({"name": list(written(pd.concat(held, ignore_index=True)))})

    made = df.repartitionByRange(key).sortWithinPartitions(key).mapInPandas(lay_out, "name string").collect()
    for name in [r.name for r in made] or written(df.limit(0).toPandas()):
        os.replace(f"{path}/_temporary/{name}", f"{path}/{name}")
    return path


@query("SELECT p_partkey, p_size AS size, p_retailprice AS price, p_brand AS brand FROM part")
def container_compound(spark, sf_dir):
    """part as compounds with a big-endian member, compressed, and members read alone."""

    def make(root, rows):
        t = T.compound(("key", T.integer(8)), ("size", T.integer(4, order=">")), ("price", T.floating(8)), ("brand", T.fixed_string(16)))
        values = [{"key": k, "size": s, "price": p, "brand": b} for k, s, p, b in rows.itertuples(index=False)]
        root.dataset("data", t, (len(values),), values, chunk=(512,), filters=((codecs.DEFLATE, (4,)),))

    path = _one_container(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand"), make)
    return spark.read.format("tilewright").load(path).select(F.col("value.key").alias("p_partkey"), "value.size", "value.price", "value.brand")


@query("SELECT event_id AS d0, event_type AS label FROM events")
def container_enum(spark, sf_dir):
    """events as an array of labels with event_id as its coordinate, in a folder of containers:
    each has the same array and stores the chunks of its own ids. Ids without an event hold a
    code without a member, which is left out; rows that repeat an id are in more containers."""
    from tilewright.container.writer import GroupNode

    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    nowhere = F.col("event_id").isNull() | (F.col("event_id") < 0)
    names, n, odd = events.agg(F.array_sort(F.collect_set("event_type")), F.coalesce(F.max("event_id") + 1, F.lit(0)), F.count_if(nowhere)).first()
    if odd:
        raise ValueError(f"{odd} events have no place in an array, their ids are null or negative")
    gap, null = [k for k in range(-1, -128, -1) if str(k) not in names][:2]
    t = T.enum(T.integer(1 if len(names) < 128 else 2 if len(names) < 1 << 15 else 4), **{x: k for k, x in enumerate(names)})

    def make(rows):
        for _, own in rows.groupby(rows.groupby("event_id").cumcount()) if len(rows) else [(0, rows)]:
            ids = own["event_id"].to_numpy(np.int64)
            places, at = np.unique(ids // 1000, return_inverse=True)
            chunks = np.full((len(places), 1000), gap)
            chunks[at, ids % 1000] = own["code"].to_numpy(np.int64)
            root = GroupNode()
            d = root.dataset("data", t, (n,), None, chunk=(1000,), most=(None,), fill=gap, index="b-tree v2")
            d.tiles = {(k,): codecs.encode(T.encode(t, c), ()) for k, c in zip(places.tolist(), chunks, strict=True)}
            yield root

    code = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("event_type")) - 1
    path = _containers(events.select("event_id", F.coalesce(code, F.lit(null)).alias("code")), "event_id", make)
    cells = spark.read.format("tilewright").options(labels="true", missing="skip").load(path).where(F.col("value") != str(gap))
    return cells.select("d0", F.when(F.col("value") != str(null), F.col("value")).alias("label"))


@query("SELECT p_partkey AS d0, CASE WHEN p_partkey // 100 % 2 = 0 THEN p_size ELSE -999 END AS value FROM part")
def container_fill(spark, sf_dir):
    """Every other chunk was never written; its cells have the fill value."""

    def make(root, rows):
        rows = rows.sort_values("p_partkey")
        d = root.dataset("data", T.integer(4), (len(rows),), None, chunk=(100,), most=(None,), fill=-999)
        sizes = rows["p_size"].tolist()
        d.tiles = {(k,): codecs.encode(T.encode(T.integer(4), (sizes[100 * k : 100 * k + 100] + [-999] * 100)[:100]), ()) for k in range(0, -(-len(sizes) // 100), 2)}

    path = _one_container(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make)
    return spark.read.format("tilewright").load(path)


def _tree_container(spark, sf_dir) -> str:
    def make(root, rows):
        groups = {}
        for region, nation in rows.sort_values(["r_regionkey", "n_nationkey"])[["r_name", "n_name"]].itertuples(index=False):
            if region not in groups:
                groups[region] = root.group(region, ordered=True, dense_links=2)
            groups[region].group(nation)
        for region in sorted(groups):
            root.soft(f"to {region}", f"/{region}")

    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return _one_container(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_regionkey", "n_nationkey", "r_name", "n_name"), make)


@query(f"SELECT path, parent, 'group' AS kind FROM {TREE} UNION ALL SELECT '/', NULL, 'group'")
def container_tree(spark, sf_dir):
    """Regions and nations as groups, the nations' links in dense storage."""
    return spark.read.format("tilewright").option("view", "objects").load(_tree_container(spark, sf_dir)).select("path", "parent", "kind")


@query("SELECT n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT - 1 AS creation_order FROM nation")
def container_creation_order(spark, sf_dir):
    links = spark.read.format("tilewright").option("view", "links").load(_tree_container(spark, sf_dir))
    return links.where("parent <> '/'").select("name", "creation_order")


@query("SELECT 'to ' || r_name AS name, '/' || r_name AS target_path, 'soft' AS kind FROM region")
def container_links(spark, sf_dir):
    links = spark.read.format("tilewright").option("view", "links").load(_tree_container(spark, sf_dir))
    return links.where("kind = 'soft'").select("name", "target_path", "kind")


# -- trees --------------------------------------------------------------------------


def _tree(spark, sf_dir) -> DataFrame:
    """region and nation as groups of a container: path, parent, name."""
    return spark.read.format("tilewright").option("view", "objects").load(_tree_container(spark, sf_dir)).where("parent is not null").select("path", "parent", "name")


@query(f"SELECT parent, count(*) AS members, min(name) AS first_name FROM {TREE} GROUP BY parent")
def tree_members(spark, sf_dir):
    return _tree(spark, sf_dir).groupBy("parent").agg(F.count(F.lit(1)).alias("members"), F.min("name").alias("first_name"))


@query(f"SELECT path, parent, name FROM {TREE}")
def tree_paths(spark, sf_dir):
    return _tree(spark, sf_dir)


@query(f"SELECT path, (length(path) - length(replace(path, '/', '')))::BIGINT AS depth FROM {TREE}")
def tree_depth(spark, sf_dir):
    return _tree(spark, sf_dir).select("path", (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("long").alias("depth"))


@query(f"SELECT path FROM {TREE} WHERE path = (SELECT min(path) FROM {TREE})")
def open_path(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return t.join(t.agg(F.min("path").alias("wanted")), F.col("path") == F.col("wanted")).select("path")


@query("SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS creation, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::BIGINT AS by_name FROM nation")
def creation_vs_name_order(spark, sf_dir):
    links = spark.read.format("tilewright").option("view", "links").load(_tree_container(spark, sf_dir)).where("parent <> '/'")
    return links.select(F.col("name").alias("n_name"), (F.col("creation_order") + 1).alias("creation"), F.row_number().over(Window.partitionBy("parent").orderBy("name")).cast("long").alias("by_name"))


_LINKS = "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey - 1 END AS target FROM nation"
_FOLLOW = "WITH RECURSIVE l AS ({l}), f(id, here, depth) AS (SELECT id, id, 0 FROM l UNION ALL SELECT f.id, l.target, f.depth + 1 FROM f JOIN l ON l.id = f.here WHERE l.target IS NOT NULL AND f.depth < 16) SELECT id, max_by(here, depth) AS resolved, max(depth) AS hops FROM f GROUP BY id"


@query(_FOLLOW.format(l=_LINKS))
def soft_links(spark, sf_dir):
    """Chains of soft links: where each leads to as the container resolves it, and its links."""

    def make(root, rows):
        for k in sorted(rows["n_nationkey"].tolist()):
            if k % 5:
                root.soft(f"n{k}", f"/n{k - 1}" if k % 2 else f"n{k - 1}")
            else:
                root.group(f"n{k}")

    path = _one_container(table(spark, sf_dir, "nation").select("n_nationkey"), make)
    links = spark.read.format("tilewright").option("view", "links").load(path).where("parent = '/'")
    objects = spark.read.format("tilewright").option("view", "objects").load(path).select(F.col("address").alias("resolved"), F.col("path").alias("there"))
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("int")
    links.select(number("name").alias("id"), number("target_path").alias("target")).createOrReplaceTempView("tilewright_links")
    hops = spark.sql(_FOLLOW.format(l="SELECT id, target FROM tilewright_links")).select("id", "hops")
    return links.join(objects, "resolved").select(number("name").alias("id"), number("there").alias("resolved")).join(hops, "id")


@query("""SELECT '/part' AS path, 'rows' AS name, count(*)::DOUBLE AS value FROM part UNION ALL SELECT '/part', 'most_size', max(p_size) FROM part UNION ALL
SELECT '/orders', 'rows', count(*) FROM orders UNION ALL SELECT '/orders', 'least_price', min(o_totalprice) FROM orders""")
def attributes_view(spark, sf_dir):
    """Attributes, those of one group in dense storage."""
    p = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.max("p_size").cast("double").alias("most_size")).select(F.lit("part").alias("path"), F.expr("stack(2, 'rows', rows, 'most_size', most_size) as (name, value)"))
    o = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.min("o_totalprice").alias("least_price")).select(F.lit("orders").alias("path"), F.expr("stack(2, 'rows', rows, 'least_price', least_price) as (name, value)"))

    def make(root, rows):
        groups = {"part": root.group("part", dense_attributes=1, ordered=True), "orders": root.group("orders")}
        for group, name, value in rows.itertuples(index=False):
            groups[group].attribute(name, T.floating(8), value)

    path = _one_container(p.unionByName(o), make)
    return spark.read.format("tilewright").option("view", "attributes").load(path).select("path", "name", F.col("value_json").cast("double").alias("value"))


# -- rendering ----------------------------------------------------------------------


@query(f"SELECT d0, d1, value FROM {CELLS} ORDER BY d0, d1 LIMIT 5")
def preview5(spark, sf_dir):
    """The preview line of the text of a container."""
    lines = blobs.info_of(_content(spark, _embedding_container(spark, sf_dir)), 5).where("startswith(trim(line), '= [')")
    values = F.from_json(F.regexp_extract("line", "= (.*)", 1), "array<float>")
    return lines.select(F.posexplode(values).alias("p", "value")).select(F.lit(0).cast("long").alias("d0"), F.col("p").cast("long").alias("d1"), "value")


def _nations(spark, sf_dir) -> DataFrame:
    """(path, content) of a container with a group for each nation, its region as an attribute."""

    def make(root, rows):
        for name, region in rows.itertuples(index=False):
            g = root.group(name)
            g.attribute("name", T.vlen_string(), name)
            g.attribute("region", T.integer(4), region)

    return _content(spark, _one_container(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), make))


@query("SELECT n_nationkey, printf('/%s: group, region %d', n_name, n_regionkey) AS line FROM nation")
def info_text(spark, sf_dir):
    """Lines of the text of a container, those of a group's attribute put behind it."""
    lines = blobs.info_of(_nations(spark, sf_dir))
    group = lines.where("line like '%: group' and line like '  /%'").select("n", F.trim("line").alias("line"))
    region = lines.where("line like '%@region = %'").select((F.col("n") - 2).alias("n"), F.regexp_extract("line", "[0-9]+$", 0).alias("region"))
    both = group.join(region, "n").select(F.concat("line", F.lit(", region "), "region").alias("line"), F.regexp_extract("line", "^/(.*):", 1).alias("n_name"))
    return both.join(table(spark, sf_dir, "nation"), "n_name").select("n_nationkey", "line")


@query("SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS json FROM nation")
def object_json(spark, sf_dir):
    """The attributes of a container's groups, out of its JSON."""
    kind = "struct<children:map<string,struct<kind:string,attributes:struct<name:string,region:int>>>>"
    tree = blobs.json_of(_nations(spark, sf_dir)).select(F.explode(F.from_json("json", kind)["children"]).alias("n_name", "own"))
    return tree.where("own.kind = 'group'").join(table(spark, sf_dir, "nation"), "n_name").select("n_nationkey", F.to_json("own.attributes").alias("json"))


# -- views and layouts --------------------------------------------------------------


@query("SELECT 3 AS version, 8 AS offset_size, 8 AS length_size, false AS swmr_write_in_progress, true AS whole")
def container_files(spark, sf_dir):
    path = _embedding_container(spark, sf_dir)
    f = spark.read.format("tilewright").option("view", "files").load(path).join(_content(spark, path).select(F.length("content").alias("bytes")))
    return f.select("version", "offset_size", "length_size", "swmr_write_in_progress", (F.col("size") == F.col("bytes")).alias("whole"))


@query("SELECT * FROM (VALUES (1, 'dataspace'), (3, 'datatype'), (5, 'fill value'), (8, 'layout'), (11, 'filters'), (12, 'attribute')) t(type, name)")
def container_messages(spark, sf_dir):
    """The messages of the header of a filtered dataset."""
    path = _embedding_container(spark, sf_dir, filters=((codecs.DEFLATE, (1,)),))
    m = spark.read.format("tilewright").option("view", "messages").load(path).where("path = '/data'")
    names = {1: "dataspace", 3: "datatype", 5: "fill value", 8: "layout", 11: "filters", 12: "attribute"}
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return m.where(F.col("type").isin(*names)).select("type", known[F.col("type")].alias("name")).distinct()


@query(f"SELECT d0, d1, value FROM {CELLS} WHERE d0 BETWEEN 100 AND 149 AND d1 BETWEEN 5 AND 11")
def container_contiguous(spark, sf_dir):
    """The rectangle of hyperslab_2d out of a contiguous array, of which only rows inside are read."""

    def make(root, rows):
        raw = np.stack(rows.sort_values("vec_id")["embedding"].to_numpy()).astype("<f4").tobytes()
        root.dataset("data", T.floating(4), (len(rows), 64), None, raw=raw)

    path = _one_container(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), make)
    return dims.hyperslab(spark.read.format("tilewright").load(path), [100, 5], [50, 7])


@query(f"SELECT d0, d1, value FROM {CELLS}")
def container_btree_v1(spark, sf_dir):
    """Chunks found by a version-1 tree."""
    return spark.read.format("tilewright").load(_embedding_container(spark, sf_dir, layout_version=3, index="b-tree v1", filters=((codecs.DEFLATE, (1,)),)))


@query(f"SELECT d0, d1, value FROM {CELLS}")
def container_btree_v2(spark, sf_dir):
    """Chunks of an array without bounds in both directions, found by a version-2 tree."""
    return spark.read.format("tilewright").load(_embedding_container(spark, sf_dir, most=(None, None)))


@query("SELECT p_partkey AS d0, p_size AS value, (CASE WHEN p_partkey // 100 % 2 = 0 THEN 0 ELSE 2 END)::BIGINT AS mask FROM part")
def container_masks(spark, sf_dir):
    """Every other chunk was stored without its second filter, as its mask says."""
    pipeline = ((codecs.SHUFFLE, (4,)), (codecs.DEFLATE, (4,)), (codecs.FLETCHER32, ()))

    def make(root, rows):
        sizes = rows.sort_values("p_partkey")["p_size"].tolist()
        d = root.dataset("data", I4, (len(sizes),), None, chunk=(100,), filters=pipeline)
        d.tiles = {}
        for k in range(-(-len(sizes) // 100)):
            raw = T.encode(I4, (sizes[100 * k : 100 * k + 100] + [0] * 100)[:100])
            d.tiles[k,] = codecs.encode(raw, pipeline) if k % 2 == 0 else (codecs.encode(raw, (pipeline[0], pipeline[2]))[0], 2)

    path = _one_container(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make)
    masks = spark.read.format("tilewright").option("view", "chunks").load(path).select(F.col("scaled")[0].alias("chunk"), F.col("filter_mask").alias("mask"))
    return spark.read.format("tilewright").load(path).withColumn("chunk", dims.chunk_of("d0", 100)).join(masks, "chunk").select("d0", "value", "mask")


def _typed_container(spark, sf_dir) -> str:
    """nation's keys with a committed type, names and regions, an empty and a scalar dataset."""

    def make(root, rows):
        rows = rows.sort_values("n_nationkey")
        root.commit("key type", T.integer(8))
        g = root.group("nation")
        g.dataset("key", T.integer(8), (len(rows),), rows["n_nationkey"].tolist(), committed="key type").attribute("twice", T.integer(8), 2 * len(rows), committed="key type")
        g.dataset("name", T.fixed_string(20, "space-pad"), (len(rows),), rows["n_name"].tolist(), compact=True)
        root.dataset("none", T.floating(8), None)
        root.dataset("one", T.integer(2, signed=False, order=">"), (), [len(rows)])

    return _one_container(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), make)


@query("SELECT * FROM (VALUES ('/', 'group', NULL), ('/key type', 'datatype', '/'), ('/nation', 'group', '/'), ('/nation/key', 'dataset', '/nation'), ('/nation/name', 'dataset', '/nation'), ('/none', 'dataset', '/'), ('/one', 'dataset', '/')) t(path, kind, parent)")
def container_committed(spark, sf_dir):
    """Objects with a committed type among them, by containers held as bytes."""
    return blobs.objects_of(_content(spark, _typed_container(spark, sf_dir))).select("path", "kind", "parent")


@query("SELECT * FROM (VALUES ('/nation/key', 'fixed', 8, 'true', 'contiguous'), ('/nation/name', 'string', 20, NULL, 'compact'), ('/none', 'float', 8, NULL, 'contiguous'), ('/one', 'fixed', 2, 'false', 'contiguous')) t(path, class, bytes, signed, layout)")
def container_types(spark, sf_dir):
    """Element types as JSON; that of a dataset with a committed type is the type itself."""
    d = spark.read.format("tilewright").option("view", "datasets").load(_typed_container(spark, sf_dir))
    get = lambda k: F.get_json_object("type_json", f"$.{k}")
    return d.select("path", get("class").alias("class"), get("size").cast("int").alias("bytes"), get("signed").alias("signed"), "layout")


@query("SELECT '/nation/key' AS path, 'twice' AS name, (2 * count(*))::BIGINT AS value FROM nation")
def container_shared_attribute(spark, sf_dir):
    """An attribute whose type is committed."""
    a = spark.read.format("tilewright").option("view", "attributes").load(_typed_container(spark, sf_dir))
    return a.select("path", "name", F.col("value_json").cast("long").alias("value"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS d0, n_name AS value FROM nation")
def container_blobs(spark, sf_dir):
    """Strings of fixed size out of a container that is a row of bytes."""
    return blobs.cells_of(_content(spark, _typed_container(spark, sf_dir)), "/nation/name", T.fixed_string(20, "space-pad"), 1).select("d0", "value")


@query("SELECT * FROM (VALUES ('/'), ('/key type'), ('/nation'), ('/nation/key'), ('/nation/name'), ('/none'), ('/one')) t(path)")
def container_text(spark, sf_dir):
    """The objects that the text of a container names, one line each."""
    lines = blobs.info_of(_content(spark, _typed_container(spark, sf_dir)))
    return lines.where("trim(line) like '/%'").select(F.regexp_extract(F.trim("line"), "^(/[^:]*): ", 1).alias("path"))


@query("SELECT count(*)::BIGINT AS one, list(n_nationkey::BIGINT ORDER BY n_nationkey) AS keys, list(n_name ORDER BY n_nationkey) AS names FROM nation")
def container_json(spark, sf_dir):
    """Data out of the JSON of a container."""
    tree = blobs.json_of(_content(spark, _typed_container(spark, sf_dir)))
    get = lambda k, kind: F.from_json(F.get_json_object("json", k), kind)
    return tree.select(F.element_at(get("$.children.one.data", "array<bigint>"), 1).alias("one"), get("$.children.nation.children.key.data", "array<bigint>").alias("keys"), get("$.children.nation.children.name.data", "array<string>").alias("names"))


# -- consumers of cells -------------------------------------------------------------


@query(f"SELECT a.d0, a.d1, a.value - b.value AS change FROM {CELLS} a JOIN {CELLS} b ON b.d0 = a.d0 + 1 AND b.d1 = a.d1")
def aligned_join(spark, sf_dir):
    a = _stored_cells(spark, sf_dir)
    b = a.select((F.col("d0") - 1).alias("d0"), "d1", F.col("value").alias("other"))
    return a.join(b, ["d0", "d1"]).select("d0", "d1", (F.col("value") - F.col("other")).alias("change"))


@query(f"SELECT d1, count(*) AS n, max(value) AS most FROM {CELLS} WHERE d0 < 100 GROUP BY d1")
def slab_groupby(spark, sf_dir):
    return dims.hyperslab(_stored_cells(spark, sf_dir), [0], [100], ["d0"]).groupBy("d1").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@query(f"SELECT d0, d1, row_number() OVER (PARTITION BY d0 ORDER BY value DESC, d1)::BIGINT AS place FROM {CELLS} WHERE d0 < 50")
def slab_window(spark, sf_dir):
    w = Window.partitionBy("d0").orderBy(F.desc("value"), "d1")
    return dims.hyperslab(_stored_cells(spark, sf_dir), [0], [50], ["d0"]).select("d0", "d1", F.row_number().over(w).cast("long").alias("place"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle, through a container."""
    return container_slab(spark, sf_dir)
