import pytest
from pyspark.sql import functions as F

from tilewright.container import types as T
from tilewright.container.writer import GroupNode, build
from tilewright.__main__ import main
from tilewright.functions import dims
from tilewright.operators import blobs as blobs_module
from tilewright.operators import tiles
from tilewright.sources import arrays


@pytest.fixture(scope="module")
def path(tmp_path_factory, spark):
    arrays.register(spark)
    r = GroupNode()
    r.dataset("data", T.floating(4), (50, 64), [float(i) for i in range(3200)], chunk=(16, 10), filters=((2, (4,)), (1, (4,)))).attribute("units", T.vlen_string(), "m")
    r.dataset("gaps", T.integer(4), (9,), None, chunk=(4,), fill=-1)
    point = T.compound(("id", T.integer(4)), ("c", T.enum(T.integer(1), RED=0, BLUE=2)), ("v", T.vlen_string()))
    r.dataset("points", point, (3,), [{"id": 1, "c": 0, "v": "a"}, {"id": 2, "c": 2, "v": ""}, {"id": 3, "c": 9, "v": "xyz"}])
    r.dataset("big", T.integer(8, signed=False), (2,), [2**63, 5])
    r.dataset("scalar", T.integer(4), (), [7])
    r.soft("also", "/data")
    f = tmp_path_factory.mktemp("arrays") / "a.h5"
    f.write_bytes(build(r, times=(1600000000,) * 4))
    return str(f)


def read(spark, path, **options):
    return spark.read.format("tilewright").options(**options).load(path)


def test_cells_and_pushed_bounds(spark, path):
    c = read(spark, path)
    assert c.count() == 3200
    slab = c.where("d0 >= 20 and d0 < 30 and d1 > 4 and d1 <= 7")
    want = [(i, j, float(i * 64 + j)) for i in range(20, 30) for j in (5, 6, 7)]
    assert sorted(tuple(r) for r in slab.collect()) == want
    reader = arrays.Reader({"path": path, "dataset": "/data", "partition_bytes": "1"}, c.schema)
    assert len(reader.partitions()) == 28
    kept = list(reader.pushFilters([arrays.GreaterThanOrEqual(("d0",), 20), arrays.LessThan(("d0",), 30), arrays.GreaterThan(("d1",), 4), arrays.LessThanOrEqual(("d1",), 7)]))
    assert len(kept) == 4 and sorted(p.chunks[0].scaled for p in reader.partitions()) == [(1, 0)]
    none = arrays.Reader({"path": path, "dataset": "/data"}, c.schema)
    list(none.pushFilters([arrays.EqualTo(("d0",), 999)]))
    assert len(none.partitions()) == 1 and not none.partitions()[0].chunks
    assert read(spark, path).where("d0 = 999").count() == 0
    assert read(spark, path, dataset="/also").where("d0 = 1 and d1 = 1").first().value == 65.0


def test_other_types(spark, path):
    rows = read(spark, path, dataset="/points", labels="true").orderBy("d0").collect()
    assert [r.value.c for r in rows] == ["RED", "BLUE", "9"] and rows[2].value.v == "xyz"
    assert [int(r.value) for r in read(spark, path, dataset="/big").orderBy("d0").collect()] == [2**63, 5]
    assert [tuple(r) for r in read(spark, path, dataset="/scalar").collect()] == [(7,)]


def test_missing_chunks(spark, path):
    assert [r.value for r in read(spark, path, dataset="/gaps").collect()] == [-1] * 9
    assert [r.value for r in read(spark, path, dataset="/gaps", missing="zero").collect()] == [0] * 9
    assert read(spark, path, dataset="/gaps", missing="skip").count() == 0


def test_views(spark, path):
    t = read(spark, path, view="tiles").where("origin[0] = 48 and origin[1] = 60").first()
    assert list(t.extent) == [2, 4] and list(t["values"]) == [3132.0, 3133.0, 3134.0, 3135.0, 3196.0, 3197.0, 3198.0, 3199.0]
    assert read(spark, path, view="chunks").where("path = '/data'").count() == 28
    assert {r.path for r in read(spark, path, view="objects").collect()} == {"/", "/data", "/gaps", "/points", "/big", "/scalar"}
    assert read(spark, path, view="links").where("kind = 'soft'").first().target_path == "/data"
    a = read(spark, path, view="attributes").first()
    assert (a.path, a.name, a.value_json) == ("/data", "units", '"m"')
    d = read(spark, path, view="datasets").where("path = '/data'").first()
    assert [f.id for f in d.filters] == [2, 1] and list(d.chunk_shape) == [16, 10] and d.index_kind == "fixed array"
    assert read(spark, path, view="files").first().version == 3
    assert read(spark, path, view="messages").where("name = 'layout'").count() == 5


def test_sink_comes_back(spark, tmp_path, sf_dir):
    arrays.register(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value"))).withColumn("ok", F.col("event_id") % 2 == 0)
    out = str(tmp_path / "out")
    write = e.repartition(3).write.format("tilewright").options(shuffle="true", deflate="5", chunk="100")
    write.mode("append").save(out)
    back = spark.read.format("tilewright").schema(e.schema).option("view", "table").load(out)
    assert back.exceptAll(e).count() == 0 and back.count() == e.count()
    write.mode("append").save(out)
    assert spark.read.format("tilewright").schema(e.schema).option("view", "table").load(out).count() == e.count() * 2
    write.mode("overwrite").save(out)
    assert spark.read.format("tilewright").schema(e.schema).option("view", "table").load(out).count() == e.count()
    few = spark.read.format("tilewright").schema("user_id long").option("view", "table").load(out)
    assert few.agg(F.sum("user_id")).first()[0] == e.agg(F.sum("user_id")).first()[0]


def test_stream_of_a_growing_dataset(spark, tmp_path):
    arrays.register(spark)

    def write(n):
        r = GroupNode()
        r.dataset("data", T.integer(4), (n, 2), list(range(2 * n)), chunk=(4, 2), most=(None, 2))
        (tmp_path / "g.h5").write_bytes(build(r))

    write(5)
    s = spark.readStream.format("tilewright").load(str(tmp_path / "g.h5"))
    q = s.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("grown").count() == 10
        write(8)
        q.processAllAvailable()
        assert sorted(r.value for r in spark.table("grown").collect()) == list(range(16))
    finally:
        q.stop()


def test_tiles_with_gaps(spark):
    cells = spark.createDataFrame([(0, 0, 1), (2, 3, 5)], "d0 long, d1 long, value int")
    t = tiles.to_tiles(cells, [3, 4], [2, 3], fill=-1)
    got = {r.chunk: list(r["values"]) for r in t.collect()}
    assert got[0] == [1, -1, -1, -1, -1, -1] and got[3] == [5, -1, -1, -1, -1, -1] and len(got) == 4
    back = tiles.from_tiles(t, [3, 4], [2, 3])
    assert back.count() == 12 and back.where("value >= 0").count() == 2


def test_hyperslab_arguments(spark):
    with pytest.raises(ValueError):
        dims.hyperslab(spark.range(1), [0, 0], [1])
    with pytest.raises(ValueError):
        dims.hyperslab(spark.range(1), [-1], [1], ["id"])


def test_containers_as_bytes(spark, path):
    blobs = spark.read.format("binaryFile").load(path)
    got = blobs_module.cells_of(blobs, "/data", T.floating(4), 2)
    assert got.count() == 3200 and got.where("d0 = 3 and d1 = 4").first().value == 196.0
    assert [r.value for r in blobs_module.cells_of(blobs, "/scalar", T.integer(4), 0).collect()] == [7]
    assert {r.path for r in blobs_module.objects_of(blobs).collect()} >= {"/", "/data", "/points"}


def test_command_line(path, capsys):
    assert main(["info", path]) == 0 and "/data: float32 little-endian (50, 64), chunked [16, 10] by fixed array, shuffle + deflate" in capsys.readouterr().out
    assert main(["info", path, "--read-dataset", "/data"]) == 0 and capsys.readouterr().out == "[0.0, 1.0, 2.0, 3.0, 4.0]\n"
    assert main(["json", path, "-d", "/points"]) == 0 and '"c": "RED"' in capsys.readouterr().out
    assert main(["json", path, "-H"]) == 0 and '"data":' not in capsys.readouterr().out.replace('"data": {', "")
    assert main(["json", "/nowhere"]) == 1


def test_contiguous_rows_are_parts(spark, tmp_path, monkeypatch):
    """A contiguous array is read in blocks of rows, and of those only the rows inside the bounds."""
    from tilewright.container.reader import Container, Dataset
    from tilewright.sources.arrays import Reader

    monkeypatch.setattr(Dataset, "BLOCK", 800)
    root = GroupNode()
    root.dataset("data", T.integer(4), (100, 7), list(range(700)))
    root.dataset("cube", T.integer(2), (5, 4, 3), list(range(60)))
    (tmp_path / "a.h5").write_bytes(build(root))
    path = str(tmp_path / "a.h5")
    reader = Reader({"path": path, "partition_bytes": "1000"}, None)
    assert len(reader.partitions()) > 1
    reader.bounds = {0: (30, 31)}
    assert [[x.scaled for x in p.chunks] for p in reader.partitions()] == [[(1, 0)]]
    df = spark.read.format("tilewright").load(path)
    assert sorted(tuple(r) for r in df.collect()) == [(k // 7, k % 7, k) for k in range(700)]
    assert sorted(tuple(r) for r in df.where("d0 >= 27 and d0 < 60 and d1 = 3").collect()) == [(k, 3, 7 * k + 3) for k in range(27, 60)]
    assert sorted(tuple(r) for r in spark.read.format("tilewright").option("dataset", "/cube").load(path).where("d1 > 2").collect()) == [(a, 3, b, 12 * a + 9 + b) for a in range(5) for b in range(3)]
    d = Container.open(path).dataset(Container.open(path).resolve("/data"))
    assert d.read_shape == (28, 7) and d.chunk_shape == (100, 7)


def test_index_is_read_once(tmp_path):
    """Rectangles of an array of many chunks look chunks up by their place."""
    from tilewright.container.reader import Container

    root = GroupNode()
    root.dataset("data", T.integer(4), (20_000,), list(range(20_000)), chunk=(16,))
    c = Container.from_bytes(build(root))
    d = c.dataset(c.resolve("/data"))
    read, times = d.chunks, []
    d.chunks = lambda: times.append(1) or read()
    for at in range(0, 20_000, 16):
        assert d.values((at,), (16,)) == list(range(at, at + 16))
    assert len(times) == 1


def test_vax_floats_are_bytes():
    """Floats of an order that nothing here computes with are given as their bytes."""
    t = T.Type("float", 4, "vax", True, 0, 32)
    assert T.numpy_dtype(t) is None and T.spark_type(t) == "binary" and T.decode(t, b"abcdefgh", 2) == [b"abcd", b"efgh"]


def test_nested_columns_come_back(spark, tmp_path):
    """Binary, struct and map columns, null ones too, in several containers for a task."""
    import datetime
    from decimal import Decimal

    schema = "k long, b binary, s struct<x:int,y:string,t:date,d:decimal(9,2),z:struct<f:boolean>>, m map<string,array<long>>, l array<binary>"
    rows = [(k, b"\0" * k + b"x", {"x": k, "y": f"v{k}", "t": datetime.date(2020, 1, 1 + k), "d": Decimal("1.25"), "z": {"f": bool(k % 2)}}, {f"a{k}": [k, 2], "": []}, [b"", b"q"]) for k in range(20)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "nested")
    df.coalesce(1).write.format("tilewright").mode("append").option("file_bytes", "1").option("deflate", "1").save(path)
    got = spark.read.format("tilewright").schema(schema).option("view", "table").load(path)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="null inside"):
        spark.createDataFrame([([None, 1],)], "a array<int>").write.format("tilewright").mode("append").save(path)
