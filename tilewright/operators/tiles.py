"""Cells to tiles and back, and filters over tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tilewright.container.types import Type, decode, encode, spark_type
from tilewright.functions import codecs
from tilewright.functions.dims import chunk_grid, chunk_of, delinearize, linearize, local_of


def to_tiles(cells: DataFrame, shape: Sequence[int], chunk: Sequence[int], fill=0, dims: Sequence[str] | None = None, value: str = "value") -> DataFrame:
    """(chunk, values) from cells d0, d1, ..., value: the tile's elements in row-major
    order. Edge tiles are padded with the fill value; cells of the array that are not
    given have it too. Two shuffles: of the cells by chunk and place, then of those by chunk."""
    dims = list(dims or (f"d{k}" for k in range(len(shape))))
    grid = [-(-d // c) for d, c in zip(shape, chunk, strict=True)]
    place = linearize([chunk_of(d, c) for d, c in zip(dims, chunk, strict=True)], grid)
    inside = linearize([local_of(d, c) for d, c in zip(dims, chunk, strict=True)], chunk)
    own = cells.select(place.alias("chunk"), inside.alias("place"), F.col(value).alias("v"))
    blank = chunk_grid(cells.sparkSession, shape, chunk).select("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.prod(chunk) - 1).cast("long"))).alias("place"), F.lit(fill).cast(own.schema["v"].dataType).alias("v"))
    both = own.withColumn("given", F.lit(1)).unionByName(blank.withColumn("given", F.lit(0)))
    one = both.groupBy("chunk", "place").agg(F.max_by("v", "given").alias("v"))
    rows = one.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("cells"))
    return rows.select("chunk", F.col("cells.v").alias("values"))


def from_tiles(tiles: DataFrame, shape: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """Cells d0, d1, ..., value of tiles (chunk, values); padding is dropped."""
    grid = [-(-d // c) for d, c in zip(shape, chunk, strict=True)]
    rows = tiles.select("chunk", F.posexplode("values").alias("place", "value"))
    coords = [(a * n + b).alias(f"d{k}") for k, (a, b, n) in enumerate(zip(delinearize("chunk", grid), delinearize("place", chunk), chunk, strict=True))]
    inside = " and ".join(f"d{k} < {n}" for k, n in enumerate(shape))
    return rows.select(*coords, "value").where(inside)


def encode_tiles(tiles: DataFrame, t: Type, pipeline: codecs.Pipeline, keys: Sequence[str] = ("chunk",)) -> DataFrame:
    """keys, data, mask: each tile's values as stored bytes."""

    def rows(batches):
        for batch in batches:
            got = [codecs.encode(encode(t, v), pipeline) for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32())], [*keys, "data", "mask"])

    kinds = dict(tiles.dtypes)
    return tiles.select(*keys, "values").mapInArrow(rows, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", data binary, mask int")


def decode_tiles(stored: DataFrame, t: Type, pipeline: codecs.Pipeline, keys: Sequence[str] = ("chunk",)) -> DataFrame:
    """keys, values: the tiles of stored bytes (data, mask)."""

    schema = to_arrow_schema(StructType.fromDDL(f"values array<{spark_type(t)}>"))

    def rows(batches):
        for batch in batches:
            out = []
            for data, mask in zip(batch.column("data").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                raw = codecs.decode(data, pipeline, mask)
                out.append(decode(t, raw, len(raw) // t.size))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, schema.field(0).type)], [*keys, "values"])

    kinds = dict(stored.dtypes)
    return stored.select(*keys, "data", "mask").mapInArrow(rows, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", values array<{spark_type(t)}>")
