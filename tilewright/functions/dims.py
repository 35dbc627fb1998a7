"""Coordinate algebra of chunked arrays, as Column expressions that Catalyst sees through."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def linearize(coords: Sequence[str | Column], shape: Sequence[int]) -> Column:
    """Row-major position of a cell; the last dimension varies fastest."""
    out = F.lit(0).cast("long")
    for c, n in zip(coords, shape, strict=True):
        out = out * F.lit(n).cast("long") + _col(c)
    return out


def delinearize(position: str | Column, shape: Sequence[int]) -> list[Column]:
    """The coordinates of a row-major position."""
    out, rest = [], _col(position).cast("long")
    for n in reversed(shape[1:]):
        out.append(F.pmod(rest, F.lit(n).cast("long")))
        rest = _div(rest, n)
    out.append(rest)
    return out[::-1]


def _div(c: Column, n: int) -> Column:
    """Whole-number division; exact for all longs."""
    return F.call_function("div", c, F.lit(n).cast("long"))


def chunk_of(coord: str | Column, chunk: int) -> Column:
    return F.call_function("div", _col(coord).cast("long"), F.lit(chunk).cast("long"))


def local_of(coord: str | Column, chunk: int) -> Column:
    return F.pmod(_col(coord).cast("long"), F.lit(chunk).cast("long"))


def chunk_extent(scaled: str | Column, chunk: int, dim: int) -> Column:
    """Cells of a chunk along one dimension: fewer at the edge."""
    origin = _col(scaled).cast("long") * chunk
    return F.greatest(F.lit(0).cast("long"), F.least(origin + chunk, F.lit(dim).cast("long")) - origin)


def overlap(scaled: str | Column, chunk: int, start: int, count: int, dim: int) -> tuple[Column, Column]:
    """(start, count) of the cells that a chunk shares with [start, start + count)."""
    origin = _col(scaled).cast("long") * chunk
    low = F.greatest(origin, F.lit(start).cast("long"))
    high = F.least(origin + chunk, F.lit(min(start + count, dim)).cast("long"))
    return low, F.greatest(F.lit(0).cast("long"), high - low)


def hyperslab(df: DataFrame, start: Sequence[int], count: Sequence[int], dims: Sequence[str] | None = None) -> DataFrame:
    """The cells of a rectangle. Plain comparisons, so a source can skip chunks."""
    dims = dims or [f"d{k}" for k in range(len(start))]
    if len(start) != len(count) or len(start) != len(dims):
        raise ValueError("start, count and dimensions differ in number")
    if any(s < 0 or c < 0 for s, c in zip(start, count, strict=True)):
        raise ValueError("a negative start or count")
    tests = [(F.col(d) >= s) & (F.col(d) < s + c) for d, s, c in zip(dims, start, count, strict=True)]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def chunk_grid(spark: SparkSession, shape: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """One row for each chunk: its linear number and scaled place c0, c1, ..."""
    grid = [-(-d // c) for d, c in zip(shape, chunk, strict=True)]
    total = reduce(int.__mul__, grid, 1)
    places = [c.alias(f"c{k}") for k, c in enumerate(delinearize("id", grid))]
    return spark.range(total).select(F.col("id").alias("chunk"), *places)


def fill_missing(cells: DataFrame, grid: DataFrame, dims: Sequence[str], value: str, fill) -> DataFrame:
    """Every cell of grid with its value, or the fill value where none is stored."""
    joined = grid.join(cells, list(dims), "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def index_kind(free: Column, chunks: Column, filtered: Column, early: Column) -> Column:
    """The chunk index that a writer takes."""
    return F.when(free > 1, "b-tree v2").when(free == 1, "extensible array").when(chunks == 1, "single").when(early & ~filtered, "implicit").otherwise("fixed array")


def number_at(data: str | Column, at: Column, size: int) -> Column:
    """The little-endian number of ``size`` bytes at place ``at`` (from 1) of a binary."""
    byte = lambda k: F.conv(F.hex(F.substring(_col(data), at + k, F.lit(1))), 16, 10).cast("long")
    return reduce(Column.bitwiseOR, [F.shiftleft(byte(k), 8 * k) for k in range(size)])
