"""Shared folder, labelled samples and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session. Without the setting a temporary one is made in local mode, and a cluster
    gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "own" not in _FOLDER:
            _FOLDER["own"] = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        folder = _FOLDER["own"]
    return folder.rstrip("/")


def stored(df: DataFrame, sorted_by: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends here, and
    the loss of an executor does not lose it. ``parts``: columns whose values get folders
    of their own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if sorted_by:
        df = df.sortWithinPartitions(*sorted_by)
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by stored()."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does the same where a text is ASCII, and is much faster there."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def folded_bytes(text: Column) -> Column:
    """A text with A-Z lower-cased, fit for comparing and splitting at ASCII characters only:
    one that is not ASCII stands as its UTF-8 bytes, read as ISO-8859-1. lower() changes
    the first bytes of some characters there, each to another one of the same length, so
    texts are equal if and only if they were equal but for A-Z. Faster than translate()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.lower(F.decode(text.cast("binary"), "ISO-8859-1")))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows outside the held-out part, in
    the order of a hash of the id. Rows with a null id or label are left out; an id
    with several labels has the largest. ``most`` bounds what is broadcast."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_labels(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): the documents of labelled_sample()."""
    sample = labelled_sample(labels, label, most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the
    component's smallest node. Alternating large-star and small-star rounds; each
    round is stored, so lineage stays short. No node's neighbours meet in one row:
    only minima are aggregated, and the joins back can be split where a node has
    many neighbours."""

    def canonical(e: DataFrame) -> DataFrame:
        e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return e.distinct()

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(canonical(edges))
    mark = stamp(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = stored(canonical(small))
        drop_stored(now)
        now, before = after, mark
        mark = stamp(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def pieces_of(batch, most_bytes: int = 4 << 20):
    """Slices of an Arrow batch whose texts hold about ``most_bytes`` at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end
