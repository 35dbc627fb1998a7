"""Benchmark decontamination by size-partitioned MinHash containment, with DataFrame
operations only.

Test items are short, documents long, so what counts is containment: the share of an
item's distinct five-word shingles that a document holds. Items are partitioned by
their number of shingles, n, into classes of a factor of two. An item's sketch is its k
smallest shingle hashes (a bottom-k MinHash). A document that holds at least
need(n) = ceil(threshold x n) of the shingles lacks at most n - need(n) of them, so of any
n - need(n) + 1 it holds one: with k from the largest n of the class no such document is
missed. Documents probe the sketches with every shingle of their whole text, and the
candidate pairs are verified by counting the exact shingles.

Words are runs of letters and digits, lower-cased. Items of fewer than five words have
one shingle of all their words.

Defined results: null or empty items match nothing, null or empty documents hold
nothing; rows that repeat an id are one document (or item) with all their shingles; a
null doc_id is an id of its own, items with a null id are left out. A containment of
exactly the threshold counts (no ties are broken: every item that is contained is
named). Texts of any length are read whole. No documents or no items give no rows, and
leave all documents. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import stored

WIDTH = 5
#: Up to so many rows, and bytes of text in them, a side is broadcast; beyond, it is joined
#: by a shuffle.
MOST_BROADCAST, MOST_BYTES = 500_000, 64 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, width: int, made: str) -> str:
    """SQL: one value for each place of ``width`` words; ``made`` makes it from {w}."""
    parts = ", ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(width))
    return f"if(size({words}) >= {width}, transform(sequence(0, size({words}) - {width}), i -> {made.format(w=parts)}), array())"


def _all(words: str, widths: list[int], made: str) -> Column:
    parts = [_shingles(words, w, made) for w in widths]
    return F.expr(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})")


def _bounded(df: DataFrame) -> DataFrame:
    """df (a stored one), to be broadcast if it is small."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= MOST_BROADCAST and size <= MOST_BYTES else df


def contained(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document and item
    with at least ``percent`` per cent of the item's distinct shingles in the document."""
    docs = docs.select("doc_id", "text")
    words = items.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    whole = words.select("item_id", F.when(F.size("words") < WIDTH, F.array(F.array_join("words", " "))).otherwise(_all("words", [WIDTH], "concat_ws(' ', {w})")).alias("s"), F.least(F.size("words"), F.lit(WIDTH)).alias("width"))
    shingles = stored(whole.select("item_id", F.explode("s").alias("s"), "width").distinct())
    widths = sorted(r.width for r in shingles.select("width").distinct().collect())
    if not widths:
        return docs.limit(0).select(F.col("doc_id").cast("long"), F.lit(0).alias("item_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment"))
    sizes = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.floor(F.log2("n")))
    need = F.floor((F.col("n") * percent + 99) / 100)
    most = sizes.groupBy("class").agg(F.max("n").alias("n")).select("class", (F.col("n") - need + 1).alias("k"))
    sizes = stored(sizes.join(F.broadcast(most), "class").select("item_id", "n", need.alias("need"), "k"))
    hashed = shingles.withColumn("h", F.xxhash64(F.concat_ws(" ", "s")))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "s"))
    sketch = hashed.join(_bounded(sizes), "item_id").withColumn("rank", rank).where(F.col("rank") <= F.col("k")).select("h", "item_id")
    sketch = stored(sketch.distinct())

    probes = docs.select("doc_id", _words(F.col("text")).alias("words")).select("doc_id", F.explode(_all("words", widths, "xxhash64(concat_ws(' ', {w}))")).alias("h"))
    pairs = stored(probes.join(_bounded(sketch), "h").select("doc_id", "item_id").distinct())

    ids = pairs.select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.join(_bounded(stored(ids)), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    exact = texts.select("doc_id", _words(F.col("text")).alias("words")).select("doc_id", F.explode(F.array_distinct(_all("words", widths, "concat_ws(' ', {w})"))).alias("s")).distinct()
    wanted = pairs.join(_bounded(shingles).select("item_id", "s"), "item_id").select(F.col("doc_id").alias("__id"), "item_id", F.col("s").alias("__s"))
    found = wanted.join(exact, (F.col("s") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    shared = found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.join(_bounded(sizes), "item_id").where(F.col("n_shared") >= F.col("need")).select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that contain no item."""
    leaks = stored(contained(docs, items, percent).select(F.col("doc_id").alias("leak")).distinct())
    # columns of docs stay inside one struct, so that none has the name of this one
    held = docs.select(F.struct(*docs.columns).alias("row"))
    return held.join(_bounded(leaks), F.col("row.doc_id").eqNullSafe(F.col("leak")), "left_anti").select("row.*")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' ')) END) AS s, least(len(w), 5) AS width FROM iw WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM i),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - width + 2), lambda p: array_to_string(w[p : p + width - 1], ' '))) AS s FROM dw, widths WHERE len(w) >= width),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, any_value(n.n) AS n_shingles, count(*) AS n_shared, count(*) / any_value(n.n) AS containment
FROM d JOIN i USING (s) JOIN n ON n.item_id = i.item_id GROUP BY d.doc_id, i.item_id HAVING count(*) * 100 >= 80 * any_value(n.n)
"""
