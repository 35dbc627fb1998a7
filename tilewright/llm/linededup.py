"""Line dedup with levelled sorted runs, by DataFrame operations only.

Texts are read once to make their line keys, which are stored; everything after reads
those. A run is a table (key, n_docs), bucketed and sorted by key: how many documents of
a batch hold each line. Runs of level 0 come from batches; when a level has two runs they
are merged into one run of the next level. A run's key is settled where it counts enough
documents: each new batch is merge-anti-joined with the settled keys of all runs and adds
only what is left as its own run. Runs have one bucketing and order, so joining and
merging them needs no exchange and no sort of theirs. In the end all runs together name
the keys to drop.

A line's key is the MD5 of the line, white space stripped at both ends and A-Z
lower-cased. Only keys are shuffled for counting, once for each document that holds
them, and summed before the shuffle. Of the keys to drop the most frequent are broadcast,
a bounded number; the others are joined by a shuffle, and none of them is frequent. Whole
texts are shuffled once, to meet the places of the lines that they lose.

Defined results: a null or empty text is one empty line; empty lines are never dropped
(they are below the least length); rows that repeat an id count as documents of their
own, equal ones too, and all lose the same keys; a null id is an id of its own. A key in
exactly ``least_docs`` documents is dropped (no ties are broken). Texts of any length are
read whole, and a text costs time in proportion to its length. An empty table gives an
empty one. Other columns stay as they are and may have any name.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import WHITE, drop_stored, folded_bytes, shared_folder, stored, union_all

#: At most about so many keys to drop are broadcast; the others are joined by a shuffle.
MOST_BROADCAST = 200_000


def line_keys(text: Column, least_length: int = 1) -> Column:
    """The keys of a text's lines, in order; null for lines below the least length."""

    def key(line: Column) -> Column:
        own = F.btrim(line, F.lit(WHITE))
        if least_length <= 1:
            return F.when(own != "", F.md5(own)) if least_length else F.md5(own)
        # a code point has one byte that is not a continuation
        return F.when(F.length(F.regexp_replace(own, "[\x80-\xBF]", "")) >= least_length, F.md5(own))

    return F.transform(F.split(folded_bytes(F.coalesce(text, F.lit(""))), "\n"), key)


@contextmanager
def _in_order(spark: SparkSession):
    """Scans of runs say that their buckets are sorted (each is one file)."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled runs of line keys with the number of documents that hold them."""

    def __init__(self, least_docs: int):
        self.least_docs = least_docs
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _settled_in(self, run: DataFrame) -> DataFrame:
        return run.where(F.col("n_docs") >= self.least_docs).select("key")

    @property
    def settled(self) -> DataFrame:
        """(key) of all lines that some run finds in enough documents."""
        return union_all([self._settled_in(r) for r in self.runs]).distinct()

    def add(self, keys: DataFrame) -> None:
        """Add a batch: rows (key), one for each document that holds it."""
        new = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
        with _in_order(keys.sparkSession):
            for run in self.runs:
                new = new.join(self._settled_in(run).hint("merge"), "key", "left_anti")
            new, level = self.written(new), 0
            while level < len(self.levels) and self.levels[level]:
                old = self.levels[level].pop()
                merged = self.written(self.merged(old, new))
                self._dropped(old)
                self._dropped(new)
                new, level = merged, level + 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.hint("merge").join(b.withColumnRenamed("n_docs", "more"), "key", "full")
        return both.select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))

    @staticmethod
    def written(run: DataFrame) -> DataFrame:
        """A run, as a table of the shared folder in as many sorted buckets as a shuffle has partitions."""
        spark = run.sparkSession
        name = f"run_{uuid.uuid4().hex}"
        path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        run.write.format("parquet").bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        out = spark.table(name)
        out.stored_at, out.stored_as = path, name
        return out

    @staticmethod
    def _dropped(run: DataFrame) -> None:
        run.sparkSession.sql(f"DROP TABLE {run.stored_as}")
        drop_stored(run)

    def repeated(self) -> DataFrame:
        """(key, n_docs) of every line found in at least ``least_docs`` documents."""
        runs = self.runs
        counts = runs[0] if len(runs) == 1 else union_all(runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
        return counts.where(F.col("n_docs") >= self.least_docs)

    def drop(self) -> None:
        for r in self.runs:
            self._dropped(r)
        self.levels = []


def _lost(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, tie, places) of the documents that lose lines."""
    placed = lines.select("id", "tie", F.posexplode("keys").alias("place", "key")).where("key is not null")
    n, total = repeated.agg(F.count(F.lit(1)), F.sum("n_docs")).first()
    if n <= MOST_BROADCAST:
        hit = placed.join(F.broadcast(repeated.select("key")), "key", "left_semi")
    else:
        # no more than MOST_BROADCAST keys have so large a share of all that are counted
        often = F.col("n_docs") * MOST_BROADCAST > total
        rest = placed.join(F.broadcast(repeated.where(often).select("key")), "key", "left_anti")
        hit = placed.join(F.broadcast(repeated.where(often).select("key")), "key", "left_semi")
        hit = hit.unionByName(rest.join(repeated.where(~often).select("key").hint("merge"), "key", "left_semi"))
    return hit.groupBy("id", "tie").agg(F.array_sort(F.collect_set("place")).alias("places"))


def without_repeated_lines(docs: DataFrame, least_docs: int = 10, least_length: int = 1, n_batches: int = 4, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with each text less the lines whose key is found in ``least_docs`` documents
    or more. ``counts``: names of two more columns, for the lines before and those dropped."""
    tie = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    batch = F.pmod(F.xxhash64(docs["doc_id"], tie), F.lit(n_batches)).cast("int")
    lines = stored(docs.select(docs["doc_id"].alias("id"), tie.alias("tie"), line_keys(docs["text"], least_length).alias("keys"), batch.alias("batch")), parts=["batch"])
    runs = LineRuns(least_docs)
    for k in range(n_batches):
        own = lines.where(F.col("batch") == k)
        runs.add(own.select(F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")))
    repeated = stored(runs.repeated())
    runs.drop()
    lost = stored(_lost(lines, repeated))
    drop_stored(lines)
    drop_stored(repeated)

    # columns of docs stay inside one struct, so that none has the name of one of these
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc"), tie.alias("text_key"))
    joined = held.join(lost, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("tie")), "left")
    joined = joined.select("row", "places", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n").alias("lines"))
    between = F.expr("""flatten(transform(sequence(0, size(places)), j -> slice(lines,
        if(j = 0, 0, places[j - 1] + 1) + 1,
        if(j = size(places), size(lines), places[j]) - if(j = 0, 0, places[j - 1] + 1))))""")
    text = F.when(F.col("places").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(F.array_join(between, "\n"))
    out = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    if counts:
        out += [F.size("lines").cast("long").alias(counts[0]), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    out = without_repeated_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY r
"""
