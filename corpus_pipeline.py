"""A training-data pipeline over ``documents``, in five stages.

Each stage works on all that the one before kept, and its result is written as Parquet
and read again. All but the last return the columns of ``documents``.

Defined results, for any columns beside doc_id and text, of any name: a null text counts
as an empty one (the line stage makes it one). The quality stage judges each row by its
text, a score of exactly 0.7 stays. The line stage drops lines found in exactly ten rows
or more, rows that repeat an id counted each. Texts without words are one group of near
copies; of rows with one id and one text one stays; a null id comes after all others. The
decontamination stage judges all rows of an id together, null being an id. Texts of any
length are read whole. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontam, linededup, quality, simhash, spm
from tilewright.llm.common import stored

#: Up to so many ids are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: SQL cannot express a discriminant, SimHash or SentencePiece; tests/llm holds run()
#: against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars follows."""
    kept = linededup.without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (0.8 of their distinct five-word shingles): that
    with the smallest id, and of several texts with that id the one of the smallest hash. A
    null id comes after all others. Of rows with that id and text any one stays."""
    lost = simhash.surplus(docs, width=5).select(F.col("doc_id").alias("id"), "text_key", "once")
    lost = F.broadcast(lost) if lost.count() <= MOST_BROADCAST else lost
    # columns of docs stay inside one struct, so that none has the name of one of these
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), simhash.text_key().alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key"))
    kept = held.join(lost, same, "left_anti")
    if not lost.where("once").isEmpty():
        kept = kept.unionByName(held.join(lost.where("once"), same, "left_semi").dropDuplicates(["own_id", "own_key"]))
    return kept.select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, round_trip, ids) of every document."""
    return spm.encode(docs, spm.load())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
