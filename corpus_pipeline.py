"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but
the last return the columns of documents. A stage reads doc_id, text, source and n_chars; all other
columns of docs are kept as they are, whatever their names, also where an operator makes a column of
that name itself, in another case or with a dot in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import decontamination, mixing, neardup, quality, sharding
from tracewise.llm.shared import held, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with a score of 0.5 (a tie) or more.

    The model is fitted on docs and the labels. A null, empty or very long text is scored like any other;
    a row with a null id is scored but never trains; repeated rows are kept or rejected together; an empty table
    gives an empty table. If fewer than two classes can train, all rows share one score, the share of
    good labels or 0.5, so all are kept or none.
    """
    model = quality.fitted(docs, _table(spark, sf_dir, "labels"))
    rows, back = held(docs, {"text": "text"})
    return quality.scored(rows, model).where("predicted = 1").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group (5 words, similarity 0.8 or more).

    A null text, or one without words, is in no group and is kept; a row with a null id is kept;
    of rows that share a kept id, so of repeated rows, one stays: that with the smallest text, null
    last, and any one of those that tie in text; a text of fewer than 5 words is one shingle; a very long text is compared whole;
    an empty table gives an empty table.
    """
    return neardup.deduped(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that they share with the benchmark, with n_chars of what is left; a text of which no word is left goes.

    A null or empty text has no words, no hits and is kept as it is; a row with a null id is treated like any other;
    repeated rows and ties get the same answer each; a very long text is searched whole; an empty table, or an
    empty benchmark, gives docs as they are.
    """
    rows, back = held(docs, {"text": "text", "n_chars": "n_chars"})
    rows = decontamination.find(rows, _table(spark, sf_dir, "benchmark"), clean=True).where("n_hit = 0 OR n_hit < n_words")
    hit = F.col("n_hit") > 0
    rows = rows.withColumn("n_chars", F.when(hit, F.char_length("clean_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.when(hit, F.col("clean_text")).otherwise(F.col("text")))
    return rows.select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents of each source, repeated or left out so that its words come near its target.

    A null or empty text has no words and goes on once; a null source is a source of its own; rows with a null id are
    ordered by a digest of their text; repeated rows count each, and those that tie at a cut are taken or left one by one; a very
    long text is taken if at least half of it is before its source's cut; an empty table gives an empty table.
    """
    rows, back = held(docs, {"doc_id": "doc_id", "text": "text", "source": "source"})
    mixed = mixing.mix(rows, mixing.n_words(F.col("text")), whole=True, tie=F.md5(F.coalesce("text", F.lit(""))))
    return mixing.repeated(mixed).select(*back)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of 16, their slot (place in it, gapless from 0), virtual slot and map version.

    A null or empty text has a size of 1; a null id hashes by its text; repeated rows and ties get a place each in the same
    shard; a very long text weighs its bytes; an empty table gives an empty table. Columns of docs that are named shard, slot,
    virtual_slot or map_version, in any case, are replaced.
    """
    rows, back = held(docs, {"doc_id": "doc_id", "text": "text"}, ("shard", "slot", "virtual_slot", "map_version"))
    return sharding.shard(rows, shards=16).select(*back, "shard", "slot", "virtual_slot", "map_version")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL has neither the classifier nor the MinHash groups; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
