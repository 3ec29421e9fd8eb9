"""Durable state of a resumable run: results by key, as an append log and as a stream.

A result is ok with a payload or error with a reason; the latest by time wins. Resuming leaves
out every recorded key, errors too, unless they are to be tried again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = T.StructType([T.StructField(c, T.StringType()) for c in ("pair_id", "status", "pair_json", "raw_json", "error_json")] + [T.StructField("updated_at", T.TimestampType())])


def recorded(results: DataFrame) -> DataFrame:
    """Results with status; exactly one of pair_json and error_json must be set."""
    good = F.col("pair_json").isNotNull() != F.col("error_json").isNotNull()
    status = F.when(good, F.when(F.col("pair_json").isNotNull(), "ok").otherwise("error")).otherwise(F.raise_error(F.lit("a result needs a pair or an error")))
    return results.withColumn("status", status).select(*STATE.fieldNames())


def append(results: DataFrame, path: str) -> None:
    recorded(results).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The log, empty if there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(STATE).parquet(path) if there else spark.createDataFrame([], STATE)


def latest(log: DataFrame, key: str = "pair_id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The last row of each key; of rows that tie in order, the one with the largest values, column by column, so a success before an error.

    Aggregated with partial maxima, so a key of many results is no hot task.
    """
    rest = [c for c in log.columns if c not in (key, *order)]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_s")).select(*[key if c == key else F.col("_s")[c].alias(c) for c in log.columns])


def pending(requests: DataFrame, state: DataFrame, key: str = "pair_id", retry_errors: bool = False) -> DataFrame:
    """Requests without a result."""
    done = state.where("status = 'ok'") if retry_errors else state
    return requests.join(done.select(key).distinct(), key, "left_anti")


def counts(state: DataFrame) -> DataFrame:
    """One row: results, successes, errors and errors of overlong prompts."""
    kind = F.get_json_object("error_json", "$.error_type")
    return state.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if(kind.isin("PromptTooLong", "QwenContextOverflow")).alias("n_too_long"))


def label_counts(state: DataFrame) -> DataFrame:
    """One row: pairs of either label among the payloads."""
    label = F.get_json_object("pair_json", "$.compatibility_label")
    return state.agg(F.count_if(label == "1").alias("n_positive"), F.count_if(label == "0").alias("n_negative"))


def error_types(state: DataFrame) -> DataFrame:
    """Errors by their type."""
    return state.where("status = 'error'").groupBy(F.coalesce(F.get_json_object("error_json", "$.error_type"), F.lit("")).alias("error_type")).agg(F.count("*").alias("n"))


def discovered(requests: DataFrame, name: str = "discovered", key: str = "pair_id") -> tuple[DataFrame, Observation]:
    """requests that count themselves as they are read: the observation's `requests` and `samples` are there once an action has run, without a pass of their own."""
    seen = Observation(name)
    return requests.observe(seen, F.count(key).alias("requests"), F.count("*").alias("samples")), seen


def merge_legacy(log: DataFrame, pairs: DataFrame, errors: DataFrame, raw: DataFrame, at: Column, key: str = "pair_id") -> DataFrame:
    """log with the results of an older run's files: (key, pair_json), (key, error_json) and (key, raw_json). A key of pairs is a success also if it has an error; keys that log holds are left as they are."""
    one = lambda rows, c: rows.groupBy(key).agg(F.max(c).alias(c))
    both = one(pairs, "pair_json").join(one(errors, "error_json"), key, "full_outer").join(one(raw, "raw_json"), key, "left")
    status = F.when(F.col("pair_json").isNotNull(), "ok").otherwise("error")
    new = both.join(log.select(key).distinct(), key, "left_anti").withColumns({"status": status, "updated_at": at})
    return log.unionByName(new.select(*log.columns))


def ingest_latest(spark: SparkSession, source: str, target: str, checkpoint: str, files_at_once: int = 100):
    """A stream that upserts new result files of source: each micro-batch of files_at_once files is appended as one commit with its number, and a batch that runs again replaces itself."""
    stream = spark.readStream.schema(STATE).option("maxFilesPerTrigger", files_at_once).json(source)

    def put(batch: DataFrame, n: int) -> None:
        latest(recorded(batch)).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_resume(before: dict, now: dict, keys: tuple[str, ...]) -> None:
    """Raises if a setting that results depend on has changed."""
    if changed := [k for k in keys if before.get(k) != now.get(k)]:
        raise ValueError(f"settings changed since the run began: {', '.join(changed)}")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """A stream that appends new result files of source to the log at target, and ends when none are left."""
    stream = spark.readStream.schema(STATE).json(source)
    return recorded(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def export(state: DataFrame, path: str) -> None:
    """Payloads of successes in key order as JSON lines."""
    state.where("status = 'ok'").orderBy("pair_id").select(F.col("pair_json").alias("value")).write.mode("errorifexists").text(path)
