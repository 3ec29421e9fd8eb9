"""The numbered queries: each reads a whole table and applies its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import align, ann, decontamination, exact, licenses, lines, mixing, neardup, quality, runs, sharding, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return rows.select("doc_id", F.col("_shard_size").alias("size"), F.col("_shard_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = tokens.counted(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = warc.lookup(archive, archive.captures.select("url_key", "page_id").distinct())
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    store = lines.LineStore(spark)
    for part in range(2):  # the second half is settled through the filters of the first
        store.insert(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part))
    return lines.deduped(docs, store).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return rows.select("doc_id", "n_sentences", "n_known", F.size("matches").cast("long").alias("n_matches"), found.alias("licenses"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, mixing.n_words(F.col("text")), tie=F.md5(F.coalesce("text", F.lit("")))).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fitted(docs, _table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    rows = align.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")).documents
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = exact.groups(docs.withColumn("text_sha256", F.sha2(exact.folded(F.col("text")), 256)))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def planted(doc_id: Column, text: Column) -> Column:
    """text, but in one of ten documents with words that repeat: from a on, word i is word a + (i - a) % p. A null id plants nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    # a bound array, so that words are taken once a row
    whole = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text)), 1)
    return F.when(F.pmod(h, F.lit(10)) == 0, whole).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    rows = runs.found(docs, least=24, times=3)
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])  # noqa: E731  runs are in order, so the first of ties stays
    best = F.reduce("runs", F.lit(None).cast(runs.RUN), lambda best, r: F.when(greater(best, r), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_sharding, op2_near_dedup, op3_tokens, op4_warc, op5_decontamination, op6_line_dedup, op7_license_scan, op8_mixing, op9_quality, op10_nearest, op11_alignment, op12_exact_dedup, op13_runs)
    return {f.__name__: f for f in numbered} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    from tracewise.llm import oracles

    return oracles.SQL
