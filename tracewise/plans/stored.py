"""Registered queries over files: each writes a table in a file form of the library into the shared folder, and loads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.operators import generation as G
from tracewise.operators import normalise as N
from tracewise.operators import scorers as V
from tracewise.operators import tokenised as K
from tracewise.plans.queries import query, reward_by_dataset, state_log
from tracewise.session import scratch
from tracewise.sources import adapters as D
from tracewise.sources import archives as Z
from tracewise.sources import files, loaders
from tracewise.streaming import state as S
from tracewise.streaming.snapshots import StateTable


def _conversation_archives(spark, d):
    """Conversations as members of archives, one of their turns' texts after another; every second is stored, the rest deflated."""
    turns = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = F.array_join(F.transform("t", lambda t: t["text"]), "\n")
    folder = scratch(spark, "conversations")
    name, member = F.concat(F.format_string("part-%d", F.col("conv_id") % 4), _part(F.col("conv_id"))), F.format_string("conv/%012d.jsonl", F.col("conv_id"))
    Z.write(turns.select("conv_id", texts.alias("text")), folder, name, member, F.col("text"), F.col("conv_id") % 2 == 0)
    return Z.directory(spark, folder)


def _archive_name():
    return F.regexp_extract("archive", r"([^/]+)\.zip$", 1)


@query
def archive_lines(spark, d):
    """Lines of archives with their numbers, and their places over all archives."""
    rows = Z.lines(Z.strict(Z.line_index(_conversation_archives(spark, d))))
    return rows.select(_archive_name().alias("archive"), "member", "line", "row_index", F.sha2("value", 256).alias("digest"))


@query
def archive_rows(spark, d):
    """Lines at the places that another table asks for, some of which no line has."""
    wanted = D.table(spark, d, "part").select((F.col("p_partkey") * 7 % 5000).alias("row_index"), F.col("p_partkey").alias("position"))
    rows = Z.rows_at(Z.strict(Z.line_index(_conversation_archives(spark, d))), wanted)
    return rows.select("position", "row_index", "member", "line", F.sha2("value", 256).alias("digest"))


@query
def archive_members(spark, d):
    """Pages as members of archives, with their packed form's checksum, and their contents read back."""
    folder = scratch(spark, "pages")
    page = F.col("page_id")
    Z.write(D.table(spark, d, "pages"), folder, F.concat(F.format_string("pages-%d", page % 4), _part(page)), F.concat("page_id", F.lit(".html")), F.coalesce("html", F.lit("")), page % 3 == 0)
    members = Z.directory(spark, folder)
    rows = Z.strict(Z.contents(members)).join(members.select("archive", "member", "method", "crc"), ["archive", "member"])
    return rows.select(F.regexp_extract("member", r"^(\d+)\.html$", 1).cast("long").alias("page_id"), _archive_name().alias("archive"), F.when(F.col("method") == Z.STORED, "stored").otherwise("deflated").alias("method"), "size", (F.col("crc") == F.crc32("content")).alias("same_crc"), F.sha2("content", 256).alias("digest"))


#: Keys whose rows go to one file, so that files grow in number and not in size.
KEYS = 100_000


def _part(key):
    """The run of keys that a key is in, as it stands in file names."""
    return F.format_string("-%06d", F.floor(key / KEYS))


def _files(rows, spark, name, file, line, value):
    """rows as text files of lines in order below a new folder."""
    folder = scratch(spark, name)
    lines = rows.select(file.alias("_file"), line.alias("_line"), value.alias("value")).repartition("_file").sortWithinPartitions("_file", "_line")
    lines.select("_file", "value").write.partitionBy("_file").text(folder)
    return folder


def _lines_of(folder, spark):
    """(file, line, value) of the text files below a folder, files by the name that they were partitioned by."""
    rows = files.read_lines(spark, [folder])
    return rows.withColumn("file", F.regexp_extract("file", r"_file=([^/]+)/", 1))


def _judged(spark, d):
    """Customers as judged solutions: order k has two or three steps; some records are broken in each of the ways that there are."""
    k = F.col("c_custkey")
    steps = F.array(F.lit('" first "'), F.when(k % 5 == 0, F.lit('" "')).otherwise(F.concat(F.lit('"'), "c_name", F.lit('"'))), F.when(k % 29 == 0, F.lit("7")).otherwise(F.concat(F.lit('"é '), "c_mktsegment", F.lit('"'))))
    labels = F.when(k % 31 == 0, "[1,0,2]").when(k % 37 == 0, "[1,0]").when(k % 25 == 0, "[1,-1,1]").otherwise("[1,0,-1]")
    response = F.when(k % 41 == 0, "3").when(k % 43 == 0, '{"steps":"one","process_correctness":[1]}').when(k % 47 == 0, '{"steps":[],"process_correctness":[]}').otherwise(F.concat(F.lit('{"steps":['), F.array_join(steps, ","), F.lit('],"process_correctness":'), labels, F.lit("}")))
    named = F.when(k % 4 == 0, F.concat(F.lit(',"source_sample_id":'), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit(',"metadata":{"source_sample_id":"c'), k.cast("string"), F.lit('","policy_model":"m"}'))).otherwise(F.lit(""))
    record = F.concat(F.lit('{"question":'), F.when(k % 53 == 0, '" "').otherwise('" why? "'), F.lit(',"data_source":"'), "c_mktsegment", F.lit('","response":'), response, named, F.lit("}"))
    record = F.when(k % 59 == 0, "{cut off").when(k % 61 == 0, "[1]").otherwise(record)
    return D.table(spark, d, "customer").select(k.alias("line"), record.alias("value"))


@query
def context_evaluation(spark, d):
    """Raw records of judged steps from a file, good and bad: each step with its question and earlier steps, or what is wrong with the record. Every fourth line is followed by a blank one."""
    rows = _judged(spark, d).withColumn("value", F.when(F.col("line") % 4 == 0, F.concat("value", F.lit("\n"))).otherwise(F.col("value")))
    lines = _lines_of(_files(rows, spark, "judged", F.concat(F.lit("judged"), _part(F.col("line"))), F.col("line"), F.col("value")), spark)
    steps = N.context_steps(N.records(lines))
    return steps.select("file", "row_index", "step_index", F.md5("anchor").alias("anchor"), "generated", "compatibility_label", "data_source", "policy_model", "pair_id", "source_sample_id", "input_mode", "error")


@query
def loaded_traces(spark, d):
    """Traces from files, whose rows count from 1 in each, with error rows beside them; names come from the file where the record has none."""
    k = F.col("o_orderkey")
    value = F.when(k % 10 == 3, F.lit("[1]")).when(k % 10 == 7, F.lit("{cut off")).when(k % 10 == 1, F.concat(F.lit('{"id":"t'), k.cast("string"), F.lit('","steps":["a","'), "o_orderpriority", F.lit('"],"domain":"x y"}'))).when(k % 10 == 2, F.lit('{"question":"q"}')).otherwise(F.concat(F.lit('{"solution":{"text":"'), "o_orderpriority", F.lit('"},"question":" q "}')))
    rows = D.table(spark, d, "orders").select(k.alias("line"), F.concat(value, F.when(k % 6 == 0, "\n  \n").otherwise("\n")).alias("value"), F.concat(F.lit("part "), (k % 3).cast("string"), _part(k), F.lit(".jsonl")).alias("name"))
    lines = _lines_of(_files(rows, spark, "traces", F.col("name"), F.col("line"), F.col("value")), spark)
    found = loaders.trace_table(loaders.numbered_by_file(lines.withColumn("file", F.regexp_replace("file", "%20", " "))), by_file=True)
    texts = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("question", "reasoning")]
    return found.select("file", "row_index", "trace_id", *texts, "source", "subcategory", "error")


@query
def loaded_cases(spark, d):
    """Caption records of parts by brand and run of keys as JSON documents, lists or objects by id, some cut off, and as JSON lines with bad ones among them: the first cases of each, and all errors."""
    k = F.col("p_partkey")
    caption = F.concat(F.lit('{"caption":" '), "p_name", F.lit('","caption2":"'), "p_type", F.lit('","negative_caption":'), F.when(k % 5 == 0, '""').otherwise(F.concat(F.lit('"no '), "p_name", F.lit('"'))), F.when(k % 2 == 0, F.concat(F.lit(',"id":'), k.cast("string"))).otherwise(F.lit("")), F.lit(',"filename":"a.jpg"}'))
    parts = D.table(spark, d, "part").select(k.alias("k"), F.concat("p_brand", _part(k)).alias("brand"), F.when(k % 11 == 0, "7").otherwise(caption).alias("record"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("b"))
    listed = F.col("b") % 2 == 0
    entries = F.transform(F.array_sort(F.collect_list(F.struct("k", "record", "b"))), lambda x: F.when(x["b"] % 2 == 0, x["record"]).otherwise(F.concat(F.lit('"k'), x["k"].cast("string"), F.lit('":'), x["record"])))
    documents = parts.groupBy("brand", listed.alias("listed"), (F.col("b") % 7 == 0).alias("cut")).agg(F.array_join(entries, ",\n").alias("t"))
    text = F.concat(F.when(F.col("listed"), "[").otherwise("{"), "t", F.when(F.col("cut"), "").when(F.col("listed"), "]").otherwise("}"))
    folder = scratch(spark, "documents")
    documents.select(F.translate("brand", "#", "_").alias("_file"), text.alias("value")).repartition("_file").write.partitionBy("_file").text(folder)
    brand = F.regexp_extract("file", r"_file=([^/]+)/", 1)
    rows = files.read_documents(spark, [folder], loaders.CAPTIONS).withColumn("file", F.translate(brand, "_", "#"))
    cases = loaders.separation_cases(rows.where("error IS NULL"), "parts", F.col("file"), "key", ["at"], 40)
    lines = _files(parts.where("b < 20").withColumn("record", F.when(F.col("k") % 13 == 0, "{cut off").otherwise(F.col("record"))), spark, "lines", F.concat(F.lit("lines"), _part(F.col("k"))), F.col("k"), F.col("record"))
    good, bad = files.parsed_objects(files.with_places(_lines_of(lines, spark)), loaders.CAPTIONS, ["place"])
    cases = cases.unionByName(loaders.ranking_cases(good, "parts", "lines", "id", "place"))
    made = cases.select("case_id", "subcategory", "mode", "positive", F.array_join("negatives", "|").alias("negatives"), F.lit(None).cast("string").alias("error"))
    errors = rows.where("error IS NOT NULL").select(F.col("file").alias("subcategory"), "error").unionByName(bad.select(F.lit("lines").alias("subcategory"), F.col("error_message").alias("error")))
    return made.unionByName(errors.select(F.lit(None).cast("string").alias("case_id"), "subcategory", *[F.lit(None).cast("string").alias(c) for c in ("mode", "positive", "negatives")], "error"))


@query
def state_snapshot(spark, d):
    """Events as results in seven batches of two streams, taken into a state table that merges every three; one batch comes twice."""
    table = StateTable(spark, scratch(spark, "state"), keep=3)
    log, part = state_log(spark, d), F.pmod(F.xxhash64("updated_at", "pair_json"), F.lit(7))
    for n in (0, 1, 2, 3, 2, 4, 5, 6):
        table.append(log.where(part == n), f"s{n % 2}", n)
    return table.read().select("pair_id", "status", "pair_json", "error_json")


@query
def table_scorer(spark, d):
    """Names and types of parts, scored by a table of word vectors that is written to a file first: eight digits of a word's digest."""
    parts = D.table(spark, d, "part")
    words = parts.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word")).distinct().where(F.pmod(F.length("word"), F.lit(11)) != 0)
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.conv(F.substring(F.md5("word"), k, F.lit(1)), 16, 10).cast("double") - 7.5)
    folder = scratch(spark, "words")
    words.select("word", digits.alias("vector")).coalesce(1).write.parquet(folder)  # the words of names: a table that each worker holds
    V.register_table("word_table", spark.read.parquet(folder).inputFiles()[0])
    rows = V.score_pairs(parts.select("p_partkey", "p_name", "p_type"), "word_table", "p_name", "p_type")
    return rows.select("p_partkey", "scorer", F.round("raw_score", 6).alias("raw_score"), "error")


@query
def text_gates(spark, d):
    """Documents as prompts with their first lines as anchors, tokenised by words, and gated by length and budget."""
    docs = D.table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("anchor"), F.col("text").alias("prompt"))
    return K.gated_texts(docs, "words", "words", max_model_len=1024).select("doc_id", "anchor_tokens", "prompt_tokens", "max_output_tokens", "error_type")


@query
def training_pairs(spark, d):
    """Customers' names and segments, some many times over, as tokenised training pairs, of which some are cut."""
    k = F.col("c_custkey")
    pairs = D.table(spark, d, "customer").select(k, F.array_join(F.array_repeat("c_name", (k % 9).cast("int")), " ").alias("anchor"), F.array_join(F.array_repeat(F.concat_ws(" ", "c_mktsegment", "c_name"), (k % 7).cast("int")), " ").alias("generated"), (k % 2).alias("label"))
    rows = K.training_pairs(pairs, "words", "anchor", "generated", 12, "label", ([1], [2], [2]), 0)
    return rows.select("c_custkey", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("length"), "n_tokens", "truncated", "labels", "error")


@query
def table_files(spark, d):
    """A reward table written as CSV, JSON lines and Parquet, and read from each."""
    table, root = reward_by_dataset(spark, d), scratch(spark, "tables")
    files.write_csv(table, f"{root}/csv", table.columns)
    files.write_jsonl(table, f"{root}/rows.jsonl")
    files.write_parquet(table, f"{root}/parquet")
    read = {"csv": files.read_csv(spark, [f"{root}/csv"]), "jsonl": files.read_jsonl(spark, f"{root}/rows.jsonl", table.schema), "staged": files.load_staged(spark, f"{root}/rows.jsonl", table.schema), "parquet": files.load_staged(spark, f"{root}/parquet", columns=table.columns)}
    parts = [rows.select(F.lit(form).alias("form"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]) for form, rows in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def state_stream(spark, d):
    """Events as result files, which a stream takes into the log until none are left; then the last result of each key."""
    root = scratch(spark, "stream")
    results = state_log(spark, d).drop("status")
    results.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/in")
    S.ingest(spark, f"{root}/in", f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return S.latest(S.load(spark, f"{root}/log")).select("pair_id", "status", "pair_json", "error_json")


@query
def numbered_lines(spark, d):
    """Lines of files, every fifth followed by a blank one, with their numbers in the file and ids over all files."""
    k = F.col("o_orderkey")
    value = F.concat(F.to_json(F.struct(k.alias("k"), "o_orderpriority")), F.when(k % 5 == 0, "\n \t").otherwise(""))
    rows = D.table(spark, d, "orders").select(k.alias("line"), F.concat(F.lit("part"), (k % 4).cast("string"), _part(k)).alias("name"), value.alias("value"))
    lines = files.with_row_ids(_lines_of(_files(rows, spark, "orders", F.col("name"), F.col("line"), F.col("value")), spark))
    return lines.select("file", "line", "row_id", F.get_json_object("value", "$.k").cast("long").alias("k"))


@query
def archive_counts(spark, d):
    """Rows of each archive."""
    rows = Z.lines(Z.strict(Z.line_index(_conversation_archives(spark, d))))
    return files.count_zip_rows(rows).select(_archive_name().alias("archive"), "n")


@query
def gate_errors(spark, d):
    """Documents that do not fit the gates, as error records of the audit profile."""
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("pair_id"), "source", F.substring_index("text", "\n", 1).alias("anchor"), F.col("text").alias("prompt"))
    counted = K.gated_texts(docs, "words", "words", max_model_len=1024).drop("max_output_tokens", "error_type")
    errors = G.gate_errors(counted.withColumnsRenamed({"source": "source_sample_id"}), max_model_len=1024)
    return N.profiled_errors(errors, "audit").withColumn("anchor", F.md5("anchor"))
