"""Loaders of test cases and score files, and their registry. A file that is missing or malformed is an error row, not the end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path, PurePath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions import text as X
from tracewise.operators import normalise as N
from tracewise.sources import archives, files, ranges

#: Columns that may hold the positive and the negatives of a CSV row, in the order they are tried.
POSITIVE_FIELDS = ("positive", "positive_caption", "affirmative_caption", "control_caption", "caption", "true_caption", "answer", "correct", "option_0", "choice_0", "A")
NEGATIVE_FIELDS = ("negative", "negative_caption", "negated_caption", "hard_negative", "false_caption", "option_1", "option_2", "option_3", "choice_1", "choice_2", "choice_3", "B", "C", "D")
NEGATIVE_PREFIXES = ("negative_", "neg_", "hard_negative_")

CASE = T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", "dataset", "subcategory", "mode", "anchor", "positive")] + [T.StructField("negatives", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
LOAD_ERROR = "dataset string, subcategory string, error_type string, error_message string"
#: A raw trace as published: steps with a score and Monte Carlo counts.
RAW_TRACE = "id string, image string, question string, response string, steps_with_score array<struct<step:string,score:double,num_mc_correct:bigint,num_mc_total:bigint>>, num_mc_sequences bigint"


def _struct(**kinds: T.DataType | str) -> T.StructType:
    named = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(n, named[k] if isinstance(k, str) else k) for n, k in kinds.items()])


_NLI = dict.fromkeys(("E_ab", "E_ba", "C_ab", "C_ba", "N_ab", "N_ba"), "double")
#: Score rows: what any scorer's file may hold.
SCORES = _struct(
    **dict.fromkeys(("case_id", "trace_id", "dataset", "subcategory", "mode", "pair_type", "negative_type"), "string"), negative_index="int", text_a="string", text_b="string", scorer="string", score_field="string",
    **dict.fromkeys(("score", "raw_score", "bertscore_precision", "bertscore_recall", "bertscore_f1", "nli_score_coverage", "nli_score_equiv"), "double"), **_NLI, all_raw_values=_struct(**_NLI), calibrated_score="double", source_path="string",
)

Loaded = tuple[DataFrame, DataFrame]


def _cases(rows: DataFrame, dataset: str, subcategory: Column | str, mode: str, anchor: Column, positive: Column, negatives: Column, source_id: Column, metadata: dict[str, Column], order: list[str], limit: int | None, kept: Iterable[str] = ()) -> DataFrame:
    """rows as cases; those without a positive or a negative are left out, and each subcategory keeps its first limit cases in order."""
    sub = F.lit(subcategory) if isinstance(subcategory, str) else subcategory
    about = F.map_from_arrays(F.array(*[F.lit(k) for k in metadata]), F.array(*[v.cast("string") for v in metadata.values()]))
    made = rows.select(F.concat_ws("::", F.lit(dataset), sub, source_id).alias("case_id"), F.lit(dataset).alias("dataset"), sub.alias("subcategory"), F.lit(mode).alias("mode"), anchor.alias("anchor"), positive.alias("positive"), F.filter(negatives, lambda t: t != "").alias("negatives"), about.alias("metadata"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *kept)
    made = made.where("anchor <> '' AND positive <> '' AND size(negatives) > 0")
    if limit is not None and limit > 0:
        made = made.withColumn("_n", F.row_number().over(Window.partitionBy("subcategory").orderBy(*[f"_o{k}" for k in range(len(order))]))).where(F.col("_n") <= limit)
    return made.select(*CASE.fieldNames(), *kept)


def separation_cases(rows: DataFrame, dataset: str, subcategory: Column | str, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Records (caption, negative_caption, filename) as separation cases."""
    positive = X.coerce_text(F.col("caption"))
    return _cases(rows, dataset, subcategory, "separation", positive, positive, F.array(X.coerce_text(F.col("negative_caption"))), F.col(key).cast("string"), {"source_id": F.col(key), "filename": F.col("filename")}, order, limit)


def ranking_cases(rows: DataFrame, dataset: str, subcategory: Column | str, key: str, place: str, limit: int | None = None) -> DataFrame:
    """Records (caption, caption2, negative_caption, filename) as ranking cases in the order of place; it stands for an empty key."""
    name = F.coalesce(F.nullif(X.coerce_text(F.col(key)), F.lit("")), F.col(place).cast("string"))
    return _cases(rows.withColumn("_id", name), dataset, subcategory, "ranking", X.coerce_text(F.col("caption")), X.coerce_text(F.col("caption2")), F.array(X.coerce_text(F.col("negative_caption"))), F.col("_id"), {"source_id": F.col("_id"), "filename": F.col("filename")}, [place], limit)


def choice_parts(rows: DataFrame) -> tuple[Column, Column]:
    """Positive and negatives of multiple-choice rows: by caption_k and correct_answer, else by the columns' names."""
    def place(c: str) -> int:
        end = c.rpartition("_")[2]
        return int(end) if end.isdigit() else 999

    captions = sorted((c for c in rows.columns if c.startswith("caption_")), key=place)
    given = [X.coerce_text(F.col(c)) for c in POSITIVE_FIELDS if c in rows.columns]
    others = [c for c in NEGATIVE_FIELDS if c in rows.columns] + [c for c in rows.columns if c.lower().startswith(NEGATIVE_PREFIXES)]
    plain = F.coalesce(*[F.nullif(c, F.lit("")) for c in given], F.lit(""))
    negatives = X.ordered_unique(F.array(*[X.coerce_text(F.col(c)) for c in others])) if others else F.array().cast("array<string>")
    if not captions or "correct_answer" not in rows.columns:
        return plain, negatives
    answer = F.col("correct_answer").try_cast("int")
    chosen = F.coalesce(*[F.when(answer == place(c), X.coerce_text(F.col(c))) for c in captions], F.lit(""))
    rest = F.filter(F.array(*[F.when(answer != place(c), X.coerce_text(F.col(c))) for c in captions]), lambda t: t.isNotNull() & (t != ""))
    good = (chosen != "") & (F.size(rest) > 0)
    return F.when(good, chosen).otherwise(plain), F.when(good, rest).otherwise(negatives)


def choice_cases(rows: DataFrame, dataset: str, subcategory: Column | str, stem: str, order: list[str], limit: int | None = None, kept: Iterable[str] = ()) -> DataFrame:
    """Rows of a CSV of choices as separation cases, with columns kept beside them. Rows are named by id, image_id or their place, from 0."""
    positive, negatives = choice_parts(rows)
    ids = [F.nullif(X.coerce_text(F.col(c)), F.lit("")) for c in ("id", "image_id") if c in rows.columns]
    name = F.coalesce(*ids, F.col(order[0]).cast("string"))
    return _cases(rows, dataset, subcategory, "separation", positive, positive, negatives, F.concat_ws("::", F.lit(stem), name), {"source_id": name}, order, limit, kept)


def _attempt(spark: SparkSession, dataset: str, parts: dict[str, Callable[[], Loaded]]) -> Loaded:
    """The unions of cases and errors of parts by subcategory; a part that cannot be read gives an error row."""
    cases, errors, failed = spark.createDataFrame([], CASE), spark.createDataFrame([], LOAD_ERROR), []
    for subcategory, read in parts.items():
        try:
            found, bad = read()
            cases, errors = cases.unionByName(found), errors.unionByName(bad)
        except Exception as e:  # noqa: BLE001  errors are data here
            failed.append((dataset, subcategory, type(e).__name__, str(e).split("\n")[0]))
    return cases, errors.unionByName(spark.createDataFrame(failed, LOAD_ERROR))


def _load_errors(rows: DataFrame, dataset: str, subcategory: str, message: Column) -> DataFrame:
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(subcategory).alias("subcategory"), F.lit("ValueError").alias("error_type"), message.alias("error_message"))


def _there(spark: SparkSession, path: str) -> str:
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no file: {path}")
    return path


CAPTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "caption", "caption2", "negative_caption", "filename")])


def load_separation(spark: SparkSession, paths: dict[str, str], dataset: str, limit: int | None = None) -> Loaded:
    """JSON documents of caption records by subcategory, a list or an object by id; a document that is none is an error row. limit keeps a document's first cases."""
    def read(subcategory: str, path: str) -> Loaded:
        rows = files.read_documents(spark, [_there(spark, path)], CAPTIONS)
        bad = _load_errors(rows.where("error IS NOT NULL"), dataset, subcategory, F.concat("file", F.lit(": "), "error"))
        return separation_cases(rows.where("error IS NULL"), dataset, subcategory, "key", ["at"], limit), bad

    return _attempt(spark, dataset, {s: (lambda s=s, p=p: read(s, p)) for s, p in paths.items()})


def load_ranking(spark: SparkSession, paths: dict[str, str], dataset: str, limit: int | None = None) -> Loaded:
    """JSON-line files of caption records by configuration. A bad line is an error row and keeps its place among the lines that are not blank."""
    def read(config: str, path: str) -> Loaded:
        lines = files.with_places(files.read_lines(spark, [_there(spark, path)]))
        good, bad = files.parsed_objects(lines, CAPTIONS, ["place"])
        return ranking_cases(good, dataset, config, "id", "place", limit), _load_errors(bad, dataset, config, F.col("error_message"))

    return _attempt(spark, dataset, {c: (lambda c=c, p=p: read(c, p)) for c, p in paths.items()})


def load_choices(spark: SparkSession, names: dict[str, list[str]], roots: Iterable[str], dataset: str, limit: int | None = None, all_files: frozenset[str] = frozenset()) -> Loaded:
    """CSV files of choices by subcategory: the first file found below roots (also in images, videos and medical), or all of them. limit keeps the first rows, by file as found and row."""
    folders = [f"{r.rstrip('/')}/{sub}".rstrip("/") for r in map(str, roots) for sub in ("", "images", "videos", "medical")]

    def read(subcategory: str) -> Loaded:
        found = [p for f in folders for n in names[subcategory] if files.exists(spark, p := f"{f}/{n}")]
        if not found:
            raise FileNotFoundError(f"no file of {', '.join(names[subcategory])}")
        parts = []
        for k, path in enumerate(found if subcategory in all_files else found[:1]):
            rows = files.read_csv(spark, [path]).withColumn("_row", F.monotonically_increasing_id())  # one small file, in file order
            cases = choice_cases(rows, dataset, subcategory, PurePath(path).stem, ["_row"], limit, kept=["_row"])
            parts.append(cases.withColumn("_file", F.lit(k)))
        out = reduce(DataFrame.unionByName, parts)
        out = out.orderBy("_file", "_row").limit(limit) if limit else out
        return out.drop("_file", "_row"), spark.createDataFrame([], LOAD_ERROR)

    return _attempt(spark, dataset, {s: (lambda s=s: read(s)) for s in names})


#: Loaders by the name of their dataset: each takes a session and gives cases and errors.
LOADERS: dict[str, Callable[..., Loaded]] = {"separation": load_separation, "ranking": load_ranking, "choices": load_choices}


def register(name: str, loader: Callable[..., Loaded]) -> None:
    LOADERS[name] = loader


def load_cases(spark: SparkSession, wanted: dict[str, tuple[str, dict]]) -> Loaded:
    """Cases of several datasets, sorted by dataset, subcategory and id, and their errors. wanted: by dataset, the loader's name and its arguments; an unknown loader is an error row."""
    cases, errors = spark.createDataFrame([], CASE), spark.createDataFrame([], LOAD_ERROR)
    for dataset, (loader, arguments) in wanted.items():
        if loader not in LOADERS:
            got = cases.limit(0), spark.createDataFrame([(dataset, "", "KeyError", f"unknown loader: {loader}")], LOAD_ERROR)
        else:
            got = LOADERS[loader](spark, dataset=dataset, **arguments)
        cases, errors = cases.unionByName(got[0]), errors.unionByName(got[1])
    return cases.orderBy("dataset", "subcategory", "case_id"), errors


def load_scores(spark: SparkSession, paths: list[str]) -> Loaded:
    """Score files as rows with file and line, and errors (file, line, error_type, error_message); a missing file is an error at line 0."""
    there = [p for p in paths if files.exists(spark, p)]
    missing = spark.createDataFrame([(p, 0, "FileNotFoundError", f"Missing score file: {p}") for p in paths if p not in there], "file string, line int, error_type string, error_message string")
    if not there:
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.LongType()), *SCORES.fields])), missing
    good, bad = files.read_objects(spark, there, SCORES)
    return good, bad.unionByName(missing)


def load_traces(spark: SparkSession, paths: list[str]) -> Loaded:
    """JSON-line files of traces, and errors (file, row_index, trace_id, source, subcategory, error_type, error_message).

    Each file counts its own rows, from 1, without blank lines, and gives its name to rows without a source. A row without an id is named by its
    row, and where there are several files by its file's name too, so no two rows share a made name.
    """
    return traces(numbered_by_file(files.read_lines(spark, paths)), len(paths) > 1)


def numbered_by_file(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value) with row_index, their place in their file from 1."""
    return files.with_places(lines, "_place", by_file=True).withColumn("row_index", F.col("_place") + 1).drop("_place", "line")


def trace_table(rows: DataFrame, by_file: bool = False) -> DataFrame:
    """Rows (file, row_index, value) of JSON texts as traces with error, good and bad in one pass; a bad row has names only if it was an object. by_file: made names hold the file's name."""
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    made = F.format_string("visualprm_%06d", F.col("row_index"))
    made = F.concat(X.clean_label(name), F.lit("_"), made) if by_file else made
    found = N.trace_rows(N.records(rows), name, "row_index", made)
    known = F.col("error").isNull() | (F.col("error") == "Missing reasoning text")  # the record was an object, so its names count
    return found.withColumns({c: F.when(known, F.col(c)) for c in ("trace_id", "source", "subcategory")})


def traces(rows: DataFrame, by_file: bool = False) -> Loaded:
    """trace_table as traces and errors."""
    found = trace_table(rows, by_file)
    errors = found.where("error IS NOT NULL").select("file", "row_index", "trace_id", "source", "subcategory", F.lit("ValueError").alias("error_type"), F.col("error").alias("error_message"))
    return found.where("error IS NULL").drop("error"), errors


def load_archived_traces(spark: SparkSession, path: str, limit: int | None = None) -> Loaded:
    """Traces of the JSON-line members of ZIP archives, and errors, of archives and members too. A trace's source is its member's file name, its subcategory the name's label, and its id begins with it; limit takes the first rows, and opens no member behind them."""
    members = archives.directory(spark, path)
    index = archives.line_index(members.where(F.col("member").endswith(".jsonl") | F.col("error").isNotNull()))
    lines = archives.lines(index, limit)
    lines = lines.select(F.concat("archive", F.lit("::"), "member").alias("file"), (F.col("row_index") + 1).alias("row_index"), "line", "value", F.regexp_extract("member", r"([^/]+)$", 1).alias("source"))
    records = N.records(lines)
    records = records.withColumn("error", F.coalesce("error", F.when(N.bad_image(N.R.field(F.col("v"), "image")), "image is not a text")))
    found = N.trace_rows(records, F.col("source"), "row_index").drop("subcategory", "source").join(lines.select("file", "row_index", "source"), ["file", "row_index"])
    found = found.withColumn("subcategory", X.clean_label(F.col("source"))).withColumn("trace_id", F.concat("subcategory", F.lit("_"), X.clean_label(F.col("trace_id"))))
    known = F.col("error") == "Missing reasoning text"
    errors = found.where("error IS NOT NULL").select("file", "row_index", F.when(known, F.col("trace_id")).alias("trace_id"), "source", "subcategory", F.lit("ValueError").alias("error_type"), F.col("error").alias("error_message"))
    broken = index.where("error IS NOT NULL").select(F.concat_ws("::", "archive", "member").alias("file"), *[F.lit(None).cast(t).alias(c) for c, t in (("row_index", "long"), ("trace_id", "string"), ("source", "string"), ("subcategory", "string"))], F.lit("BadZipFile").alias("error_type"), F.col("error").alias("error_message"))
    return found.where("error IS NULL").drop("error"), errors.unionByName(broken)


def evaluation_rows(spark: SparkSession, path: str, mode: str = "pair", lines: int | None = None) -> DataFrame:
    """Evaluation examples of a JSON-line file with error: `pair` records, or the steps of `context` records (question, response.steps, response.process_correctness). A bad record is one row with its error. lines: only so many of the first lines that are not blank are read."""
    if mode not in ("pair", "context"):
        raise ValueError(f"unknown input mode: {mode}")
    found = files.read_lines(spark, [_there(spark, path)]) if lines is None else ranges.first_lines(spark, _there(spark, path), lines)
    return N.pair_examples(N.records(found)) if mode == "pair" else N.context_steps(N.records(found))


def load_evaluation(spark: SparkSession, path: str, mode: str = "pair", max_samples: int | None = None) -> DataFrame:
    """evaluation_rows, but a bad record raises; max_samples keeps the first examples, and reads the file only as far as they go."""
    if max_samples is None:
        return N.strict(evaluation_rows(spark, path, mode))
    if max_samples <= 0:
        raise ValueError("max_samples must be positive")
    lines = max_samples
    while True:  # a context record may have no step that counts
        rows = N.strict(evaluation_rows(spark, path, mode, lines))
        if mode == "pair" or rows.count() >= max_samples or ranges.first_lines(spark, path, lines).count() < lines:
            return rows.orderBy("row_index", "step_index").limit(max_samples)
        lines *= 4


def load_reward_examples(spark: SparkSession, path: str) -> DataFrame:
    """The fields that train a judge; a bad record raises."""
    return N.strict(N.reward_examples(N.records(files.read_lines(spark, [path])))).drop("file", "line")


def _document(spark: SparkSession, path: str) -> dict | None:
    """A small JSON document at a path of any file system; None if there is none."""
    if not files.exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_calibration_weights(spark: SparkSession, path: str) -> dict | None:
    """weights and bias of a calibration document; None if it is missing or has no weights."""
    found = _document(spark, path)
    return found if found is not None and isinstance(found.get("weights"), dict) else None


def load_selected_tau(spark: SparkSession, path: str) -> float | None:
    """The threshold that a calibration document chose."""
    tau = (_document(spark, path) or {}).get("tau")
    return None if tau is None else float(tau)
