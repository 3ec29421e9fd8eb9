"""From raw records to the library's rows: pairs, evaluation examples, traces, canonical rows, training examples.

Errors are data: an operator gives its rows with `error` (null if the row is good), and `split_errors`
parts them; `strict` raises instead. Everything stays on the row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions import embedded
from tracewise.functions import records as R
from tracewise.functions import text as X
from tracewise.operators import pairs as P

#: Names that a field may have, in the order they are tried.
ID_FIELDS = ("id", "trace_id", "uid", "sample_id")
QUESTION_FIELDS = ("question", "problem", "prompt", "query")
REASONING_FIELDS = ("reasoning", "solution", "response", "analysis", "answer", "rationale", "steps")
SUBCATEGORY_FIELDS = ("subcategory", "category", "task", "domain")
SOURCE_FIELDS = ("source", "filename", "file", "data_source")
PROMPT_FIELDS = ("prompt", "question", "query", "instruction", "problem", "input", "user")
RESPONSE_FIELDS = ("response", "answer", "output", "solution", "chosen", "assistant", "label")
SOURCE_NAMES = ("data_source", "source_dataset", "dataset")
LABEL_FIELDS = ("compatibility_label", "process_correctness", "label")
FLIPS = {"negative_value_flip": "value_flip", "negative_entity_flip": "entity_flip", "negative_relation_flip": "relation_flip"}
CANONICAL_FIELDS = ("question", "images", "steps", "step_labels", "answer", "metadata")
PROVENANCE = ("pair_id", "anchor", "generated", "compatibility_label", "generation_backend", "generation_model", "generation_type", "source_sample_id", "step_index", "prompt_version", "generation_seed")
PROFILES = {
    "train": ("pair_id", "source_sample_id", "step_index", "compatibility_label", "anchor", "generated"),
    "audit": ("generation_type", "generation_seed", "in_context_example_ids", "prompt_tokens", "anchor_tokens", "max_output_tokens"),
    "debug": ("generation_backend", "generation_model", "prompt_version", "prompt", "raw_output"),
}
#: What errors of generation tell beside their type and message.
ERROR_DETAILS = ("observed_tokens", "prompt_tokens", "max_output_tokens", "min_output_tokens", "limit")


def split_errors(rows: DataFrame, kept: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Good rows without `error`, and bad ones as (kept, error_type, error_message)."""
    errors = rows.where("error IS NOT NULL").select(*kept, F.lit("ValueError").alias("error_type"), F.col("error").alias("error_message"))
    return rows.where("error IS NULL").drop("error"), errors


def strict(rows: DataFrame) -> DataFrame:
    """rows without `error`; a bad one raises when it is read."""
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(True))).drop("error")


def _first(*checks: tuple[Column, str]) -> Column:
    """The message of the first check that is true."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in checks])


def records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Text lines with `v`, the line's JSON object as a variant, and `error` where it is none. The variant is the one element of an array, so filters on what is taken from it do not parse the line again."""
    v = F.explode(F.array(F.try_parse_json(F.col(value))))
    return lines.withColumn("v", v).withColumn("error", _first((F.col("v").isNull(), "invalid JSON"), (R.kind(F.col("v")) != "OBJECT", "not a JSON object")))


def _checked(rows: DataFrame, once: bool = True, **columns: Column) -> DataFrame:
    """rows with columns, and error set to the earlier error if there is one.

    With once, columns are the one element of an array, so a filter on them, such as split_errors has, stays above the step and does not work them out once more.
    """
    columns["error"] = F.coalesce(F.col("error"), columns["error"])
    kept = [c for c in rows.columns if c not in ("v", "value", *columns) and not c.startswith("_raw_")]
    if not once:
        return rows.select(*kept, *[c.alias(n) for n, c in columns.items()])
    made = rows.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made"))
    return made.select(*kept, *[F.col("_made")[n].alias(n) for n in columns])


def named_source(v: Column, nested: Column, record_first: bool) -> Column:
    """The first of SOURCE_NAMES that is a text or integer, in the record and in its metadata: name by name, or with record_first all of the record before the metadata."""
    here, there = [R.field(v, n) for n in SOURCE_NAMES], [R.field(nested, n) for n in SOURCE_NAMES]
    tries = [*here, *there] if record_first else [F.coalesce(a, b) for a, b in zip(here, there, strict=True)]
    return F.coalesce(*[F.nullif(X.strip(R.identifier(c)), F.lit("")) for c in tries], F.lit("UNKNOWN"))


def pair_examples(lines: DataFrame, line: str = "line") -> DataFrame:
    """Records (v, error) of pairs as evaluation examples, labels 1 and -1, with error."""
    v = F.col("v")
    nested = R.field(v, "metadata")
    anchor, generated, label, step = (R.field(v, n) for n in ("anchor", "generated", "compatibility_label", "step_index"))
    either = {n: F.coalesce(R.field(v, n), R.field(nested, n)) for n in ("pair_id", "source_sample_id", "policy_model")}
    return _checked(
        lines,
        row_index=F.col(line),
        anchor=X.strip(R.string(anchor)),
        generated=X.strip(R.string(generated)),
        compatibility_label=F.when(R.integer(label) == 1, 1).when(R.integer(label) == 0, -1),
        data_source=named_source(v, nested, False),
        policy_model=F.coalesce(F.nullif(X.strip(R.identifier(either["policy_model"])), F.lit("")), F.lit("UNKNOWN")),
        pair_id=R.identifier(either["pair_id"]),
        source_sample_id=R.identifier(either["source_sample_id"]),
        step_index=R.integer(step),
        input_mode=F.lit("pair"),
        metadata=R.compact(v, nested),
        error=_first(
            (X.coerce_text(R.string(anchor)) == "", "no non-empty string 'anchor'"),
            (X.coerce_text(R.string(generated)) == "", "no non-empty string 'generated'"),
            (~F.coalesce(R.integer(label).isin(0, 1), F.lit(False)), "invalid 'compatibility_label'"),
            (~R.none(step) & R.integer(step).isNull(), "invalid 'step_index'"),
            (R.bad_identifier(either["pair_id"]), "invalid 'pair_id'"),
            (R.bad_identifier(either["source_sample_id"]), "invalid 'source_sample_id'"),
        ),
    )


def _step_error(step: Column, i: Column) -> Column:
    """What is wrong with a step (kind, text, label) at place i; null if nothing is."""
    at = i.cast("string")
    return (
        F.when(step["kind"].isNull() | (step["kind"] != "STRING"), F.concat(F.lit("an invalid step at index "), at))
        .when(~F.coalesce(step["label"].isin(-1, 0, 1), F.lit(False)), F.concat(F.lit("invalid process_correctness at step index "), at))
        .when((step["text"] == "") & (step["label"] != 0), F.concat(F.lit("an empty non-neutral response step at index "), at))
    )


def context_steps(lines: DataFrame, line: str = "line") -> DataFrame:
    """Records (v, error) with question, response.steps and response.process_correctness as a row per non-empty step, labels -1, 0 and 1, and one row with error for a bad record.

    A step's anchor is the question with all earlier non-empty steps. Empty neutral steps are left out, but count as places.
    """
    v = F.col("v")
    nested, question = R.field(v, "metadata"), R.field(v, "question")
    raw, labels = R.field(v, "response", "steps"), R.field(v, "response", "process_correctness")
    parts = lambda c: F.try_variant_get(c, "$", "array<variant>")
    steps = F.transform(F.arrays_zip(parts(raw).alias("s"), parts(labels).alias("l")), lambda x: F.struct(R.kind(x["s"]).alias("kind"), X.strip(R.string(x["s"])).alias("text"), R.integer(x["l"]).alias("label")))
    n, n_labels = F.size(parts(raw)), F.size(parts(labels))
    asked = X.strip(R.string(question))
    given = F.coalesce(R.field(v, "source_sample_id"), R.field(nested, "source_sample_id"))
    source = named_source(v, nested, False)
    policy = F.coalesce(F.nullif(X.strip(R.identifier(F.coalesce(R.field(v, "policy_model"), R.field(nested, "policy_model")))), F.lit("")), F.lit("UNKNOWN"))
    image = R.json_text(F.coalesce(R.field(v, "image"), R.field(v, "images")))
    own_id = R.stable_id("vpb_", R.json_object({"question": R.json_string(asked), "image": image, "policy_model": R.json_string(policy), "data_source": R.json_string(source)}))
    unnamed = R.none(given) | F.coalesce(R.integer(given) == 0, F.lit(False))
    rows = _checked(
        lines,
        row_index=F.col(line),
        question=asked,
        data_source=source,
        policy_model=policy,
        source_sample_id=F.when(unnamed, own_id).otherwise(R.identifier(given)),
        id_json=F.when(unnamed, R.json_string(own_id)).otherwise(R.json_text(given)),
        metadata=R.compact(v, nested),
        steps=steps,
        error=_first(
            (X.coerce_text(R.string(question)) == "", "no non-empty string 'question'"),
            (F.coalesce(R.kind(R.field(v, "response")), F.lit("")) != "OBJECT", "no response object"),
            (F.coalesce(R.kind(raw), F.lit("")) != "ARRAY", "response.steps must be a list"),
            (F.coalesce(R.kind(labels), F.lit("")) != "ARRAY", "response.process_correctness must be a list"),
            (n != n_labels, "step/label length mismatch"),
            (n == 0, "no response steps"),
            (R.bad_identifier(given), "invalid 'source_sample_id'"),
        ),
    )
    wrong = F.try_element_at(F.filter(F.transform("steps", _step_error), lambda e: e.isNotNull()), F.lit(1))
    rows = rows.withColumn("error", F.coalesce("error", wrong))
    texts = F.transform("steps", lambda s: s["text"])
    rows = rows.select("*", texts.alias("_texts"), F.posexplode_outer(F.when(F.col("error").isNull(), F.col("steps"))).alias("step_index", "_s")).where("error IS NOT NULL OR _s.text <> ''")
    earlier = F.filter(F.slice("_texts", F.lit(1), F.col("step_index")), lambda s: s != "")
    pair_id = R.stable_id("vpb_step_", R.json_object({"source_sample_id": F.col("id_json"), "step_index": F.col("step_index").cast("string"), "step": R.json_string(F.col("_s.text"))}))
    good = lambda c: F.when(F.col("error").isNull(), c)
    kept = [c for c in rows.columns if c in lines.columns and c not in ("v", "error", "value")]
    return rows.select(
        *[c for c in kept if c != "row_index"], "row_index", good(X.context_anchor(F.col("question"), earlier)).alias("anchor"), F.col("_s.text").alias("generated"), F.col("_s.label").cast("int").alias("compatibility_label"), "data_source", "policy_model",
        good(pair_id).alias("pair_id"), good(F.col("source_sample_id")).alias("source_sample_id"), F.col("step_index").cast("long").alias("step_index"), F.lit("context_step").alias("input_mode"), "metadata", "error",
    )


def label_of(value: Column, name: str) -> tuple[Column, Column]:
    """A label field as (1, 0 or null for neutral, whether it is unsupported). Truth values are unsupported; only process_correctness knows -1, and 0 as neutral."""
    words = F.create_map(*[F.lit(x) for kv in P.PAIR_LABELS.items() for x in kv])
    text = F.lower(X.strip(R.string(value)))
    number = F.coalesce(R.integer(value), F.when(text.isin("0", "1", "-1"), text.cast("long")))
    if name == "process_correctness":
        made, right = F.when(number == 1, 1).when(number == -1, 0), number.isin(-1, 0, 1)
    else:
        made, right = number.cast("int"), number.isin(0, 1)
    worded = F.try_element_at(words, text)
    return F.coalesce(worded, F.when(right, made)), ~F.coalesce(worded.isNotNull() | right, F.lit(False))


def normalized_pairs(lines: DataFrame, label_field: str | None = None, neutral: str = "skip") -> DataFrame:
    """Records (v, error) of pairs, flat or nested in `pair`, as rows with stable ids, and error.

    Label fields that disagree are an error. Neutral rows are left out, or with neutral="error" are errors.
    """
    v = F.col("v")
    nested, inner = R.field(v, "metadata"), R.field(v, "pair")
    fields = [label_field] if label_field else list(LABEL_FIELDS)
    # a step for each that later ones name several times: the variants, the texts, the made ids
    wanted = dict.fromkeys(["anchor", "generated", "step_index", "pair_id", "source_sample_id", *fields])
    lines = lines.withColumns({f"_raw_{n}": F.coalesce(R.field(v, n), R.field(inner, n)) for n in wanted})  # a null in the record counts before the pair
    here = lambda n: F.col(f"_raw_{n}")
    step = here("step_index")
    lines = lines.withColumns({f"_raw_{n}": F.coalesce(R.known(here(n)), R.field(nested, n)) for n in ("pair_id", "source_sample_id")})
    ids = {n: here(n) for n in ("pair_id", "source_sample_id")}
    raw = (R.kind(R.field(v, "response", "steps")) == "ARRAY") & (R.kind(R.field(v, "response", "process_correctness")) == "ARRAY")
    labels, wrong, present = [], F.lit(False), F.lit(False)
    for f in fields:
        value, unsupported = label_of(here(f), f)
        there = ~R.none(here(f))
        labels.append(F.when(there, value))
        wrong |= there & unsupported
        present |= there
    values = F.array_distinct(F.array_compact(F.array(*labels)))
    lines = lines.withColumns({"_raw_source": named_source(v, nested, True), "_raw_a": X.strip(R.string(here("anchor"))), "_raw_g": X.strip(R.string(here("generated"))), "_raw_values": values})
    source, a, g, values = (F.col(f"_raw_{n}") for n in ("source", "a", "g", "values"))
    made_source = R.stable_id("vpb_", R.json_object({"data_source": R.json_string(source), "question": R.json_text(R.field(v, "question")), "image": R.json_text(F.coalesce(R.field(v, "image"), R.field(v, "images"))), "policy_model": R.json_text(R.field(v, "policy_model")), "anchor": R.json_string(a)}))
    lines = lines.withColumn("_raw_made", made_source)
    made_source = F.col("_raw_made")
    sample = F.coalesce(R.identifier(ids["source_sample_id"]), made_source)
    sample_json = F.when(R.none(ids["source_sample_id"]), R.json_string(made_source)).otherwise(R.json_text(ids["source_sample_id"]))
    made_pair = R.stable_id("pair_", R.json_object({"source_sample_id": sample_json, "step_index": R.json_text(step), "anchor": R.json_string(a), "generated": R.json_string(g)}))
    no_anchor, no_generated = (F.coalesce(c, F.lit("")) == "" for c in (a, g))
    rows = _checked(
        lines,
        pair_id=F.coalesce(R.identifier(ids["pair_id"]), made_pair),
        source_sample_id=sample,
        step_index=R.integer(step),
        data_source=source,
        anchor=a,
        generated=g,
        compatibility_label=F.try_element_at(values, F.lit(1)),
        metadata=R.compact(v, nested),
        error=_first(
            ((no_anchor | no_generated) & raw, "a raw record without a pair"),
            (no_anchor, "no non-empty string 'anchor'"),
            (no_generated, "no non-empty string 'generated'"),
            (~present, "no label field"),
            (wrong, "unsupported label"),
            (F.size(values) > 1, "conflicting labels"),
            ((F.size(values) == 0) & F.lit(neutral == "error"), "neutral label"),
            (R.bad_identifier(ids["source_sample_id"]), "invalid 'source_sample_id'"),
            (~R.none(step) & R.integer(step).isNull(), "invalid 'step_index'"),
            (R.bad_identifier(ids["pair_id"]), "invalid 'pair_id'"),
        ),
    )
    return rows.where("error IS NOT NULL OR compatibility_label IS NOT NULL")


def pair_summary(rows: DataFrame) -> DataFrame:
    """One row over normalized pairs: pairs, positives, negatives and the sorted data sources."""
    return rows.agg(F.count("*").alias("pairs_written"), F.count_if(F.col("compatibility_label") == 1).alias("positive_pairs"), F.count_if(F.col("compatibility_label") == 0).alias("negative_pairs"), F.sort_array(F.collect_set("data_source")).alias("data_sources"))


def trace_rows(lines: DataFrame, default_source: str | Column, index: str = "line", made_id: Column | None = None) -> DataFrame:
    """Records (v, error) as traces: trace_id, question, reasoning, subcategory, source, row_index; without reasoning an error. made_id names those without an id, else their index does."""
    texts = embedded.first_texts(F.col("v"), {"id": ID_FIELDS, "question": QUESTION_FIELDS, "reasoning": REASONING_FIELDS, "subcategory": SUBCATEGORY_FIELDS, "source": SOURCE_FIELDS})
    rows = lines.withColumn("_texts", F.explode(F.array(texts)))  # one element, so a filter does not call for the texts again
    own = lambda c: F.nullif(F.col(f"_texts.{c}"), F.lit(""))
    source = F.coalesce(own("source"), F.lit(default_source) if isinstance(default_source, str) else default_source)
    made_id = F.format_string("visualprm_%06d", F.col(index)) if made_id is None else made_id
    return _checked(
        rows,
        once=False,  # the texts are a step of their own, and a filter needs little of the rest
        trace_id=F.coalesce(own("id"), made_id),
        question=F.col("_texts.question"),
        reasoning=F.col("_texts.reasoning"),
        subcategory=X.clean_label(F.coalesce(own("subcategory"), source)),
        source=source,
        row_index=F.col(index),
        error=_first((F.col("_texts.reasoning") == "", "Missing reasoning text")),
    ).drop("_texts")


def image_names(value: Column) -> Column:
    """An image field, a text, an object with a path, or a list of them, as distinct names in their order."""
    values = F.when(R.kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    names = F.transform(values, lambda x: F.coalesce(X.strip(R.string(x)), *[F.nullif(X.strip(R.string(R.field(x, n))), F.lit("")) for n in ("path", "image_path", "filename")]))
    return F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "")))


def bad_image(value: Column) -> Column:
    """Whether an image field is neither null nor a text."""
    return F.coalesce(~R.none(value) & (R.kind(value) != "STRING"), F.lit(False))


def sample_id(v: Column, question: Column, images: Column, steps: Column) -> Column:
    """A record's own id, else one of its content."""
    own = [R.field(v, n) for n in ("id", "uid", "sample_id")]
    texts = [F.when(~R.none(c) & ~R.identifier(c).isin("", "-1"), F.try_variant_get(c, "$", "string")) for c in own]
    payload = R.json_object({"question": R.json_string(question), "images": R.json_strings(images, True), "steps": R.json_strings(steps, True)}, True)
    return F.coalesce(*texts, R.stable_id("visualprm_", payload))


def canonical_rows(lines: DataFrame, dataset: str, config: str | None = None, split: str = "train", index: str = "line") -> DataFrame:
    """Records (v, error) of labelled conversations as canonical traces: question, images, steps, step_labels, answer and metadata, with error."""
    turn = "array<struct<from:string,role:string,value:string,content:string,text:string>>"
    v = F.col("v")
    turns = F.transform(F.try_variant_get(v, "$.conversations", turn), lambda t: F.struct(F.coalesce(F.nullif(t["from"], F.lit("")), t["role"]).alias("from"), X.first_text(t["value"], t["content"], t["text"]).alias("value")))
    rows = lines.withColumns({"conversations": turns, "_q": R.string(R.field(v, "question")), "_error": F.col("error")}).drop("error")
    rows = P.parsed_conversations(rows, question="_q")
    images = image_names(F.coalesce(R.field(v, "images"), R.field(v, "image")))
    meta = {"source_sample_id": sample_id(v, F.col("question"), images, F.col("steps")), "dataset": F.lit(dataset), "dataset_config": F.lit(config), "split": F.lit(split), "source_index": F.col(index).cast("long")}
    rows = rows.withColumns({"images": images, "answer": F.coalesce(X.strip(R.string(R.field(v, "answer"))), F.lit("")), "metadata": F.struct(*[c.alias(n) for n, c in meta.items()]), "error": F.coalesce("_error", "error")})
    return rows.select(*[c for c in lines.columns if c not in ("v", "error", "value", *CANONICAL_FIELDS)], *CANONICAL_FIELDS, "error")


def step_label_counts(canonical: DataFrame) -> DataFrame:
    """Steps of each label."""
    return canonical.select(F.explode("step_labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def canonical_violation(line: str = "line") -> Column:
    """What is wrong with a canonical row that was read back as a variant `v`; null if nothing."""
    v = F.col("v")
    missing = F.array_join(F.array_except(F.array(*[F.lit(c) for c in sorted(CANONICAL_FIELDS)]), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))), ", ")
    steps, labels = R.field(v, "steps"), R.field(v, "step_labels")
    listed = lambda x: F.try_variant_get(x, "$", "array<variant>")
    bad_step = F.exists(listed(steps), lambda s: X.coerce_text(R.string(s)) == "")
    bad_label = F.exists(listed(labels), lambda x: ~F.coalesce(R.integer(x).isin(-1, 0, 1), F.lit(False)))
    sample = R.field(v, "metadata", "source_sample_id")
    problem = F.coalesce(
        F.when(missing != "", F.concat(F.lit("is missing fields: "), missing)),
        _first(
            ((R.kind(R.field(v, "question")) != "STRING") | (R.kind(steps) != "ARRAY"), "has invalid question or steps"),
            ((R.kind(labels) != "ARRAY") | (F.size(listed(steps)) != F.size(listed(labels))), "has misaligned steps and step_labels"),
            (bad_step, "contains an empty or non-string step"),
            (bad_label, "contains a label outside -1, 0, 1"),
            (R.none(sample) | (X.strip(R.json_text(sample)) == '""'), "is missing metadata.source_sample_id"),
        ),
    )
    return F.concat(F.lit("row "), F.col(line).cast("string"), F.lit(" "), problem)


def pair_violation(fields: tuple[str, ...] = PROVENANCE, line: str = "line") -> Column:
    """What is wrong with a pair record `v` for scoring: missing fields, texts or label; null if nothing."""
    v = F.col("v")
    missing = F.array_join(F.array_except(F.array(*[F.lit(c) for c in fields]), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))), ", ")
    text = lambda n: X.coerce_text(R.string(R.field(v, n)))
    problem = F.coalesce(F.when(missing != "", F.concat(F.lit("is missing fields: "), missing)), _first((text("anchor") == "", "has an invalid anchor"), (text("generated") == "", "has invalid generated text"), (~F.coalesce(R.integer(R.field(v, "compatibility_label")).isin(0, 1), F.lit(False)), "has a non-binary compatibility_label")))
    return F.concat(F.lit("row "), F.col(line).cast("string"), F.lit(" "), problem)


def reward_examples(lines: DataFrame) -> DataFrame:
    """Records (v, error) as the four fields that train a judge, with error."""
    v = F.col("v")
    anchor, generated, label, sample = (R.field(v, n) for n in ("anchor", "generated", "compatibility_label", "source_sample_id"))
    return _checked(
        lines,
        anchor=X.strip(R.string(anchor)),
        generated=X.strip(R.string(generated)),
        compatibility_label=R.integer(label).cast("int"),
        source_sample_id=R.identifier(sample),
        error=_first(
            (X.coerce_text(R.string(anchor)) == "", "Invalid anchor"),
            (X.coerce_text(R.string(generated)) == "", "Invalid generated text"),
            (~F.coalesce(R.integer(label).isin(0, 1), F.lit(False)), "Invalid compatibility_label"),
            (X.coerce_text(R.identifier(sample)) == "", "Invalid source_sample_id"),
        ),
    )


def supervised_examples(lines: DataFrame) -> DataFrame:
    """Records (v, error) as prompt, response and images: from chat messages, else from fields by name, with error."""
    v = F.col("v")
    tries = []
    for n in ("messages", "conversations", "conversation"):
        said = F.try_variant_get(R.field(v, n), "$", "array<variant>")
        own = F.transform(said, lambda m: F.lower(F.coalesce(F.nullif(R.identifier(R.field(m, "role")), F.lit("")), R.identifier(R.field(m, "from")), F.lit(""))).isin("assistant", "gpt", "model"))
        turns = F.zip_with(own, embedded.content_texts(F.to_json(R.known(R.field(v, n)))), lambda o, t: F.struct(o.alias("own"), t.alias("t")))
        tries.append(F.filter(turns, lambda t: F.coalesce(t["t"], F.lit("")) != ""))
    rows = lines.withColumns({f"_m{k}": t for k, t in enumerate(tries)})
    found = [F.when(F.exists(f"_m{k}", lambda t: t["own"]), F.struct(X.strip(F.array_join(F.transform(F.filter(f"_m{k}", lambda t: ~t["own"]), lambda t: t["t"]), "\n")).alias("p"), X.strip(F.element_at(F.transform(F.filter(f"_m{k}", lambda t: t["own"]), lambda t: t["t"]), -1)).alias("r"))) for k in range(3)]
    rows = rows.withColumn("_c", F.coalesce(*found))
    named = lambda names: F.coalesce(*[F.nullif(X.strip(R.string(R.field(v, n))), F.lit("")) for n in names])
    images = [F.filter(F.when(R.kind(c) == "ARRAY", F.try_variant_get(c, "$", "array<variant>")).otherwise(F.array(c)), lambda x: ~R.none(x)) for c in (R.field(v, n) for n in ("image", "images", "pixel_values"))]
    texts = F.array_distinct(F.flatten(F.array(*[F.transform(F.coalesce(i, F.array().cast("array<variant>")), lambda x: F.coalesce(R.string(x), F.to_json(x))) for i in images])))
    prompt = F.when(F.col("_c").isNotNull(), F.col("_c.p")).otherwise(named(PROMPT_FIELDS))
    response = F.when(F.col("_c").isNotNull(), F.col("_c.r")).otherwise(named(RESPONSE_FIELDS))
    return _checked(rows, prompt=prompt, response=response, images=texts, error=_first((prompt.isNull() | response.isNull(), "no prompt and response fields"))).drop("_c", "_m0", "_m1", "_m2")


def user_prompt(prompt: Column, images: Column) -> Column:
    """One user message: its images, then its text without a leading image tag."""
    part = lambda kind, image, text: F.struct(F.lit(kind).alias("type"), image.alias("image"), text.alias("text"))
    null = F.lit(None).cast("string")
    content = F.concat(F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda i: part("image", i, null)), F.array(part("text", null, F.regexp_replace(prompt, r"^\s*<image>\s*", ""))))
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def chat_messages(prompt: Column, response: Column, images: Column) -> Column:
    """user_prompt with the assistant's answer."""
    null = F.lit(None).cast("string")
    answer = F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), null.alias("image"), response.alias("text"))).alias("content"))
    return F.concat(user_prompt(prompt, images), F.array(answer))


def nullable_text(c: Column) -> Column:
    """A stripped text; null where it is empty or the word null."""
    t = X.coerce_text(c)
    return F.when((t != "") & (F.lower(t) != "null"), t)


def cases_from_generations(requests: DataFrame, output: str = "output") -> DataFrame:
    """Segment requests with a generator's text as numeric cases: positive, negatives (type, text), mode, with error."""
    made = F.try_parse_json(embedded.first_object(F.col(output)))
    rows = requests.withColumn("_g", made)
    text = lambda n: nullable_text(F.try_variant_get(F.col("_g"), f"$.{n}", "string"))
    negatives = F.filter(F.array(*[F.struct(F.lit(t).alias("type"), text(n).alias("text")) for n, t in FLIPS.items()]), lambda n: n["text"].isNotNull())
    error = _first((F.col("_g").isNull(), "No valid JSON object found in generation"), (text("positive").isNull(), "Generation is missing positive"), (F.size(negatives) == 0, "Generation has no valid negatives"))
    return rows.withColumns({"positive": text("positive"), "negatives": negatives, "mode": F.lit("ranking"), "error": error}).drop("_g", output)


def numeric_pair_rows(cases: DataFrame) -> DataFrame:
    """Numeric cases as a row per pair: the reference with the positive and with each negative, where both have text."""
    base = {"case_id": F.col("case_id"), "trace_id": F.col("trace_id")} | {c: F.coalesce(F.col(c), F.lit(d)) if c in cases.columns else F.lit(d) for c, d in (("dataset", "visualprm"), ("subcategory", "unknown"), ("mode", "ranking"))}
    pair = lambda kind, n, t: F.struct(n.alias("negative_type"), F.lit(kind).alias("pair_type"), t.alias("text_b"))
    one = F.array(pair("positive", F.lit(None).cast("string"), X.coerce_text(F.col("positive"))))
    others = F.transform(F.coalesce("negatives", F.expr("slice(negatives, 1, 0)")), lambda n: pair("negative", X.first_text(n["type"], F.lit("unknown")), X.coerce_text(n["text"])))
    rows = cases.select(*[c.alias(n) for n, c in base.items()], X.coerce_text(F.col("reference")).alias("text_a"), F.explode(F.concat(one, others)).alias("_p"))
    return rows.select(*base, "text_a", "_p.*").where("text_a <> '' AND text_b <> ''")


def _profile(profile: str) -> list[str]:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    return [c for name in ("train", "audit", "debug")[: ("train", "audit", "debug").index(profile) + 1] for c in PROFILES[name]]


def profiled(pairs: DataFrame, profile: str = "train") -> DataFrame:
    """The columns of an output profile: audit has those of train too, debug those of audit."""
    return pairs.select(*[c for c in _profile(profile) if c in pairs.columns])


def profiled_errors(errors: DataFrame, profile: str = "train") -> DataFrame:
    """Errors of requests in an output profile: what was wrong with its details, and in audit and debug the request too, without a generated text."""
    wanted = ["pair_id", "error_type", "error_message", *ERROR_DETAILS] + ([] if profile == "train" else [c for c in _profile(profile) if c != "generated"])
    return errors.select(*[c for c in dict.fromkeys(wanted) if c in errors.columns])
