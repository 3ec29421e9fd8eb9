"""From cases, traces and conversations to pairs, steps and training rows. Everything stays on the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions import text as X

#: Label tokens of steps, and label words of pair records.
STEP_LABELS = {"+": 1, "positive": 1, "correct": 1, "-": -1, "negative": -1, "incorrect": -1, "0": 0, "=": 0, "neutral": 0}
PAIR_LABELS = {"+": 1, "correct": 1, "compatible": 1, "positive": 1, "-": 0, "incorrect": 0, "incompatible": 0, "negative": 0}
QUESTION_STEP = r"(?is)^\s*###\s*Question:\s*(.*?)\s*###\s*Solution\s+Process:\s*(.*)\s*$"


def _pair(kind: str, index: Column, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("pair_type"), index.cast("int").alias("negative_index"), a.alias("text_a"), b.alias("text_b"))


def pair_rows(cases: DataFrame) -> DataFrame:
    """Cases (mode, anchor, positive, negatives, ...) as a row per text pair. Ranking cases compare the anchor with the positive and each negative, separation cases the positive with each negative; other modes give nothing."""
    against = lambda side: F.transform("negatives", lambda n, i: _pair("negative_pair", i, F.col(side), n))
    ranking = F.concat(F.array(_pair("positive_pair", F.lit(None), F.col("anchor"), F.col("positive"))), against("anchor"))
    pairs = F.when(F.col("mode") == "ranking", ranking).when(F.col("mode") == "separation", against("positive"))
    kept = [c for c in cases.columns if c not in ("anchor", "positive", "negatives")]
    return cases.withColumn("_p", F.explode(pairs)).select(*kept, "_p.*")


def choice_case(captions: list[str], answer: Column) -> tuple[Column, Column]:
    """Of caption columns in their order: the one that answer (from 0) names, and the others."""
    all_ = F.array(*[X.coerce_text(F.col(c)) for c in captions])
    others = F.filter(F.transform(all_, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: (x["i"] != answer) & (x["t"] != ""))
    return F.try_element_at(all_, (answer + 1).cast("int")), F.transform(others, lambda x: x["t"])


def segment_requests(traces: DataFrame) -> DataFrame:
    """Traces (trace_id, reasoning, ...) as a row per eligible segment, with case_id and segment_index. Traces without any give none; see traces_without_segments."""
    rows = traces.withColumn("_s", F.explode(X.eligible_segments(F.col("reasoning"))))
    return rows.select(*[c for c in traces.columns if c != "reasoning"], F.format_string("%s_seg_%02d", F.col("trace_id").cast("string"), F.col("_s.index")).alias("case_id"), F.col("_s.index").alias("segment_index"), F.col("_s.segment").alias("reference"))


def traces_without_segments(traces: DataFrame) -> DataFrame:
    return traces.where(F.size(X.eligible_segments(F.col("reasoning"))) == 0)


def mock_cases(requests: DataFrame) -> DataFrame:
    """Segments with their positive and flipped negatives (type, text): a deterministic stand-in for a generator."""
    flips = {"value_flip": X.flip_number, "entity_flip": X.flip_entity, "relation_flip": X.flip_relation}
    made = F.array(*[F.struct(F.lit(k).alias("type"), f(F.col("reference")).alias("text")) for k, f in flips.items()])
    return requests.withColumn("positive", F.concat(F.col("reference"), F.lit(" This is equivalent."))).withColumn("negatives", F.filter(made, lambda n: n["text"].isNotNull())).withColumn("mode", F.lit("ranking"))


def pair_id(source: Column, step_index: Column, kind: Column) -> Column:
    return F.concat(F.lit("pair_"), F.substring(F.sha2(F.concat_ws(":", source, step_index.cast("string"), kind), 256), 1, 20))


def request_seed(seed: int, source: Column, step_index: Column, kind: Column) -> Column:
    """31 bits of a digest of seed and request."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), source, step_index.cast("string"), kind), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def generation_requests(traces: DataFrame, seed: int = 42, context_steps: int = 2, done: DataFrame | None = None) -> DataFrame:
    """Traces (source_sample_id, steps, step_labels) as a request per labelled step; neutral steps are left out, as are requests whose pair_id is in done."""
    steps = F.posexplode(F.arrays_zip("steps", "step_labels"))
    rows = traces.select("source_sample_id", "steps", steps.alias("step_index", "_s")).where(F.col("_s.step_labels") != 0)
    kind = F.when(F.col("_s.step_labels") == 1, "positive_paraphrase").otherwise("hard_negative")
    back = F.least(F.col("step_index"), F.lit(context_steps))
    rows = rows.select(
        pair_id(F.col("source_sample_id"), F.col("step_index"), kind).alias("pair_id"),
        X.strip(F.col("_s.steps")).alias("anchor"),
        F.transform(F.slice("steps", F.col("step_index") - back + 1, back), lambda s: X.strip(s)).alias("context_steps"),
        (F.col("_s.step_labels") == 1).cast("int").alias("compatibility_label"),
        kind.alias("generation_type"),
        "source_sample_id",
        "step_index",
        request_seed(seed, F.col("source_sample_id"), F.col("step_index"), kind).alias("generation_seed"),
    )
    return rows if done is None else rows.join(done.select("pair_id"), "pair_id", "left_anti")


def context_examples(traces: DataFrame) -> DataFrame:
    """Traces (question, steps, step_labels, ...) as a row per non-empty step; its anchor is the question with all earlier non-empty steps."""
    rest = [c for c in traces.columns if c not in ("question", "steps", "step_labels")]
    rows = traces.select(*rest, X.coerce_text(F.col("question")).alias("_q"), F.transform("steps", lambda s: X.coerce_text(s)).alias("_clean"), "step_labels")  # each step is stripped once
    rows = rows.select(*rest, "_q", "_clean", F.posexplode(F.arrays_zip(F.col("_clean").alias("steps"), "step_labels")).alias("step_index", "_s"))
    earlier = F.filter(F.slice("_clean", F.lit(1), F.col("step_index")), lambda s: s != "")
    generated = F.col("_s.steps")
    bad = (generated == "") & (F.col("_s.step_labels") != 0)
    rows = rows.withColumn("generated", F.when(bad, F.raise_error(F.lit("empty non-neutral response step"))).otherwise(generated)).where("generated <> ''")
    return rows.select(*rest, "step_index", X.context_anchor(F.col("_q"), earlier).alias("anchor"), "generated", F.col("_s.step_labels").alias("compatibility_label"))


def parsed_conversations(rows: DataFrame, turns: str = "conversations", question: str | None = None) -> DataFrame:
    """Rows with turns (array of from, value) as question, steps, step_labels and error (null if the row is good).

    One pass over the turns keeps the state; the first error wins and stops it.
    """
    labels = F.create_map(*[F.lit(x) for kv in STEP_LABELS.items() for x in kv])
    state = "struct<question:string,pending:string,steps:array<string>,labels:array<int>,error:string>"
    start = F.struct(F.lit("").alias("question"), F.lit(None).cast("string").alias("pending"), F.array().cast("array<string>").alias("steps"), F.array().cast("array<int>").alias("labels"), F.lit(None).cast("string").alias("error")).cast(state)

    def made(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(f, s[f]).alias(f) for f in ("question", "pending", "steps", "labels", "error")]).cast(state)

    def step(s: Column, turn: Column) -> Column:
        role, content = F.lower(X.coerce_text(turn["from"])), X.coerce_text(turn["value"])
        templated = content.rlike(QUESTION_STEP)
        asked, body = X.strip(F.regexp_extract(content, QUESTION_STEP, 1)), X.strip(F.regexp_extract(content, QUESTION_STEP, 2))
        clash = templated & (s["question"] != "") & (s["question"] != asked)
        pending = F.when(templated, body).otherwise(content)
        user = (
            F.when(s["pending"].isNotNull(), made(s, error=F.lit("step before its label")))
            .when(clash, made(s, error=F.lit("conflicting questions")))
            .when(pending == "", made(s, error=F.lit("empty step")))
            .otherwise(made(s, question=F.when(templated, asked).otherwise(s["question"]), pending=pending))
        )
        token = F.lower(content)
        known = token.isin(*STEP_LABELS)
        answer = F.when(s["pending"].isNull(), s).when(~known, made(s, error=F.lit("unknown label"))).otherwise(made(s, pending=F.lit(None).cast("string"), steps=F.concat(s["steps"], F.array(s["pending"])), labels=F.concat(s["labels"], F.array(F.try_element_at(labels, token)))))
        return F.when(s["error"].isNotNull() | (content == ""), s).when(role.isin("human", "user"), user).when(role.isin("gpt", "assistant", "model"), answer).otherwise(s)

    out = rows.withColumn("_c", F.aggregate(F.coalesce(F.col(turns), F.expr(f"slice({turns}, 1, 0)")), start, step))
    own = F.when(F.col("_c.question") != "", F.col("_c.question")).otherwise(X.coerce_text(F.col(question)) if question else F.lit(""))
    error = F.coalesce(F.col("_c.error"), F.when(F.col("_c.pending").isNotNull(), "last step without label").when(own == "", "missing question").when(F.size("_c.steps") == 0, "no labelled steps"))
    kept = [c for c in rows.columns if c not in (turns, question)]
    return out.select(*kept, own.alias("question"), F.col("_c.steps").alias("steps"), F.col("_c.labels").alias("step_labels"), error.alias("error"))


def supervised(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns (key, order, role, text) as prompt (all that is not the assistant's) and response (the last of the assistant). Conversations without an assistant are left out."""
    own = F.lower(F.coalesce("role", F.lit(""))).isin("assistant", "gpt", "model")
    rows = turns.withColumn("_t", X.coerce_text(F.col("text"))).where("_t <> ''").withColumn("_own", own)
    said = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_own"), F.struct(order, "_t")))), lambda x: x["_t"])
    grouped = rows.groupBy(key).agg(F.array_join(said, "\n").alias("prompt"), F.max_by("_t", F.when(F.col("_own"), F.col(order))).alias("response"), F.max(F.col("_own")).alias("_any"))
    return grouped.where("_any").select(key, X.strip(F.col("prompt")).alias("prompt"), "response")


def turn_pairs(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    w = Window.partitionBy(key).orderBy(order)
    rows = turns.withColumn("_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.where((F.col("role") == "user") & (F.col("_role") == "assistant")).select(key, F.col(order).alias("turn"), F.col("text").alias("question"), "answer")


def training_rows(examples: DataFrame, source: str, ability: str = "math") -> DataFrame:
    """(prompt, response) and maybe images (texts) as rows for reinforcement training: the prompt and the truth are whole texts, and images are named beside them."""
    images = F.coalesce(F.col("images"), F.array().cast("array<string>")) if "images" in examples.columns else F.array().cast("array<string>")
    policy = F.when(F.size(images) > 0, "local_paths_in_images_column").otherwise("omitted_from_verl_parquet")
    rest = [F.col(c) for c in examples.columns if c not in ("prompt", "response", "images")]
    return examples.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("response").alias("ground_truth")).alias("reward_model"),
        F.struct(*rest, F.size(images).alias("num_images"), policy.alias("image_policy")).alias("extra_info"),
        F.when(F.size(images) > 0, F.transform(images, lambda i: F.struct(i.alias("image")))).alias("images"),
    )


def reconciled_label(*fields: Column) -> Column:
    """(label, conflict) of label fields: words of PAIR_LABELS or 0 and 1. Null fields do not count; fields that disagree or are unknown are a conflict."""
    words = F.create_map(*[F.lit(x) for kv in ({str(v): v for v in (0, 1)} | PAIR_LABELS).items() for x in kv])
    texts = [F.lower(X.coerce_text(c)) for c in fields]
    values = F.array_distinct(F.array_compact(F.array(*[F.try_element_at(words, t) for t in texts])))
    unknown = F.lit(False)
    for c, t in zip(fields, texts, strict=True):
        unknown |= c.isNotNull() & F.try_element_at(words, t).isNull()
    conflict = unknown | (F.size(values) > 1)
    return F.struct(F.when(~conflict, F.try_element_at(values, F.lit(1))).alias("label"), conflict.alias("conflict"))


def resolved_members(references: DataFrame, members: DataFrame, prefixes: tuple[str, ...], key: str, reference: str, member: str = "member") -> DataFrame:
    """references with the first candidate path that is among members, null if none is. Candidates meet members in one join."""
    tries = references.select(key, F.posexplode(X.candidate_paths(F.col(reference), prefixes)).alias("_n", "_c"))
    hits = tries.join(members.select(F.col(member).alias("_c")).distinct(), "_c").groupBy(key).agg(F.min_by("_c", "_n").alias(member))
    return references.join(hits, key, "left")


def unpivoted(rows: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """A row per score field that is not null: keys, score_field, score."""
    return rows.unpivot(keys, fields, "score_field", "score").where("score IS NOT NULL")
