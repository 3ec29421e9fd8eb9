"""Planning of generation: prompts, budgets and the interface of generators. A generator runs in Arrow batches; rows never leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The instructions of prompts. {segment} stands for the reference.
PARAPHRASE = (
    "Paraphrase the anchor faithfully. Preserve every claim, entity, value, relation, equation, inference, and conclusion. Keep similar detail, order, structure, and length; "
    "do not summarize, correct, add, or omit reasoning."
)
HARD_NEGATIVE = (
    "Create a fluent version that disagrees with the anchor through exactly one underlying semantic change. Preserve all unrelated content and keep similar detail, order, structure, "
    "and length. Update only direct consequences of that change. Do not explain the alteration."
)
SEGMENT_TEMPLATE = """You are generating controlled adversarial examples for evaluating semantic similarity metrics.

Given one reference reasoning segment, generate:
1. A POSITIVE paraphrase that is logically equivalent to the reference.
2. A NEGATIVE_VALUE_FLIP that changes exactly one numerical value while preserving the entity/relation as much as possible.
3. A NEGATIVE_ENTITY_FLIP that changes exactly one variable, object, edge, point, or symbol while preserving the numerical value as much as possible.
4. A NEGATIVE_RELATION_FLIP that changes exactly one relation/operator/direction while preserving entities and numbers as much as possible.

Rules:
- Do not solve the problem.
- Do not add new context.
- Do not generate a full reasoning chain.
- Each output must be one standalone sentence or equation.
- The POSITIVE must preserve every number, variable, entity, unit, and mathematical relation.
- Each NEGATIVE must be minimally different and logically non-equivalent.
- If a requested negative type is impossible, output null.
- Return only valid JSON.

Reference segment:
{segment}

Return JSON:
{
  "positive": "...",
  "negative_value_flip": "... or null",
  "negative_entity_flip": "... or null",
  "negative_relation_flip": "... or null",
  "notes": {
    "changed_value": "... or null",
    "changed_entity": "... or null",
    "changed_relation": "... or null"
  }
}"""
PROMPT_VERSIONS = ("v1", "v2")


def segment_prompt(segment: Column) -> Column:
    """The prompt for the variants of a reasoning segment."""
    before, after = SEGMENT_TEMPLATE.split("{segment}")
    return F.concat(F.lit(before), segment, F.lit(after))


def pair_prompt(kind: Column, anchor: Column, shots: Column | None = None, version: str = "v2") -> Column:
    """The prompt for one pair. shots: an array of (anchor, generated), null or empty for none."""
    if version not in PROMPT_VERSIONS:
        raise ValueError(f"unknown prompt version: {version}")
    asked = F.when(kind == "positive_paraphrase", PARAPHRASE).otherwise(HARD_NEGATIVE)
    examples = F.lit("")
    if shots is not None:
        shown = F.array_join(F.transform(shots, lambda s: F.concat(F.lit("Anchor:\n"), s["anchor"], F.lit("\nGenerated:\n"), s["generated"])), "\n\n")
        examples = F.when(F.size(shots) > 0, F.concat(F.lit("\n\nExamples:\n"), shown)).otherwise("")
    return F.concat(asked, F.lit('\nReturn only {"generated_segment":"..."}.'), examples, F.lit("\n\nAnchor:\n"), anchor)


def output_budget(anchor_tokens: Column, prompt_tokens: Column, max_model_len: int, cap: int = 256) -> Column:
    """Tokens that an answer may have: a tenth more than the anchor and 16, at least 64, within the model's length and cap; at least 0."""
    asked = F.greatest(F.lit(64), F.floor(anchor_tokens * F.lit(1.1)).cast("int") + 16)
    return F.greatest(F.lit(0), F.least(asked, F.lit(max_model_len) - prompt_tokens, F.lit(cap)))


def gated(requests: DataFrame, max_anchor: int = 224, max_model_len: int = 4096, least_output: int = 64, cap: int = 512) -> DataFrame:
    """requests (anchor_tokens, prompt_tokens, ...) with max_output_tokens and error_type, null where the request fits."""
    rows = requests.withColumn("max_output_tokens", output_budget(F.col("anchor_tokens"), F.col("prompt_tokens"), max_model_len, cap))
    budget = F.col("max_output_tokens")
    overflow = (budget < least_output) | (F.col("prompt_tokens") + budget > max_model_len)
    return rows.withColumn("error_type", F.when(F.col("anchor_tokens") > max_anchor, "DebertaAnchorTooLong").when(overflow, "QwenContextOverflow"))


#: What errors of the gates say.
GATE_MESSAGES = {"DebertaAnchorTooLong": "Anchor exceeds the configured DeBERTa token limit", "QwenContextOverflow": "Prompt and output budget do not fit the context window"}


def gate_errors(requests: DataFrame, max_anchor: int = 224, max_model_len: int = 4096, least_output: int = 64, cap: int = 512) -> DataFrame:
    """Of requests (anchor_tokens, prompt_tokens, ...) those that do not fit, with error_type, error_message and the details of their error: observed_tokens and limit, or prompt_tokens, max_output_tokens, min_output_tokens and limit. The others of these are null."""
    rows = gated(requests, max_anchor, max_model_len, least_output, cap).where("error_type IS NOT NULL")
    anchor = F.col("error_type") == "DebertaAnchorTooLong"
    message = F.create_map(*[F.lit(x) for kv in GATE_MESSAGES.items() for x in kv])
    details = {"observed_tokens": F.when(anchor, F.col("anchor_tokens")), "limit": F.when(anchor, F.lit(max_anchor)).otherwise(F.lit(max_model_len)), "min_output_tokens": F.when(~anchor, F.lit(least_output))}
    details |= {c: F.when(~anchor, F.col(c)) for c in ("prompt_tokens", "max_output_tokens")}
    return rows.withColumns({"error_message": F.try_element_at(message, "error_type"), **details}).drop("anchor_tokens")


Generator = Callable[[list[str]], list[str]]
Template = Callable[[list[dict[str, str]]], str]


def rendered(requests: DataFrame, make: Callable[[], Template] | None = None, prompt: str = "prompt") -> DataFrame:
    """requests with their prompt as a chat's user turn in a model's template: make() gives a worker its template, once, a function from messages (role, content) to text. Without one the prompt stays as it is; a template that fails gives its error on the batch's rows."""
    if make is None:
        return requests.withColumns({"rendered": F.col(prompt), "error": F.lit(None).cast("string")})

    def batches() -> Generator:
        own = make()
        return lambda prompts: [own([{"role": "user", "content": p}]) for p in prompts]

    return generated(requests, batches, prompt).withColumnRenamed("output", "rendered")


def generated(requests: DataFrame, make: Callable[[], Generator], prompt: str = "prompt") -> DataFrame:
    """requests with output and error: make() gives a worker its generator, once; a batch that fails gives its error on each row."""
    schema = T.StructType([*requests.schema.fields, T.StructField("output", T.StringType()), T.StructField("error", T.StringType())])
    at = requests.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out, error = [None] * batch.num_rows, None
            try:
                own = own or make()
                out = own(batch.column(at).to_pylist())
                if len(out) != batch.num_rows:
                    raise ValueError(f"{len(out)} outputs for {batch.num_rows} prompts")
            except Exception as e:  # noqa: BLE001  errors are data here
                out, error = [None] * batch.num_rows, f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.string()), pa.array([error] * batch.num_rows, type=pa.string())], names=[*batch.schema.names, "output", "error"])

    return requests.mapInArrow(run, schema)
