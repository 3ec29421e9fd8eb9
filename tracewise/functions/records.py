"""Fields of loosely typed records: Column functions over variants, which tell true from 1, and missing from null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewise.functions import text as X

#: Fields of a record's short metadata, by the stage that reads it.
PAIR_METADATA = ("category", "subcategory", "error_type", "transformation_category", "generation_type")


def field(record: Column, *path: str) -> Column:
    """A field of a variant, null if it is missing or anything on the way is no object."""
    return F.try_variant_get(record, "$" + "".join(f'["{p}"]' for p in path), "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, DOUBLE, DECIMAL, ARRAY, OBJECT or VOID (null); null if missing."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def none(value: Column) -> Column:
    """Whether a value is missing or null."""
    return value.isNull() | F.is_variant_null(value)


def known(value: Column) -> Column:
    """The value, null if it is JSON's null."""
    return F.when(~none(value), value)


def string(value: Column) -> Column:
    """The text of a string; null for any other kind."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def integer(value: Column) -> Column:
    """The number of an integer; null for any other kind, truth values too."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "long"))


def identifier(value: Column) -> Column:
    """A string or an integer as text; null for any other kind."""
    return F.when(F.schema_of_variant(value).isin("STRING", "BIGINT"), F.try_variant_get(value, "$", "string"))


def bad_identifier(value: Column) -> Column:
    """Whether a value is neither null, nor an integer, nor a text that is more than white space."""
    return F.coalesce(~none(value) & (identifier(value).isNull() | (X.strip(identifier(value)) == "")), F.lit(False))


def compact(record: Column, nested: Column, fields: tuple[str, ...] = PAIR_METADATA) -> Column:
    """A map of the fields that are scalars or lists of scalars, as JSON text; a field of the record is taken before one of nested, also where it is null."""
    entries = []
    for f in fields:
        value = F.coalesce(field(record, f), field(nested, f))
        parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), kind)
        flat = F.when(kind(value) == "ARRAY", ~F.exists(parts, lambda k: k.isin("ARRAY", "OBJECT"))).otherwise(kind(value) != "OBJECT")
        entries.append(F.struct(F.lit(f).alias("key"), F.when(~none(value) & flat, F.to_json(value)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def json_text(value: Column) -> Column:
    """A value as compact JSON, null and missing as null."""
    return F.when(none(value), F.lit("null")).otherwise(F.to_json(value))


def json_string(text: Column) -> Column:
    """A text as a JSON string with no character escaped that need not be; null as null."""
    quoted = F.to_json(F.struct(text.alias("t")), {"ignoreNullFields": "false"})
    return F.substring(quoted, F.lit(6), F.char_length(quoted) - 6)


def json_object(fields: dict[str, Column], spaced: bool = False) -> Column:
    """JSON texts as a JSON object with sorted keys; spaced puts a space after each comma and colon."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    parts = [F.concat(F.lit(f'"{k}"{colon}'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))


def json_strings(texts: Column, spaced: bool = False) -> Column:
    """An array of texts as a JSON list."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, json_string), ", " if spaced else ","), F.lit("]"))


def stable_id(prefix: str, payload: Column) -> Column:
    """prefix with 20 digits of the digest of a JSON text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, 20))
