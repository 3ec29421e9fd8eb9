"""Text functions: Column in, Column out, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments that only mark structure, and relations in the order they are tried.
MARKERS = ("given", "therefore", "thus", "hence", "now", "final answer", "answer", "solution", "step")
RELATIONS = (("<=", ">="), (">=", "<="), ("≤", "≥"), ("≥", "≤"), ("=", "!="), ("<", ">"), (">", "<"), ("+", "-"), ("-", "+"))
ANSWER_TAGS = ("answer", "final", "conclusion", "CONCLUSION")


#: White space of Unicode as a class of ranges, which is much faster than the regex engine's Unicode mode.
_WHITE = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(c: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(c, rf"^{_WHITE}+|{_WHITE}(?<!{_WHITE}{{2}}){_WHITE}*$", "")  # what stands before is looked at only from white space


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that it names several times; the value is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def coerce_text(c: Column) -> Column:
    """As stripped text; null as empty."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def first_text(*columns: Column) -> Column:
    """The first of columns that is not empty once stripped, else empty."""
    return F.coalesce(*[F.nullif(coerce_text(c), F.lit("")) for c in columns], F.lit(""))


def collect_texts(*columns: Column) -> Column:
    """Non-empty stripped texts of columns (texts or arrays of texts), in order."""
    parts = [F.transform(F.coalesce(c, F.array().cast("array<string>")), coerce_text) for c in columns]
    return F.filter(F.flatten(F.array(*parts)), lambda t: t != "")


def ordered_unique(*arrays: Column) -> Column:
    return F.array_distinct(F.filter(F.flatten(F.array(*arrays)), lambda t: t.isNotNull() & (t != "")))


#: White space of Unicode, spelled out: a class of ranges is much faster than the regex engine's Unicode mode.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def filled(text: Column) -> Column:
    """Whether a text is more than white space."""
    return text.rlike(f"[^{SPACE}]")


#: What is left of a segment without content: nothing, a marker, or a step number.
_MARKER = f"(?i)\\A(?:{'|'.join(m.replace(' ', ' +') for m in MARKERS)}|(?:step *)?[0-9]+[a-z]?)?\\z"
#: More letters than any marker has, so that most segments are told from markers by their first letters.
_LETTERS = f"(?:[A-Za-z][^A-Za-z]*+){{{max(map(len, MARKERS)) + 1}}}"


def marker_only(segment: Column) -> Column:
    """Whether a segment, its white space squeezed, has no content besides signs, a marker or a step number. Signs may stand between letters too."""
    return ~segment.rlike(_LETTERS) & F.trim(F.regexp_replace(segment, "[^A-Za-z0-9 ]+", "")).rlike(_MARKER)


def segments(text: Column) -> Column:
    """Sentence-like segments: lines, split after . ! ? ; : before white space, without markers."""
    space = rf"[{SPACE}&&[^\r\n]]"
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), rf" {space}+|[{SPACE}&&[^ \r\n]]{space}*", " ")  # single spaces stay as they are
    parts = F.split(inner, r"[ \r\n](?<=[.!?;:][ \r\n])[ \r\n]*|[\r\n]+")  # what stands before is looked at only from white space
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: ~marker_only(s))


def numeric_or_symbolic(segment: Column) -> Column:
    return segment.rlike(r"[=<>+\-*/^%$(){}\[\]|√∑π∞≤≥±×÷\p{Nd}]")


def eligible_segments(text: Column) -> Column:
    """(index, segment) of numeric or symbolic segments; the index, from 1, counts all segments."""
    numbered = F.transform(segments(text), lambda s, i: F.struct((i + 1).alias("index"), s.alias("segment")))
    return F.filter(numbered, lambda x: numeric_or_symbolic(x["segment"]))


def _replaced(text: Column, at: Column, length: Column | int, new: Column) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + length, F.char_length(text)))


def flip_number(text: Column) -> Column:
    """The first number plus 1, null without one; decimals keep a fraction."""
    pattern = r"(?U)\d+(?:\.\d+)?"
    number, at = F.regexp_extract(text, f"({pattern})", 1), F.regexp_instr(text, F.lit(pattern))
    head, nines = F.regexp_extract(number, "^0*([0-9]*?)(9*)$", 1), F.regexp_extract(number, "^0*([0-9]*?)(9*)$", 2)
    last = F.coalesce((F.right(head, F.lit(1)).try_cast("int") + 1).cast("string"), F.lit("1"))
    whole = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), last, F.repeat(F.lit("0"), F.char_length(nines)))  # of any length
    value = number.try_cast("double") + 1
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", ".0")
    fraction = F.when(F.abs(value) < 1e7, value.cast("string")).otherwise(plain)
    return F.when(at > 0, _replaced(text, at, F.char_length(number), F.when(F.contains(number, F.lit(".")), fraction).otherwise(whole)))


def flip_entity(text: Column) -> Column:
    """The first single letter becomes y, or x if it is y; null without one."""
    pattern = r"(?U)\b[A-Za-z]\b"
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, _replaced(text, at, 1, F.when(F.substring(text, at, F.lit(1)) != "y", F.lit("y")).otherwise(F.lit("x"))))


def flip_relation(text: Column) -> Column:
    """The first occurrence of the first relation of RELATIONS that occurs, turned round; null without one."""
    out = F.lit(None).cast("string")
    for old, new in reversed(RELATIONS):
        at = F.instr(text, F.lit(old))
        out = F.when(at > 0, _replaced(text, at, len(old), F.lit(new))).otherwise(out)
    return out


def extract_answer(text: Column) -> Column:
    """The content of the first tag of ANSWER_TAGS that occurs, else what follows the last ####, else the text."""
    plain = coerce_text(text)
    found = [F.when(plain.rlike(f"(?s)<{t}>.*?</{t}>"), F.regexp_extract(plain, rf"(?sU)<{t}>\s*(.*?)\s*</{t}>", 1)) for t in ANSWER_TAGS]
    return strip(F.coalesce(*found, F.when(F.contains(plain, F.lit("####")), F.substring_index(plain, "####", -1)), plain))


def normalize_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(extract_answer(text)), r"[^a-z0-9.\-]+", " "))


def first_number(text: Column) -> Column:
    """The first number of the normalised answer, null without one."""
    return F.nullif(F.regexp_extract(normalize_answer(text), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def context_anchor(question: Column, steps: Column) -> Column:
    """A question with its numbered earlier steps."""
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.concat(F.lit("Question:\n"), question, F.when(F.size(steps) > 0, F.concat(F.lit("\n\nPrevious response steps:\n"), numbered)).otherwise(F.lit("")))


def candidate_paths(url: Column, prefixes: tuple[str, ...]) -> Column:
    """A reference as archive member names to try, by priority."""
    name = F.regexp_replace(url, r"^[a-z]+://", "")
    return F.array(*[F.concat(F.lit(p), name) for p in prefixes])


#: Endings that a label loses, and parts of a path that do not name a subcategory.
SUFFIXES = ("jsonl", "json", "parquet", "csv", "txt")
PLAIN_FOLDERS = ("images", "train", "val", "test", "raw")


def clean_label(text: Column) -> Column:
    """A text's last path part without a known ending, other characters than ASCII letters, digits, dot, minus and underscore as one underscore; unknown if nothing is left of a text, empty for an empty one."""

    def label(plain: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(plain, r"(?<![^/])([^/]*+)/*+\z", 1), rf"\.(?:{'|'.join(SUFFIXES)})\z", "")
        clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|(?<!_)_+\z", "")
        return F.when(plain == "", F.lit("")).otherwise(once(clean, lambda c: F.when(c == "", F.lit("unknown")).otherwise(c)))

    return once(coerce_text(text), label)


def source_subcategory(path: Column, skip: str = "VisualPRM400K") -> Column:
    """The first folder of a path that names a subcategory: no plain folder, no file, none that begins with skip; else the path's own label."""
    plain = coerce_text(path)
    parts = F.filter(F.split(plain, r"[\\/]+"), lambda p: (p != "") & ~p.startswith(skip) & ~F.lower(p).isin(*PLAIN_FOLDERS) & ~p.rlike(rf"(?i)\.(?:png|jpg|jpeg|webp|{'|'.join(SUFFIXES)})\z"))
    return F.when(plain == "", F.lit("")).otherwise(clean_label(F.coalesce(F.try_element_at(parts, F.lit(1)), plain)))
