"""Column functions: identifiers, text, durations, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a question.
STOP_WORDS = tuple(
    "what who where when how why which is are was were the a an in on at to for of with by from and or but not do does did has have had "
    "be been being this that these those it its they them their can could would should will shall may might about all".split()
)


def first_truthy(*columns: Column) -> Column:
    """The first string that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def stable_id(length: int, *parts: Column, null: str = "") -> Column:
    """A prefix of the SHA-256 of the parts joined by ``::``; null parts count as the given text."""
    return F.substring(F.sha2(F.concat_ws("::", *(F.coalesce(p.cast("string"), F.lit(null)) for p in parts)), 256), 1, length)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one ISO-8601 string to another, with fractions; null where either cannot be read."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return (micros(end) - micros(start)) / 1e6


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def issue_numbers(c: Column) -> Column:
    """Numbers written #12, in order, repeats kept."""
    return F.regexp_extract_all(c, F.lit(r"(?U)#(\d+)"), F.lit(1))


def issue_references(question: Column) -> Column:
    """Names issue_N of issues written #N or issue N, issue_N."""
    low = F.lower(question)
    found = F.concat(issue_numbers(low), F.regexp_extract_all(low, F.lit(r"(?U)issue[_\s]?(\d+)"), F.lit(1)))
    return F.transform(found, lambda n: F.concat(F.lit("issue_"), n))


def keywords(question: Column) -> Column:
    """Words of two or more characters that are not stop words, lower-cased, repeats kept."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if either vector is zero, empty or null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def clamped(c: Column) -> Column:
    """A confidence in [0, 1]; what is no number counts as 0.5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.5))))


def json_array(raw: Column, schema: str) -> Column:
    """Reads a JSON array, or the widest bracketed part of a noisy text; null if neither can be read."""
    return F.coalesce(F.from_json(raw, schema), F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), schema))


def decayed(confidence: Column, days: Column, rate: float = 0.01) -> Column:
    return confidence * F.exp(-rate * days)
