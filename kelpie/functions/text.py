"""Column functions on text: cleaning, normalising, names, numbers. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions import fixed

#: Unicode meanings of \\s, \\d and \\b, as passages have them.
U = "(?U)"
WORD = r"[A-Za-z][A-Za-z'\-]*"


def squeeze(text: Column) -> Column:
    """White space runs (Unicode) to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, U + r"\s+", " "))


def strip_html_native(html: Column) -> Column:
    """Visible text by replacement: scripts, styles, comments and tags go, common entities are decoded."""
    out = F.coalesce(html, F.lit(""))
    markup = F.regexp_replace(out, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", " ")
    markup = F.regexp_replace(markup, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        markup = F.replace(markup, F.lit(entity), F.lit(char))
    return squeeze(F.replace(F.when(F.contains(out, F.lit("<")), markup).otherwise(out), F.lit("\u00a0"), F.lit(" ")))


def clean_passage(text: Column) -> Column:
    """A passage without a leading page reference, white space squeezed; null becomes empty."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), U + r"(?i)^\s*Pg\.\s*[\d\-–,\s]+\.?\s*", ""))


def alnum_lower(text: Column) -> Column:
    """The key of exact duplicates: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_key(text: Column) -> Column:
    """The key of exact duplicates by words: ``[a-z0-9]+`` joined by spaces."""
    return F.array_join(ascii_words(text), " ")


def normal(text: Column) -> Column:
    """Everything but a-z and 0-9 to single spaces, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def padded_normal(text: Column) -> Column:
    """As :func:`normal`, with a space at both ends, so that ``' form '`` tests for whole words."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))


def to_metres(value: Column, unit: Column) -> Column:
    """A length in metres to two places; null for unknown units or numbers."""
    number = F.replace(value, F.lit(","), F.lit("")).try_cast("double")
    unit = F.regexp_replace(F.lower(unit), r"\.+$", "")
    feet = F.round(number * fixed.FEET_TO_METRES, 2)
    return F.when(unit.isin("feet", "foot", "ft"), feet).when(unit.isin("m", "meter", "meters", "metre", "metres"), F.round(number, 2))


def _endings(*more: str) -> str:
    """Rank and rock words as a name may end in them; a final s is cut from the name's word first, so words in s never match."""
    return "|".join(w for w in [*fixed.RANK_WORDS, *fixed.LITH_AS_RANK, *more] if not w.endswith("s"))


def relation_name(raw: Column) -> Column:
    """A captured unit name: punctuation and a last of/in/at/and/the go, a last rank word gets its capital."""
    name = F.regexp_replace(F.trim(F.regexp_replace(raw, U + r"\s+", " ")), r"^[ .,;:]+|[ .,;:]+$", "")
    name = F.regexp_replace(name, r"(?i)\s+(?:of|in|at|and|the)$", "")
    last = F.regexp_extract(name, r"([^ ]+)$", 1)
    known = F.lower(last).rlike(rf"^(?:{_endings()})s*$")
    return F.when(known, F.concat(F.regexp_replace(name, r"[^ ]+$", ""), F.initcap(F.lower(last)))).otherwise(name)


def clean_name(name: Column) -> Column:
    """A unit name without bracketed remarks, slashes and outer punctuation."""
    out = F.replace(F.regexp_replace(name, r"\[[^\]]*\]|\([^)]*\)", ""), F.lit("/"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(out, U + r"\s+", " "), r"^[ .,;:*]+|[ .,;:*]+$", "")


def core_name(name: Column) -> Column:
    """The identifying part of a unit name, in lower case: no last rank or rock words, one word at least."""
    return F.lower(F.regexp_replace(clean_name(name), rf"(?i)(?:\s+(?:{_endings('serie')})s*)+$", ""))


def rank_of(phrase: Column) -> Column:
    """The rank that a name's last word tells; rock words tell a Formation."""
    last = F.regexp_replace(F.lower(F.regexp_extract(clean_name(phrase), r"([^ ]+)$", 1)), "s+$", "")
    ranks = F.create_map(*[F.lit(x) for pair in fixed.RANK_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, last), F.when(last.isin(*fixed.LITH_AS_RANK), F.lit("Formation")), F.lit("Unknown"))


def usage_chain(usage: Column, unit_name: Column) -> Column:
    """'A of B in C' as [A, B, C] of clean names; null unless the first starts with the unit's name."""
    parts = F.filter(F.transform(F.split(usage, r"\s+(?:of|in)\s+(?=[A-Z/])"), clean_name), lambda s: s != "")
    return F.when(F.lower(F.get(parts, F.lit(0))).startswith(F.lower(unit_name)), parts)


def sorted_set(values: Column) -> Column:
    """Trimmed, without empties and nulls, distinct, sorted; null becomes empty."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    return F.array_sort(F.array_distinct(clean))


def long_words(strings: Column) -> Column:
    """Distinct lower-case alphabetic words of over three letters in an array of strings."""
    words = F.regexp_extract_all(F.lower(F.array_join(strings, " ")), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))


def first_number(text: Column) -> Column:
    """The first whole number, with or without thousands commas."""
    return F.replace(F.regexp_extract(text, r"\b(\d[\d,]*)\b", 1), F.lit(","), F.lit("")).try_cast("bigint")


def fenced_code(text: Column) -> Column:
    """What a fenced block of the text holds, else all of it, without semicolons at the end."""
    fence = r"(?is)```(?:cypher|sql)?\s*(.*?)```"
    found = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    return F.regexp_replace(F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")), ";+$", "")


def sparkline(values: Column, last: int = 40) -> Column:
    """The last values as block characters of eight heights; flat and empty series are low, not-a-number is a space."""
    tail = F.slice(values, F.greatest(F.size(values) - last + 1, F.lit(1)), last)
    good = F.filter(tail, lambda v: ~F.isnan(v))
    low, span = F.array_min(good), F.array_max(good) - F.array_min(good)
    bars = F.lit("▁▂▃▄▅▆▇█")
    place = lambda v: F.when(span > 0, F.floor((v - low) / span * 7)).otherwise(F.lit(0)).cast("int")
    return F.array_join(F.transform(tail, lambda v: F.when(F.isnan(v), F.lit(" ")).otherwise(F.substring(bars, place(v) + 1, 1))), "")


def quoted(value: Column) -> Column:
    """A string as a pattern that matches itself."""
    return F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")


REASONS = ["too_short", "too_long", "low_alpha_ratio", "digit_heavy", "too_few_words", "repetitive", "no_sentences"]


def reject_reason(text: Column, min_chars: int = 300, max_chars: int = 50_000) -> Column:
    """The first quality rule that a text fails, null if it passes; a null text is too short."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s\x{85}\p{Z}\x{1c}-\x{1f}]", ""))
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    periods = n - F.length(F.replace(text, F.lit("."), F.lit("")))
    whole = F.greatest(n, F.lit(1))

    def by_words(words: Column) -> Column:
        different = F.size(F.array_distinct(F.transform(words, F.lower)))
        few = different / F.greatest(F.size(words), F.lit(1)) < 0.25
        return F.when(F.size(words) < 50, REASONS[4]).when(few, REASONS[5]).when(periods < 3, REASONS[6])

    # The words are bound as a variable, else each rule would look for them again; and only where the cheap rules pass.
    rest = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), by_words), F.lit(0))
    tests = [n < min_chars, n > max_chars, letters / whole < 0.70, digits / whole > 0.20]
    return reduce(lambda case, x: case.when(x[1], F.lit(x[0])), zip(REASONS[1:4], tests[1:], strict=True), F.when(tests[0], F.lit(REASONS[0]))).otherwise(rest)


def in_length_band(text: Column, least: int = 200, most: int = 4000) -> Column:
    return F.length(text).between(least, most)
