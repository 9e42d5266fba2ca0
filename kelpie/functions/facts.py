"""Facts in passages as columns: thickness, relations, rank, subject, and how much was found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions import fixed, text

_RANGE = rf"(?i){fixed.NUMBER}\s*(?:to|-|–|or)\s*{fixed.NUMBER}\s*(?:\+\s*)?{fixed.LENGTH_UNIT}"
_SINGLE = rf"(?i){fixed.NUMBER}\s*(?:\+\s*)?{fixed.LENGTH_UNIT}"


def sentences(passage: Column) -> Column:
    return F.split(passage, text.U + r"(?<=[.;])\s+")


def _measure(sentence: Column) -> Column:
    low = text.to_metres(F.regexp_extract(sentence, _RANGE, 1), F.regexp_extract(sentence, _RANGE, 3))
    high = text.to_metres(F.regexp_extract(sentence, _RANGE, 2), F.regexp_extract(sentence, _RANGE, 3))
    one = text.to_metres(F.regexp_extract(sentence, _SINGLE, 1), F.regexp_extract(sentence, _SINGLE, 2))
    made = lambda a, b: F.struct(a.alias("min_m"), b.alias("max_m"))
    return F.when(low <= high, made(low, high)).when(one > 0, made(one, one))


def thickness(passage: Column) -> Column:
    """struct<min_m, max_m> from the first sentence on thickness that has a measure, else null."""
    about = F.filter(sentences(passage), lambda s: s.rlike("(?i)thick"))
    return F.get(F.filter(F.transform(about, _measure), lambda m: m.isNotNull()), F.lit(0))


def relation_candidates(passage: Column) -> Column:
    """array<struct<kind, unit>> of all relation phrases in order of their patterns, names cleaned, not yet known as units."""

    def named(kind: str, phrase: str) -> Column:
        raw = F.regexp_extract_all(passage, F.lit(rf"{phrase}\s+{fixed.THE}{fixed.NAME}"), F.lit(1))
        return F.transform(raw, lambda r: F.struct(F.lit(kind).alias("kind"), text.relation_name(r).alias("unit")))

    return F.concat(*[named(*x) for x in fixed.RELATION_PHRASES])


def head_word(name: Column) -> Column:
    return F.get(F.split(name, " "), F.lit(0))


def infer_rank(passage: Column, unit_name: Column) -> Column:
    """The rank read from up to three words after the unit's name: a rank word wins, a rock word means Formation."""
    pattern = F.concat(F.lit(r"(?i)\b"), text.quoted(unit_name), F.lit(r"\b((?:\s+[A-Za-z'\-]+){0,3})"))
    after = F.regexp_extract_all(passage, pattern, F.lit(1))
    words = F.split(F.trim(F.regexp_replace(F.array_join(after, " "), r"\s+", " ")), " ")
    words = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "s+$", ""))
    ranks = F.create_map(*[F.lit(x) for pair in fixed.RANK_WORDS.items() for x in pair])
    told = F.get(F.filter(words, lambda w: F.map_contains_key(ranks, w)), F.lit(0))
    rocks = F.exists(words, lambda w: w.isin(*fixed.LITH_AS_RANK))
    named = unit_name.isNotNull() & (unit_name != "")
    return F.when(~named | named.isNull(), F.lit("Unknown")).otherwise(
        F.coalesce(F.try_element_at(ranks, told), F.when(rocks, F.lit("Formation")), F.lit("Unknown"))
    )


def subject(passage: Column, unit_name: Column, within: int = 150) -> Column:
    """The unit's name if the passage mentions it as whole words early on, else null."""
    name = F.nullif(F.trim(unit_name), F.lit(""))
    first = F.regexp_instr(passage, F.concat(F.lit(r"(?i)\b"), text.quoted(name), F.lit(r"\b")))
    return F.when(first.between(1, within + 1), name)


def sorted_relations(relations: Column) -> Column:
    """One relation of each kind and unit (letter case aside; the last stays), ordered by kind and unit."""
    keyed = F.transform(
        relations, lambda r, i: F.struct(r["kind"].alias("kind"), F.lower(r["unit"]).alias("low"), (-i).alias("at"), r["unit"].alias("unit"))
    )
    ordered = F.array_sort(keyed)
    firsts = F.filter(
        ordered,
        lambda r, i: (i == 0) | (F.get(ordered, i - 1)["kind"] != r["kind"]) | (F.get(ordered, i - 1)["low"] != r["low"]),
    )
    return F.transform(firsts, lambda r: F.struct(r["kind"].alias("kind"), r["unit"].alias("unit")))


def filled_fields(e: Column) -> Column:
    """How many of an extraction's seven facts were found."""
    parts = [F.size(e[c]) > 0 for c in ("lithologies", "chronostrat", "minerals", "relations", "states")]
    parts += [e["thickness"].isNotNull(), e["rank"] != "Unknown"]
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts[1:]), F.coalesce(parts[0], F.lit(False)).cast("int"))


def is_empty(e: Column) -> Column:
    """Nothing found beyond the unit's name, rank and states."""
    some = [F.coalesce(F.size(e[c]) > 0, F.lit(False)) for c in ("lithologies", "chronostrat", "minerals", "relations")]
    return ~(some[0] | some[1] | some[2] | some[3] | e["thickness"].isNotNull())


def messages(passage: Column, target_json: Column | None = None) -> Column:
    """The chat form of an example; training and inference share it up to the last turn."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", F.lit(fixed.SYSTEM_PROMPT)), turn("user", F.concat(F.lit("Passage:\n"), F.trim(F.regexp_replace(passage, r"^\s+|\s+$", ""))))]
    return F.array(*turns, *([] if target_json is None else [turn("assistant", target_json)]))


def _quote(s: Column) -> Column:
    """A JSON string, non-ASCII characters as they are; null is null."""
    one = F.to_json(F.array(s))
    return F.when(s.isNull(), F.lit("null")).otherwise(F.substr(one, F.lit(2), F.length(one) - 2))


def _number(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit("null"))


def _listing(values: Column, each) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, each), ", "), F.lit("]"))


def extraction_json(e: Column) -> Column:
    """An extraction as JSON text with fixed key order, nulls kept and spaces after separators."""
    measure = F.when(e["thickness"].isNull(), F.lit("null")).otherwise(
        F.concat(F.lit('{"min_m": '), _number(e["thickness"]["min_m"]), F.lit(', "max_m": '), _number(e["thickness"]["max_m"]), F.lit("}"))
    )
    pairs = lambda r: F.concat(F.lit('{"kind": '), _quote(r["kind"]), F.lit(', "unit": '), _quote(r["unit"]), F.lit("}"))
    parts = [
        ("unit_name", _quote(e["unit_name"])), ("rank", _quote(e["rank"])),
        *[(c, _listing(text.sorted_set(e[c]), _quote)) for c in ("lithologies", "chronostrat", "minerals")],
        ("thickness", measure), ("relations", _listing(sorted_relations(e["relations"]), pairs)), ("states", _listing(text.sorted_set(e["states"]), _quote)),
    ]
    out = [x for i, (k, v) in enumerate(parts) for x in (F.lit(f'{", " if i else "{"}"{k}": '), v)]
    return F.concat(*out, F.lit("}"))
