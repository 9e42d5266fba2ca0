"""JSON in model output: lenient recovery, the strict test and schema validity. Arrow functions: Spark's own parser accepts trailing text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpie.functions import fixed

_THINK = re.compile(r"<think>.*?</think>", re.S)
_FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$")


def parse(value: str | None):
    """The object, or None: thoughts and fences go, then all of it, else from the first to the last brace."""
    if not value:
        return None
    clean = _FENCE.sub("", _THINK.sub("", value).strip())
    spans = [clean]
    if 0 <= clean.find("{") < clean.rfind("}"):
        spans.append(clean[clean.find("{") : clean.rfind("}") + 1])
    for span in spans:
        try:
            found = json.loads(span)
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


def strict(value: str | None) -> bool:
    try:
        json.loads((value or "").strip())
    except ValueError:
        return False
    return True


def valid(found) -> bool:
    """Whether an object fits the extraction's fields; unknown keys are let pass, missing ones have defaults."""
    if not isinstance(found, dict):
        return False
    text = lambda v: isinstance(v, str)
    number = lambda v: v is None or (isinstance(v, (int, float)) and not isinstance(v, bool))
    thick, pairs = found.get("thickness"), found.get("relations", [])
    return (
        (found.get("unit_name") is None or text(found["unit_name"]))
        and found.get("rank", "Unknown") in fixed.RANKS
        and all(isinstance(found.get(f, []), list) and all(map(text, found.get(f, []))) for f in fixed.LIST_FIELDS)
        and (thick is None or isinstance(thick, dict) and all(number(thick.get(k)) for k in ("min_m", "max_m")))
        and isinstance(pairs, list)
        and all(isinstance(r, dict) and r.get("kind") in fixed.RELATIONS and text(r.get("unit")) for r in pairs)
    )


def canonical(found) -> dict | None:
    """An object as an extraction: items of other types are left out."""
    if not isinstance(found, dict):
        return None
    thick, lists = found.get("thickness"), {}
    for f in fixed.LIST_FIELDS:
        v = found.get(f)
        lists[f] = [x for x in v if isinstance(x, str)] if isinstance(v, list) else []

    def number(v):
        try:
            return None if v is None else float(v)
        except (TypeError, ValueError):
            return float("nan")

    pairs = found.get("relations") if isinstance(found.get("relations"), list) else []
    return {
        "unit_name": found["unit_name"] if isinstance(found.get("unit_name"), str) else None,
        "rank": str(found["rank"]) if found.get("rank") is not None else "Unknown" if "rank" not in found else "null",
        **lists,
        "thickness": {k: number(thick.get(k)) for k in ("min_m", "max_m")} if isinstance(thick, dict) else None,
        "relations": [{"kind": str(r["kind"]), "unit": str(r["unit"])} for r in pairs if isinstance(r, dict) and r.get("kind") and r.get("unit")],
    }


@F.pandas_udf(T.StringType())
def recovered_json(values: pd.Series) -> pd.Series:
    """The recovered object as canonical extraction JSON, null if there is none."""
    return values.map(lambda v: None if (found := parse(v)) is None else json.dumps(canonical(found), ensure_ascii=False))


@F.pandas_udf(T.BooleanType())
def is_strict_json(values: pd.Series) -> pd.Series:
    return values.map(strict).astype(bool)


@F.pandas_udf(T.BooleanType())
def fits_schema(values: pd.Series) -> pd.Series:
    return values.map(lambda v: valid(parse(v))).astype(bool)
