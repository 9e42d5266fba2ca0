"""Scores of extractions and answers, question generators and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import fixed, json_recovery, text
from kelpie.operators.splits import seeded

SET_FIELDS = [*fixed.LIST_FIELDS, "relations"]
RELATIVE, ABSOLUTE = 0.05, 0.05


def thickness_match(pred: Column, gold: Column) -> Column:
    """Both absent, or both ends absent on both sides or within 5 % of the gold end or 0.05, whichever is more."""

    def end(k: str) -> Column:
        p, g = pred[k], gold[k]
        near = ~F.isnan(p) & (F.abs(g - p) <= F.greatest(RELATIVE * F.abs(g), F.lit(ABSOLUTE)))
        return F.when(g.isNull() & p.isNull(), True).when(g.isNull() | p.isNull(), False).otherwise(near)

    return F.when(gold.isNull() & pred.isNull(), True).when(gold.isNull() | pred.isNull(), False).otherwise(end("min_m") & end("max_m"))


def normal_set(values: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), text.normal))


def relation_set(values: Column) -> Column:
    pairs = F.coalesce(values, F.expr("cast(array() AS array<struct<kind:string,unit:string>>)"))
    return F.array_distinct(F.transform(pairs, lambda r: F.concat(F.lower(F.trim(r["kind"])), F.lit("|"), text.normal(r["unit"]))))


def score_rows(predictions: DataFrame) -> DataFrame:
    """Gates, scalar hits and tp/fp/fn of each set field for rows of raw_output and gold (an extraction)."""
    found = json_recovery.recovered_json(F.col("raw_output"))
    rows = predictions.withColumn("pred", F.from_json(found, fixed.EXTRACTION_SCHEMA)).withColumn("parsed", found.isNotNull())
    gold, pred = F.col("gold"), F.col("pred")
    rank = lambda e: F.coalesce(e["rank"], F.lit("Unknown"))
    named = F.coalesce(gold["unit_name"] != "", F.lit(False))
    out = {
        "empty_output": F.trim(F.coalesce("raw_output", F.lit(""))) == "",
        "strict_json": json_recovery.is_strict_json(F.col("raw_output")),
        "schema_ok": json_recovery.fits_schema(F.col("raw_output")),
        "named": named,
        "name_ok": named & (text.normal(pred["unit_name"]) == text.normal(gold["unit_name"])),
        "rank_ok": rank(gold) == rank(pred),
        "rank_pair": F.concat(rank(gold), F.lit("->"), rank(pred)),
        "thickness_ok": thickness_match(pred["thickness"], gold["thickness"]),
    }
    for f in SET_FIELDS:
        make = relation_set if f == "relations" else normal_set
        p, g = make(pred[f]), make(gold[f])
        out |= {f"{f}_tp": F.size(F.array_intersect(p, g)), f"{f}_fp": F.size(F.array_except(p, g)), f"{f}_fn": F.size(F.array_except(g, p))}
    return rows.withColumns(out)


def field_scores(scored: DataFrame) -> DataFrame:
    """field, tp, fp, fn, precision, recall, f1 (four decimals; 0 where a denominator is)."""
    sums = scored.agg(*[F.sum(f"{f}_{x}").cast("long").alias(f"{f}_{x}") for f in SET_FIELDS for x in ("tp", "fp", "fn")])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), *[F.coalesce(f"{f}_{x}", F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]) for f in SET_FIELDS])).alias("x")
    rows = sums.select(each).select("x.*")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select("field", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(share(2 * p * r, p + r), 4).alias("f1"))


def macro_f1(fields: DataFrame) -> DataFrame:
    """The mean f1 of the fields that gold or predictions use (four decimals, 0 if none does)."""
    return fields.where("tp + fp + fn > 0").agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1"), F.count("*").alias("fields"))


def gates(scored: DataFrame) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda c: F.round(F.count_if(c) / n, 4)
    return scored.agg(
        F.count("*").alias("n"), share(F.col("parsed")).alias("parse_rate"), share(F.col("strict_json")).alias("strict_json_rate"),
        share(F.col("schema_ok")).alias("schema_valid_rate"), share(F.col("empty_output")).alias("empty_output_rate"),
        F.round(F.count_if("name_ok") / F.greatest(F.count_if("named"), F.lit(1)), 4).alias("unit_name_accuracy"), F.count_if("named").alias("unit_name_n"),
        share(F.col("rank_ok")).alias("rank_accuracy"), share(F.col("thickness_ok")).alias("thickness_accuracy"),
    )


def rank_confusion(scored: DataFrame, most: int = 6) -> DataFrame:
    """The most frequent wrong ranks as 'gold->pred' (ties by name)."""
    return scored.where(~F.col("rank_ok")).groupBy("rank_pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rank_pair").limit(most)


def _has(padded: Column, form: Column) -> Column:
    return (form != "") & F.contains(padded, F.concat(F.lit(" "), form, F.lit(" ")))


def mentions(answer: Column, item: Column) -> Column:
    """Whether a text has an item as whole words: its words, core name, without early/middle/late, or its postal code."""
    padded = text.padded_normal(answer)
    plain = text.normal(item)
    codes = F.create_map(*[F.lit(x) for k, v in fixed.STATES.items() if k != "alaska peninsula" for x in (k, v.lower())])
    code = F.coalesce(F.try_element_at(codes, F.lower(item)), F.lit(""))
    return _has(padded, plain) | _has(padded, text.core_name(item)) | _has(padded, F.regexp_replace(plain, "^(early|middle|late) ", "")) | _has(padded, code)


def match_score(kind: Column, items: Column, count: Column, answer: Column) -> Column:
    """all: share of items; any: 1 if one; count: 1 if the first number is it; judge: null."""
    hits = F.size(F.filter(items, lambda g: mentions(answer, g)))
    return (
        F.when(kind == "all", F.try_divide(hits, F.size(items)))
        .when(kind == "any", (hits > 0).cast("double"))
        .when(kind == "count", F.coalesce(text.first_number(answer) == count, F.lit(False)).cast("double"))
    )


def context_recall(kind: Column, items: Column, count: Column, source: Column, context: Column, sources: Column) -> Column:
    """Whether the context holds the gold: the source passage (judge), the counted number (count), the items."""
    counted = F.regexp_like(context, F.concat(F.lit(r"\b"), count.cast("string"), F.lit(r"\b")))
    return (
        F.when(kind == "judge", F.array_contains(sources, source).cast("double"))
        .when(kind == "count", (counted & F.contains(F.lower(context), F.lit("count"))).cast("double"))
        .otherwise(F.coalesce(match_score(kind, items, count, context), F.lit(0.0)))
    )


def judge_verdict(reply: Column) -> Column:
    """0 or 1 from a judge's reply: the 'correct' field of its JSON, else whether it says so literally."""
    block = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    value = F.get_json_object(block, "$.correct").try_cast("double")
    return F.when(value.isNotNull(), (value != 0).cast("int")).otherwise(F.contains(reply, F.lit('"correct": 1')).cast("int"))


def report(results: DataFrame) -> DataFrame:
    """Means of score and context recall, medians of seconds and context size, judge agreement, abstentions and errors.

    A row for each system and category, and one for each system over all ('ALL').
    """
    sets = results.groupingSets([["system", "category"], ["system"]], "system", "category")
    agrees = (F.col("judge") == (F.col("score") >= 0.5).cast("int")).cast("double")
    return sets.agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("context_recall"), 4).alias("context_recall"),
        F.round(F.median("seconds"), 4).alias("seconds_median"), F.round(F.median("context_chars"), 1).alias("context_chars_median"),
        F.round(F.avg(agrees), 4).alias("judge_agreement"), F.round(F.avg(F.col("abstained").cast("double")), 4).alias("abstain_rate"),
        F.count_if(F.col("retrieval_error").isNotNull()).alias("errors"), F.grouping("category").alias("over_all"),
    ).withColumn("category", F.when(F.col("over_all") == 1, "ALL").otherwise(F.col("category"))).drop("over_all")


QUESTION = ["id", "category", "question", "gold_items", "gold_count", "match", "source", "provenance"]


def clean_units(units: DataFrame) -> DataFrame:
    """Curated units whose name identifies them: a core of their own, a known rank, a full name."""
    cores = units.where("geolex").withColumn("core", text.core_name(F.col("name")))
    alone = cores.groupBy("core").agg(F.count("*").alias("n"), F.first("key").alias("key")).where("n = 1").select("key")
    return units.join(alone, "key", "left_semi").where("rank <> 'Unknown' and full_name <> name")


def _ask(rows: DataFrame, category: str, key: Column, question: Column, match: str, items: Column | None, n: int, seed: int, provenance: str, count: Column | None = None) -> DataFrame:
    made = rows.select(
        F.concat(F.lit(f"{category}-"), F.regexp_replace(key, r"\|", "-")).alias("id"), F.lit(category).alias("category"), question.alias("question"),
        (F.lit(None).cast("array<string>") if items is None else items).alias("gold_items"), (F.lit(None) if count is None else count).cast("long").alias("gold_count"),
        F.lit(match).alias("match"), key.alias("source"), F.lit(provenance).alias("provenance"),
    )
    return made.orderBy(seeded(seed, "id"), "id").limit(n)


def questions(units: DataFrame, edges: DataFrame, spans: DataFrame, periods: list[str], n: int = 8, seed: int = 17) -> DataFrame:
    """Deterministic questions of seven categories with their gold, ``n`` of each at most, drawn by seed."""
    clean = clean_units(units).select("key", "full_name", "rank", "states")
    names = units.select(F.col("key").alias("ref"), F.col("full_name").alias("ref_name"))
    state = F.create_map(*[F.lit(x) for k, v in fixed.STATES.items() if k != "alaska peninsula" for x in (v, k.title())])
    tail = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    of = lambda kind, near, far: edges.where(F.col("type") == kind).select(F.col(near).alias("key"), F.col(far).alias("ref"))
    gather = lambda e: e.groupBy("key").agg(F.array_sort(F.collect_set("ref_name")).alias("items"))
    ask = lambda before, after: F.concat(F.lit(before), F.col("full_name"), F.lit(after))
    ages = of("HAS_AGE", "src", "dst").groupBy("key").agg(F.array_sort(F.collect_set(tail(F.col("ref")))).alias("items"))
    parents, children, above = (gather(of(k, a, b).join(names, "ref")) for k, a, b in (("PART_OF", "src", "dst"), ("PART_OF", "dst", "src"), ("OVERLIES", "dst", "src")))
    key = F.col("key")
    known = (F.size("states") >= 1) & (F.size("states") <= 4) & F.forall("states", lambda s: F.map_contains_key(state, s))
    small = F.col("rank").isin("Member", "Bed", "Tongue", "Lentil")
    out = [
        _ask(clean.join(ages, "key"), "age", key, ask("What is the geologic age of the ", "?"), "all", F.col("items"), n, seed, "geolex"),
        _ask(clean.where(known), "states", key, ask("In which US states does the ", " occur?"), "all", F.transform("states", lambda s: state[s]), n, seed, "geolex"),
        _ask(clean.where(small).join(parents, "key"), "parent", key, ask("What larger stratigraphic unit is the ", " part of?"), "any", F.col("items"), n, seed, "geolex"),
        _ask(clean.join(children, "key").where(F.size("items").between(3, 12)), "members", key, ask("Which units are part of the ", "?"), "all", F.col("items"), n, seed, "geolex"),
        _ask(clean.join(above, "key"), "relation", key, ask("Which unit overlies the ", "?"), "any", F.col("items"), n, seed, "text (rule labeller)"),
    ]
    dated = of("HAS_AGE", "src", "dst").select("key", tail(F.col("ref")).alias("desc")).join(spans, "desc").where(F.col("anc").isin(*periods)).select("key", F.col("anc").alias("period")).distinct()
    placed = units.where("geolex").select("key", "full_name", F.explode("states").alias("st")).join(dated, "key").where(F.map_contains_key(state, F.col("st")))
    rocks = edges.where("type = 'HAS_LITHOLOGY' and array_contains(sources, 'geolex')").select(F.col("src").alias("key"), tail(F.col("dst")).alias("rock"))
    hop = placed.join(rocks, "key").groupBy("period", "st", "rock").agg(F.countDistinct("key").alias("units"), F.array_sort(F.collect_set("full_name")).alias("items")).where(F.col("units").between(2, 8))
    hop_text = F.concat(F.lit("Which "), F.col("period"), F.lit(" units in "), state[F.col("st")], F.lit(" consist of "), F.col("rock"), F.lit("?"))
    out.append(_ask(hop, "multi_hop", F.concat_ws("|", "period", "st", "rock"), hop_text, "all", F.col("items"), n, seed, "geolex"))
    many = placed.groupBy("period", "st").agg(F.countDistinct("key").alias("units")).where(F.col("units").between(5, 80))
    many_text = F.concat(F.lit("How many "), F.col("period"), F.lit(" units occur in "), state[F.col("st")], F.lit("?"))
    out.append(_ask(many, "count", F.concat_ws("|", "period", "st"), many_text, "count", None, n, seed, "geolex", F.col("units")))
    return reduce(DataFrame.unionByName, out)


def descriptive_candidates(passages: DataFrame, units: DataFrame) -> DataFrame:
    """Passages of 300 to 1,500 characters that a model may be asked to write a question on."""
    return passages.where(F.length("text").between(300, 1500)).join(units.select(F.col("key").alias("unit_key"), "full_name"), "unit_key")


def names_its_unit(question: Column, full_name: Column) -> Column:
    return F.contains(F.lower(question), F.lower(F.get(F.split(full_name, " "), F.lit(0))))


def perplexity(losses: DataFrame) -> DataFrame:
    """exp of the mean of the batches' mean losses, by run."""
    return losses.groupBy("run").agg(F.round(F.exp(F.avg("loss")), 4).alias("perplexity"))


def perplexity_change(before: Column, after: Column) -> Column:
    """Improvement in percent (one decimal); negative is forgetting."""
    return F.round(100 * F.try_divide(before - after, before), 1)


def probe_summary(probes: DataFrame) -> DataFrame:
    """accuracy and mean margin of the answer over the best distractor (answer_score, distractor_scores)."""
    margin = F.col("answer_score") - F.array_max("distractor_scores")
    return probes.agg(F.count("*").alias("n"), F.round(F.avg((margin > 0).cast("double")), 4).alias("accuracy"), F.round(F.avg(margin), 4).alias("mean_margin"))


def comparison(runs: DataFrame, arm: str, value: str) -> DataFrame:
    """Mean, deviation and half the 95 % interval of a value over each arm's runs."""
    sd, n = F.stddev_samp(value), F.count(value)
    return runs.groupBy(arm).agg(n.alias("runs"), F.round(F.avg(value), 4).alias("mean"), F.round(sd, 4).alias("sd"), F.round(1.96 * sd / F.sqrt(n), 4).alias("ci95"))


def prompt_completion(messages: Column) -> Column:
    """struct<prompt, completion> for trainers that want the last turn apart."""
    return F.struct(F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))).alias("prompt"), F.try_element_at(messages, F.lit(-1)).alias("completion"))


def newest(checkpoints: DataFrame, run: str, step: str, n: int) -> DataFrame:
    """The last ``n`` checkpoints of each run by step number."""
    return checkpoints.withColumn("nth", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))).where(F.col("nth") <= n).drop("nth")


def patched_gold(gold: DataFrame, fixes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Gold rows with reviewed fields: a fix's value where it has one; rows with a fix count as reviewed."""
    renamed = fixes.select(key, *[F.col(f).alias(f"fix_{f}") for f in fields], F.lit(True).alias("fixed"))
    out = gold.join(renamed, key, "left").withColumns({f: F.coalesce(f"fix_{f}", f) for f in fields})
    return out.withColumn("reviewed", F.coalesce("fixed", F.lit(False))).drop("fixed", *[f"fix_{f}" for f in fields])


def gold_rows(gold: DataFrame) -> DataFrame:
    """Reviewed rows, or all if none is reviewed."""
    reviewed = gold.where("reviewed")
    return gold if reviewed.isEmpty() else reviewed


def run_table(summaries: DataFrame, evaluations: DataFrame) -> DataFrame:
    """run, iters_done, best_val_loss, test_loss, macro_f1, parse_rate, wall_minutes, alerts: a row a run, evaluated or not.

    ``summaries`` has run and the summary's fields (``alerts`` as an array), ``evaluations`` run, system,
    macro_f1 and parse_rate; of a run's systems the tuned one counts, else the base.
    """
    best = evaluations.groupBy("run").agg(F.min_by(F.struct("macro_f1", "parse_rate"), F.when(F.col("system") == "tuned", 0).otherwise(1)).alias("x"))
    joined = summaries.join(best, "run", "left")
    return joined.select(
        "run", "iters_done", F.round("best_val_loss", 4).alias("best_val_loss"), F.round("test_loss", 4).alias("test_loss"), F.round("x.macro_f1", 3).alias("macro_f1"),
        F.round("x.parse_rate", 3).alias("parse_rate"), F.round("wall_minutes", 1).alias("wall_minutes"), F.coalesce(F.size("alerts"), F.lit(0)).alias("alerts"),
    )
