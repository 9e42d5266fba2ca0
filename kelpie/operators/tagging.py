"""Gazetteers and the longest-match phrase tagger, relation filtering, labelling, linking, probes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import facts, fixed, text
from kelpie.operators import splits
from kelpie.scratch import cut

PLURALS = ("s", "es")
#: A gazetteer is sent to the tasks only up to so many entries; larger ones are joined.
SENT_ENTRIES = 500_000
_WORD = re.compile(text.WORD)


def gazetteer(entries: DataFrame, plurals: bool = False) -> DataFrame:
    """(phrase, canonical) from (surface, canonical, ord): the first entry owns a phrase, before its plurals."""
    keyed = entries.select(F.lower(F.trim("surface")).alias("phrase"), "canonical", "ord").where("phrase <> ''")
    forms = [(0, F.col("phrase")), *[(i + 1, F.concat("phrase", F.lit(s))) for i, s in enumerate(PLURALS if plurals else ())]]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("form"), p.alias("phrase")) for i, p in forms])).alias("x")
    spread = keyed.select("canonical", "ord", each).select("x.phrase", "x.form", "canonical", "ord")
    return spread.groupBy("phrase").agg(F.min_by("canonical", F.struct("ord", "form")).alias("canonical"))


HITS = "canonical string, start int, end int, surface string"


def longest_matches(passage: str, table: dict[str, str], most: int = 4) -> list[tuple[str, int, int, str]]:
    """Longest phrases from left to right without overlap; words are joined by single spaces whatever is between."""
    spans = [m.span() for m in _WORD.finditer(passage)]
    low = [passage[a:b].lower() for a, b in spans]
    out, free = [], 0
    for i, (start, _) in enumerate(spans):
        sizes = range(min(most, len(spans) - i), 0, -1) if i >= free else ()
        size = next((n for n in sizes if " ".join(low[i : i + n]) in table), 0)
        if size:
            free, end = i + size, spans[i + size - 1][1]
            out.append((table[" ".join(low[i:free])], start, end, passage[start:end]))
    return out


def tag(docs: DataFrame, table: DataFrame, id_col: str = "id", text_col: str = "text", most: int = 4) -> DataFrame:
    """(id, canonical, start, end, surface): a row for each hit. Offsets are code points.

    Up to ``SENT_ENTRIES`` entries are sent to the tasks, which is found out while they are fetched;
    a larger gazetteer is joined, with the same rows.
    """
    entries = table.limit(SENT_ENTRIES + 1).collect()
    if len(entries) > SENT_ENTRIES:
        return tag_joined(docs, table, id_col, text_col, most)
    sent = docs.sparkSession.sparkContext.broadcast({r["phrase"]: r["canonical"] for r in entries})
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *h) for i, t in zip(batch["id"], batch["text"], strict=True) if t for h in longest_matches(t, sent.value, most)]
            yield pd.DataFrame(rows, columns=["id", "canonical", "start", "end", "surface"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, {HITS}")
    return out.withColumnRenamed("id", id_col)


def tag_joined(docs: DataFrame, table: DataFrame, id_col: str = "id", text_col: str = "text", most: int = 4) -> DataFrame:
    """The same rows as :func:`tag` for a gazetteer of any size, which is joined to all n-grams. Ids are unique.

    Hits are put in order within each document, the longest first at a word, and streamed: those that
    begin after the last kept one's end stay, which equals the scan.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, passage in zip(batch["id"], batch["text"], strict=True):
                spans = [m.span() for m in _WORD.finditer(passage or "")]
                low = [passage[a:b].lower() for a, b in spans]
                rows = [(i, at, n, " ".join(low[at : at + n]), spans[at][0], spans[at + n - 1][1]) for at in range(len(spans)) for n in range(1, min(most, len(spans) - at) + 1)]
                rows = [(*r, passage[r[4] : r[5]]) for r in rows]
                yield pd.DataFrame(rows, columns=["id", "at", "n", "phrase", "start", "end", "surface"])

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free = None, 0
        for batch in batches:
            keep = []
            for k, (i, at, n) in enumerate(zip(batch["id"], batch["at"], batch["n"], strict=True)):
                if i != current:
                    current, free = i, 0
                if at >= free:
                    free = at + n
                    keep.append(k)
            yield batch.iloc[keep][["id", "canonical", "start", "end", "surface"]]

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = texts.mapInPandas(grams, f"id {kind}, at int, n int, phrase string, start int, end int, surface string")
    hits = made.join(table, "phrase").select("id", "at", "n", "canonical", "start", "end", "surface")
    ordered = hits.repartition("id").sortWithinPartitions("id", "at", F.desc("n"))
    return ordered.mapInPandas(kept, f"id {kind}, {HITS}").withColumnRenamed("id", id_col)


def values(hits: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, values): each document's sorted distinct canonicals."""
    return hits.groupBy(id_col).agg(F.array_sort(F.collect_set("canonical")).alias("values"))


def state_entries(spark) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(fixed.STATES.items())], "surface string, canonical string, ord int")


def relations(passages: DataFrame, heads: DataFrame, id_col: str = "id", text_col: str = "passage", self_col: str | None = None) -> DataFrame:
    """(id, relations): relation phrases whose unit begins with a known name (``heads``: name), one of each kind and unit.

    Stop names, heads of under four letters and the unit's own name are no relations.
    """
    own = F.lower(F.col(self_col)) if self_col else F.lit(None).cast("string")
    each = passages.select(F.col(id_col).alias("id"), own.alias("own"), F.posexplode(facts.relation_candidates(F.col(text_col))).alias("pos", "r"))
    each = each.select("id", "own", "pos", F.col("r.kind").alias("kind"), F.col("r.unit").alias("unit"))
    each = each.withColumn("head", facts.head_word(F.col("unit")))
    good = each.where(~F.col("head").isin(*fixed.STOP_NAMES) & (F.length("head") >= 4) & ~F.coalesce(F.lower("head") == F.col("own"), F.lit(False)))
    good = good.join(heads.select(F.col("name").alias("head")).distinct(), "head", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "unit"))), lambda x: F.struct(x["kind"].alias("kind"), x["unit"].alias("unit")))
    return good.groupBy("id").agg(facts.sorted_relations(ordered).alias("relations")).withColumnRenamed("id", id_col)


def label(passages: DataFrame, vocabularies: dict[str, DataFrame], heads: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, target): the extraction of each passage (columns passage, unit_name).

    ``vocabularies`` has the gazetteers of lithologies, chronostrat, minerals and states.
    """
    named = passages.select(F.col(id_col).alias("id"), "passage", facts.subject(F.col("passage"), F.col("unit_name")).alias("unit_name"))
    out = named
    for field in fixed.LIST_FIELDS:
        out = out.join(values(tag(named, vocabularies[field], "id", "passage")).withColumnRenamed("values", field), "id", "left")
    out = out.join(relations(named, heads, "id", "passage", "unit_name"), "id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    none = F.expr("cast(array() AS array<struct<kind:string,unit:string>>)")
    return out.select(
        F.col("id").alias(id_col),
        F.struct(
            "unit_name", facts.infer_rank(F.col("passage"), F.col("unit_name")).alias("rank"), *[empty(c) for c in fixed.LIST_FIELDS[:3]],
            facts.thickness(F.col("passage")).alias("thickness"), F.coalesce("relations", none).alias("relations"), empty("states"),
        ).alias("target"),
    )


def agreement(labelled: DataFrame) -> DataFrame:
    """Audit of the rules against curated columns: target, age_description, states.

    Percentages of filled fields and kept names (one decimal), share of passages with an interval
    that shares a word with the curated age (null if there are none), precision and recall of states
    (three decimals, 0 without any).
    """
    t, n = F.col("target"), F.greatest(F.count("*"), F.lit(1))
    percent = lambda cond: F.round(100 * F.count_if(F.coalesce(cond, F.lit(False))) / n, 1)
    aged = (F.size(text.long_words(F.col("age_description"))) > 0) & (F.size(t["chronostrat"]) > 0)
    agrees = aged & F.arrays_overlap(text.long_words(t["chronostrat"]), text.long_words(F.col("age_description")))
    curated = F.array_distinct(F.coalesce("states", F.array().cast("array<string>")))
    tp = F.sum(F.size(F.array_intersect(t["states"], curated)))
    fp, fn = F.sum(F.size(F.array_except(t["states"], curated))), F.sum(F.size(F.array_except(curated, t["states"])))
    share = lambda a, b: F.coalesce(F.round(F.try_divide(a, a + b), 3), F.lit(0.0))
    return labelled.agg(
        F.count("*").alias("n_passages"),
        percent(t["unit_name"].isNotNull()).alias("unit_name_kept_pct"),
        F.round(F.try_divide(100 * F.count_if(F.coalesce(agrees, F.lit(False))), F.count_if(F.coalesce(aged, F.lit(False)))), 1).alias("chronostrat_consistency_pct"),
        share(tp, fp).alias("states_precision"),
        share(tp, fn).alias("states_recall"),
        *[percent(F.size(t[c]) > 0).alias(f"{c}_pct") for c in ("lithologies", "chronostrat", "minerals", "relations", "states")],
        percent(t["thickness"].isNotNull()).alias("thickness_pct"),
        percent(t["rank"] != "Unknown").alias("rank_pct"),
    )


def vocabulary_filters(intervals: DataFrame, minerals: DataFrame, strat_names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Intervals (name, rank, t_age, b_age) of the five ranks and earthly timescales, minerals of 5, names of 4 letters or more."""
    scales = F.lower(F.array_join(F.transform("timescales", lambda s: F.coalesce(s["name"], F.lit(""))), " "))
    alien = F.coalesce(scales, F.lit("")).rlike("|".join(fixed.NON_TERRESTRIAL))
    chrono = intervals.where(F.col("int_type").isin(*fixed.CHRONO_RANKS) & ~alien).select("name", F.col("int_type").alias("rank"), "t_age", "b_age")
    return chrono, minerals.where(F.length("mineral") >= 5).select("mineral").distinct(), strat_names.where(F.length("strat_name") >= 4).select("strat_name").distinct()


def surface_index(units: DataFrame) -> DataFrame:
    """(form, key): names, full names and aliases in lower case and as cores, of three letters or more."""
    names = F.array_distinct(F.concat(F.array("name", "full_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    each = units.select("key", F.explode(names).alias("n"))
    forms = each.select("key", F.explode(F.array(F.lower("n"), text.core_name(F.col("n")))).alias("form"))
    return forms.where("length(form) >= 3").distinct()


class Linker:
    """Links questions to the units, intervals, states and lithologies of one graph.

    The longest phrase wins; of equal ones a state before an interval, a unit (capital required), a
    rock. A unit's phrase takes rank and rock words that follow it. Of homonyms curated ones go
    first, then those in a state of the question; three at most, by key.
    """

    def __init__(self, units: list[dict], intervals: list[str], lithologies: list[str], forms: dict[str, set[str]], most: int = 6):
        self.most, self.by_key = most, {u["key"]: u for u in units}
        self.states = {k: v for k, v in fixed.STATES.items() if k != "alaska peninsula"}
        named = {i.lower(): i for i in intervals}
        rocks = {r + s: r for s in ("s", "") for r in lithologies}
        self.kinds = (("states", self.states), ("intervals", named), ("units", forms), ("lithologies", rocks))
        self.tails = {*fixed.RANK_WORDS, *fixed.LITH_AS_RANK, "serie"}

    def readings(self, words: list[str], low: list[str]) -> Iterator[tuple]:
        """All phrases that mean something, by place, the longest first."""
        for i in range(len(words)):
            for n in range(min(self.most, len(words) - i), 0, -1):
                phrase = " ".join(low[i : i + n])
                fits = {"states": True, "intervals": True, "units": words[i][0].isupper(), "lithologies": n == 1}
                meant = next(((k, known[phrase]) for k, known in self.kinds if phrase in known and fits[k]), None)
                if meant:
                    yield i, n, *meant

    def link(self, question: str | None) -> dict[str, list]:
        words = _WORD.findall(question or "")
        low = [w.lower() for w in words]
        found: dict[str, list] = {k: [] for k, _ in self.kinds}
        free = 0
        for i, n, kind, meaning in self.readings(words, low):
            if i >= free:
                free = i + n
                if kind == "units":
                    free += next((j for j, w in enumerate(low[free:]) if w.rstrip("s") not in self.tails), len(low) - free)
                found[kind].append(meaning)
        codes = set(self.states.values())
        found["states"] += [w for w in words if w in codes]
        chosen: list[str] = []
        for keys in found["units"]:
            rank = lambda u: (not u["geolex"], not set(u["states"]) & set(found["states"]), u["key"])
            ordered = sorted((self.by_key[k] for k in keys), key=rank)
            chosen += [u["key"] for u in ordered if rank(u)[:2] == rank(ordered[0])[:2]][:3]
        return {k: list(dict.fromkeys(chosen if k == "units" else v)) for k, v in found.items()}


def link(question: str, units: list[dict], intervals: list[str], lithologies: list[str], forms: dict[str, set[str]], most: int = 6) -> dict[str, list]:
    """Entities of one question: units, intervals, states, lithologies; see :class:`Linker`."""
    return Linker(units, intervals, lithologies, forms, most).link(question)


def link_all(questions: DataFrame, units: DataFrame, intervals: DataFrame, lithologies: DataFrame, id_col: str = "id", text_col: str = "question") -> DataFrame:
    """(id, units, intervals, states, lithologies): the entities of each question of a table; null has none.

    ``units`` has key, name, full_name, aliases, geolex and states, the others a column name. One
    graph's names are sent to the tasks; over ``SENT_ENTRIES`` forms it is an error.
    """
    index = surface_index(units).groupBy("form").agg(F.collect_set("key").alias("keys")).limit(SENT_ENTRIES + 1).collect()
    if len(index) > SENT_ENTRIES:
        raise ValueError(f"over {SENT_ENTRIES} names: link against fewer units")
    known = [r.asDict() for r in units.select("key", "geolex", F.coalesce("states", F.array().cast("array<string>")).alias("states")).collect()]
    names = [[r["name"] for r in t.select("name").distinct().limit(SENT_ENTRIES).collect()] for t in (intervals, lithologies)]
    sent = questions.sparkSession.sparkContext.broadcast(Linker(known, *names, {r["form"]: set(r["keys"]) for r in index}))
    fields = ["units", "intervals", "states", "lithologies"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sent.value.link(q) for q in batch["question"]]
            yield pd.DataFrame({"id": batch["id"], **{f: [x[f] for x in found] for f in fields}})

    kind = questions.schema[id_col].dataType.simpleString()
    out = questions.select(F.col(id_col).alias("id"), F.col(text_col).alias("question")).mapInPandas(run, f"id {kind}, " + ", ".join(f"{f} array<string>" for f in fields))
    return out.withColumnRenamed("id", id_col)


def cloze_probes(docs: DataFrame, vocabulary: DataFrame, n: int, distractors: int = 3, seed: int = 17, order: str = "ord", text_col: str = "text") -> DataFrame:
    """(ord, prompt, answer, distractors): of each document the first sentence of 8 words or more with a term after 20 characters.

    The term is drawn by hash among the sentence's. Distractors are the terms that follow a place drawn
    by the document's hash, in the seeded order of all terms, so that a probe meets so many terms only.
    The first ``n`` documents with a probe.
    """
    sents = docs.select(F.col(order).alias("ord"), F.posexplode(facts.sentences(F.col(text_col))).alias("nth", "sent"))
    words = F.regexp_extract_all("sent", F.lit(r"[A-Za-z][A-Za-z\-]+"), F.lit(0))
    terms = cut(vocabulary.select(F.lower("term").alias("low"), "term").groupBy("low").agg(F.min("term").alias("term")))
    hits = sents.where(F.size(words) >= 8).select("ord", "nth", "sent", F.explode(F.array_distinct(words)).alias("word"))
    hits = hits.join(terms, F.lower("word") == F.col("low"))
    drawn = hits.groupBy("ord", "nth").agg(F.min_by(F.struct("sent", "word", "low"), F.md5(F.concat_ws("|", F.lit(str(seed)), "ord", "nth", "word"))).alias("x"))
    drawn = drawn.select("ord", "nth", "x.*").where(F.instr("sent", F.col("word")) > 21)
    firsts = drawn.groupBy("ord").agg(F.min_by(F.struct("sent", "word", "low"), "nth").alias("x")).select("ord", "x.*").orderBy("ord").limit(n)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("ord").cast("string"))), 1, 8), 16, 10).cast("long")
    asked = firsts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(distractors)))).withColumn("place", F.pmod(start + F.col("k"), F.lit(max(1, terms.count())).cast("long")))
    others = splits.ranked(terms.select("term", F.col("low").alias("other")), "term", seed).select("term", "other", F.col("place").cast("long").alias("place"))
    met = asked.join(others, "place").where("other <> low").groupBy("ord", "sent", "word")
    picked = met.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), 1, distractors).alias("distractors"))
    prompt = F.trim(F.expr("substring(sent, 1, instr(sent, word) - 1)"))
    return picked.where(F.size(F.array_distinct("distractors")) == distractors).select("ord", prompt.alias("prompt"), F.col("word").alias("answer"), "distractors")


def ordinal(rows: DataFrame, group: str, order: str) -> Column:
    """The row's number in its group, from 0."""
    return F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
