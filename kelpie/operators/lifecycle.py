"""The two corpus builds as one plan each: labelled training rows of passages, and a pretraining corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import facts
from kelpie.operators import dedup, quality, splits, tagging, tokens
from kelpie.scratch import cut


def training_rows(passages: DataFrame, vocabularies: dict[str, DataFrame], heads: DataFrame, least_filled: int = 2, test: float = 0.1, valid: float = 0.1, seed: int = 17) -> DataFrame:
    """ord, unit_id, unit_name, passage, target, messages, source_url, ref_year, split.

    First copies are labelled (a first copy of low signal is dropped with its copies), rows of under
    ``least_filled`` facts go, and all rows of a unit are in one split.
    """
    unique = dedup.exact(passages, "ord", "passage")
    labelled = unique.join(tagging.label(unique, vocabularies, heads, "ord"), "ord")
    good = cut(labelled.where(facts.filled_fields(F.col("target")) >= least_filled))
    made = splits.group_split(good, "unit_id", test, valid, seed)
    json_text = facts.extraction_json(F.col("target"))
    return made.withColumn("messages", facts.messages(F.col("passage"), json_text)).select(
        "ord", "unit_id", "unit_name", "passage", "target", "messages", "source_url", "ref_year", "split"
    )


def same_prompt(rows: DataFrame) -> Column:
    """Whether a training row's turns before the last equal those that inference would send."""
    asked = facts.messages(F.col("passage"))
    return F.slice("messages", 1, F.size("messages") - 1) == asked


def dataset_card(passages: DataFrame, rows: DataFrame) -> DataFrame:
    """passages in, rows kept, and rows and units of each split."""
    n = F.count("*").alias
    every = Window.partitionBy()
    card = rows.groupBy("split").agg(n("rows"), F.countDistinct("unit_id").alias("units"))
    return card.withColumn("kept", F.sum("rows").over(every)).withColumn("passages", F.lit(passages.count()).cast("long"))


def pretraining_corpus(domain: DataFrame, general: DataFrame, replay: float = 0.15, held_out: int = 300, near: bool = True, seed: int = 17, **limits) -> dict[str, DataFrame]:
    """train (with origin and shuffle_key), valid and card, from domain and general documents (doc_id, text).

    The order matters: rejects go before duplicates are looked for, validation documents leave
    before the mix, and general text only ever joins the training part.
    """
    kept = quality.kept(domain, **limits)
    unique = cut(dedup.near(kept) if near else dedup.exact_by_words(kept))
    train, valid = splits.hold_out(unique, "doc_id", held_out, seed)
    train, valid = cut(train), cut(valid)
    mixed = cut(splits.replay_mix(train, general, "doc_id", replay, seed))
    card = mixed.groupBy("origin").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))
    card = card.withColumn("tokens_estimate", F.floor(F.col("chars") / 4)).withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 3))
    return {"train": mixed, "valid": valid, "card": card}


def sub_sampled(rows: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """``rows`` (with ``split``) with only ``n`` training rows, lowest by seed; other splits are unchanged."""
    return rows.where("split <> 'train'").unionByName(splits.sample(rows.where("split = 'train'"), key, n, seed))


def forgetting_probe(texts: DataFrame, key: str, order: str, n_docs: int, encode, block: int, eos: int) -> DataFrame:
    """(block, tokens) of the first ``n_docs`` documents joined from texts of a corpus that is neither trained on nor replayed.

    ``encode`` maps a text column to its tokens. Rescoring the blocks before and after is a model's work;
    see ``evaluation.perplexity`` and ``perplexity_change``.
    """
    docs = tokens.greedy_documents(texts, key, order).orderBy(key, "nth").limit(n_docs)
    numbered = docs.withColumn("doc_id", F.row_number().over(Window.orderBy(key, "nth")))  # at most n_docs rows
    return tokens.pack_stream(numbered.select("doc_id", encode(F.col("text")).alias("tokens")), block, eos)
