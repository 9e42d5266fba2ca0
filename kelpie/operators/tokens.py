"""Token blocks, training pairs, fertility and vocabulary candidates. Tokenisers are plug-in column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import WORD

#: Documents of a range that is numbered on its own, about, and ranges at most; ranges are put one after another.
RANGE_ROWS, RANGES = 50_000, 1024


def stream_offsets(docs: DataFrame, order: str, size: str) -> DataFrame:
    """``docs`` with ``offset``: the sum of ``size`` of all documents before, in ``order`` (a number, not null).

    Documents are dealt to ranges of about equal numbers, at approximate quantiles of the order; their
    sums (at most ``RANGES`` rows) are added up first, then each range adds up its own, so no task
    sees all documents, however the numbers are spread.
    """
    ranges = min(RANGES, -(-docs.count() // RANGE_ROWS))
    edges = docs.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    at = docs.withColumn("range", F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e <= F.col(order))) if edges else F.lit(0))
    totals = at.groupBy("range").agg(F.sum(size).alias("total"))
    base = F.sum("total").over(Window.orderBy("range")) - F.col("total")
    totals = totals.select("range", base.alias("base"))
    inner = F.sum(size).over(Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return at.withColumn("inner", inner).join(F.broadcast(totals), "range").withColumn("offset", F.col("base") + F.col("inner")).drop("range", "inner", "base")


def pack_stream(docs: DataFrame, block: int, eos: int | None, order: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(block, tokens): documents in order, each with ``eos`` after it, as one stream cut in full blocks; the rest is dropped.

    Blocks are put together from slices of documents, not from single tokens.
    """
    ended = F.col(tokens) if eos is None else F.concat(F.col(tokens), F.array(F.lit(eos)))
    sized = docs.select(F.col(order).alias("ord"), ended.alias("t")).withColumn("n", F.size("t").cast("long")).where("n > 0")
    at = stream_offsets(sized.select("ord", "n"), "ord", "n").withColumnRenamed("n", "length")
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("n") - 1) / block)
    pieces = sized.join(at.select("ord", "offset"), "ord").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("offset"), F.col("block") * block)
    end = F.least(F.col("offset") + F.col("n"), F.col("block") * block + block)
    piece = F.slice("t", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int"))
    pieces = pieces.select("block", begin.alias("at"), piece.alias("part"))
    built = pieces.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("tokens"))
    return built.where(F.size("tokens") == block)


def pack_separate(docs: DataFrame, block: int, eos: int | None, order: str = "doc_id", tokens: str = "tokens", add_eos: bool = True) -> DataFrame:
    """(ord, nth, tokens): blocks of single documents, padded with ``eos``; without one, short blocks are left out."""
    ended = F.concat(F.col(tokens), F.array(F.lit(eos))) if eos is not None and add_eos else F.col(tokens)
    rows = docs.select(F.col(order).alias("ord"), ended.alias("t")).where(F.size("t") > 0)
    rows = rows.select("ord", "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / block).cast("int"))).alias("nth"))
    part = F.slice("t", F.col("nth") * block + 1, block)
    if eos is None:
        return rows.select("ord", "nth", part.alias("tokens")).where(F.size("tokens") == block)
    return rows.select("ord", "nth", F.concat(part, F.array_repeat(F.lit(eos), block - F.size(part))).alias("tokens"))


def pack_stats(docs: DataFrame, block: int, add_eos: bool = True, separate: bool = False, has_eos: bool = True, tokens: str = "tokens") -> DataFrame:
    """documents, tokens, blocks, padding, dropped tail, retention and efficiency in percent (two decimals), from sizes alone."""
    n = F.size(tokens) + (1 if add_eos and has_eos else 0)
    if separate:
        whole = F.ceil(n / block) if has_eos else F.floor(n / block)
        held = n if has_eos else whole * block
        sums = docs.agg(F.count("*").alias("documents"), F.sum(n).cast("long").alias("tokens"), F.sum(whole).cast("long").alias("blocks"), F.sum(held).cast("long").alias("real"))
    else:
        sums = docs.agg(F.count("*").alias("documents"), F.sum(n).cast("long").alias("tokens")).withColumn("blocks", F.floor(F.col("tokens") / block))
        sums = sums.withColumn("real", F.col("blocks") * block)
    size = F.col("blocks") * block
    return sums.select(
        "documents", "tokens", "blocks", (size - F.col("real")).alias("padding_tokens"), (F.col("tokens") - F.col("real")).alias("dropped_tail_tokens"),
        F.round(100 * F.col("real") / F.greatest("tokens", F.lit(1)), 2).alias("retention_pct"),
        F.round(100 * F.col("real") / F.greatest(size, F.lit(1)), 2).alias("efficiency_pct"),
    )


def shifted(tokens: Column) -> tuple[Column, Column]:
    """(inputs, targets): all but the last token, all but the first."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, 1, n), F.slice(tokens, 2, n)


def prompt_and_answer(prompt: Column, answer: Column, eos: int) -> Column:
    """struct<tokens, loss_from>: prompt, answer and end as one sequence, and where the loss begins."""
    return F.struct(F.concat(prompt, answer, F.array(F.lit(eos))).alias("tokens"), F.size(prompt).alias("loss_from"))


def greedy_documents(texts: DataFrame, key: str, order: str, least: int = 1500, text_col: str = "text") -> DataFrame:
    """(key, nth, text): texts of each shard (``key``) joined in order until over ``least`` characters; what is left over goes.

    Each shard's texts pass one task in order, which holds no more than one document of them.
    """
    kind = texts.schema[key].dataType.simpleString()

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, size, nth = None, [], 0, 0
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["t"], strict=True):
                if k != shard:
                    shard, held, size, nth = k, [], 0, 0
                held.append(t)
                size += len(t)
                if size > least:
                    out.append((k, nth, " ".join(held)))
                    held, size, nth = [], 0, nth + 1
            yield pd.DataFrame(out, columns=[key, "nth", "text"])

    rows = texts.select(F.col(key).alias("key"), F.col(order).alias("at"), F.trim(text_col).alias("t")).where("t <> ''")
    return rows.repartition("key").sortWithinPartitions("key", "at", "t").mapInPandas(join, f"`{key}` {kind}, nth int, text string")


def fertility(rows: DataFrame, text_col: str, encode: Callable[[Column], Column], words: str = r"\S+") -> DataFrame:
    """tokens, words and their ratio (three decimals); ``encode`` maps texts to arrays."""
    sums = rows.agg(F.sum(F.size(encode(F.col(text_col)))).cast("long").alias("tokens"), F.sum(F.regexp_count(text_col, F.lit(words))).cast("long").alias("words"))
    return sums.withColumn("fertility", F.round(F.try_divide("tokens", "words"), 3))


def word_table(docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, freq, surface): counts without letter case, and the most frequent written form (ties: by alphabet)."""
    each = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).alias("surface"))
    forms = each.groupBy("surface").agg(F.count("*").alias("n"))
    ranked = forms.groupBy(F.lower("surface").alias("word")).agg(F.sum("n").alias("freq"), F.min(F.struct((-F.col("n")).alias("m"), "surface")).alias("x"))
    return ranked.select("word", "freq", "x.surface")


def vocabulary_candidates(
    docs: DataFrame, terms: DataFrame, pieces: Callable[[Column], Column], least_freq: int = 20, least_pieces: int = 3, corpus_freq: int = 20, order: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(term, freq, base_tokens, savings, in_gazetteer) by falling savings: words that cost the base tokeniser most.

    Candidates are single words of the gazetteer (``terms``: term) and corpus words of ``corpus_freq``
    or more; the written form is the corpus's most frequent one.
    """
    table = word_table(docs, order, text_col)
    listed = terms.where(~F.col("term").rlike("[ -]")).groupBy(F.lower("term").alias("word")).agg(F.min("term").alias("listed"))
    pool = table.join(listed, "word", "full").select("word", F.coalesce("freq", F.lit(0)).alias("freq"), F.coalesce("surface", "listed", "word").alias("term"), F.col("listed").isNotNull().alias("in_gazetteer"))
    pool = pool.where(F.col("in_gazetteer") | (F.col("freq") >= corpus_freq)).where(F.col("freq") >= least_freq)
    costed = pool.withColumn("base_tokens", F.size(pieces(F.concat(F.lit(" "), F.col("term"))))).where(F.col("base_tokens") >= least_pieces)
    return costed.select("term", "freq", "base_tokens", (F.col("freq") * (F.col("base_tokens") - 1)).alias("savings"), "in_gazetteer").orderBy(F.desc("savings"), "term")


def saving(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """tokens_before, tokens_after, reduction_pct (two decimals) of two encodings."""
    sums = rows.agg(F.sum(F.size(before)).cast("long").alias("tokens_before"), F.sum(F.size(after)).cast("long").alias("tokens_after"))
    return sums.withColumn("reduction_pct", F.round(100 * F.try_divide(F.col("tokens_before") - F.col("tokens_after"), F.col("tokens_before")), 2))


def trainer_input(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq): what a tokeniser's trainer needs; training itself is a plug-in."""
    return word_table(docs, text_col=text_col).select("word", "freq")
