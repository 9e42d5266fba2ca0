"""Exact and greedy near-duplicate removal, first in order wins."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.text import alnum_lower, ascii_words, word_key
from kelpie.scratch import cut, drop


def first_of_each(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The row lowest in ``order`` of each ``key``; null keys are one key.

    An aggregate with partial minima finds the firsts (a key with very many rows is summed up
    before the shuffle), and a join by the order column fetches them. The order column must be
    unique and not null: rows without it are left out, of rows that share it all are firsts or none.
    """
    firsts = rows.groupBy(key.alias("dedupe_key")).agg(F.min(order).alias(order)).select(order)
    return rows.join(firsts, order, "left_semi")


def exact(docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose letters and digits no earlier document has; ``order`` is unique and not null."""
    return first_of_each(docs, F.sha1(alnum_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")), order)


def exact_by_words(docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose a-z0-9 words no earlier document has; texts without any are all alike."""
    return first_of_each(docs, F.sha2(word_key(F.coalesce(F.col(text_col), F.lit(""))), 256), order)


def first_by_id(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row of each id across sources: the first to have it owns it."""
    return first_of_each(rows, F.col(id_col), order)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-word shingles; fewer words make one shingle, none an empty array."""


    def of(words: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(some))

    # The words are bound as a variable, else each shingle would split the text again.
    return F.get(F.transform(F.array(ascii_words(text)), of), F.lit(0))


def band_shape(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows) with the least sum of the areas of false positives and false negatives."""
    below, above = np.linspace(0, threshold, 1001), np.linspace(threshold, 1, 1001)
    best = (math.inf, 1, permutations)
    for rows in range(1, permutations + 1):
        for bands in range(1, permutations // rows + 1):
            area = np.trapezoid(1 - (1 - below**rows) ** bands, below) + np.trapezoid((1 - above**rows) ** bands, above)
            best = min(best, (float(area), bands, rows))
    return best[1], best[2]


def signature_udf(permutations: int = 128, k: int = 5, seed: int = 1):
    """A pandas UDF from the 64-bit hashes of a text's words to its MinHash signature; null without words."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    steps = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("array<long>")
    def signature(words: pd.Series) -> pd.Series:
        def one(w):
            if w is None or not len(w):
                return None
            w = np.asarray(w, np.int64).view(np.uint64)
            n = max(1, len(w) - k + 1)
            h = np.zeros(n, np.uint64)
            for i in range(min(k, len(w))):
                h += w[i : i + n] * steps[i]
            h = np.unique(h ^ (h >> np.uint64(29)))
            low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(h), 4096):
                low = np.minimum(low, ((h[i : i + 4096, None] * a + b) >> np.uint64(24)).min(axis=0))
            return low.view(np.int64)

        return words.map(one)

    return signature


def near_cells(docs: DataFrame, threshold: float = 0.8, permutations: int = 128, k: int = 5, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cell): the buckets of each document's signature bands; documents without words have none."""
    bands, rows = band_shape(threshold, permutations)
    signed = docs.select(F.col(order).alias("id"), signature_udf(permutations, k)(F.transform(ascii_words(F.col(text_col)), lambda w: F.xxhash64(w))).alias("sig")).where("sig is not null")
    cells = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))
    return signed.select("id", F.explode(cells).alias("cell"))


def greedy_drop(cells: DataFrame) -> DataFrame:
    """The ids that a scan in order drops: those that share a cell with an id kept before.

    ``cells`` has (id, cell). Cells of one id go first, they decide nothing. Then, in each round, the
    ids that are lowest in all their open cells are kept, and drop all others in these cells; decided
    ids leave, and cells left with one id. The lowest open id is kept in every round, so it ends. Rows
    are memberships, never pairs, and sums are partial first, so a cell with very many members is no
    burden. Only whether rows are left comes to the driver; a round writes two tables.
    """
    shared = lambda rows: rows.join(rows.groupBy("cell").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("cell", "low"), "cell")
    now, dropped = cut(shared(cells.select("id", "cell").distinct())), []
    while not now.isEmpty():
        keep = now.groupBy("id").agg(F.every(F.col("id") == F.col("low")).alias("kept")).where("kept").select(F.col("id").alias("low"))
        closed = now.join(keep, "low", "left_semi").select("cell", "id", "low")
        gone = cut(closed.where("id <> low").select("id").distinct())
        # A closed cell's ids are decided: its lowest is kept and the others are gone.
        rest = now.join(gone, "id", "left_anti").join(keep.withColumnRenamed("low", "id"), "id", "left_anti").select("id", "cell")
        then = cut(shared(rest))
        drop(now)
        now = then
        dropped.append(gone)
    return reduce(DataFrame.unionByName, dropped, now.select("id"))


def near(docs: DataFrame, threshold: float = 0.8, permutations: int = 128, k: int = 5, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents left by exact removal by words, then by the greedy rule on signature bands; ``order`` is unique and not null."""
    unique = exact_by_words(docs, order, text_col)
    gone = greedy_drop(near_cells(unique, threshold, permutations, k, order, text_col))
    return unique.join(gone.withColumnRenamed("id", order), order, "left_anti")


def stats(before: DataFrame, after_exact: DataFrame, after: DataFrame) -> DataFrame:
    """documents_in, exact_removed, near_removed, documents_out, removed_pct (one decimal)."""
    n = before.agg(F.count("*").alias("documents_in")).crossJoin(after_exact.agg(F.count("*").alias("unique"))).crossJoin(after.agg(F.count("*").alias("documents_out")))
    return n.select(
        "documents_in", (F.col("documents_in") - F.col("unique")).alias("exact_removed"), (F.col("unique") - F.col("documents_out")).alias("near_removed"),
        "documents_out", F.round(100 * (F.col("documents_in") - F.col("documents_out")) / F.greatest("documents_in", F.lit(1)), 1).alias("removed_pct"),
    )
