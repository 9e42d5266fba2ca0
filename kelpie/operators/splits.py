"""Seeded splits, samples and mixes. Order by md5 of seed and key replaces a shuffle: it depends on the rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.scratch import cut


def seeded(seed: int, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def ranked(rows: DataFrame, key: str, seed: int, parts: int = 4096) -> DataFrame:
    """``rows`` with ``place``: their number from 0 in the order of md5(seed|key), made without one task for all.

    The first digits of the hash deal rows to ranges; a row's place is the rows of earlier ranges and
    its number in its own.
    """
    hashed = rows.withColumn("h", seeded(seed, key)).withColumn("range", F.conv(F.substring("h", 1, 4), 16, 10).cast("int") * parts / 65536)
    hashed = hashed.withColumn("range", F.floor("range").cast("int"))
    sizes = hashed.groupBy("range").count()
    before = F.sum("count").over(Window.orderBy("range")) - F.col("count")  # at most ``parts`` rows
    sizes = sizes.select("range", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("range").orderBy("h", key)) - 1
    return hashed.withColumn("inner", inner).join(F.broadcast(sizes), "range").withColumn("place", F.col("before") + F.col("inner")).drop("h", "range", "inner", "before")


def group_split(rows: DataFrame, group: str, test: float = 0.1, valid: float = 0.1, seed: int = 17) -> DataFrame:
    """``rows`` with ``split``: int(n * share) of the groups to test, then to valid, the rest to train; no group is in two."""
    groups = rows.select(group).distinct()
    placed = ranked(groups, group, seed)
    n = placed.agg(F.count("*").alias("n"))
    placed = placed.crossJoin(F.broadcast(n))  # one row
    n_test, n_valid = F.floor(F.col("n") * F.lit(test)), F.floor(F.col("n") * F.lit(valid))
    split = F.when(F.col("place") < n_test, "test").when(F.col("place") < n_test + n_valid, "valid").otherwise("train")
    return rows.join(placed.select(F.col(group).alias("of"), split.alias("split")), F.col(group).eqNullSafe(F.col("of"))).drop("of")


def sample(rows: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """The ``n`` rows lowest by md5 of seed and key (all, if fewer)."""
    return rows.orderBy(seeded(seed, key), key).limit(n)


def strict_sample(rows: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """As :func:`sample`, but it is an error to ask for more rows than there are."""
    if (have := rows.count()) < n:
        raise ValueError(f"sample of {n} from {have} rows")
    return sample(rows, key, n, seed)


def gold_slice(split_rows: DataFrame, key: str, n: int = 150, seed: int = 17) -> DataFrame:
    """The first ``n`` test rows in seeded order."""
    return sample(split_rows.where("split = 'test'"), key, n, seed)


def hold_out(docs: DataFrame, key: str, most: int = 300, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(train, validation): min(most, max(n // 10, 1)) documents are held out."""
    n = docs.count()
    placed = ranked(docs, key, seed)
    take = min(most, max(n // 10, 1))
    return placed.where(F.col("place") >= take).drop("place"), placed.where(F.col("place") < take).drop("place")


def replay_count(domain: int, fraction: float) -> int:
    return int(domain * fraction / (1 - fraction)) if fraction > 0 else 0


def replay_mix(domain: DataFrame, general: DataFrame, key: str, fraction: float, seed: int = 17) -> DataFrame:
    """Domain documents and as many general ones as make ``fraction`` of the union, with ``origin``, in seeded order."""
    n = replay_count(domain.count(), fraction)
    extra = ranked(general, key, seed).where(F.col("place") < n).drop("place").withColumn("origin", F.lit("replay"))
    return domain.withColumn("origin", F.lit("domain")).unionByName(extra, allowMissingColumns=True).withColumn("shuffle_key", seeded(seed, key))


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises if two corpora share a key: a corpus must not measure what it also trains."""
    if not left.select(key).join(right.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"corpora share values of {key}")


def without_overlap(docs: DataFrame, guard: DataFrame, words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that share no ``words``-word sequence with a text of ``guard`` (column text)."""
    from kelpie.functions.text import ascii_words

    def grams(df: DataFrame, *keep: str) -> DataFrame:
        w = df.select(*keep, ascii_words(F.col(text_col)).alias("w")).where(F.size("w") >= words)
        each = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.xxhash64(F.slice("w", i, words))))
        return w.select(*keep, each.alias("g"))

    held = cut(grams(guard).distinct())
    hit = grams(docs, id_col).join(held, "g", "left_semi").select(id_col).distinct()
    return docs.join(hit, id_col, "left_anti")


def limit_groups(rows: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """The rows of ``n`` groups drawn by seed."""
    return rows.join(sample(rows.select(group).distinct(), group, n, seed), group, "left_semi")


def per_category(rows: DataFrame, category: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each category in ``order``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(category).orderBy(order))).where(F.col("nth") <= n).drop("nth")
