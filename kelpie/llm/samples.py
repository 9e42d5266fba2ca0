"""Bounded, deterministic samples of labelled rows, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text of over ``PIECES * WIDTH`` characters is learned from by so many pieces of ``WIDTH`` characters.
PIECES, WIDTH = 4, 512


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus))


def pieces_of(text: Column, seed: int) -> Column:
    """The whole text as one piece, or of a long one a piece at a drawn place in each of ``PIECES`` equal parts."""
    part = F.floor(F.length(text) / PIECES).cast("int")

    def piece(i: Column) -> Column:
        at = i * part + F.pmod(F.xxhash64(F.lit(seed), i, text), part - WIDTH + 1).cast("int")
        return F.substring(text, at + 1, F.lit(WIDTH))

    return F.when(F.length(text) <= PIECES * WIDTH, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece))


def below_threshold(rows: DataFrame, label: str, wanted: int, rank: Column) -> tuple[Column | None, int]:
    """Keeps all rows of a label of up to ``2 * wanted``, else about so many, by ``rank``; and the number of labels.

    Only the labels' counts come to the driver (of distinct ids, so that rows that share one are
    no more than one); None if there are no labelled rows.
    """
    found = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("n"))
    counts, below = {r[label]: r["n"] for r in found.collect()}, F.lit(False)
    for value, n in sorted(counts.items()):
        most = (1 << 63) - 1 if n <= 2 * wanted else int(((2 * wanted / n) - 0.5) * 2.0**64)
        most = max(-(1 << 63), min((1 << 63) - 1, most))
        below |= (F.col(label) == F.lit(value)) & (rank <= F.lit(most))
    return (below if counts else None), len(counts)


def sample_by_label(rows: DataFrame, label: str, wanted: int, seed: int = 5, texts: DataFrame | None = None) -> dict:
    """{label: [[piece, ...], ...]}: at most ``wanted`` distinct texts of each label, as :func:`pieces_of` cuts them.

    ``rows`` has id, the label column and text, or its texts are in ``texts`` (id, text); then the
    chosen rows, about twice the wanted ones of each label, are joined to it. At most four times the
    wanted rows of each label come to the driver, whatever the size of the tables and however often
    ids or texts repeat; the lowest hashes are taken first. Rows with a null label or text are left
    out, no rows give an empty result. Labels are the caller's few classes.
    """
    if texts is None:
        rows = rows.where(F.col("text").isNotNull())
    chosen, labels = below_threshold(rows, label, wanted, F.xxhash64(F.lit(seed), "id"))
    if chosen is None:
        return {}
    taken = rows.where(F.col(label).isNotNull() & chosen)
    if texts is not None:
        taken = texts.where(F.col("text").isNotNull()).join(F.broadcast(taken.select("id", label).distinct()), "id")
    taken = taken.select(label, F.xxhash64(F.lit(seed), "id", "text").alias("rank"), pieces_of(F.col("text"), seed).alias("pieces"))
    taken = taken.groupBy(label, "rank").agg(F.min("pieces").alias("pieces"))  # repeated rows are one
    taken = taken.orderBy("rank", label, "pieces").limit(4 * wanted * labels).collect()
    out: dict = {value: [] for value in sorted({r[label] for r in taken})}
    seen = set()
    for r in taken:
        key = (r[label], *r["pieces"])
        if len(out[r[label]]) < wanted and key not in seen:
            seen.add(key)
            out[r[label]].append(list(r["pieces"]))
    return out
