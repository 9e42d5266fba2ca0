"""Mixing sources to target weights, with DataFrame functions only.

Every source's words, in a pseudorandom order of its documents, are cut into blocks of
``block`` words. The mix is a row of slots in a power of two of output shards. Each shard's counts
by source are a multinomial draw whose sums over all shards are fixed: a source's slots are halved
binomially down a binary tree of shards, with a draw for each node from the seed, so any shard's
counts and slots can be made without the others. Slot j of a source reads block p(j mod blocks)
with a pseudorandom permutation p for each source and epoch: every block is read once before any is
read again, the short block at a source's end last. A source's last slot is cut to what its target
leaves, so the words taken of it are its target, rounded.

Permutations are keyed Feistel networks on a grid of just over n cells with cycle walking, so
no index table is built, sorted or sent anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Each source's documents are ordered within parts, one for so many rows of the table, so that no task orders a whole source.
PART_ROWS = 1000
#: Slots that are made in a task.
MADE = 1 << 20
#: Slots up to which halves are drawn exactly, by so many random bits; beyond by the normal distribution.
BITS = 48


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of ``x`` in the pseudorandom permutation ``key`` of 0 .. n - 1."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(y: Column) -> Column:
        left, right = F.floor(y / b).cast("long"), F.pmod(y, b)
        for r in range(4):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(key, F.lit(r), left), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(key, F.lit(r), right), a), a)
        return left * b + right

    once = step(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda y, _: F.when(y < n, y).otherwise(step(y)))
    return F.when(once < n, once).otherwise(walked)


def halved(n: Column, *key: Column) -> Column:
    """A draw from the binomial distribution of ``n`` tosses of a fair coin, by the hash of ``key``."""
    bits = lambda i: F.xxhash64(*key, F.lit(i))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(BITS)).cast("int")) - 1
    unit = lambda i: (F.pmod(bits(i), F.lit(1 << 52)) + 1) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))
    drawn = F.round(n / 2 + normal * F.sqrt(n.cast("double")) / 2).cast("long")
    return F.when(n <= BITS, F.bit_count(bits(0).bitwiseAND(mask)).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(n, drawn)))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, block: int) -> DataFrame:
    """source, sid, source_size, target, n_full, n_blocks, n_slots, last_words (of the last slot); a row a source.

    Sources by code point, null last, have the ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's size, and what is above goes to the
    others by weight. With sources ordered by cap per weight the capped ones come first, so one
    pass of prefix sums finds the level that the others reach.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("sid", F.row_number().over(order)).withColumn("w", F.element_at(turn, (F.col("sid") - 1) % len(weights) + 1))
    everything = Window.partitionBy()
    sources = sources.withColumns(
        {"cap": most * F.col("source_size").cast("double"), "mass": share * F.sum("source_size").over(everything)}
    )
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("mass") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    sources = sources.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    rest = F.try_divide(
        F.col("mass") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything),
        F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything),
    )
    sources = sources.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", rest * F.col("w"))))
    size, wanted = F.col("source_size"), F.round("target").cast("long")
    whole = F.coalesce(F.call_function("div", wanted, F.nullif(size, F.lit(0))), F.lit(0)).cast("long")
    rest = F.greatest(wanted - whole * size, F.lit(0))
    last = F.ceil(rest / block).cast("long")
    sources = sources.withColumns({"n_full": F.floor(size / block).cast("long"), "n_blocks": F.ceil(size / block).cast("long")})
    return sources.select(
        "source", "sid", "source_size", "target", "n_full", "n_blocks", (whole * F.col("n_blocks") + last).alias("n_slots"),
        F.when(rest > 0, rest - (last - 1) * block).otherwise(block).alias("last_words"),
    )


def placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The documents with ``sid``, ``source_size``, ``target`` and ``start``: the words of their source before them."""
    n_parts = -(-sized.count() // PART_ROWS) or 1
    sized = sized.withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("part", F.pmod("at", F.lit(n_parts)))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")).toDF("s", "p", "part_size")
    base = F.sum("part_size").over(Window.partitionBy("s").orderBy("p")) - F.col("part_size")
    parts = parts.withColumn("base", base).drop("part_size")
    parts = parts.join(sources.select("source", "sid", "source_size", "target"), F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inner = Window.partitionBy("source", "part").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("within", F.sum("size").over(inner) - F.col("size"))
    out = sized.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return out.withColumn("start", F.col("base") + F.col("within")).drop("at", "part", "within", "base", "s", "p")


def drawn(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """Each shard's draw: sid, n_full, n_blocks, n_slots, last_words, shard, first, count (if not 0).

    A source's slots in a shard are ``first`` .. ``first + count - 1``. Counts of a source are a draw
    of its slots over shards of equal chances; a shard has about ``shard`` slots or up to half fewer.
    """
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, total) / shard)))
    low = levels // 2
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << n) - 1)))
    rows = sources.where("n_slots > 0").select("sid", "n_full", "n_blocks", "n_slots", "last_words", numbers(levels - low).alias("high"))
    # A number, so that the few bytes of these rows aren't gathered in one task that then makes all slots.
    rows = rows.repartition(-(-total // MADE) or 1, "sid", "high").select("*", numbers(low).alias("low"))
    rows = rows.withColumn("shard", F.col("high") * (1 << low) + F.col("low")).drop("high", "low")

    def step(held: Column, level: Column) -> Column:
        left = halved(held["n"], F.lit(seed), F.col("sid"), held["node"])
        right = F.call_function("shiftright", F.col("shard"), (F.lit(levels - 1) - level).cast("int")).bitwiseAND(F.lit(1)) == 1
        return F.struct(
            F.when(right, held["n"] - left).otherwise(left).alias("n"), F.when(right, held["first"] + left).otherwise(held["first"]).alias("first"),
            (held["node"] * 2 + F.when(right, 1).otherwise(0)).alias("node"),
        )

    start = F.struct(F.col("n_slots").alias("n"), F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("node"))
    at = F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step) if levels else start
    return rows.withColumn("draw", at).select("*", F.col("draw.first").alias("first"), F.col("draw.n").alias("count")).drop("draw").where(F.col("count") > 0)


def slots(draws: DataFrame, block: int, seed: int) -> DataFrame:
    """sid, block, words (that the slot reads), epoch, shard, place (a key of the order in the shard); a row a slot of the mix."""
    each = draws.withColumn("j", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    each = each.withColumns({"epoch": F.floor(F.col("j") / F.col("n_blocks")), "i": F.pmod("j", "n_blocks")})
    # Sums rather than branches, in which the planner would make each common part again.
    full, short = F.greatest("n_full", F.lit(1)), (F.col("i") >= F.col("n_full")).cast("long")
    at = permuted(F.pmod("i", full), full, F.struct(F.lit(seed), "sid", "epoch")) * (1 - short) + F.col("i") * short
    words = F.when(F.col("j") == F.col("n_slots") - 1, F.col("last_words")).otherwise(block)
    return each.select("sid", at.alias("block"), words.cast("long").alias("words"), "epoch", "shard", F.xxhash64(F.lit(seed), "sid", "j").alias("place"))


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = 32,
    shard: int = 8192,
    seed: int = 17,
    size: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """What the mix reads: a row for each slot and each document of its block.

    Input: doc_id, source, text (or ``size``, a column of sizes); ``carry`` names columns to keep,
    none that is made here (a ValueError). Output: doc_id, source, carried columns, size, sid,
    source_size, target, start (the document's first word in its source), from_word and n_words
    (the piece of the document), block, epoch (how often the block was read before), shard and
    place (a key of the order in the shard). Pieces that no slot reads, that a cut slot leaves out,
    and documents without words have null epoch, shard and place. A null text has size 0, null is a
    source like others, repeated rows are separate documents; an empty table gives no rows. Sources
    are few enough for one task to order a row of each. ``most`` is a whole number: no document is
    read more often. Equal input gives equal output, whatever the partitions.
    """
    if clash := set(carry) & {"doc_id", "source", "size", "sid", "source_size", "target", "start", "from_word", "n_words", "block", "epoch", "shard", "place", "at", "part", "within", "base", "s", "p", "words"}:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    size = words_in(F.col("text")) if size is None else size
    sized = docs.select("doc_id", "source", *carry, size.cast("long").alias("size"))
    if "text" in docs.columns:
        sized = cut(sized)  # three plans read the sizes; the texts are read once
    sources = cut(source_targets(sized.select("source", "size"), weights, share, most, block))
    at = placed(sized, sources, seed)
    last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    first = F.floor(F.col("start") / block).cast("long")
    pieces = at.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    pieces = pieces.withColumns(
        {
            "from_word": begin - F.col("start"),
            "n_words": F.least(F.col("start") + F.col("size"), F.col("block") * block + block) - begin,
        }
    )
    # Both sides come out of explode(), whose output the planner takes for small: never a broadcast.
    met = pieces.join(slots(drawn(sources, shard, seed), block, seed).hint("merge"), ["sid", "block"], "left")
    room = F.coalesce(F.col("block") * block + F.col("words") - F.col("start") - F.col("from_word"), F.lit(0))
    read = {c: F.when(room > 0, F.col(c)) for c in ("epoch", "shard", "place")}
    return met.withColumns(read | {"n_words": F.when(room > 0, F.least("n_words", room)).otherwise(F.col("n_words"))}).drop("words")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and epoch that reads any of its blocks.

    Columns are those of ``docs`` (doc_id, text, source and others, n_chars recomputed if there);
    text has the blocks read in that epoch, in order, with the white space after each word.
    Texts cross the network once: rows are matched by id and a hash of source and text, and
    repeated rows by their number. Documents that no slot reads, null and wordless ones among them,
    are not in the mix; an empty table gives no rows; other columns may have any names.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*place.values())  # so that no column's name clashes with those made here
    doc_id, text, source = (F.col(place[c]) for c in ("doc_id", "text", "source"))
    key = [F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(source, text).alias("k2")]
    sized = cut(inner.select(doc_id.alias("doc_id"), source.alias("source"), *key, words_in(text).alias("size")))
    rows = mixture(sized, size=F.col("size"), carry=("k1", "k2"), **options).where("epoch is not null")
    read = rows.groupBy("k1", "k2", "sid", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("pieces"))
    read = read.withColumn("copy", F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("start")))
    read = read.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "pieces", "copy")
    texts = inner.select("*", *key)
    texts = texts.withColumn("number", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))
    # As a difference, so that the copies' numbers are no join key and the window's exchange serves.
    same = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("number") - F.col("copy") == 0)
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))

    def read_of(held: Column) -> Column:
        part = lambda p: F.array_join(F.slice(held, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")), "")
        return F.array_join(F.transform("pieces", part), "")

    # The words are bound as a variable, else each piece would split the text again.
    out = texts.join(read.hint("merge"), same).withColumn(place["text"], F.get(F.transform(F.array(words), read_of), F.lit(0)))
    if "n_chars" in place:
        out = out.withColumn(place["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*place.values()).toDF(*docs.columns)


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``: what the mix takes of each."""
    rows = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = F.sum(F.when(F.col("epoch").isNotNull(), F.col("n_words")).otherwise(0)).cast("long")
    key = ["doc_id", "source", "size", "source_size", "target"]
    full = rows.where("size > 0").groupBy(*key, "sid", "start").agg(taken.alias("taken")).drop("sid", "start")
    bare = rows.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return full.unionByName(bare)
