"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union-find.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and a SuperMinHash
   signature: every element walks its own random permutation of the ``m`` slots and offers
   slot p(j) the value j + r; steps go on only until no later step can lower a slot.
2. Texts with equal sets form a class, of which the smallest id takes part further.
3. Bands of ``ROWS`` slots put classes into buckets. Each member is paired with its bucket's
   smallest member only, so the pairs are linear in the bucket, however large it is.
4. Pairs whose signatures leave the threshold possible are verified on the full sets, and
   confirmed links are grouped by star contraction.
5. Buckets that still hold several components may hide links between them. Their members are
   packed in cells of ``CELL``, and cells are compared by signature, each two of a bucket in a task
   of their own. A member that may be linked with one of another component asks for that member's
   home block (of its component, if large, else of its surroundings) and is compared there with the
   full sets of the whole block. So rows are made for members, cells and blocks, not for pairs, and
   a link is lost only if no band or the signature estimate shows it: the number of bands is set so
   that this has a chance under ``MISS`` at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import kernels as K
from kelpie.llm.components import components
from kelpie.scratch import cut, drop

U = np.uint64
ROWS = 4
MISS = 1e-5
#: A pair is verified if its estimated similarity is at most so many standard errors too low.
ERRORS = 6
#: Members to a home block, and members that ask for a block, at a time.
BLOCK, ASKING = 256, 256
#: Members of a bucket that are compared by signature with so many others at a time.
CELL = 1024
#: Bytes of text that are hashed and drawn at a time, which bounds a worker's arrays on the way.
RUN = 1 << 19
#: Parts of the rows that ask for one block, while they are numbered.
SALTS = 8
_FRACTION = U(40)


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - min(0.99, percent / 100) ** ROWS))


def superminhash(hashes: np.ndarray, rows: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m, uint64: the step in the high bits, the random rank below).

    All elements take step j together; a row is done after the first step that leaves none of
    its slots with a value of a later step, since further steps only offer larger values.
    """
    n = len(rows) - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(n), np.diff(rows))
    permutation = None
    for j in range(m):
        if not len(row):
            break
        draw = K.mix(hashes + K.salt(j + 1))
        k = (j + (((draw & U(0xFFFFFF)) * U(m - j)) >> U(24)).astype(np.int64)).astype(np.int64)
        if permutation is None:
            slot = k
        else:
            at = np.arange(len(k))
            slot = permutation[at, k].astype(np.int64)
            permutation[at, k] = permutation[:, j]
            permutation[:, j] = slot
        np.minimum.at(sig, row * m + slot, (U(j) << _FRACTION) | (draw >> U(24)))
        open_rows = sig.reshape(n, m).max(axis=1) >= (U(j + 1) << _FRACTION)
        go = open_rows[row]
        if not go.any():
            break
        if permutation is None:
            k0, count = k[go], int(go.sum())
            permutation = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (count, m)).copy()
            at = np.arange(count)
            permutation[at, k0] = 0
            permutation[at, 0] = k0
        elif not go.all():
            permutation = permutation[go]
        hashes, row = hashes[go], row[go]
    return sig.reshape(n, m)


SKETCH = "id long, n_shingles long, fp1 long, fp2 long, sig binary, bands array<long>"


def _sketch(words: int, bands: int):
    m = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(K.column(batch, "text"))
            ids = K.column(batch, "id")
            for i, j in K.runs(offsets, RUN):
                grams, rows = K.shingles(*K.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), words)
                sizes = np.diff(rows)
                sums = [np.concatenate([[U(0)], np.cumsum(K.mix(grams ^ U(s)))]) for s in (0x1F83D9AB, 0x5BE0CD19)]
                fp = [(s[rows[1:]] - s[rows[:-1]]).view(np.int64) for s in sums]
                sig = superminhash(grams, rows, m)
                keys = np.empty((j - i, bands), np.uint64)
                for b in range(bands):
                    key = np.full(j - i, K.salt(b + 1))
                    for r in range(ROWS):
                        key = K.mix(key ^ sig[:, b * ROWS + r]) + U(r)
                    keys[:, b] = key
                short = (K.mix(sig) >> U(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        pa.array(sizes),
                        pa.array(fp[0]),
                        pa.array(fp[1]),
                        _binary(short.reshape(-1), np.arange(j - i + 1) * m),
                        pa.ListArray.from_arrays(pa.array((np.arange(j - i + 1) * bands).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["id", "n_shingles", "fp1", "fp2", "sig", "bands"],
                )

    return run


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _sets(words: int):
    """(id, set): the full shingle sets as ascending 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(K.column(batch, "text"))
            ids = K.column(batch, "id")
            for i, j in K.runs(offsets, RUN):
                grams, rows = K.shingles(*K.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), words)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), _binary(grams.view(np.uint8), rows * 8)], names=["id", "set"])

    return run


def _linked(percent: int):
    """Of rows (a, b, set_a, set_b) those with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = K.column(batch, "set_a"), K.column(batch, "set_b")
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), np.uint64)
                y = np.frombuffer(right[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([K.column(batch, "a").take(at), K.column(batch, "b").take(at)], names=["a", "b"])

    return run


def _possible(percent: int, m: int) -> float:
    t = percent / 100
    return t - ERRORS * math.sqrt(t * (1 - t) / m)


def _estimated(percent: int, m: int):
    """Of rows (a, b, na, nb, sa, sb) those whose sizes and signatures leave a link possible."""
    least = _possible(percent, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa = K.buffers(K.column(batch, "sa"))[0].reshape(-1, m)
            sb = K.buffers(K.column(batch, "sb"))[0].reshape(-1, m)
            na, nb = (K.column(batch, c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            keep = ((sa == sb).mean(axis=1) >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([K.column(batch, "a").take(at), K.column(batch, "b").take(at)], names=["a", "b"])

    return run


def _asks(percent: int, m: int):
    """(y, places): members and the blocks (anchor, blk) of other components that they may be linked with.

    Of two components the smaller asks. A row tells each member's places at once, so that
    places which several buckets tell become one before they are spread out.

    Input: rows of one cell of a bucket, which is compared with itself, or of two.
    """
    least = math.ceil(_possible(percent, m) * m)

    def arrays(cell: pa.StructArray) -> list[np.ndarray]:
        return [*(cell.field(c).to_numpy() for c in ("id", "root", "csize", "anchor", "blk", "n")), K.buffers(cell.field("sig"))[0].reshape(-1, m)]

    def pairs(a: list[np.ndarray], b: list[np.ndarray], itself: bool) -> Iterator[np.ndarray]:
        """(y, anchor, blk) of the pairs that may be linked, for each member of the first cell."""
        for i in range(len(a[0])):
            others = slice(i + 1 if itself else 0, None)
            ok = np.flatnonzero((b[1][others] != a[1][i]) & (100 * np.minimum(b[5][others], a[5][i]) >= percent * np.maximum(b[5][others], a[5][i]))) + (others.start)
            if len(ok):
                ok = ok[np.count_nonzero(b[6][ok] == a[6][i], axis=1) >= least]
            if len(ok):
                larger = (a[2][i] > b[2][ok]) | ((a[2][i] == b[2][ok]) & (a[1][i] < b[1][ok]))
                yield np.unique(np.stack([np.where(larger, b[0][ok], a[0][i]), *(np.where(larger, a[c][i], b[c][ok]) for c in (3, 4))]), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for row in K.column(batch, "cells"):
                cells = [arrays(cell.values) for cell in row.values]
                found = list(pairs(cells[0], cells[-1], len(cells) == 1))
                if found:
                    out.append(np.unique(np.concatenate(found, axis=1), axis=1))
            rows = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
            ys, first = np.unique(rows[0], return_index=True)
            places = pa.StructArray.from_arrays([pa.array(rows[1]), pa.array(rows[2])], names=["anchor", "blk"])
            offsets = pa.array(np.append(first, rows.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ys), pa.ListArray.from_arrays(offsets, places)], names=["y", "places"])

    return run


def _meet(percent: int):
    """Links (a: an asking member, b: a member of the block) by the full sets, as many as join different components."""

    def sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return K.column(table, "id").to_numpy(), K.column(table, "root").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in K.column(table, "set")]

    def run(key: tuple[pa.Scalar, ...], asking: pa.Table, block: pa.Table) -> pa.Table:
        ids, roots, held = sets(block)
        sizes = np.array([len(x) for x in held], np.int64)
        everything = np.concatenate(held) if held else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(held)), sizes)
        order = np.argsort(everything, kind="stable")
        everything, owner = everything[order], owner[order]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        out = []
        for y, root, mine in zip(*sets(asking), strict=True):
            lo, hi = np.searchsorted(everything, mine, "left"), np.searchsorted(everything, mine, "right")
            count = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            shared = np.bincount(owner[at], minlength=len(held))
            linked = (100 * shared >= percent * (sizes + len(mine) - shared)) & (shared > 0) & (roots != root)
            for i in np.flatnonzero(linked):
                a, b = find(int(root)), find(int(roots[i]))
                if a != b:
                    parent[a] = b
                    out.append((y, ids[i]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept.

    Texts are linked if 100 * |A n B| >= percent * |A u B| for their sets of distinct
    ``words``-word shingles; a text of fewer words is one shingle, a null or wordless text has an
    empty set and is linked with nothing. ``percent`` is 40 or more, so that a signature's slots have
    numbers of 16 bits (a ValueError below). Ids are meant to be unique: rows that share one have a
    row each, and a link of one may count for the others. A row whose id is null belongs to no
    group (component_id null, kept). Other columns of ``docs`` are not read; an empty table gives
    no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not 40 <= percent <= 100:
        raise ValueError("percent is between 40 and 100")
    bands = bands_for(percent)
    m = bands * ROWS
    sketch = cut(docs.mapInArrow(K.giving_back(_sketch(words, bands)), SKETCH))
    same = ["n_shingles", "fp1", "fp2"]
    reps = cut(
        sketch.where("n_shingles > 0 and id is not null")
        .groupBy(*same)
        .agg(F.min(F.struct("id", "sig", "bands")).alias("x"))
        .select(F.col("x.id").alias("rep"), *same, "x.sig", "x.bands")
    )
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(buckets, "key").select("key", "rep", "centre", "n"))
    sigs = reps.select("rep", "n_shingles", "sig")

    # The same plan at every size: a broadcast of the ids would not hold for a large table.
    wanted = members.select(F.col("rep").alias("id")).distinct().hint("shuffle_hash")
    sets = cut(docs.join(wanted, "id", "left_semi").mapInArrow(K.giving_back(_sets(words)), "id long, set binary"))

    stars = (
        members.where("rep <> centre")
        .select(F.col("rep").alias("a"), F.col("centre").alias("b"))
        .distinct()
        .join(sigs.toDF("a", "na", "sa"), "a")
        .join(sigs.toDF("b", "nb", "sb"), "b")
        .select("a", "b", "na", "nb", "sa", "sb")
    )
    stars = stars.mapInArrow(K.giving_back(_estimated(percent, m)), "a long, b long")
    stars = stars.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
    links = cut(stars.mapInArrow(K.giving_back(_linked(percent)), "a long, b long").distinct())
    roots = components(links)

    sizes = roots.groupBy("root").agg(F.count("*").alias("csize"))
    homes = (
        members.groupBy("rep").agg(F.min("centre").alias("anchor"))
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .join(sizes, "root", "left")
        .select("rep", F.coalesce("root", "rep").alias("root"), F.coalesce("csize", F.lit(1)).alias("csize"), "anchor")
    )
    # A large component's members have their own blocks, others share those of the least centre around.
    homes = cut(homes.withColumn("anchor", F.when(F.col("csize") >= BLOCK, F.col("root")).otherwise(F.col("anchor"))))
    crowds = homes.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).alias("blks"))
    homes = cut(homes.join(crowds, "anchor").select("rep", "root", "csize", "anchor", F.pmod(F.xxhash64("rep"), "blks").alias("blk")))
    rooted = members.select("key", "rep", "n").join(homes, "rep")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    member = F.struct(F.col("rep").alias("id"), "root", "csize", "anchor", "blk", F.col("n_shingles").alias("n"), "sig")
    packed = cut(
        rooted.join(mixed, "key")
        .join(sigs, "rep")
        .withColumn("of", F.ceil(F.col("n") / CELL))
        .withColumn("at", F.pmod(F.xxhash64("rep", F.lit(1)), "of"))
        .groupBy("key", "of", "at")
        .agg(F.collect_list(member).alias("cell"))
    )
    # Of a bucket of several cells each two meet under a key of their own, so no task has all of a bucket.
    spread = packed.where("of > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    spread = spread.groupBy("key", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi")).agg(F.collect_list("cell").alias("cells"))
    met = packed.where("of = 1").select(F.array("cell").alias("cells")).unionByName(spread.where("lo = hi or size(cells) = 2").select("cells"))
    told = met.mapInArrow(K.giving_back(_asks(percent, m)), "y long, places array<struct<anchor:long,blk:long>>")
    told = told.groupBy("y").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    asks = cut(told.select("y", F.explode("places").alias("x")).select("y", "x.anchor", "x.blk").withColumn("salt", F.pmod(F.xxhash64("y", F.lit(2)), F.lit(SALTS))))
    place = ["anchor", "blk", "chunk"]
    loads = cut(asks.groupBy("anchor", "blk").agg(F.ceil(F.count("*") / ASKING).alias("chunks")))
    salted = loads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    asking = (
        asks.join(salted, ["anchor", "blk", "salt"])
        .select(F.col("y").alias("id"), "anchor", "blk", F.pmod(F.xxhash64("y"), "chunks").alias("chunk"))
        .join(homes.select(F.col("rep").alias("id"), "root"), "id")
        .join(sets, "id")
    )
    blocks = (
        homes.select(F.col("rep").alias("id"), "root", "anchor", "blk")
        .join(loads, ["anchor", "blk"])
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("id", "root", *place)
        .join(sets, "id")
    )
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("id", "root", *place, "set")])  # noqa: E731  both sides hold columns of ``sets``
    asking, blocks = fresh(asking), fresh(blocks)
    more = cut(asking.groupBy(*place).cogroup(blocks.groupBy(*place)).applyInArrow(_meet(percent), "a long, b long"))
    roots = components(links.unionByName(more))
    drop(members, sets, packed, asks, loads, homes, links, more)
    return (
        sketch.select("id", *same)
        .join(reps.select(*same, "rep"), same, "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id")))
        .select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
    )


def op1_superminhash(spark, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity 0.85 or more, over all of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
