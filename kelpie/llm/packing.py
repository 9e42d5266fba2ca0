"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

Documents are dealt to shards by a hash and each shard packs its own, largest first. Open bins
are ordered by their residual capacity; each carries bitmaps of the sources and duplicate
clusters that it holds. A document goes to the tightest bin that fits it and is compatible: the
search starts at the smallest sufficient residual and goes on to the next larger one until a
bin of another set of clusters, with room for the source, is found, or a new bin is opened.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import kernels as K
from kelpie.llm.mixing import words_in
from kelpie.scratch import cut

CAPACITY = 2048
#: Documents of one source in a bin at most: so many bitmaps of sources does a bin carry.
PER_SOURCE = 4
#: Documents of a shard, and bytes of text where texts are packed, about.
SHARD, SHARD_BYTES = 4096, 64 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


class Bins:
    """Open bins by residual capacity."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residual: list[int] = []
        self.sources: list[list[int]] = []  # plane p has the sources of which the bin holds over p
        self.clusters: list[int] = []
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0  # bit r: some bin has residual r

    def place(self, size: int, source: int, cluster: int | None) -> int:
        """The number of the bin that takes the document."""
        mark = 0 if cluster is None else 1 << cluster
        rest = self.present >> size
        at = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            at, rest = at + step, rest >> step
            for i, number in enumerate(self.by_residual[at]):
                if not self.clusters[number] & mark and not self.sources[number][-1] >> source & 1:
                    del self.by_residual[at][i]
                    if not self.by_residual[at]:
                        self.present &= ~(1 << at)
                    return self._fill(number, size, source, mark)
            at, rest = at + 1, rest >> 1
        self.residual.append(self.capacity)
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        return self._fill(len(self.residual) - 1, size, source, mark)

    def _fill(self, number: int, size: int, source: int, mark: int) -> int:
        left = self.residual[number] = self.residual[number] - size
        self.clusters[number] |= mark
        planes, bit = self.sources[number], 1 << source
        for p, plane in enumerate(planes):
            if not plane & bit:
                planes[p] |= bit
                break
        if left:
            self.by_residual[left].append(number)
            self.present |= 1 << left
        return number


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int, int, int, int]]:
    """(document, from_word, n_words, bin, offset) of each piece.

    A document over the capacity fills whole bins of its own with pieces of it, and its rest, if
    any, is packed like a document. Documents of size 0 have no piece. Ties keep the input order.
    """
    source_of = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c, n in zip(clusters, sizes, strict=True):
        if n:
            seen[c] = seen.get(c, 0) + 1
    cluster_of = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    bins, out = Bins(capacity, per_source), []
    for d in sorted(range(len(sizes)), key=lambda d: -(sizes[d] % capacity)):
        if rest := sizes[d] % capacity:
            number = bins.place(rest, source_of[sources[d]], cluster_of.get(clusters[d]))
            out.append((d, sizes[d] - rest, rest, number, capacity - bins.residual[number] - rest))
    number = len(bins.residual)
    for d, size in enumerate(sizes):
        for i in range(size // capacity):
            out.append((d, i * capacity, capacity, number, 0))
            number += 1
    return out


def _pack_shard(capacity: int, per_source: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), ("size", "ascending"), ("source", "ascending"), ("cluster", "ascending")]
        table = table.sort_by([*order, ("text", "ascending")] if with_text else order)
        sizes = K.column(table, "size").to_pylist()
        found = pack(sizes, K.column(table, "source").to_pylist(), K.column(table, "cluster").to_pylist(), capacity, per_source)
        at = pa.array([f[0] for f in found], pa.int64())
        out = {
            "doc_id": K.column(table, "doc_id").take(at),
            "source": K.column(table, "source").take(at),
            "shard": pa.array([key[0].as_py()] * len(found), pa.int32()),
            **{n: pa.array([f[i] for f in found], pa.int64()) for i, n in ((3, "bin"), (4, "offset"), (1, "from_word"), (2, "n_words"))},
        }
        if with_text:
            texts = K.column(table, "text").cast(pa.large_string())
            held: dict[int, list[str]] = {}
            pieces = []
            for d, start, n, _, _ in found:
                if n == sizes[d]:
                    pieces.append(texts[d].as_py())
                else:
                    if d not in held:
                        held[d] = _WORD.findall(texts[d].as_py())
                    pieces.append("".join(held[d][start : start + n]))
            out["text"] = pa.array(pieces, pa.string())
        return pa.table(out)

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            K.give_back()

    return whole


PIECES = "doc_id long, source string, shard int, bin long, offset long, from_word long, n_words long"


def pack_documents(
    docs: DataFrame, cluster: Column, capacity: int = CAPACITY, per_source: int = PER_SOURCE, size: Column | None = None, with_text: bool = False
) -> DataFrame:
    """doc_id, source, shard, bin, offset, from_word, n_words (and text): a row for each piece packed.

    Input: doc_id, source, text (or ``size``). ``cluster`` is the duplicate cluster: documents of
    one never share a bin, nor do over ``per_source`` documents of one source; null is a source
    like others, a null cluster conflicts with none. Pieces of one long document fill bins of
    their own. A null or wordless text has no piece; repeated rows are packed each; an empty table
    gives no rows. The result depends on the rows alone, not on their order or partitions. Shards
    are as many as rows and bytes ask for. Rows equal in id and size share a shard; where over
    ``SHARD`` rows share an id, each so many of them are a part of their own. Other columns are not read.
    """
    size = words_in(F.col("text")) if size is None else size
    kept = docs.select("doc_id", "source", size.cast("long").alias("size"), cluster.cast("long").alias("cluster"), *(["text"] if with_text else []))
    held = docs.agg(F.count("*").alias("n"), (F.sum(F.octet_length("text")) if with_text else F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-held["n"] // SHARD), -(-(held["bytes"] or 0) // SHARD_BYTES))
    often = cut(docs.groupBy("doc_id").count().where(F.col("count") > SHARD).select(F.col("doc_id").alias("often")))
    if often.isEmpty():
        kept = kept.withColumn("part", F.lit(0))
    else:
        same = F.col("doc_id").eqNullSafe(F.col("often"))
        order = Window.partitionBy("doc_id").orderBy(*[c for c in kept.columns if c != "doc_id"])
        many = kept.join(often, same, "left_semi").withColumn("part", F.floor((F.row_number().over(order) - 1) / SHARD).cast("int"))
        kept = kept.join(often, same, "left_anti").withColumn("part", F.lit(0)).unionByName(many)
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "part"), F.lit(shards)).cast("int")).drop("part")
    return kept.groupBy("shard").applyInArrow(_pack_shard(capacity, per_source, with_text), PIECES + (", text string" if with_text else ""))


def text_cluster(text: str = "text") -> Column:
    """The duplicate cluster of a text: equal words, A-Z lower-cased, whatever white space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")))


def op8_best_fit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return pack_documents(docs, text_cluster())
