"""Exact top-k inner products: a KD-tree for each shard, searched best box first.

Points are dealt to cells by median splits of a bounded sample, and a cell's points to shards by a
hash. Each shard's tree is built once and stored: it splits its points at the median of the widest
dimension down to leaves, and every node keeps its tight bounding box. A query's bound for a
box is the highest inner product that any point of the box could have. Queries travel: they visit
the cells in rounds, those of the highest bounds first, and a cell whose box cannot beat the k-th
score so far is never visited. Within a shard a query opens boxes by descending bound and ends when
the next bound falls short of the k-th score that it brought or found.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm import kernels as K
from kelpie.scratch import cut, drop

#: Points of a shard, of a leaf, and queries that meet a shard at a time.
SHARD, LEAF, QUERIES = 4096, 256, 8192
#: Cells at most, and points that the splits between them are fitted on, about.
CELLS, SAMPLE = 1024, 16_384
#: Cells that a query visits in each round; all others in the last.
ROUNDS = (1, 16, 256)
_LONG = (1 << 63) - 1


def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, bool]:
    """Each query's bound for each box, and whether all products are exact."""
    largest = np.abs(queries).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * max(1, queries.shape[1])
    exact = bool(largest < 2.0**53)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        if not exact:
            bounds = np.where(np.isfinite(bounds), bounds + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T), np.inf)
    return bounds, exact


class Tree:
    """Points in leaf order with, for each node, its range, children, box and smallest id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        place = np.arange(len(ids))
        self.nodes: list[list[int]] = []
        low, high, least = [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            some = points[place[start:end]]
            low.append(some.min(axis=0))
            high.append(some.max(axis=0))
            least.append(ids[place[start:end]].min())
            self.nodes.append([start, end, -1, -1])
            if end - start > LEAF:
                widest = int((high[-1] - low[-1]).argmax())
                middle = (end - start) // 2
                by = np.argpartition(some[:, widest], middle)
                place[start:end] = place[start:end][by]
                stack += [(start + middle, end, me, 1), (start, start + middle, me, 0)]
        self.ids, self.points = ids[place], points[place]
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)

    def dump(self) -> list[bytes]:
        """What :meth:`load` needs: ids, points, nodes, low, high and least as bytes."""
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.points, np.array(self.nodes, np.int32), self.low, self.high, self.least)]

    @classmethod
    def load(cls, dim: int, parts: list[bytes]) -> Tree:
        tree = cls.__new__(cls)
        kinds = (np.int64, np.float64, np.int32, np.float64, np.float64, np.int64)
        tree.ids, points, nodes, low, high, tree.least = (np.frombuffer(x, kind) for x, kind in zip(parts, kinds, strict=True))
        tree.points, tree.low, tree.high = (x.reshape(-1, dim) for x in (points, low, high))
        tree.nodes = nodes.reshape(-1, 4).tolist()
        return tree

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, known: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, -id) here that could enter ``known``, its best so far."""
        bounds, exact = bounds_of(queries, self.low, self.high)
        out = []
        for q, (own, query) in enumerate(zip(ids, queries, strict=True)):
            best, found = sorted(known[q])[-k:], []
            heapq.heapify(best)
            bound = bounds[q]
            todo = [(-bound[0], 0)]
            while todo:
                negative, node = heapq.heappop(todo)
                if len(best) == k and (-negative < best[0][0] or (-negative == best[0][0] and -self.least[node] < best[0][1] and exact)):
                    if -negative < best[0][0]:
                        break
                    continue
                start, end, left, right = self.nodes[node]
                if left >= 0:
                    for child in (left, right):
                        heapq.heappush(todo, (-bound[child], child))
                    continue
                some, names = self.points[start:end], self.ids[start:end]
                if exact:
                    score = some @ query
                    if len(best) == k:
                        good = np.flatnonzero(score >= best[0][0])
                    else:
                        good = np.arange(len(names))
                    if len(good) > 2 * k:
                        good = good[np.lexsort((names[good], -score[good]))[: k + 1]]
                    pairs = [(int(score[i]), -int(names[i])) for i in good if names[i] != own]
                else:
                    whole = [int(x) for x in query]
                    pairs = [(sum(a * int(b) for a, b in zip(whole, p, strict=True)), -int(n)) for p, n in zip(some, names, strict=True) if n != own]
                for pair in pairs:
                    if len(best) < k:
                        heapq.heappush(best, pair)
                        found.append(pair)
                    elif pair > best[0]:
                        heapq.heapreplace(best, pair)
                        found.append(pair)
            out.append(sorted(found, reverse=True)[:k])
        return out


def _matrix(cells, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.as_py() for c in cells), np.float64).reshape(-1, dim)


def _points(scale: float):
    def run(batches):
        for batch in batches:
            vectors = K.column(batch, "vector").cast(pa.list_(pa.float64()))
            offsets = vectors.offsets.to_numpy().astype(np.int64)
            with np.errstate(over="ignore"):
                flat = np.floor(scale * vectors.values.to_numpy(zero_copy_only=False))
            flat = np.nan_to_num(flat, posinf=np.finfo(np.float64).max, neginf=-np.finfo(np.float64).max)
            yield pa.RecordBatch.from_arrays(
                [
                    K.column(batch, "id"),
                    pa.array(np.diff(offsets).astype(np.int32)),
                    pa.array([flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()),
                ],
                names=["id", "dim", "point"],
            )

    return run


class Cells:
    """Median splits of a sample of points, down to about ``most`` cells."""

    def __init__(self, points: np.ndarray, most: int):
        self.splits: list[list[float]] = []  # dimension (-1: none), value, left, right or cell
        self.cells = 0
        share = max(1, len(points) // most)
        stack = [(np.arange(len(points)), -1, 0)]
        while stack:
            some, parent, side = stack.pop()
            me = len(self.splits)
            if parent >= 0:
                self.splits[parent][2 + side] = me
            widest = points[some].max(axis=0) - points[some].min(axis=0) if len(some) else np.zeros(1)
            d = int(widest.argmax())
            value = float(np.median(points[some][:, d])) if widest[d] > 0 else 0.0
            right = points[some][:, d] > value if widest[d] > 0 else np.zeros(0, bool)
            if len(some) > share and 0 < right.sum() < len(some):
                self.splits.append([d, value, -1, -1])
                stack += [(some[right], me, 1), (some[~right], me, 0)]
            else:
                self.splits.append([-1, 0.0, self.cells, self.cells])
                self.cells += 1

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        splits = np.array(self.splits)
        at = np.zeros(len(points), np.int64)
        while True:
            d = splits[at, 0].astype(np.int64)
            inner = np.flatnonzero(d >= 0)
            if not len(inner):
                return splits[at, 2].astype(np.int32)
            right = points[inner, d[inner]] > splits[at[inner], 1]
            at[inner] = np.where(right, splits[at[inner], 3], splits[at[inner], 2]).astype(np.int64)


def _dealt(sent):
    """(id, dim, point, cell) of rows (id, dim, point)."""

    def run(batches):
        for batch in batches:
            dims, points = K.column(batch, "dim").to_numpy(zero_copy_only=False), K.column(batch, "point")
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) in sent.value:
                    cell[at] = sent.value[int(dim)].of(_matrix(points.take(pa.array(at)), int(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


PARTS = ["ids", "points", "nodes", "low", "high", "least"]
TREE = "dim int, cell int, sub int, " + ", ".join(f"{p} binary" for p in PARTS)


def _build(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
    tree = Tree(K.column(shard, "id").to_numpy(), _matrix(K.column(shard, "point"), key[0].as_py()))
    held = {c: pa.array([k.as_py()], pa.int32()) for c, k in zip(("dim", "cell", "sub"), key, strict=True)}
    return pa.table(held | {p: pa.array([x], pa.binary()) for p, x in zip(PARTS, tree.dump(), strict=True)})


def _boxes(key: tuple[pa.Scalar, ...], roots: pa.Table) -> pa.Table:
    """The box around the roots of a cell's trees."""
    dim = key[0].as_py()
    low, high = (np.array([np.frombuffer(x.as_py(), np.float64)[:dim] for x in K.column(roots, c)]) for c in ("low", "high"))
    box = {"low": low.min(axis=0).tobytes(), "high": high.max(axis=0).tobytes()}
    held = {c: pa.array([k.as_py()], pa.int32()) for c, k in zip(("dim", "cell"), key, strict=True)}
    return pa.table(held | {c: pa.array([x], pa.binary()) for c, x in box.items()} | {"subs": pa.array([roots.num_rows], pa.int32())})


STATE = "id long, dim int, point binary, best array<struct<vec_id:long,score:long>>"


def _visits(sent, k: int, start: int, end: int):
    """Rows of ``STATE`` for each shard (cell, sub) that a query visits: its cells number ``start`` to ``end`` by bound that can beat its k-th score."""

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                dims, points, bests = K.column(batch, "dim").to_numpy(zero_copy_only=False), K.column(batch, "point"), K.column(batch, "best")
                for dim in np.intersect1d(dims, list(sent.value)).tolist():
                    cells, low, high, subs = sent.value[dim]
                    at = np.flatnonzero(dims == dim)
                    bounds, _ = bounds_of(_matrix(points.take(pa.array(at)), dim), low, high)
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, start:end]
                    least = np.array([kth(b, k) for b in bests.take(pa.array(at)).to_pylist()])
                    row, place = np.nonzero(np.take_along_axis(bounds, order, axis=1) >= least[:, None])
                    cell = order[row, place]
                    n = subs[cell]
                    sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, cell = at[np.repeat(row, n)], cells[np.repeat(cell, n)]
                    for i in range(0, len(row), 4096):
                        part = slice(i, i + 4096)
                        yield pa.RecordBatch.from_arrays(
                            [*batch.take(pa.array(row[part])).columns, pa.array(cell[part]), pa.array(sub[part].astype(np.int32))],
                            names=[*batch.schema.names, "cell", "sub"],
                        )

    return run


def kth(best: list[dict] | None, k: int) -> float:
    """The least score that a new neighbour needs; scores cut to the least long tell nothing."""
    score = min(x["score"] for x in best) if best and len(best) == k else -_LONG
    return -np.inf if score <= -_LONG else float(score)


FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], shard: pa.Table, queries: pa.Table) -> pa.Table:
        dim, rows = key[0].as_py(), []
        if shard.num_rows and queries.num_rows:
            tree = Tree.load(dim, [K.column(shard, p)[0].as_py() for p in PARTS])
            ids = K.column(queries, "id").to_numpy()
            known = [[(x["score"], -x["vec_id"]) for x in (best or []) if x["score"] > -_LONG] for best in K.column(queries, "best").to_pylist()]
            for own, found in zip(ids, tree.search(ids, _matrix(K.column(queries, "point"), dim), k, known), strict=True):
                rows += [(int(own), -n, max(-_LONG - 1, min(_LONG, s))) for s, n in found]
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return run


def shard_trees(points: DataFrame) -> DataFrame:
    """A row for each shard (dim, cell, sub) of the points (id, dim, point): its tree. Points are shuffled once, here."""
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    some = points.where(F.xxhash64(F.lit(3), "id") <= F.lit(min(_LONG, int((share - 0.5) * 2.0**64)))).select("dim", "point")
    by_dim: dict[int, list[bytes]] = {}
    for r in some.orderBy(F.xxhash64("point")).limit(2 * SAMPLE).collect():
        by_dim.setdefault(r["dim"], []).append(bytes(r["point"]))
    most = min(CELLS, -(-n // SHARD))
    cells = {d: Cells(np.frombuffer(b"".join(held), np.float64).reshape(-1, d), most) for d, held in by_dim.items()}
    sent = points.sparkSession.sparkContext.broadcast(cells)
    dealt = points.mapInArrow(_dealt(sent), "id long, dim int, point binary, cell int")
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).alias("subs"))
    placed = dealt.join(sizes, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
    return placed.select("id", "point", "dim", "cell", "sub").groupBy("dim", "cell", "sub").applyInArrow(_build, TREE)


def top_inner_products(
    vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    Components become floor(scale * x). ``is_query`` is a condition on the rows. Rows take no part
    if their id or vector is null, or the vector is empty or holds a null or non-finite component;
    vectors of different lengths don't meet. A query never finds its own id. Ties go to smaller
    ids; queries with fewer candidates have fewer rows. Of rows that share a query id one vector
    is the query (the smallest by bytes). Scores are exact; those that no long can hold are cut
    to its range. Other columns are not read, an empty table gives no rows. Ids are meant to be
    unique: rows that share one are candidates each, in one shard.

    Only boxes of cells (``CELLS`` at most for each length of vectors) and a sample of points come
    to the driver. A tree is copied only for each ``QUERIES`` queries that visit its shard.
    """
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad)
    good = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    points = cut(good.select("id", "vector").mapInArrow(_points(scale), "id long, dim int, point binary"))
    asking = good.where("asks").select("id", "vector").mapInArrow(_points(scale), "id long, dim int, point binary")
    asking = asking.groupBy("id").agg(F.min(F.struct("dim", "point")).alias("x")).select("id", "x.dim", "x.point")
    trees = cut(shard_trees(points))
    drop(points)
    boxes: dict[int, list] = {}
    for r in trees.select("dim", "cell", "low", "high").groupBy("dim", "cell").applyInArrow(_boxes, "dim int, cell int, low binary, high binary, subs int").orderBy("dim", "cell").collect():
        boxes.setdefault(r["dim"], []).append((r["cell"], np.frombuffer(r["low"], np.float64), np.frombuffer(r["high"], np.float64), r["subs"]))
    held = {d: (np.array([b[0] for b in some], np.int32), np.array([b[1] for b in some]), np.array([b[2] for b in some]), np.array([b[3] for b in some])) for d, some in boxes.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(held)
    most = max((len(some) for some in boxes.values()), default=0)
    state = cut(asking.withColumn("best", F.lit(None).cast("array<struct<vec_id:long,score:long>>")))
    key, start = ["dim", "cell", "sub"], 0
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for end in [n for n in ROUNDS if n < most] + [most]:
        going = cut(state.mapInArrow(_visits(sent, k, start, end), STATE + ", cell int, sub int"))
        loads = going.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
        asked = going.join(loads, key).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).drop("chunks")
        copies = trees.join(loads, key).withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))).drop("chunks")
        found = copies.groupBy(*key, "chunk").cogroup(asked.groupBy(*key, "chunk")).applyInArrow(_search(k), FOUND)
        before = state.select(F.col("id").alias("query_id"), F.explode("best").alias("x")).select("query_id", "x.vec_id", "x.score")
        ranked = found.unionByName(before).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = ranked.groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))
        then = cut(state.select("id", "dim", "point").join(best.withColumnRenamed("query_id", "id"), "id", "left"))
        drop(state, going)
        state, start = then, end
    out = state.select(F.col("id").alias("query_id"), F.explode("best").alias("x")).select("query_id", "x.vec_id", "x.score")
    return out.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def op5_kd_top5(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_inner_products(vectors, F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS p FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.p, c.p) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
