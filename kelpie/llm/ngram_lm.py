"""Language-model scoring with a weighted backoff automaton, sliced by blocks of documents.

States are the n-grams of up to ``order - 1`` tokens seen in training, the empty one is the
root. The arc (h, w) exists if hw was seen and weighs log10 of the smoothed probability

    P(w|h) = (c(hw) + mu * P(w|h')) / (c(h) + mu),   P(w) = (c(w) + 1) / (N + V + 1)

(h' is h without its first token). The failure arc of h leads to h' and weighs
log10(mu / (c(h) + mu)), which makes the sum over all words one. A text is scored in one
traversal from left to right that carries the state and adds the weights.

The automaton of a large corpus fits no machine, so each block of documents gets the slice
that its own traversals can reach. A block sends the 64-bit hashes of its distinct n-grams with
their training counts, split by hash range; each range sums them over all blocks and answers
with totals in the same order. So hot n-grams are pre-aggregated by block, nothing is collected
or broadcast, and a task holds one block or one range at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import kernels as K
from kelpie.llm.samples import remainder

U = np.uint64
#: Bytes of text in a block, and blocks at least.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 32
#: Bytes of text whose n-grams a range holds, and ranges at least.
RANGE_BYTES, LEAST_RANGES = 16 << 20, 32
MU = 100.0
_END = np.array([K.salt(0xE0D)], np.uint64)


def tokens(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with one end after each text, and the rows' offsets in them."""
    data, offsets = K.buffers(text)
    n = len(offsets) - 1
    parts = [K.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in K.runs(offsets)]
    words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([np.diff(p[1]) for p in parts]) if parts else np.zeros(0, np.int64)
    rows = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(rows[-1], np.uint64)
    ends = np.zeros(rows[-1], bool)
    ends[rows[1:] - 1] = True
    out[ends] = _END[0]
    out[~ends] = words
    return out, rows


def grams(words: np.ndarray, rows: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 .. order: the hashes of the k-grams that end at each token, and whether there is one.

    A text begins in the state of the end token, so its first word ends a 2-gram too.
    """
    nth = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
    out = [(words, np.ones(len(words), bool))]
    if not len(words):
        return out * order
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[nth == 0] = _END[0]
    last = before
    for k in range(2, order + 1):
        now = K.chain(last, words, 0x6A + k)
        out.append((now, nth >= k - 2))
        last = np.empty_like(now)
        last[1:], last[0] = now[:-1], 0
    return out


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, so that the shuffle's compression drops the empty ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _edges(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


ASKED = "part int, block int, keys array<binary>, counts array<binary>"
TOLD = "block int, part int, totals array<binary>"
SUMS = "n long, v long"
_LISTS = pa.list_(pa.binary())


def _ask(ranges: int, order: int):
    """A block's distinct n-grams of each order and their training counts, by hash range."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, rows = tokens(K.column(table, "text"))
        train = np.repeat(K.column(table, "train").to_numpy().astype(bool), np.diff(rows))
        each: list[tuple] = []
        for hashes, real in grams(words, rows, order):
            keys, inverse = np.unique(hashes[real], return_inverse=True)
            counts = np.bincount(inverse, weights=train[real], minlength=len(keys)).astype(np.uint64)
            each.append((keys, counts, np.concatenate([[0], np.searchsorted(keys, _edges(ranges)), [len(keys)]])))
        some = np.flatnonzero(sum(np.diff(cuts) for _, _, cuts in each)).tolist()
        return pa.table(
            {
                "part": pa.array(some, pa.int32()),
                "block": pa.array([key[0].as_py()] * len(some), pa.int32()),
                "keys": pa.array([[_planes(np.diff(keys[cuts[p] : cuts[p + 1]], prepend=U(0))) for keys, _, cuts in each] for p in some], _LISTS),
                "counts": pa.array([[_planes(counts[cuts[p] : cuts[p + 1]]) for _, counts, cuts in each] for p in some], _LISTS),
            }
        )

    return run


def _totals(table: pa.Table, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys that each block asked for, the numbers of all of them among the distinct ones, and these ones' totals."""
    asked = [np.cumsum(_values(x[k].as_py())) for x in K.column(table, "keys")]
    found, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.zeros(len(found), np.uint64)
    np.add.at(totals, inverse, np.concatenate([_values(x[k].as_py()) for x in K.column(table, "counts")]))
    return asked, inverse, totals


def _tell(order: int):
    """The totals of a hash range for each block that asked."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out: list[list[bytes]] = [[] for _ in range(table.num_rows)]
        for k in range(order):
            asked, inverse, totals = _totals(table, k)
            start = 0
            for i, a in enumerate(asked):
                out[i].append(_planes(totals[inverse[start : start + len(a)]]))
                start += len(a)
        return pa.table({"block": K.column(table, "block"), "part": pa.array([key[0].as_py()] * len(out), pa.int32()), "totals": pa.array(out, _LISTS)})

    return run


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The range's share of N and V."""
    _, _, totals = _totals(table, 0)
    return pa.table({"n": pa.array([int(totals.sum())], pa.int64()), "v": pa.array([int((totals > 0).sum())], pa.int64())})


class Automaton:
    """The slice of the backoff automaton that the traversals of some token sequences can reach.

    For each k, ``at[k]`` has the number of the k-gram that ends at each token (-1: none),
    ``seen[k]`` whether it was seen in training, ``arc[k]`` the weight of the arc that it stands
    for, ``fail[k]`` the weight of the failure arc of the state that it is; ``fail[0]`` is 0.
    """

    def __init__(self, words: np.ndarray, rows: np.ndarray, totals: list[np.ndarray], n: int, v: int, mu: float):
        self.rows, self.order = rows, len(totals)
        self.at, self.seen, self.arc, self.fail = [None], [None], [None], [np.zeros(1)]
        start, lower, self.first = np.full(len(words), -1), None, None
        for k, (hashes, real) in enumerate(grams(words, rows, self.order), 1):
            where = np.flatnonzero(real)
            _, one, inverse = np.unique(hashes[real], return_index=True, return_inverse=True)
            at = start.copy()
            at[where] = inverse
            count = totals[k - 1].astype(np.float64)
            if k == 1:
                share = (count + 1) / (n + v + 1)
                ends = rows[1:][:1] - 1
                boundary = float(count[inverse[ends[0]]]) if len(ends) else 0.0
            else:
                token = where[one]
                nth = token - rows[np.searchsorted(rows, token, "right") - 1]
                state = np.where(nth > 0, self.at[k - 1][np.maximum(token - 1, 0)], -1)
                context = np.where(state >= 0, before[np.maximum(state, 0)], boundary if k == 2 else 0.0)
                share = (count + mu * lower[self.at[k - 1][token]]) / (context + mu)
            self.at.append(at)
            self.seen.append(count > 0)
            self.arc.append(np.log10(share))
            self.fail.append(np.log10(mu / (count + mu)))
            lower, before = share, count
        self.begin = float(np.log10(mu / (boundary + mu))) if len(words) else 0.0

    def traverse(self) -> np.ndarray:
        """log10 probability of each sequence; all advance together, a token a step."""
        lengths = np.diff(self.rows)
        by = np.argsort(-lengths, kind="stable")
        alive = len(by) - np.searchsorted(lengths[by][::-1], np.arange(1, lengths.max(initial=0) + 1))
        place = self.rows[:-1][by].copy()
        score = np.zeros(len(by))
        level = np.full(len(by), min(1, self.order - 1))
        weight = [np.zeros(len(by)) for _ in range(self.order)]  # of the failure arcs of the state and its suffixes
        if self.order > 1:
            weight[1][:] = self.begin
        for m in alive:
            p = place[:m]
            gain = np.zeros(m)
            todo = np.arange(m)
            for k in range(self.order, 1, -1):
                here = todo[level[todo] == k - 1]
                if not len(here):
                    continue
                arc = self.at[k][p[here]]
                ok = self.seen[k][arc] & (arc >= 0)
                gain[here[ok]] += self.arc[k][arc[ok]]
                fall = here[~ok]
                gain[fall] += weight[k - 1][fall]
                level[fall] = k - 2
                level[here[ok]] = -1
            root = np.flatnonzero(level[:m] == 0)
            gain[root] += self.arc[1][self.at[1][p[root]]]
            score[:m] += gain
            level[:m] = 0
            for k in range(1, self.order):
                state = self.at[k][p]
                known = (state >= 0) & self.seen[k][state]
                weight[k][:m] = np.where(known, self.fail[k][state], 0.0)
                level[:m] = np.where(known, k, level[:m])
            place[:m] += 1
        out = np.empty(len(by))
        out[by] = score
        return out


SCORED = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, mu: float):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        n, v = (K.column(told, c)[0].as_py() for c in ("n", "v"))
        words, rows = tokens(K.column(docs, "text"))
        by_part, column = np.argsort(K.column(told, "part").to_numpy()), K.column(told, "totals")
        totals = [np.concatenate([_values(column[int(i)][k].as_py()) for i in by_part] or [np.zeros(0, np.uint64)]) for k in range(order)]
        slice_ = Automaton(words, rows, totals, n, v, mu)
        each = slice_.at[1]
        sums = lambda x: np.add.reduceat(x, rows[:-1]) if len(rows) > 1 else np.zeros(0)
        return pa.table(
            {
                "id": K.column(docs, "id"),
                "n_tokens": pa.array(np.diff(rows).astype(np.int64)),
                "n_known": pa.array(sums(slice_.seen[1][each].astype(np.int64)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(rows) - 1, n, np.int64)),
                "base_score": pa.array(sums(slice_.arc[1][each])),
                "score": pa.array(slice_.traverse()),
            }
        )

    return run


def score_texts(docs: DataFrame, train, order: int = 2, mu: float = MU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``train`` is a boolean column of ``docs``: the rows that the model learns from. A null text is
    empty: its one token is the end. Repeated rows count and are scored each; an empty table gives
    no rows; with no training rows every word is unknown. Scores don't depend on the blocks. Other
    columns are not read. Ids are meant to be unique: rows equal in id and text share a block.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    ranges = max(LEAST_RANGES, -(-total // RANGE_BYTES))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    asked = docs.groupBy("block").applyInArrow(_ask(ranges, order), ASKED)
    told = asked.groupBy("part").applyInArrow(_tell(order), TOLD)
    sums = asked.groupBy("part").applyInArrow(_sum, SUMS).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    told = told.crossJoin(F.broadcast(sums))  # one row
    scored = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(order, mu), SCORED)
    return scored.withColumnRenamed("id", id_col)


def op2_backoff_automaton(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    return score_texts(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
