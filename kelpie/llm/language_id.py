"""Language identification by compression: the dictionary that encodes a text shortest wins.

Each language has a raw-content zstandard dictionary made of texts of that language. A text is
lower-cased, reduced to letters and single spaces, cut into chunks that are encoded one by one
(so that a long text cannot live on its own repetitions), and its code length with a dictionary
is the sum over all chunks. The lead over the next language must be a share of that length; the
least share is calibrated for each size of text, on held-out halves of the sample, so that right
calls pass and the same texts with their letters shuffled, which are in no language, don't.
Languages that tie by whole bytes are settled by bits under byte trigrams of their dictionaries,
where a lead of under ``FINE_LEAD`` is rejected.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import kernels as K
from kelpie.llm.samples import remainder, sample_by_label

#: Labelled texts of a language that its dictionary is fitted on at most, and bytes of each in it.
SAMPLE, SHARE = 512, 512
CHUNK = 1024
#: Sizes of text in bytes for which leads are calibrated, and texts of a language for each.
SIZES, CALIBRATED = tuple(16 << i for i in range(9)), 48
#: Shares of shuffled texts that the least lead rejects, and of right calls that it may reject.
NOISE, LOST = 0.99, 0.005
#: The least lead where the sample is too small to calibrate, or right calls would let less pass, and that of bits between languages that tie.
LEAD, FINE_LEAD = 0.03, 0.1
#: Bytes of code length that change the odds by e, for the score, at least.
SCALE = 2.0
UND = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The lower-cased letters with single spaces for all else; empty without any letter."""
    some = _OTHER.sub(" ", (text or "").lower()).strip()
    return some.encode("utf-8", "surrogatepass") if any(map(str.isalpha, some)) else b""


class Trigrams:
    """Bits of texts under the byte trigrams of a dictionary, smoothed by its bigrams and bytes."""

    def __init__(self, data: bytes):
        x = np.frombuffer(data, np.uint8).astype(np.int64)
        self.one, self.two = np.bincount(x, minlength=256), np.bincount(x[:-1] << 8 | x[1:], minlength=1 << 16)
        self.keys, self.three = np.unique(x[:-2] << 16 | x[1:-1] << 8 | x[2:], return_counts=True)
        self.total = len(data)

    def bits(self, data: bytes) -> float:
        x = np.frombuffer(b"  " + data + b" ", np.uint8).astype(np.int64)
        a, b, c = x[:-2], x[1:-1], x[2:]
        code = a << 16 | b << 8 | c
        at = np.minimum(np.searchsorted(self.keys, code), max(0, len(self.keys) - 1))
        three = np.where(self.keys[at] == code, self.three[at], 0) if len(self.keys) else 0
        p = (self.two[b << 8 | c] + 4 * (self.one[c] + 0.5) / (self.total + 128)) / (self.one[b] + 4)
        return float(-np.log2((three + 4 * p) / (self.two[a << 8 | b] + 4)).sum())


class Model(NamedTuple):
    """Each language's dictionary, and the least lead for texts of up to each of ``SIZES`` bytes."""

    dictionaries: dict[str, bytes]
    leads: tuple[float, ...] = (LEAD,) * len(SIZES)


class Coder:
    """Code lengths of texts under each language's dictionary."""

    def __init__(self, model: Model):
        dictionaries, self.leads = model
        self.names = sorted(dictionaries)
        self.dictionaries, self.fine = dictionaries, {}
        self.coders = []
        for name in self.names:
            data = dictionaries[name]
            how = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=CHUNK, dict_size=len(data), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            table = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if data:
                table.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=table).compress)

    def lengths(self, data: bytes) -> list[int]:
        parts = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
        return [sum(len(code(p)) for p in parts) for code in self.coders]

    def lead(self, data: bytes) -> tuple[int, float]:
        """The shortest language's number, and its lead over the next as a share of its code length."""
        lengths = self.lengths(data)
        best, second = sorted(lengths)[:2]
        return lengths.index(best), (second - best) / best

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected; ``und`` (rejected) for a text without a letter.

        Equal bits too go to the language first by name, rejected. The score is the best language's
        share of exp(-length / scale), where the scale is the least lead in bytes (``SCALE`` at least).
        """
        data = letters(text)
        if not data or not self.names:
            return UND, 0.0, True
        lengths = self.lengths(data)
        best = min(lengths)
        least = best * self.leads[next((i for i, size in enumerate(SIZES) if len(data) <= size), -1)]
        score = 1 / sum(math.exp((best - n) / max(SCALE, least)) for n in lengths)
        if len(lengths) == 1:
            return self.names[0], score, False
        if lengths.count(best) == 1:
            return self.names[lengths.index(best)], score, sorted(lengths)[1] - best < least
        bits = sorted((self.trigrams(name).bits(data), name) for name, n in zip(self.names, lengths, strict=True) if n == best)
        return bits[0][1], score, bits[1][0] - bits[0][0] < FINE_LEAD * bits[0][0]

    def trigrams(self, name: str) -> Trigrams:
        if name not in self.fine:
            self.fine[name] = Trigrams(self.dictionaries[name])
        return self.fine[name]


def dictionary(texts: list[list[str]]) -> bytes:
    """``SHARE`` bytes of letters of each text, from all its pieces; the first sampled come last, nearest to what is coded."""
    return b" ".join(letters(piece)[: SHARE // len(pieces)] for pieces in reversed(texts) for piece in pieces)


def calibrated(coders: list[Coder], halves: list[dict[str, list[list[str]]]], seed: int = 7) -> tuple[float, ...]:
    """The least lead for each of ``SIZES``, from texts that the other half's coder has not seen."""
    rng, out = np.random.default_rng(seed), []
    whole = [[[letters(" ".join(pieces)) for pieces in half[name]] for name in coder.names] for half, coder in zip(halves, coders, strict=True)]
    for size in SIZES:
        right, noise = [], []
        for texts, coder in zip(whole, reversed(coders), strict=True):
            for at in range(len(coder.names)):
                for data in [data[:size] for data in texts[at] if len(data) >= size // 2][:CALIBRATED]:
                    found, lead = coder.lead(data)
                    right += [lead] if found == at else []
                    shuffled = rng.permutation(list(data.decode("utf-8", "ignore")))
                    noise.append(coder.lead("".join(shuffled).encode())[1])
        some = min(len(right), len(noise)) >= CALIBRATED
        out.append(min(sorted(noise)[int(NOISE * len(noise))], max(LEAD, sorted(right)[int(LOST * len(right))])) if some else LEAD)
    return tuple(out)


def fit(texts: dict[str, list[list[str]]]) -> Model:
    """A model from labelled texts (each a list of pieces), without those that look mislabelled.

    Halves of the sample judge each other: a text stays if the other half's dictionaries don't
    place it in another language. A language left with nothing keeps all its texts.
    """
    halves = [{name: t[i::2] for name, t in texts.items()} for i in (0, 1)]
    build = lambda some: Model({n: dictionary(t) for n, t in some.items()})
    coders = [Coder(build(h)) for h in halves]
    clean: dict[str, list[list[str]]] = {}
    for name, t in texts.items():
        judged = [(x, coders[(i + 1) % 2].predict(" ".join(x))) for i, x in enumerate(t)]
        clean[name] = [x for x, (found, _, rejected) in judged if rejected or found == name] or t
    if len(texts) < 2:
        return build(clean)
    halves = [{name: t[i::2] for name, t in clean.items()} for i in (0, 1)]
    return Model(build(clean).dictionaries, calibrated([Coder(build(h)) for h in halves], halves))


_coders: dict[str, Coder] = {}  # of the latest model that this worker has used


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and id, lang_pred, score, rejected for each row, from its whole text alone.

    A null text, or one without a letter, is ``und``, score 0, rejected; so is every text if the
    model has no language. Repeated rows are judged each, an empty table gives no rows. Columns of
    ``keep`` are carried through unchanged; others are not read. ``keep`` must not name lang_pred,
    score or rejected (a ValueError): rename such columns before.
    """
    if clash := {"lang_pred", "score", "rejected"} & {id_col, *keep}:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    sent, named = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    if docs.schema[id_col].dataType.simpleString() != "bigint":
        docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    kept = [c for c in columns if c in keep or c == id_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if named not in _coders:
            _coders.clear()
            _coders[named] = Coder(sent.value)
        coder = _coders[named]
        for batch in batches:
            found = [coder.predict(t.as_py()) for t in K.column(batch, text_col)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[K.column(batch, c) for c in kept],
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                names=[*kept, "lang_pred", "score", "rejected"],
            )

    return docs.select(*columns).mapInArrow(K.giving_back(run), schema)


def learn(docs: DataFrame) -> Model:
    """A model from the rows of ``docs`` that aren't held out (crc32 of doc_id mod 4 is not 2).

    At most ``SAMPLE`` texts of a language come to the driver, long ones as pieces from all over them.
    """
    rows = docs.where(remainder("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang")
    return fit(sample_by_label(rows, "lang", SAMPLE))


def op3_compression_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
