"""A training corpus from ``documents``: languages, near duplicates, personal data, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import language_id, mixing, near_dup, packing, pii
from kelpie.scratch import cut, drop

#: The stages' models, signatures and permutations are no SQL; tests compare with brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that identification rejects go.

    Null, empty and wordless texts have no language and go; repeated rows are judged each and stay or
    go together; an empty table stays empty; other columns may have any names.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column's name clashes with those of the operator
    found = language_id.identify(
        docs.toDF(*place.values()), language_id.learn(docs), place["doc_id"], place["text"], keep=tuple(place.values())
    )
    return found.where(~F.col("rejected")).select(*place.values()).toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more).

    Documents without words or id are in no group and stay. Rows repeated with their id and text
    are one document. An empty table stays empty; other columns may have any names.
    """
    found = near_dup.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    often = cut(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if often.isEmpty():
        return stay
    many = stay.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(often, "doc_id", "left_anti").select(*docs.columns).unionByName(many.select(*docs.columns))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind.

    Null texts stay null, ``n_chars`` follows the text; other columns may have any names.
    """
    out = pii.redact_texts(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and each time that the mix reads of it.

    Null and wordless texts are never read; a null source is one like others; repeated rows are
    documents each; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins; what the mix reads of one document twice never shares a bin.

    Documents without an id conflict with none; null and wordless texts have no piece.
    """
    return packing.pack_documents(docs, F.col("doc_id"), with_text=True)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``: doc_id, source, shard, bin, offset, from_word, n_words, text; no rows of an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return done
        done = cut(done)
        drop(docs)
        docs = done
