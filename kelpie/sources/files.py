"""Files of a corpus: JSONL, token blocks, graphs, run summaries, stage caches, resumable results, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.scratch import cut

PASSAGE = (
    "unit_id long, unit_name string, passage string, age_description array<string>, usages array<string>, states array<string>, "
    "ref_lithology array<string>, ref_province array<string>, ref_year int, ref_publication string, source_url string"
)
RAW_UNIT = (
    "id long, name string, url string, age_description array<string>, usages array<struct<usage:string,states:array<string>>>, "
    "unit_reference_summaries array<struct<summary:array<string>,lithology:array<string>,province:array<string>,reference_year:int,publication:string>>"
)
METRIC = "run string, nth long, kind string, wall_s double, iteration long, train_loss double, val_loss double, learning_rate double, tokens_per_second double, peak_memory double, trained_tokens long"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def passages(units: DataFrame, least: int = 200, most: int = 4000, where: str = "") -> DataFrame:
    """A row for each reference summary of raw unit records whose clean text has a length in the band.

    States are the sorted union over usages; ``ord`` keeps the order of units and summaries.
    """
    from kelpie.functions.text import clean_passage, in_length_band

    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    usages = F.coalesce("usages", F.expr("cast(array() AS array<struct<usage:string,states:array<string>>>)"))
    states = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(usages, lambda u: none(u["states"]))), lambda s: s.isNotNull())))
    named = F.filter(F.transform(usages, lambda u: u["usage"]), lambda u: u.isNotNull() & (u != ""))
    rows = units.select(
        F.col("id").alias("unit_id"), F.trim(F.coalesce("name", F.lit(""))).alias("unit_name"), none(F.col("age_description")).alias("age_description"),
        named.alias("usages"), states.alias("states"), F.coalesce("url", F.concat(F.lit(where), F.col("id").cast("string"))).alias("source_url"),
        F.posexplode("unit_reference_summaries").alias("nth", "ref"),
    )
    body = F.array_join(F.filter(F.col("ref.summary"), lambda s: s.isNotNull() & (s != "")), " ")
    rows = rows.withColumn("passage", clean_passage(body)).where(in_length_band(F.col("passage"), least, most))
    return rows.select(
        "unit_id", "unit_name", "passage", "age_description", "usages", "states", none(F.col("ref.lithology")).alias("ref_lithology"),
        none(F.col("ref.province")).alias("ref_province"), F.col("ref.reference_year").alias("ref_year"), F.col("ref.publication").alias("ref_publication"),
        "source_url", (F.col("unit_id") * 100_000 + F.col("nth")).alias("ord"),
    )


def documents(rows: DataFrame, source: str, id_col: str, text_col: str, title_col: str | None = None, year_col: str | None = None) -> DataFrame:
    """id 'source:...', source, title, year, text, ord of any table of texts."""
    return rows.select(
        F.concat(F.lit(source + ":"), F.col(id_col).cast("string")).alias("id"), F.lit(source).alias("source"),
        (F.col(title_col) if title_col else F.lit("")).alias("title"), (F.col(year_col) if year_col else F.lit(None)).cast("int").alias("year"),
        F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("ord"),
    )


def scan_queries(records: DataFrame, queries: list[str], most: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The records that a scan of paged answers takes, query after query: (query, page, pos, ...) with non-empty text.

    The first query to see an id owns it. A query's pages are read until it owns ``most`` records or more;
    the last page read counts whole. ``queries`` are the caller's few, each a pass over its own records.
    """
    taken = None
    for name in queries:
        rows = records.where((F.col("query") == name) & (F.coalesce(F.col(text_col), F.lit("")) != ""))
        if taken is not None:
            rows = rows.join(taken.select(id_col), id_col, "left_anti").select(*records.columns)
        first = F.min(F.struct("page", "pos")).alias("x")
        firsts = rows.groupBy(id_col).agg(first).select(id_col, "x.page", "x.pos")
        pages = firsts.groupBy("page").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a page
        read = pages.withColumn("before", before).where(F.col("before") < most).select("page")
        mine = rows.join(firsts, [id_col, "page", "pos"], "left_semi").join(read, "page", "left_semi").select(*records.columns)
        mine = mine.dropDuplicates([id_col])
        taken = cut(mine if taken is None else taken.unionByName(mine))
    return taken


def task_texts(passages_: DataFrame, split_col: str = "split") -> DataFrame:
    """Texts of the train split only, labels dropped."""
    return passages_.where(F.col(split_col) == "train").select("unit_id", "unit_name", "passage")


def union(sources: list[DataFrame]) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def once(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """The Parquet table at ``path``; it is made and written only if it isn't there, or by force."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_graph(graph: dict[str, DataFrame], path: str) -> None:
    """Units, passages and intervals as tables, edges by type so that a query reads the types it needs."""
    for name in ("units", "passages", "intervals"):
        graph[name].write.mode("overwrite").parquet(f"{path}/{name}")
    graph["edges"].write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("units", "passages", "intervals", "edges")}


def append_missing(spark: SparkSession, rows: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key the table lacks, and returns their number: an interrupted run goes on where it was."""
    todo = rows
    if exists(spark, path):
        todo = rows.join(spark.read.parquet(path).select(*key), key, "left_anti")
    todo = todo.persist()
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    todo.unpersist()
    return n


def write_blocks(blocks: DataFrame, path: str, stats: DataFrame) -> None:
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def run_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(pattern).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def markdown(small: DataFrame) -> str:
    """A report table of a small aggregate."""
    rows = small.collect()
    head = "| " + " | ".join(small.columns) + " |\n|" + "---|" * len(small.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def report(small: DataFrame, path: str) -> None:
    """The same as JSON and Markdown, written by Spark so that any store will do."""
    spark = small.sparkSession
    rows = json.dumps([r.asDict(recursive=True) for r in small.collect()], default=str)
    for name, body in (("json", rows), ("md", markdown(small))):
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
