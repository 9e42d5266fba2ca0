"""JSON services: a batch data source of pages, and single answers with a cache in a table.

Each page is a partition, so pages are fetched in parallel by the tasks; a page or record that
fails after all attempts becomes a row with an error instead of ending the job. Answers are cached as
a Parquet table in storage that all executors share. ``fetch`` is a plug-in, so that tests and
machines without a network read fixtures.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kelpie.scratch import cut
from kelpie.sources import files


def http_get(url: str, params: dict) -> str:
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    with urllib.request.urlopen(full, timeout=30) as answer:
        return answer.read().decode()


def get_json(url: str, params: dict, attempts: int = 4, delay: float = 0.15, fetch: Callable[[str, dict], str] = http_get):
    """The parsed answer; failures are tried again after 1, 2, 4 ... seconds, and each request is followed by a short wait."""
    for attempt in range(attempts):
        try:
            body = json.loads(fetch(url, params))
            break
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(delay and 2**attempt)
    time.sleep(delay)
    return body


ANSWER = "key string, url string, params string, body string, error string"


def fetched(spark: SparkSession, requests: DataFrame, path: str, tasks: int = 6, attempts: int = 4, delay: float = 0.15, fetch: Callable[[str, dict], str] = http_get) -> DataFrame:
    """key, url, params, body, error: an answer for each distinct request (url, params as JSON text).

    Answers that the table at ``path`` has are not asked for again; new ones are added to it, failures
    are not. ``tasks`` requests run at a time, since services are public.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    rows.append((r.key, r.url, r.params, json.dumps(get_json(r.url, json.loads(r.params or "{}"), attempts, delay, fetch)), None))
                except Exception as failure:
                    rows.append((r.key, r.url, r.params, None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=["key", "url", "params", "body", "error"])

    key = F.substring(F.sha2(F.concat("url", F.coalesce("params", F.lit("{}"))), 256), 1, 24)
    wanted = requests.select(key.alias("key"), "url", "params").dropDuplicates(["key"])
    held = spark.read.schema(ANSWER).parquet(path) if files.exists(spark, path) else None
    todo = wanted if held is None else wanted.join(held.select("key"), "key", "left_anti")
    made = cut(todo.repartition(tasks, "key").mapInPandas(ask, ANSWER))
    made.where("error is null").write.mode("append").parquet(path)
    known = spark.read.schema(ANSWER).parquet(path).join(wanted.select("key"), "key", "left_semi")
    return known.unionByName(made.where("error is not null"))


def index_rows(pages: DataFrame, most: int) -> DataFrame:
    """The first ``most`` items of a paged index (page, pos, body, more), up to the first page that names no next one."""
    last = pages.where("not more").agg(F.coalesce(F.min("page"), F.lit((1 << 31) - 1)).alias("last"))  # one row
    read = pages.join(F.broadcast(last), F.col("page") <= F.col("last")).where("body is not null")
    return read.drop("last").orderBy("page", "pos").limit(most)


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedJson(DataSource):
    """``spark.read.format("paged_json")`` with options url, pages, page_param, items (dotted path), next (the key that names a next page), fixture.

    Rows: page, pos, body (an item as JSON, null on failure or for a page without items), error, more
    (whether the page names a next one). ``fixture`` is a folder that all executors see, with
    ``<page>.json`` files to read instead of the network.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, pos int, body string, error string, more boolean"

    def reader(self, schema) -> DataSourceReader:
        return PagedJsonReader(dict(self.options))


class PagedJsonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        o = self.options
        try:
            if "fixture" in o:
                with open(os.path.join(o["fixture"], f"{partition.number}.json")) as f:
                    body = json.load(f)
            else:
                body = get_json(o["url"], {o.get("page_param", "page"): partition.number})
            more = bool(body.get(o["next"])) if "next" in o else True
            for step in filter(None, o.get("items", "").split(".")):
                body = body[step]
        except Exception as failure:
            yield partition.number, 0, None, f"{type(failure).__name__}: {failure}", True
            return
        items = body if isinstance(body, list) else [body]
        for i, item in enumerate(items or [None]):
            yield partition.number, i, None if item is None else json.dumps(item), None, more


def pages_needed(items: int, page_size: int = 100) -> int:
    return -(-items // page_size)
