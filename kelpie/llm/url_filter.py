"""URL filters: a trie over reversed host labels and path segments, longest match wins.

A rule is (verdict, host, path). It fits its host and all subdomains if the URL's path starts
with the rule's. Of the rules that fit, the one with the longest text (host + path, in
characters) decides; of equally long ones block goes before allow, then the greatest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import kernels as K

#: A trie is sent to the tasks only for rules of at most so many bytes; beyond, rules are joined.
TRIE_BYTES = 8 << 20
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rank(rule: tuple[str, str]) -> tuple[int, bool, str]:
    """The order of precedence of (verdict, text): the greatest decides."""
    return len(rule[1]), rule[0] == "block", rule[1]


class Trie:
    """Nodes of host labels from the right; each holds a trie of path segments.

    A segment is a path's text up to and with its next slash, so that descending by whole
    segments equals a prefix test; a rule whose path ends within a segment is kept with its last
    node as an open end. Open ends are looked up by their lengths, however many a node has.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            whole, open_end = self.segments(path)
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            by_size = node.setdefault("ends", {}).setdefault(len(open_end), {})
            if open_end not in by_size or rank((verdict, host + path)) > rank(by_size[open_end]):
                by_size[open_end] = (verdict, host + path)

    @staticmethod
    def segments(path: str) -> tuple[list[str], str]:
        parts = path.split("/")
        return [p + "/" for p in parts[:-1]], parts[-1]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        node, segments = self.root, None
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            if "paths" not in node:
                continue
            whole, tail = segments = segments or self.segments(path)
            at = node["paths"]
            for i in range(len(whole) + 1):
                here = whole[i] if i < len(whole) else tail
                for size, by_size in at.get("ends", {}).items():
                    rule = by_size.get(here[:size])
                    if rule and (best is None or rank(rule) > rank(best)):
                        best = rule
                at = at.get("next", {}).get(here) if i < len(whole) else None
                if at is None:
                    break
        return best


def judge_urls(
    df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """id, host, path, rule (its text, null if none fits), verdict; a row for each row of ``df``.

    A null URL, or one without ``://``, has empty host and path and the default verdict unless a
    rule has an empty host. Repeated rows are judged each, an empty table gives no rows, other
    columns are not read. Rules over ``TRIE_BYTES`` are joined instead of sent, with the same
    results: see :func:`judge_urls_joined`.
    """
    rules = list(rules)
    if sum(len(h) + len(p) for _, h, p in rules) > TRIE_BYTES:
        table = df.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
        return judge_urls_joined(df, table, default, id_col, url_col)
    sent = df.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for batch in batches:
            places = [split_url(u) for u in K.column(batch, "url").to_pylist()]
            found = [trie.find(*p) for p in places]
            yield pa.RecordBatch.from_arrays(
                [
                    K.column(batch, "id"),
                    pa.array([p[0] for p in places], pa.string()),
                    pa.array([p[1] for p in places], pa.string()),
                    pa.array([f and f[1] for f in found], pa.string()),
                    pa.array([f[0] if f else default for f in found], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    return out.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def judge_urls_joined(df: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same verdicts from a rule table (verdict, host, path) of any size; nothing is sent whole.

    Each distinct place (host and path) meets the lengths that the paths of its hosts' rules have,
    by an equi-join on the host suffix; only prefixes of these lengths are then looked up, by a
    second equi-join. So rows grow with places times the distinct rule lengths of a host, not with
    the length of paths or the number of rules.
    """
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    out = out.withColumn("rest", F.coalesce(after, F.lit("")))
    out = out.withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0))
    out = out.withColumn("host", F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).select("id", "host", "path")
    table = rules.select(F.col("verdict").alias("v"), F.col("host").alias("h"), F.col("path").alias("p"))
    sizes = table.select("h", F.length("p").alias("n")).distinct()
    places = out.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    suffixes = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    keys = places.select("host", "path", F.explode(suffixes).alias("h")).join(sizes, "h").where(F.col("n") <= F.length("path"))
    keys = keys.select("host", "path", "h", F.expr("substring(path, 1, n)").alias("p"))
    text = F.concat("h", "p")
    best = F.max(F.struct(F.length(text).alias("n"), (F.col("v") == "block").alias("block"), text.alias("rule"), "v"))
    found = keys.join(table, ["h", "p"]).groupBy("host", "path").agg(best.alias("x")).select("host", "path", "x.rule", "x.v")
    return out.join(found, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict")
    )


def op9_url_trie(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
), d AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM c
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
