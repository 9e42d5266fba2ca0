"""Vector, graph and hybrid retrieval; models are plug-ins behind small protocols."""

from __future__ import annotations

import json
import threading
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps of a plan that untrusted queries may have, its expressions that hold plans, and the functions.
PLANS = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "Distinct", "Union",
    "Except", "Intersect", "UnresolvedHaving", "UnresolvedInlineTable", "OneRowRelation", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Generate",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "LateralJoin", "LocalRelation",
}
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}
#: Expressions that read more than their arguments.
LEAVES = {"InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "CurrentDatabase", "CurrentCatalog"}
FUNCTIONS = set(
    "abs any_value array array_contains array_distinct array_join array_sort avg between ceil coalesce collect_list collect_set concat concat_ws contains count count_if "
    "date_trunc dense_rank endswith explode first floor greatest if initcap instr lag last lead least left length like lower ltrim max max_by mean median min min_by "
    "month named_struct nullif nvl percentile percentile_cont posexplode range rank regexp_count regexp_extract regexp_like regexp_replace replace reverse right rlike "
    "round row_number rtrim size sort_array split split_part startswith stddev struct substr substring sum trim try_divide upper variance year".split()
)
ABSTAIN = "I don't know: nothing relevant was found."


class Embedder(Protocol):
    def documents(self, texts: Sequence[str]) -> list[list[float]]: ...
    def query(self, text: str) -> list[float]: ...


class QueryWriter(Protocol):
    def write(self, question: str, linked: dict[str, list], error: str | None = None) -> str: ...


class Answerer(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Judge(Protocol):
    def judge(self, question: str, reference: str, answer: str) -> str: ...


class FirstLine:
    """A deterministic stand-in for an answering model: the context's first line."""

    def answer(self, question: str, context: str) -> str:
        return context.splitlines()[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; not-a-number for a zero vector."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(float("nan"))))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embedded_text(title: Column, body: Column, prefix: str = "search_document: ") -> Column:
    """What is embedded of a passage: task prefix, contextual title, text."""
    return F.concat(F.lit(prefix), F.coalesce(title, F.lit("")), F.lit("\n"), body)


def top_k(passages: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` passages of highest cosine with one query vector (ties by id): scan, partial top-k, no shuffle of vectors."""
    score = cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return passages.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def top_k_by(passages: DataFrame, group: str, query: Column, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best passages of each group."""
    best = Window.partitionBy(group).orderBy(F.desc("score"), id_col)
    scored = passages.withColumn("score", cosine(F.col(vector_col), query))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def missing_embeddings(passages: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Passages that the cache (model, id, embedding) has no vector of ``model`` for."""
    return passages.join(cache.where(F.col("model") == model).select("id"), "id", "left_anti")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(node, views: set[str], is_plan) -> None:
    """Raises ValueError at the first node of a parsed plan or expression that isn't on the lists."""
    kind = node.getClass().getSimpleName()
    known = set(views)
    if kind == "UnresolvedWith":
        for name, relation in ((r._1(), r._2()) for r in _items(node.cteRelations())):
            _walk(relation, known, is_plan)
            known.add(name.lower())
    if kind == "UnresolvedRelation":
        name = _items(node.multipartIdentifier())
        if len(name) != 1 or name[0].lower() not in known:
            raise ValueError(f"only these views may be read: {', '.join(sorted(views))}")
    elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
        name = [node.name().funcName()] if kind == "UnresolvedGenerator" else _items(node.nameParts() if kind == "UnresolvedFunction" else node.name())
        if len(name) != 1 or name[0].lower() not in FUNCTIONS:
            raise ValueError(f"function {'.'.join(name)} is not allowed")
    if kind in PLANS:
        below = [*_items(node.children()), *_items(node.expressions())]
    elif is_plan(node) or kind in LEAVES:
        raise ValueError(f"{kind} is not allowed")
    else:
        below = _items(node.children())
        if kind in SUBQUERIES:
            below.append(node.plan())
    for inner in below:
        _walk(inner, known, is_plan)


def check_read_only(spark: SparkSession, query: str, views: set[str] | None = None) -> None:
    """Raises ValueError unless the query's plan is made of listed steps and functions over named views only.

    ``views`` are the names that may be read, the session's temporary views if none are given. So
    commands, files named as tables, table functions and reflection are no queries.
    """
    allowed = views if views is not None else {t.name for t in spark.catalog.listTables() if t.isTemporary}
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as failure:
        raise ValueError(f"no query: {str(failure).splitlines()[0] if str(failure) else failure}") from None
    logical = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    _walk(plan, {v.lower() for v in allowed}, logical.isInstance)


def read_untrusted(spark: SparkSession, query: str, limit: int = 200, timeout: float = 15.0, views: set[str] | None = None) -> list[dict]:
    """Rows of a query written by a model: read-only, at most ``limit`` rows, cancelled after ``timeout`` seconds."""
    check_read_only(spark, query, views)
    group = f"untrusted-{threading.get_ident()}"
    spark.sparkContext.setJobGroup(group, "untrusted query", interruptOnCancel=True)
    timer = threading.Timer(timeout, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in spark.sql(query).limit(limit).collect()]
    finally:
        timer.cancel()
        spark.sparkContext._jsc.clearJobGroup()


#: Question categories and the query over views ``edges``, ``units``, ``spans`` that answers each.
TEMPLATES = {
    "age": "SELECT replace(dst, 'interval:', '') AS age FROM edges WHERE type = 'HAS_AGE' AND src = '{key}' ORDER BY 1",
    "states": "SELECT replace(dst, 'state:', '') AS state FROM edges WHERE type = 'OCCURS_IN' AND src = '{key}' ORDER BY 1",
    "parent": "SELECT u.full_name AS parent FROM edges e JOIN units u ON u.key = e.dst WHERE e.type = 'PART_OF' AND e.src = '{key}' ORDER BY 1",
    "members": "SELECT u.full_name AS member FROM edges e JOIN units u ON u.key = e.src WHERE e.type = 'PART_OF' AND e.dst = '{key}' ORDER BY 1",
    "relation": "SELECT u.full_name AS above FROM edges e JOIN units u ON u.key = e.src WHERE e.type = 'OVERLIES' AND e.dst = '{key}' ORDER BY 1",
    "multi_hop": "SELECT DISTINCT u.full_name AS unit FROM units u JOIN edges a ON a.src = u.key AND a.type = 'HAS_AGE' JOIN spans s ON s.desc = replace(a.dst, 'interval:', '') AND s.anc = '{interval}' JOIN edges o ON o.src = u.key AND o.type = 'OCCURS_IN' AND o.dst = 'state:{state}' JOIN edges l ON l.src = u.key AND l.type = 'HAS_LITHOLOGY' AND l.dst = 'lithology:{lithology}' ORDER BY 1",
    "count": "SELECT count(DISTINCT u.key) AS count FROM units u JOIN edges a ON a.src = u.key AND a.type = 'HAS_AGE' JOIN spans s ON s.desc = replace(a.dst, 'interval:', '') AND s.anc = '{interval}' JOIN edges o ON o.src = u.key AND o.type = 'OCCURS_IN' AND o.dst = 'state:{state}'",
}


class TemplateWriter:
    """Writes a query by the words of the question and the entities linked in it."""

    def write(self, question: str, linked: dict[str, list], error: str | None = None) -> str:
        low = question.lower()
        safe = lambda v: str(v).replace("'", "''")
        if linked["intervals"] and linked["states"]:
            kind = "count" if "how many" in low else "multi_hop"
            rock = linked["lithologies"][0] if linked["lithologies"] else ""
            return TEMPLATES[kind].format(interval=safe(linked["intervals"][0]), state=safe(linked["states"][0]), lithology=safe(rock))
        if not linked["units"]:
            raise ValueError("no entity to ask about")
        kinds = (("age", "age"), ("states", "state"), ("parent", "part of"), ("members", "members"), ("relation", "overl"))
        kind = next((k for k, word in kinds if word in low), "age")
        if kind == "parent" and low.startswith("which units are part of"):
            kind = "members"
        return TEMPLATES[kind].format(key=safe(linked["units"][0]))


def row_context(query: str, rows: list[dict], linked: dict[str, list], cap: int = 60) -> str:
    """Entities, query and rows as text for an answering model; rows over ``cap`` are only counted."""
    as_json = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    shown = [as_json(r) for r in rows[:cap]] + ([f"... and {len(rows) - cap} more rows"] if len(rows) > cap else [])
    result = "\n".join([f"Result ({len(rows)} rows):", *shown]) if rows else "The graph query returned no rows."
    return "\n\n".join([f"Entities in the question:\n{as_json(linked)}", f"Graph query:\n{query}", result])


def ask_graph(spark: SparkSession, question: str, linked: dict[str, list], writer: QueryWriter | None = None, limit: int = 500) -> tuple[str, str | None]:
    """(context, error): writes a query, runs it, and lets the writer repair it once if it fails or finds nothing."""
    writer, error, query, rows = writer or TemplateWriter(), None, "", []
    for _ in range(2):
        try:
            query = writer.write(question, linked, error)
            rows = read_untrusted(spark, query, limit)
            error = None if rows else "the query returned no rows"
        except Exception as failure:
            error = str(failure)
        if rows:
            break
    return row_context(query, rows, linked), error


def passage_context(passages: DataFrame) -> DataFrame:
    """One row: passages as '[id] unit (year): text' blocks in rank order."""
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("unit_name"), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")), F.lit(": "), F.col("text"))
    rows = passages.select("rank", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return rows.select(F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("context"))


def hybrid(passages: DataFrame, describes: DataFrame, cards: DataFrame, linked_units: list[str], query: Sequence[float], k: int = 5, most_units: int = 4, routed_each: int = 2) -> dict[str, DataFrame]:
    """entry (top k), seeds (cards of linked and described units) and routed passages of linked units that entry lacks.

    Seeds are the linked units in order, then the units that the entry passages describe, up to the
    greater of ``most_units`` and the number of linked ones. Everything here is bounded by k.
    """
    spark = passages.sparkSession
    entry = top_k(passages, query, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    linked = spark.createDataFrame([(u, i) for i, u in enumerate(linked_units)], "key string, at int")
    found = entry.join(describes, "id").select("key", (F.col("rank") + len(linked_units)).alias("at"))
    seeds = linked.unionByName(found).groupBy("key").agg(F.min("at").alias("at")).orderBy("at").limit(max(most_units, len(linked_units)))
    vector = F.array(*[F.lit(float(x)) for x in query])
    mine = passages.join(describes, "id").join(F.broadcast(linked.select("key")), "key")
    routed = top_k_by(mine, "key", vector, routed_each).join(entry.select("id"), "id", "left_anti")
    return {"entry": entry, "seeds": seeds.join(cards, "key", "left"), "routed": routed}


def answer(question: str, context: str, answerer: Answerer | None = None) -> str:
    """The model's answer; without context a fixed abstention, and the model is not asked."""
    return (answerer or FirstLine()).answer(question, context) if context.strip() else ABSTAIN
