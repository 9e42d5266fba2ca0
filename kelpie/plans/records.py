"""Queries on sources, stores, folds, evaluation records and questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import text
from kelpie.operators import dedup, evaluation, graph, lifecycle, retrieval, tagging, tokens
from kelpie.plans import lexicon
from kelpie.plans.corpus import table
from kelpie.scratch import folder
from kelpie.sources import files

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS c_mktsegment FROM customer")
def jsonl_round_trip(spark, sf):
    """Rows written as JSON lines, nulls kept, and read back."""
    path = folder(spark)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("c_mktsegment"))
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT s_suppkey, s_name, s_suppkey % 2 = 0 AS again FROM supplier")
def cached_stage(spark, sf):
    """A stage is made once; only by force is it made again."""
    path, rows = folder(spark), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    files.once(spark, path, lambda: rows.withColumn("again", F.lit(False)))
    files.once(spark, path, lambda: rows.limit(0).withColumn("again", F.lit(False)))
    return files.once(spark, path, lambda: rows.withColumn("again", F.col("s_suppkey") % 2 == 0), force=True)


@query("""
WITH old AS (SELECT 'u' || c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 4 <> 3), new AS (SELECT 'u' || c_custkey AS key, c_name || '!' AS name FROM customer WHERE c_custkey % 2 = 1),
units AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE key NOT IN (SELECT key FROM new))
SELECT 'unit' AS kind, key, name AS value FROM units UNION ALL SELECT 'edge', type || ':' || src, dst FROM (SELECT 'OCCURS_IN' AS type, 'u' || c_custkey AS src, 'state:' || c_nationkey AS dst FROM customer
 UNION ALL SELECT 'WITHIN', 'n' || n_nationkey, 'r' || n_regionkey FROM nation) WHERE type = 'OCCURS_IN'""")
def graph_store(spark, sf):
    """A graph stored as tables, its units replaced by newer ones of the same key, edges read by type."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("u"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
    old, new = customers.where("k % 4 <> 3").select("key", "name"), customers.where("k % 2 = 1").select("key", F.concat("name", F.lit("!")).alias("name"))
    homes = table(spark, sf, "nation").select(F.lit("WITHIN").alias("type"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    edges = customers.select(F.lit("OCCURS_IN").alias("type"), F.col("key").alias("src"), F.concat(F.lit("state:"), F.col("n")).alias("dst")).unionByName(homes)
    path = folder(spark)
    for units in (old, graph.upsert(old, new, ["key"])):  # the second load replaces the first
        files.write_graph({"units": units, "passages": old.limit(0), "intervals": old.limit(0), "edges": edges}, path)
    held = files.read_graph(spark, path)
    occurs = held["edges"].where("type = 'OCCURS_IN'").select(F.lit("edge").alias("kind"), F.concat("type", F.lit(":"), "src").alias("key"), F.col("dst").alias("value"))
    return held["units"].select(F.lit("unit").alias("kind"), "key", F.col("name").alias("value")).unionByName(occurs)


@query("SELECT vec_id AS id, md5('search_document: label ' || label || chr(10) || vec_id) AS text FROM embeddings WHERE vec_id % 3 <> 0")
def embeddings_missing(spark, sf):
    """What has still to be embedded by one model, with its header and prefix."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    cache = vectors.where("id % 3 = 0").withColumn("model", F.lit("m")).unionByName(vectors.withColumn("model", F.lit("other")))
    todo = retrieval.missing_embeddings(vectors, cache, "m")
    return todo.select("id", F.md5(retrieval.embedded_text(F.concat(F.lit("label "), F.col("label")), F.col("id").cast("string"))).alias("text"))


@query("""SELECT o_orderkey, s AS system, CASE WHEN s = 'b' THEN 2 WHEN o_orderkey % 3 < 2 THEN 1 ELSE 2 END AS run, (SELECT count(*) FROM orders WHERE o_orderkey % 3 < 2) AS first_run, (SELECT 2 * count(*) FROM orders) - (SELECT count(*) FROM orders WHERE o_orderkey % 3 < 2) AS second_run
FROM orders, (VALUES ('a'), ('b')) v(s)""")
def resumed_results(spark, sf):
    """An interrupted run goes on where it was: only missing (question, system) pairs are appended."""
    path = folder(spark)
    orders = table(spark, sf, "orders").select("o_orderkey")
    first = orders.where("o_orderkey % 3 < 2").select("o_orderkey", F.lit("a").alias("system"), F.lit(1).alias("run"))
    both = orders.select("o_orderkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("system"), F.lit(2).alias("run"))
    added = [files.append_missing(spark, rows, path, ["o_orderkey", "system"]) for rows in (first, both)]
    return spark.read.parquet(path).withColumns({"first_run": F.lit(added[0]).cast("long"), "second_run": F.lit(added[1]).cast("long")})


@query("""
WITH r AS (SELECT 'en' AS query, doc_id // 100 AS page, doc_id % 100 AS pos, doc_id AS id, length(text) AS n FROM documents WHERE lang = 'en' AND text <> ''
 UNION ALL SELECT 'even', doc_id // 200, doc_id % 200 // 2, doc_id, length(text) FROM documents WHERE doc_id % 2 = 0 AND text <> ''),
a AS (SELECT *, (SELECT count(*) FROM r b WHERE b.query = 'en' AND b.page < r.page) AS before FROM r WHERE query = 'en'), t1 AS (SELECT * FROM a WHERE before < 150),
f AS (SELECT * FROM r WHERE query = 'even' AND id NOT IN (SELECT id FROM t1)), b AS (SELECT *, (SELECT count(*) FROM f g WHERE g.page < f.page) AS before FROM f), t2 AS (SELECT * FROM b WHERE before < 150)
SELECT query, CAST(page AS BIGINT) AS page, id FROM t1 UNION ALL SELECT query, CAST(page AS BIGINT), id FROM t2""")
def multi_query_scan(spark, sf):
    """Two queries over one service: ids owned by the first to see them, pages read up to a quota."""
    docs, key = table(spark, sf, "documents"), F.col("doc_id")
    one = docs.where("lang = 'en'").select(F.lit("en").alias("query"), F.floor(key / 100).alias("page"), (key % 100).alias("pos"), key.alias("id"), "text")
    two = docs.where("doc_id % 2 = 0").select(F.lit("even").alias("query"), F.floor(key / 200).alias("page"), F.floor(key % 200 / 2).alias("pos"), key.alias("id"), "text")
    return files.scan_queries(one.unionByName(two), ["en", "even"], 150).select("query", "page", "id")


@query("""SELECT 'chrono' AS kind, p_name || p_partkey AS name FROM part WHERE p_size % 6 < 5 AND p_partkey % 7 NOT IN (1, 2)
UNION ALL SELECT DISTINCT 'mineral', split_part(p_name, ' ', 1) FROM part WHERE length(split_part(p_name, ' ', 1)) >= 5
UNION ALL SELECT DISTINCT 'name', split_part(p_name, ' ', 2) FROM part WHERE length(split_part(p_name, ' ', 2)) >= 4""")
def vocabulary_kept(spark, sf):
    """Vocabulary records by their filters: ranks, earthly timescales, lengths."""
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    rank = F.element_at(F.array(*[F.lit(r) for r in ("eon", "era", "period", "epoch", "age", "supereon")]), F.col("p_size") % 6 + 1)
    scale = F.when(key % 7 == 1, "Lunar stages").when(key % 7 == 2, "Old MARTIAN scale").when(key % 7 != 3, "International")
    scales = F.when(key % 7 != 4, F.array(F.struct(scale.alias("name")), F.struct(F.lit("b").alias("name"))))
    intervals = part.select(F.concat("p_name", key).alias("name"), rank.alias("int_type"), scales.alias("timescales"), F.lit(0.0).alias("t_age"), F.lit(1.0).alias("b_age"))
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    kept = tagging.vocabulary_filters(intervals, part.select(word(0).alias("mineral")), part.select(word(1).alias("strat_name")))
    rows = [k.select(F.lit(n).alias("kind"), F.col(k.columns[0]).alias("name")) for n, k in zip(("chrono", "mineral", "name"), kept, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""
WITH v AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events), t AS (SELECT *, min(value) OVER w AS low, max(value) OVER w AS high FROM v WHERE back <= 40 WINDOW w AS (PARTITION BY user_id))
SELECT user_id, string_agg(substr('▁▂▃▄▅▆▇█', CASE WHEN high > low THEN CAST(floor((value - low) / (high - low) * 7) AS INT) ELSE 0 END + 1, 1), '' ORDER BY event_id) AS line FROM t GROUP BY user_id""")
def sparklines(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("values"))
    return rows.select("user_id", text.sparkline(F.col("values")).alias("line"))


@query("""
WITH x AS (SELECT *, ['judge', 'count', 'all', 'any'][o_orderkey % 4 + 1] AS kind, o_custkey % 50 AS n, 'The total is ' || (o_custkey % 60) || CASE WHEN o_orderkey % 3 = 0 THEN ' as Count' ELSE '' END || ' of ' || o_orderstatus || ' and ' || o_orderpriority AS ctx FROM orders)
SELECT o_orderkey, kind, CASE kind WHEN 'judge' THEN CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END WHEN 'count' THEN CASE WHEN regexp_matches(ctx, '\\b' || n || '\\b') AND contains(lower(ctx), 'count') THEN 1.0 ELSE 0.0 END
 WHEN 'all' THEN (CAST(o_orderstatus = 'F' AS INT) + CAST(substr(o_orderpriority, 3) = 'HIGH' AS INT)) / 2.0 ELSE CASE WHEN o_orderstatus = 'F' OR substr(o_orderpriority, 3) = 'HIGH' THEN 1.0 ELSE 0.0 END END AS recall FROM x""")
def context_recall_rows(spark, sf):
    """Whether a context holds the gold: its source, its number with the word count, its items."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("judge", "count", "all", "any")]), (key % 4 + 1).cast("int"))
    context = F.concat(F.lit("The total is "), cust % 60, F.when(key % 3 == 0, " as Count").otherwise(""), F.lit(" of "), F.col("o_orderstatus"), F.lit(" and "), F.col("o_orderpriority"))
    sources = F.array(F.lit("s1"), F.concat(F.lit("s"), cust % 3))
    recall = evaluation.context_recall(kind, F.array(F.lit("F"), F.lit("HIGH")), cust % 50, F.lit("s0"), context, sources)
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), recall.alias("recall"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN CAST(p_size % 2 <> 0 AS INT) ELSE 1 END AS verdict FROM part""")
def judge_verdicts(spark, sf):
    """Verdicts in replies of a judging model: JSON with text around it, other numbers, a literal, nothing."""
    key = F.col("p_partkey") % 6
    reply = (
        F.when(key == 0, '{"correct": 1, "reason": "as the reference"}').when(key == 1, 'Well: {"correct": 0} so').when(key == 2, 'it says "correct": 1 though').when(key == 3, "I cannot judge.")
        .when(key == 4, F.concat(F.lit('{"reason": "x", "correct": '), F.col("p_size") % 2, F.lit("}"))).otherwise('{"correct": "1"}')
    )
    return table(spark, sf, "part").select("p_partkey", evaluation.judge_verdict(reply).alias("verdict"))


@query("SELECT count(*) AS n, round(avg(CAST(l_quantity - greatest(l_discount * 400, l_tax * 500, 20) > 0 AS INT)), 4) AS accuracy, round(avg(l_quantity - greatest(l_discount * 400, l_tax * 500, 20)), 4) AS mean_margin FROM lineitem")
def probe_scores(spark, sf):
    probes = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("answer_score"), F.array(F.col("l_discount") * 400, F.col("l_tax") * 500, F.lit(20.0)).alias("distractor_scores"))
    return evaluation.probe_summary(probes)


@query("SELECT c_custkey, o_orderstatus AS c_mktsegment FROM customer JOIN (SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def reviewed_gold(spark, sf):
    """Only reviewed rows are gold, once there are any."""
    fixes = table(spark, sf, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("c_mktsegment"))
    gold = evaluation.patched_gold(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), fixes, "c_custkey", ["c_mktsegment"])
    return evaluation.gold_rows(gold).select("c_custkey", "c_mktsegment")


@query("""
WITH s AS (SELECT 'r' || n_nationkey AS run, n_nationkey * 100 AS iters_done, n_nationkey / 7.0 AS best_val_loss, n_nationkey / 3.0 AS test_loss, n_nationkey * 1.26 AS wall_minutes, n_regionkey AS alerts FROM nation),
e AS (SELECT 'r' || (p_partkey % 30) AS run, CASE WHEN p_partkey < 20 THEN 'tuned' ELSE 'base' END AS system, p_size / 77.0 AS macro_f1, p_size / 50.0 AS parse_rate FROM part WHERE p_partkey < 45),
b AS (SELECT run, arg_min(macro_f1, system <> 'tuned') AS macro_f1, arg_min(parse_rate, system <> 'tuned') AS parse_rate FROM e GROUP BY run)
SELECT run, iters_done, round(best_val_loss, 4) AS best_val_loss, round(test_loss, 4) AS test_loss, round(macro_f1, 3) AS macro_f1, round(parse_rate, 3) AS parse_rate, CAST(round(wall_minutes, 1) AS DOUBLE) AS wall_minutes, CAST(alerts AS INTEGER) AS alerts FROM s LEFT JOIN b USING (run)""")
def run_comparison(spark, sf):
    """Every run beside its evaluation, the tuned system before the base."""
    n = F.col("n_nationkey")
    summaries = table(spark, sf, "nation").select(
        F.concat(F.lit("r"), n).alias("run"), (n * 100).alias("iters_done"), (n / 7.0).alias("best_val_loss"), (n / 3.0).alias("test_loss"), (n * 1.26).alias("wall_minutes"),
        F.slice(F.array(*[F.lit(f"alert {i}") for i in range(5)]), F.lit(1), F.col("n_regionkey")).alias("alerts"),
    )
    part = table(spark, sf, "part").where("p_partkey < 45")
    found = part.select(F.concat(F.lit("r"), F.col("p_partkey") % 30).alias("run"), F.when(F.col("p_partkey") < 20, "tuned").otherwise("base").alias("system"), (F.col("p_size") / 77.0).alias("macro_f1"), (F.col("p_size") / 50.0).alias("parse_rate"))
    return evaluation.run_table(summaries, found)


_TURNS = """
tn AS (SELECT conv_id // 100 AS shard, trim(text, ' ') AS t, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id * 1000 + turn) AS i FROM conversations WHERE trim(text, ' ') <> ''),
fold(shard, i, held, n, nth, made) AS (SELECT shard, CAST(0 AS BIGINT), '', 0, 0, NULL::VARCHAR FROM tn WHERE i = 1 UNION ALL
 SELECT f.shard, tn.i, CASE WHEN f.n + length(t) > 1500 THEN '' WHEN held = '' THEN t ELSE held || ' ' || t END, CASE WHEN f.n + length(t) > 1500 THEN 0 ELSE f.n + length(t) END, CASE WHEN f.n + length(t) > 1500 THEN f.nth + 1 ELSE f.nth END,
 CASE WHEN f.n + length(t) > 1500 THEN CASE WHEN held = '' THEN t ELSE held || ' ' || t END END FROM fold f JOIN tn ON tn.shard = f.shard AND tn.i = f.i + 1),
made AS (SELECT shard, nth - 1 AS nth, made AS text FROM fold WHERE made IS NOT NULL)"""


def _turns(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select(F.floor(F.col("conv_id") / 100).alias("shard"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "text")


@query(f"WITH RECURSIVE {_TURNS} SELECT shard, CAST(nth AS INTEGER) AS nth, md5(text) AS digest FROM made")
def greedy_documents(spark, sf):
    """Conversation turns of each hundred conversations joined to documents of over 1,500 characters."""
    return tokens.greedy_documents(_turns(spark, sf), "shard", "at").select("shard", "nth", F.md5("text").alias("digest"))


@query(f"""WITH RECURSIVE {_TURNS}, d AS (SELECT text, row_number() OVER (ORDER BY shard, nth) AS doc FROM made QUALIFY doc <= 40),
k AS (SELECT doc, unnest(list_append(list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: length(w)), 0)) AS tok, unnest(range(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 1)) AS i FROM d),
p AS (SELECT tok, row_number() OVER (ORDER BY doc, i) - 1 AS pos FROM k)
SELECT pos // 256 AS block, md5(string_agg(CAST(tok AS VARCHAR), ',' ORDER BY pos)) AS digest FROM p GROUP BY 1 HAVING count(*) = 256""")
def forgetting_blocks(spark, sf):
    """Token blocks of a probe from a corpus of its own."""
    sizes = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.length)
    blocks = lifecycle.forgetting_probe(_turns(spark, sf), "shard", "at", 40, sizes, 256, 0)
    return blocks.select("block", F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query(r"""SELECT doc_id, md5(array_to_string(list_transform(w[:len(w) - 1], lambda x: length(x)), ',')) AS inputs, md5(array_to_string(list_transform(w[2:], lambda x: length(x)), ',')) AS targets
FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)""")
def shifted_pairs(spark, sf):
    """Inputs and targets of next-token training."""
    sizes = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.length)
    inputs, targets = tokens.shifted(F.col("t"))
    digest = lambda c: F.md5(F.array_join(c.cast("array<string>"), ","))
    return table(spark, sf, "documents").select("doc_id", sizes.alias("t")).select("doc_id", digest(inputs).alias("inputs"), digest(targets).alias("targets"))


@query(r"""SELECT CAST(sum((length(text) + 2) // 3) AS BIGINT) AS tokens_before, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens_after, round(100 * (sum((length(text) + 2) // 3) - sum((length(text) + 3) // 4)) / sum((length(text) + 2) // 3), 2) AS reduction_pct FROM documents""")
def token_saving(spark, sf):
    """What an extended vocabulary saves, here pieces of four characters for three."""
    pieces = lambda n: F.regexp_extract_all("text", F.lit("(?s).{1," + str(n) + "}"), F.lit(0))
    return tokens.saving(table(spark, sf, "documents"), pieces(3), pieces(4))


@query("SELECT lower(w) AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*')) AS w FROM documents) GROUP BY 1")
def trainer_words(spark, sf):
    """The word counts that a tokeniser's trainer takes."""
    return tokens.trainer_input(table(spark, sf, "documents"))


@query("""
WITH RECURSIVE c AS (SELECT DISTINCT o_orderkey AS id, cell FROM (SELECT o_orderkey, 'a' || (o_custkey % 400) AS cell FROM orders UNION ALL SELECT o_orderkey, 'b' || CAST(floor(o_totalprice / 700) AS BIGINT) FROM orders UNION ALL SELECT o_orderkey, 'c' || o_orderkey % 3000 FROM orders)),
st(id, status, round) AS (SELECT DISTINCT id, 'open', 0 FROM c UNION ALL
 SELECT s.id, CASE WHEN s.status <> 'open' THEN s.status WHEN k.kept THEN 'kept' WHEN k.gone THEN 'dropped' ELSE 'open' END, s.round + 1 FROM st s JOIN (
  SELECT x.id, bool_and(x.id = x.low) AS kept, bool_or(x.low <> x.id AND x.low_kept) AS gone FROM (
   SELECT o.id, o.cell, o.low, bool_and(l.mine) AS low_kept FROM (SELECT c.id, c.cell, min(c.id) OVER (PARTITION BY c.cell) AS low FROM c JOIN st t ON t.id = c.id AND t.status = 'open') o
   JOIN (SELECT c.id, c.id = min(c.id) OVER (PARTITION BY c.cell) AS mine FROM c JOIN st t ON t.id = c.id AND t.status = 'open') l ON l.id = o.low GROUP BY o.id, o.cell, o.low) x GROUP BY x.id) k ON k.id = s.id
 WHERE s.status = 'open')
SELECT id FROM st WHERE status = 'dropped'""")
def greedy_removal(spark, sf):
    """Which of the orders a scan in order drops, where each shares three kinds of cells with others."""
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    cells = F.array(F.concat(F.lit("a"), F.col("o_custkey") % 400), F.concat(F.lit("b"), F.floor(F.col("o_totalprice") / 700)), F.concat(F.lit("c"), key % 3000))
    return dedup.greedy_drop(orders.select(key.alias("id"), F.explode(cells).alias("cell")))


@query(f"""{lexicon._ALL} SELECT pid AS id, key AS unit_key, CASE WHEN unit_id % 2 = 0 THEN unit_name || ' Shale Member' ELSE unit_name END AS full_name, contains(lower('what is said of the ' || unit_name || ' beds?'), lower(unit_name)) AS names_it
FROM numbered WHERE length(passage) BETWEEN 300 AND 1500""")
def descriptive_questions(spark, sf):
    """Passages that a model may be asked to write a question on, and whether a question names the unit."""
    g = lexicon._graph(spark, sf)
    rows = evaluation.descriptive_candidates(g["passages"], g["units"])
    asked = F.concat(F.lit("What is said of the "), F.col("unit_name"), F.lit(" beds?"))
    return rows.select("id", "unit_key", "full_name", evaluation.names_its_unit(asked, F.col("full_name")).alias("names_it"))


_CLEAN = "clean AS (SELECT key, unit_name || ' Shale Member' AS full_name, states FROM head WHERE unit_id % 2 = 0)"
_STATE = "[['KS', 'Kansas'], ['TX', 'Texas'], ['OK', 'Oklahoma'], ['WV', 'West Virginia']]"


@query(f"""{lexicon._ALL}, {_CLEAN},
lith AS (SELECT src AS key, substr(dst, 11) AS rock FROM edges WHERE type = 'HAS_LITHOLOGY' AND list_contains(sources, 'geolex')),
dated AS (SELECT h.key, CASE WHEN h.unit_id % 2 = 0 THEN h.unit_name || ' Shale Member' ELSE h.unit_name END AS full_name, unnest(h.states) AS st FROM head h WHERE h.unit_id % 2 = 1),
placed AS (SELECT d.*, s[2] AS state FROM dated d JOIN (SELECT unnest({_STATE}) AS s) ON s[1] = d.st),
nms AS (SELECT key, CASE WHEN unit_id % 2 = 0 THEN unit_name || ' Shale Member' ELSE unit_name END AS nm FROM head UNION ALL SELECT DISTINCT b_key, b FROM up WHERE b_key LIKE 'name:%'
 UNION ALL SELECT 'name:umber', 'Umber Group'),
q AS (
 SELECT 'states-' || key AS id, 'states' AS category, 'In which US states does the ' || full_name || ' occur?' AS question, list_transform(states, lambda c: list_filter({_STATE}, lambda s: s[1] = c)[1][2]) AS items, NULL::BIGINT AS n, 'all' AS match FROM clean
 UNION ALL SELECT 'parent-' || c.key, 'parent', 'What larger stratigraphic unit is the ' || c.full_name || ' part of?', list_sort(list(DISTINCT nm)), NULL, 'any' FROM clean c JOIN edges e ON e.src = c.key AND e.type = 'PART_OF' JOIN nms ON nms.key = e.dst GROUP BY c.key, c.full_name
 UNION ALL SELECT 'relation-' || c.key, 'relation', 'Which unit overlies the ' || c.full_name || '?', list_sort(list(DISTINCT nm)), NULL, 'any' FROM clean c JOIN edges e ON e.dst = c.key AND e.type = 'OVERLIES' JOIN nms ON nms.key = e.src GROUP BY c.key, c.full_name
 UNION ALL SELECT 'multi_hop-' || p || '-' || st || '-' || rock, 'multi_hop', 'Which ' || p || ' units in ' || state || ' consist of ' || rock || '?', list_sort(list(DISTINCT full_name)), NULL, 'all' FROM placed JOIN lith USING (key), (VALUES ('Late Cretaceous'), ('Cretaceous')) v(p) GROUP BY p, st, state, rock HAVING count(DISTINCT key) BETWEEN 2 AND 8
 UNION ALL SELECT 'count-' || p || '-' || st, 'count', 'How many ' || p || ' units occur in ' || state || '?', NULL, count(DISTINCT key), 'count' FROM placed, (VALUES ('Late Cretaceous'), ('Cretaceous')) v(p) GROUP BY p, st, state HAVING count(DISTINCT key) BETWEEN 5 AND 80)
SELECT id, category, question, coalesce(array_to_string(items, '; '), '') AS items, n AS gold_count, match FROM q QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('17|' || id), id) <= 8""")
def question_set(spark, sf):
    """Questions with their gold from the graph, drawn by seed, eight of each category at most."""
    g = lexicon._graph(spark, sf)
    asked = evaluation.questions(g["units"], g["edges"], graph.closure(graph.within(g["intervals"])), ["Late Cretaceous", "Cretaceous"])
    return asked.select("id", "category", "question", F.coalesce(F.array_join("gold_items", "; "), F.lit("")).alias("items"), "gold_count", "match")


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, 'k' || label AS key, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q),
e AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
sd AS (SELECT key, min(place) AS place FROM (SELECT 'k9' AS key, 0 AS place UNION ALL SELECT 'k2', 1 UNION ALL SELECT key, rank + 2 FROM e) GROUP BY key ORDER BY place LIMIT 4),
r AS (SELECT vec_id, key, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS rank FROM s WHERE key IN ('k9', 'k2') QUALIFY rank <= 2)
SELECT 'entry' AS part, CAST(vec_id AS VARCHAR) AS id FROM e UNION ALL SELECT 'seed', key FROM sd UNION ALL SELECT 'routed', CAST(vec_id AS VARCHAR) FROM r WHERE vec_id NOT IN (SELECT vec_id FROM e)""")
def hybrid_retrieval(spark, sf):
    """The nearest passages, the cards that they and the linked units lead to, and passages of linked units."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    wanted = vectors.where("id = 7").first()
    describes = vectors.select("id", F.concat(F.lit("k"), F.col("label")).alias("key"))
    cards = spark.range(10).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("card").alias("card"))
    found = retrieval.hybrid(vectors.drop("label"), describes, cards, ["k9", "k2"], wanted["embedding"] if wanted else [1.0])
    part = lambda n, c: found[n + ("s" if n == "seed" else "")].select(F.lit(n).alias("part"), F.col(c).cast("string").alias("id"))
    return part("entry", "id").unionByName(part("seed", "key")).unionByName(part("routed", "id"))


@query("""WITH t AS (SELECT item_id, '[' || item_id || '] u' || (item_id % 3) || CASE WHEN item_id % 2 = 0 THEN ' (' || (1900 + item_id) || ')' ELSE '' END || ': ' || text AS line FROM benchmark WHERE item_id < 8) SELECT string_agg(line, chr(10) || chr(10) ORDER BY item_id DESC) AS context FROM t""")
def passage_blocks(spark, sf):
    """Passages as an answering model sees them, in rank order."""
    key = F.col("item_id")
    rows = table(spark, sf, "benchmark").where("item_id < 8").select(key.cast("string").alias("id"), (-key).alias("rank"), F.concat(F.lit("u"), key % 3).alias("unit_name"), F.when(key % 2 == 0, 1900 + key).alias("year"), "text")
    return retrieval.passage_context(rows)


@query(f"""{lexicon._ALL}, {_CLEAN}, w AS (SELECT key, full_name, states FROM clean ORDER BY key LIMIT 6)
SELECT full_name AS unit, CASE WHEN i.q = 'states' THEN array_to_string(list_sort(states), ',') ELSE coalesce((SELECT string_agg(DISTINCT n.nm, ',' ORDER BY n.nm) FROM edges e JOIN (SELECT key, CASE WHEN unit_id % 2 = 0 THEN unit_name || ' Shale Member' ELSE unit_name END AS nm FROM head
 UNION ALL SELECT DISTINCT b_key, b FROM up WHERE b_key LIKE 'name:%') n ON n.key = e.dst WHERE e.type = 'PART_OF' AND e.src = w.key), '') END AS rows, i.q AS asked, true AS answered FROM w, (VALUES ('states'), ('parent')) i(q)""")
def graph_answers(spark, sf):
    """Questions on units, answered by queries that a writer makes, checked and run."""
    g = lexicon._graph(spark, sf)
    g["edges"].select("type", "src", "dst").createOrReplaceTempView("edges")
    g["units"].select("key", "full_name").createOrReplaceTempView("units")
    units = g["units"].where("geolex and rank <> 'Unknown'").orderBy("key").limit(6).collect()
    out = []
    for u in units:
        for asked, question, field in (("states", f"In which states does the {u['full_name']} occur?", "state"), ("parent", f"What is the {u['full_name']} part of?", "parent")):
            linked = {"units": [u["key"]], "intervals": [], "states": [], "lithologies": []}
            context, _ = retrieval.ask_graph(spark, question, linked)
            rows = sorted({line.split('": "')[1].rstrip('"}') for line in context.split("\n") if line.startswith('{"' + field)})
            out.append((u["full_name"], ",".join(rows), asked, retrieval.answer(question, context) != retrieval.ABSTAIN))
    return spark.createDataFrame(out, "unit string, rows string, asked string, answered boolean")


@query(f"""{lexicon._ALL}, qs AS (SELECT k AS id, CASE k % 3 WHEN 0 THEN 'How old is the ' || unit_name || ' Shale in ' || CASE n % 2 WHEN 0 THEN 'West Virginia' ELSE 'Texas' END || '?' WHEN 1 THEN 'Which Late Cretaceous ' || rock || 's lie near ' || unit_name || ' in KS?' ELSE 'what of ' || lower(unit_name) || ' shale?' END AS q FROM lex),
tk AS (SELECT id, q, string_split(regexp_replace(q, '[?]', ''), ' ') AS w FROM qs),
un AS (SELECT tk.id, list(DISTINCT h.key) AS units FROM (SELECT id, unnest(w) AS w FROM tk) tk JOIN head h ON h.unit_name = tk.w GROUP BY tk.id)
SELECT id, coalesce(array_to_string(units, ','), '') AS units, CASE WHEN contains(q, 'Late Cretaceous') THEN 'Late Cretaceous' ELSE '' END AS intervals,
 CASE WHEN contains(q, 'West Virginia') THEN 'WV' WHEN contains(q, 'Texas') THEN 'TX' WHEN contains(q, 'KS') THEN 'KS' ELSE '' END AS states,
 CASE WHEN regexp_matches(q, '^Which') THEN regexp_extract(q, '(shale|limestone|sandstone|chalk|marl)s lie', 1) WHEN regexp_matches(q, '^what') THEN 'shale' WHEN units IS NULL THEN 'shale' ELSE '' END AS lithologies FROM tk LEFT JOIN un USING (id)""")
def linked_questions(spark, sf):
    """The units, intervals, states and rocks that each question of a table names."""
    g = lexicon._graph(spark, sf)
    key, unit = F.col("p_partkey"), lexicon._name(F.floor(F.col("p_partkey") / 4))
    rock = F.element_at(F.array(*[F.lit(r) for r in lexicon.ROCKS]), (key % 5 + 1).cast("int"))
    asked = (
        F.when(key % 3 == 0, F.concat(F.lit("How old is the "), unit, F.lit(" Shale in "), F.when(F.col("p_size") % 2 == 0, "West Virginia").otherwise("Texas"), F.lit("?")))
        .when(key % 3 == 1, F.concat(F.lit("Which Late Cretaceous "), rock, F.lit("s lie near "), unit, F.lit(" in KS?"))).otherwise(F.concat(F.lit("what of "), F.lower(unit), F.lit(" shale?")))
    )
    rocks = spark.createDataFrame([(r,) for r in lexicon.ROCKS], "name string")
    found = tagging.link_all(table(spark, sf, "part").select(key.alias("id"), asked.alias("question")), g["units"].where("geolex"), g["intervals"], rocks)
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("units", "intervals", "states", "lithologies")])
