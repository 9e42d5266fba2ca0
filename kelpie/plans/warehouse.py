"""Queries on the relational tables: graph, closure, cards, retrieval, scores, reports, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import facts, fixed, text
from kelpie.operators import evaluation, graph, monitor, retrieval, tagging
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


def _raw_edges(spark, sf):
    """Customers and suppliers as units, nations as states, regions above them, orders as passages."""
    t = lambda n: table(spark, sf, n)
    ref = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    customers = t("customer").withColumn("ord", F.col("c_custkey"))
    lines = t("orders").withColumn("ord", F.col("o_orderkey"))
    parts = graph.edge(customers, "OCCURS_IN", ref("geolex", "c_custkey"), ref("state", "c_nationkey"), "customer")
    homes = graph.edge(t("nation").withColumn("ord", F.col("n_nationkey")), "WITHIN", ref("interval", "n_nationkey"), F.concat(F.lit("interval:r"), F.col("n_regionkey")))
    made = graph.edge(
        lines, "DESCRIBES", ref("geolex", "o_custkey"), ref("lithology", "o_orderpriority"), "orders", passage=F.col("o_orderkey").cast("string"),
        usage=F.col("o_orderstatus"), unconformable=F.col("o_orderstatus") == "F",
    )
    return parts.unionByName(homes).unionByName(made)


_RAW = """
raw AS (
 SELECT 'OCCURS_IN' AS type, 'geolex:' || c_custkey AS src, 'state:' || c_nationkey AS dst, 'customer' AS source, NULL::VARCHAR AS passage, NULL::VARCHAR AS usage, NULL::BOOLEAN AS unconformable, c_custkey AS ord FROM customer
 UNION ALL SELECT 'WITHIN', 'interval:' || n_nationkey, 'interval:r' || n_regionkey, NULL, NULL, NULL, NULL, n_nationkey FROM nation
 UNION ALL SELECT 'DESCRIBES', 'geolex:' || o_custkey, 'lithology:' || o_orderpriority, 'orders', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderstatus = 'F', o_orderkey FROM orders),
edges AS (SELECT type, src, dst, list_sort(list_distinct(list(source) FILTER (source IS NOT NULL))) AS sources, list_sort(list_distinct(list(passage) FILTER (passage IS NOT NULL))) AS passages,
 arg_min(usage, ord) FILTER (usage IS NOT NULL) AS usage, coalesce(bool_or(unconformable), false) AS unconformable FROM raw WHERE src <> dst GROUP BY type, src, dst)"""


@query(f"WITH {_RAW} SELECT type, src, dst, coalesce(array_to_string(sources, ','), '') AS sources, coalesce(array_to_string(passages, ','), '') AS passages, usage, unconformable FROM edges")
def graph_edges_merged(spark, sf):
    merged = graph.merge_edges(_raw_edges(spark, sf))
    return merged.withColumns({c: F.array_join(c, ",") for c in ("sources", "passages")})


@query(f"WITH {_RAW} SELECT type, source, count(*) AS edges FROM (SELECT type, unnest(CASE WHEN len(coalesce(sources, [])) > 0 THEN sources ELSE ['derived'] END) AS source FROM edges) GROUP BY type, source")
def graph_counts(spark, sf):
    return graph.counts(graph.merge_edges(_raw_edges(spark, sf)))


@query(f"""WITH {_RAW} SELECT DISTINCT CASE WHEN ref LIKE 'lithology:%' THEN 'Lithology' ELSE 'State' END AS kind, substr(ref, strpos(ref, ':') + 1) AS key
FROM (SELECT dst AS ref FROM edges) WHERE ref LIKE 'lithology:%' OR ref LIKE 'state:%'""")
def graph_leaf_nodes(spark, sf):
    return graph.leaf_nodes(graph.merge_edges(_raw_edges(spark, sf)))


@query(f"""WITH {_RAW}, ends AS (SELECT src AS key, type, 'out' AS direction, dst AS n FROM edges UNION ALL SELECT dst, type, 'in', src FROM edges)
SELECT key, type, direction, md5(array_to_string(list_sort(list(DISTINCT n)), ',')) AS neighbours FROM ends GROUP BY ALL""")
def graph_adjacency(spark, sf):
    return graph.adjacency(graph.merge_edges(_raw_edges(spark, sf))).withColumn("neighbours", F.md5(F.array_join("neighbours", ",")))


def _spans(spark, sf):
    t = lambda n: table(spark, sf, n)
    text_of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = t("customer").select(text_of("c", "c_custkey").alias("child"), text_of("n", "c_nationkey").alias("parent"))
    rows = rows.unionByName(t("nation").select(text_of("n", "n_nationkey").alias("child"), text_of("r", "n_regionkey").alias("parent")))
    return graph.closure(rows)


_SPANS = """
e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w(descendant, anc, depth) AS (SELECT n, n, 0 FROM (SELECT child AS n FROM e UNION SELECT parent FROM e) UNION ALL SELECT w.descendant, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.anc WHERE w.depth < 6),
spans AS (SELECT descendant, anc, min(depth) AS depth FROM w GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_SPANS} SELECT descendant AS \"desc\", anc, CAST(depth AS INTEGER) AS depth FROM spans")
def closure(spark, sf):
    return _spans(spark, sf)


@query(f"WITH RECURSIVE {_SPANS} SELECT anc, count(DISTINCT o_custkey) AS members FROM orders JOIN spans ON descendant = 'c' || o_custkey GROUP BY anc")
def closure_members(spark, sf):
    occurs = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.concat(F.lit("c"), F.col("o_custkey")).alias("desc"))
    return graph.members(_spans(spark, sf), occurs)


@query(f"""WITH RECURSIVE {_SPANS} SELECT DISTINCT c_name AS unit, o_orderpriority AS lithology FROM customer JOIN spans ON descendant = 'c' || c_custkey AND anc = 'r1'
JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '5-LOW'""")
def multi_hop(spark, sf):
    customers = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", F.col("c_name").alias("unit"), F.concat(F.lit("c"), F.col("c_custkey")).alias("desc"))
    orders = table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("lithology"))
    return customers.join(_spans(spark, sf).where("anc = 'r1'"), "desc").join(orders, "c_custkey").select("unit", "lithology").distinct()


@query("""SELECT 'geolex:' || c_custkey AS key, c_name AS unit, coalesce(array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderpriority IS NOT NULL))), ', '), '') AS lithologies, any_value(CAST(c_nationkey AS VARCHAR)) AS states
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def unit_card(spark, sf):
    units = table(spark, sf, "customer").select(F.concat(F.lit("geolex:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("full_name"), F.lit("Group").alias("rank"))
    raw = _raw_edges(spark, sf).withColumn("type", F.when(F.col("type") == "DESCRIBES", "HAS_LITHOLOGY").otherwise(F.col("type")))
    cards = graph.unit_cards(units, graph.merge_edges(raw))
    return cards.select("key", "unit", F.array_join("lithologies", ", ").alias("lithologies"), F.array_join("states", ", ").alias("states"))


_INTERVALS = """
i AS (SELECT 'p' || p_partkey AS name, ['age','epoch','period','era'][(p_partkey % 4) + 1] AS rank, (p_partkey % 4) AS level,
 CASE p_partkey % 4 WHEN 0 THEN p_size * 10.0 + 1 WHEN 1 THEN (p_size // 5) * 50.0 WHEN 2 THEN (p_size // 10) * 100.0 ELSE 0.0 END AS t,
 CASE p_partkey % 4 WHEN 0 THEN p_size * 10.0 + 9 WHEN 1 THEN (p_size // 5) * 50.0 + 50 WHEN 2 THEN (p_size // 10) * 100.0 + 100 ELSE 600.0 END AS b FROM part)"""


@query(f"""WITH {_INTERVALS}, pairs AS (SELECT c.name AS child, p.name AS parent, p.level, min(p.level) OVER (PARTITION BY c.name) AS least
FROM i c JOIN i p ON p.level > c.level AND p.t - 0.01 <= c.t AND c.b <= p.b + 0.01) SELECT child, parent FROM pairs WHERE level = least""")
def interval_within(spark, sf):
    return graph.within(_intervals(table(spark, sf, "part")))


def _intervals(part):
    """Parts as intervals of four ranks."""
    ranks = F.array(*[F.lit(r) for r in fixed.INTERVAL_RANKS[:4]])
    kind = F.col("p_partkey") % 4
    top = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_size * 10.0 + 1 WHEN 1 THEN (p_size div 5) * 50.0 WHEN 2 THEN (p_size div 10) * 100.0 ELSE 0.0 END").cast("double")
    base = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_size * 10.0 + 9 WHEN 1 THEN (p_size div 5) * 50.0 + 50 WHEN 2 THEN (p_size div 10) * 100.0 + 100 ELSE 600.0 END").cast("double")
    return part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), F.get(ranks, kind.cast("int")).alias("rank"), top.alias("t_age"), base.alias("b_age"))


@query("""
WITH nm AS (SELECT *, lower(p_name) || ' ' || translate(CAST(p_partkey % 300 AS VARCHAR), '0123456789', 'klmnopqrsz') AS core, lower(p_name) || ' ' || translate(CAST(p_partkey * 7 % 400 AS VARCHAR), '0123456789', 'klmnopqrsz') AS said FROM part),
best AS (SELECT m.p_partkey, count(u.p_partkey) AS n, max(CAST(u.p_size = m.p_size AS INT)) AS shared, arg_min(u.p_partkey, (-CAST(u.p_size = m.p_size AS INT), u.p_partkey)) AS k FROM nm m LEFT JOIN nm u ON u.core = m.said GROUP BY m.p_partkey)
SELECT p_partkey AS ord, said AS core, CASE WHEN n = 0 THEN 'name:' || said ELSE 'geolex:' || k END AS key, CASE WHEN n = 0 THEN 'placeholder' WHEN n = 1 THEN 'resolved' WHEN shared > 0 THEN 'by_state' ELSE 'guess' END AS outcome FROM nm JOIN best USING (p_partkey)""")
def entity_resolution(spark, sf):
    """Every part is a unit with one state, and mentions another unit, or none, with a state."""
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    name = lambda number: F.concat("p_name", F.lit(" "), F.translate(number.cast("string"), "0123456789", "klmnopqrsz"))
    states = F.array(F.concat(F.lit("s"), F.col("p_size")))
    units = part.select(F.concat(F.lit("geolex:"), key).alias("key"), F.concat(name(key % 300), F.lit(" Limestone")).alias("name"), F.lit(True).alias("geolex"), states.alias("states"), key.alias("ord"))
    mentions = part.select(key.alias("ord"), F.concat(name(key * 7 % 400), F.lit(" shale group")).alias("name"), states.alias("states"))
    return graph.resolve(mentions, units).select("ord", "core", "key", "outcome")


@query("""
SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS core, CASE WHEN p_partkey % 3 = 0 THEN 'Member' WHEN p_partkey % 3 = 1 THEN 'Formation' ELSE 'Unknown' END AS rank,
 p_name || CASE p_partkey % 3 WHEN 0 THEN ' Shale Member' WHEN 1 THEN ' Limestone' ELSE ' thing' END AS clean FROM part WHERE contains(p_name, ' ') = false
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN lower(p_name) || ' thing' ELSE lower(p_name) END, CASE WHEN p_partkey % 3 = 0 THEN 'Member' WHEN p_partkey % 3 = 1 THEN 'Formation' ELSE 'Unknown' END,
 p_name || CASE p_partkey % 3 WHEN 0 THEN ' Shale Member' WHEN 1 THEN ' Limestone' ELSE ' thing' END FROM part WHERE contains(p_name, ' ')""")
def unit_names(spark, sf):
    tail = F.expr("CASE p_partkey % 3 WHEN 0 THEN ' Shale  Member [informal]' WHEN 1 THEN ' Limestone (old), ' ELSE ' thing*' END")
    made = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/"), F.col("p_name"), tail).alias("n"))
    return made.select("p_partkey", text.core_name(F.col("n")).alias("core"), text.rank_of(F.col("n")).alias("rank"), text.clean_name(F.col("n")).alias("clean"))


@query("""
SELECT p_partkey, round(CAST(p_size AS DOUBLE) * 0.3048, 2) AS min_m, round(CAST(p_size * 3 AS DOUBLE) * 0.3048, 2) AS max_m FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE), CAST(p_size AS DOUBLE) FROM part WHERE p_partkey % 2 = 1""")
def thickness(spark, sf):
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Exposed along 9 feet of road. The bed is "), F.col("p_size"), F.lit(" to "), F.col("p_size") * 3, F.lit(" feet thick; other words.")))
    said = said.otherwise(F.concat(F.lit("It lies 4 m below. Total thickness about "), F.col("p_size"), F.lit(" metres.")))
    found = facts.thickness(said)
    return table(spark, sf, "part").select("p_partkey", found.alias("t")).where("t is not null").select("p_partkey", "t.min_m", "t.max_m")


@query("""
SELECT s_suppkey, 'overlies' AS kind, 'Ostrava Limestone' AS unit FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'underlies', 'Vardar Member' FROM supplier UNION ALL SELECT s_suppkey, 'grades_into', 'Tolmin Group' FROM supplier WHERE s_suppkey % 3 = 0""")
def relations(spark, sf):
    said = F.concat(
        F.when(F.col("s_suppkey") % 2 == 0, "It overlies the Ostrava limestone. ").otherwise("Above North lies nothing. "), F.lit("Below the Vardar member of Ilmen shale. "),
        F.when(F.col("s_suppkey") % 3 == 0, "Grades laterally into Tolmin Group and grades into Tolmin group.").otherwise("Overlies Something Unknown."),
    )
    heads = spark.createDataFrame([("Ostrava",), ("Vardar",), ("Tolmin",)], "name string")
    passages = table(spark, sf, "supplier").select(F.col("s_suppkey"), said.alias("passage"))
    found = tagging.relations(passages, heads, "s_suppkey")
    return found.select("s_suppkey", F.explode("relations").alias("r")).select("s_suppkey", "r.kind", "r.unit")


@query("""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 8""")
def topk_cosine(spark, sf):
    vectors = table(spark, sf, "embeddings")
    wanted = vectors.where("vec_id = 7").first()
    return retrieval.top_k(vectors, wanted["embedding"] if wanted else [1.0], 8, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), r AS (
 SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS rank FROM embeddings, q)
SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 5) AS score FROM r WHERE rank <= 2""")
def topk_by_label(spark, sf):
    vectors = table(spark, sf, "embeddings")
    wanted = vectors.where("vec_id = 7").first()
    best = retrieval.top_k_by(vectors, "label", F.array(*[F.lit(float(x)) for x in (wanted["embedding"] if wanted else [1.0])]), 2, "vec_id")
    return best.select("label", "rank", "vec_id", F.round("score", 5).alias("score"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))))), 6) AS total FROM embeddings")
def unit_vectors(spark, sf):
    made = F.aggregate(retrieval.unit(F.transform("embedding", lambda x: x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(made, 6).alias("total"))


@query("""SELECT 'graph' AS system, count(*) AS rows, CAST(sum(s_acctbal > 0) AS BIGINT) AS positive FROM supplier""")
def guarded_query(spark, sf):
    """A query as a model would write it, fenced, extracted, checked to be read-only and run."""
    table(spark, sf, "supplier").createOrReplaceTempView("kelpie_supplier")
    reply = "Here:\n```sql\nSELECT count(*) AS rows, count_if(s_acctbal > 0) AS positive FROM kelpie_supplier;\n```"
    written = spark.createDataFrame([(reply,)], "r string").select(text.fenced_code(F.col("r"))).first()[0]
    rows = retrieval.read_untrusted(spark, written, timeout=120.0)
    return spark.createDataFrame([("graph", r["rows"], r["positive"]) for r in rows], "system string, rows long, positive long")


def _predictions(spark, sf):
    """Parts as gold; as predictions JSON text that is right, partly right or no JSON at all."""
    words, key = F.split("p_name", " "), F.col("p_partkey")
    gold = F.struct(
        F.lit("A").alias("unit_name"), F.lit("Group").alias("rank"), words.alias("lithologies"), F.array().cast("array<string>").alias("chronostrat"), F.array().cast("array<string>").alias("minerals"),
        F.struct(F.col("p_size").cast("double").alias("min_m"), F.lit(None).cast("double").alias("max_m")).alias("thickness"),
        F.expr("cast(array() AS array<struct<kind:string,unit:string>>)").alias("relations"), F.array("p_type").alias("states"),
    )
    said = F.concat(
        F.lit('{"unit_name": "a ", "rank": "'), F.when(key % 3 == 0, "Group").otherwise("Bed"), F.lit('", "lithologies": ["'), F.get(words, F.lit(0)), F.lit('", "'), F.col("p_brand"),
        F.lit('"], "states": ["'), F.lower("p_type"), F.lit('"], "thickness": {"min_m": '), F.col("p_size") + key % 2, F.lit("}}"),
    )
    raw = F.when(key % 7 == 0, "I cannot answer.").when(key % 5 == 0, F.concat(F.lit("Sure: "), said, F.lit(" ok"))).otherwise(said)
    return table(spark, sf, "part").select(gold.alias("gold"), raw.alias("raw_output"))


_FIELDS = r"""
n AS (SELECT p_partkey % 7 = 0 AS none, list_distinct(list_transform(string_split(p_name, ' '), lambda w: lower(w))) AS g,
 trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS brand FROM part),
f AS (SELECT 'lithologies' AS field, CAST(sum(CASE WHEN none THEN 0 ELSE 1 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN none THEN 0 ELSE 1 END) AS BIGINT) AS fp, CAST(sum(len(g) - CASE WHEN none THEN 0 ELSE 1 END) AS BIGINT) AS fn FROM n
 UNION ALL SELECT 'states', CAST(sum(CASE WHEN none THEN 0 ELSE 1 END) AS BIGINT), CAST(0 AS BIGINT), CAST(sum(CASE WHEN none THEN 1 ELSE 0 END) AS BIGINT) FROM n
 UNION ALL SELECT unnest(['chronostrat', 'minerals', 'relations']), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM f),
r AS (SELECT field, tp, fp, fn, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 4) AS f1 FROM p)"""


@query(f"WITH {_FIELDS} SELECT * FROM r")
def field_scores(spark, sf):
    return evaluation.field_scores(evaluation.score_rows(_predictions(spark, sf)))


@query(f"WITH {_FIELDS} SELECT round(coalesce(avg(f1), 0), 4) AS macro_f1, count(*) AS fields FROM r WHERE tp + fp + fn > 0")
def macro_f1(spark, sf):
    return evaluation.macro_f1(evaluation.field_scores(evaluation.score_rows(_predictions(spark, sf))))


@query("""
WITH x AS (SELECT p_partkey % 7 = 0 AS none, p_partkey % 5 = 0 AS chatty, p_partkey % 3 = 0 AS ranked, p_partkey % 2 = 0 OR greatest(0.05 * p_size, 0.05) >= 1 AS thick FROM part)
SELECT count(*) AS n, round(count_if(NOT none) / count(*), 4) AS parse_rate, round(count_if(NOT none AND NOT chatty) / count(*), 4) AS strict_json_rate, round(count_if(NOT none) / count(*), 4) AS schema_valid_rate,
 0.0::DOUBLE AS empty_output_rate, round(count_if(NOT none) / count(*), 4) AS unit_name_accuracy, count(*) AS unit_name_n, round(count_if(NOT none AND ranked) / count(*), 4) AS rank_accuracy, round(count_if(NOT none AND thick) / count(*), 4) AS thickness_accuracy FROM x""")
def json_gates(spark, sf):
    return evaluation.gates(evaluation.score_rows(_predictions(spark, sf)))


@query("SELECT CASE WHEN p_partkey % 7 = 0 THEN 'Group->Unknown' ELSE 'Group->Bed' END AS rank_pair, count(*) AS n FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 3 <> 0 GROUP BY 1")
def rank_confusion(spark, sf):
    return evaluation.rank_confusion(evaluation.score_rows(_predictions(spark, sf)))


@query("""
WITH x AS (SELECT o_orderkey, o_custkey % 60 AS want, CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'any' ELSE 'count' END AS kind, o_custkey, o_orderstatus FROM orders)
SELECT o_orderkey, kind AS match, CASE kind WHEN 'all' THEN CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END WHEN 'any' THEN 1.0 ELSE CASE WHEN o_custkey = want THEN 1.0 ELSE 0.0 END END AS score FROM x""")
def match_modes(spark, sf):
    kind = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'any' ELSE 'count' END")
    answer = F.concat(F.lit("It is "), F.format_number("o_custkey", 0), F.lit(" in the Paleocene of TX"), F.when(F.col("o_orderstatus") == "F", "; Ostrava beds").otherwise(""))
    items = F.array(F.when(F.col("o_orderkey") % 2 == 0, "Late Paleocene").otherwise("Texas"), F.lit("Ostrava Limestone"))
    score = evaluation.match_score(kind, items, F.col("o_custkey") % 60, answer)
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("match"), score.alias("score"))


_RESULTS = """
r AS (SELECT l_returnflag AS system, l_linestatus AS category, l_discount * 10 AS score, CAST(l_tax >= 0.04 AS INTEGER) AS judge, l_tax AS context_recall, l_quantity AS seconds, CAST(l_extendedprice AS BIGINT) AS context_chars,
 l_linenumber = 1 AS abstained, CASE WHEN l_linenumber = 7 THEN 'x' END AS retrieval_error FROM lineitem)"""


@query(f"""
WITH {_RESULTS} SELECT system, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n, round(avg(score), 4) AS score, round(avg(context_recall), 4) AS context_recall,
 round(median(seconds), 4) AS seconds_median, round(median(context_chars), 1) AS context_chars_median, round(avg(CAST(judge = CAST(score >= 0.5 AS INTEGER) AS DOUBLE)), 4) AS judge_agreement,
 round(avg(CAST(abstained AS DOUBLE)), 4) AS abstain_rate, count(retrieval_error) AS errors FROM r GROUP BY GROUPING SETS ((system, category), (system))""")
def system_category_report(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS system", "l_linestatus AS category", "l_discount * 10 AS score", "cast(l_tax >= 0.04 AS int) AS judge", "l_tax AS context_recall", "l_quantity AS seconds",
        "cast(round(l_extendedprice) AS bigint) AS context_chars", "l_linenumber = 1 AS abstained", "CASE WHEN l_linenumber = 7 THEN 'x' END AS retrieval_error",
    )
    return evaluation.report(rows)


def _log(spark, sf):
    """Events as the metric logs of runs (users): errors and clicks as validation, the rest as training."""
    events = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("error", "click"), "val").otherwise("train")
    value = F.col("value") / 10
    return events.select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("nth"), kind.alias("kind"), F.col("event_id").alias("iteration"),
        F.when(kind == "train", value).alias("train_loss"), F.when(kind == "val", value).alias("val_loss"),
    )


_LOG = """
l AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS nth, CASE WHEN event_type IN ('error', 'click') THEN 'val' ELSE 'train' END AS kind, value / 10 AS v FROM events),
a AS (SELECT run, nth, kind, v, last_value(CASE WHEN kind = 'train' THEN v END IGNORE NULLS) OVER (PARTITION BY run ORDER BY nth ROWS UNBOUNDED PRECEDING) AS latest_train FROM l)"""


@query(f"WITH {_LOG} SELECT run, nth, round(latest_train, 6) AS latest_train, round(CASE WHEN kind = 'val' THEN v - latest_train END, 6) AS gap FROM a")
def asof_train_loss(spark, sf):
    return monitor.with_latest_train(_log(spark, sf)).select("run", "nth", F.round("latest_train", 6).alias("latest_train"), F.round("gap", 6).alias("gap"))


@query(f"""
WITH {_LOG}, t AS (SELECT run, nth, v, row_number() OVER w AS place, avg(v) OVER (PARTITION BY run ORDER BY nth ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM l WHERE kind = 'train' WINDOW w AS (PARTITION BY run ORDER BY nth))
SELECT run, nth, round(avg(CASE WHEN place <= 5 THEN v END) OVER (PARTITION BY run), 6) AS first_mean, round(recent, 6) AS recent_mean FROM t QUALIFY place >= 12""")
def flat_windows(spark, sf):
    return monitor.flat_windows(_log(spark, sf)).select("run", "nth", F.round("first_mean", 6).alias("first_mean"), F.round("recent_mean", 6).alias("recent_mean"))


@query(f"""
WITH RECURSIVE {_LOG}, v AS (SELECT run, nth, v, row_number() OVER (PARTITION BY run ORDER BY nth) AS i FROM l WHERE kind = 'val'),
f(run, i, nth, v, best, best_iteration, since) AS (SELECT run, i, nth, v, v, nth, 0 FROM v WHERE i = 1 UNION ALL
 SELECT f.run, v.i, v.nth, v.v, CASE WHEN v.v < f.best - 0.0001 THEN v.v ELSE f.best END, CASE WHEN v.v < f.best - 0.0001 THEN v.nth ELSE f.best_iteration END, CASE WHEN v.v < f.best - 0.0001 THEN 0 ELSE f.since + 1 END
 FROM f JOIN v ON v.run = f.run AND v.i = f.i + 1)
SELECT run, nth, round(best, 6) AS best, best_iteration, since FROM f""")
def best_validation(spark, sf):
    return monitor.best_validation(_log(spark, sf)).select("run", "nth", F.round("best", 6).alias("best"), "best_iteration", "since")


@query(f"""
WITH RECURSIVE {_LOG}, v AS (SELECT run, nth, v, row_number() OVER (PARTITION BY run ORDER BY nth) AS i FROM l WHERE kind = 'val'),
f(run, i, nth, v, best, since) AS (SELECT run, i, nth, v, v, 0 FROM v WHERE i = 1 UNION ALL
 SELECT f.run, v.i, v.nth, v.v, CASE WHEN v.v < f.best - 0.0001 THEN v.v ELSE f.best END, CASE WHEN v.v < f.best - 0.0001 THEN 0 ELSE f.since + 1 END FROM f JOIN v ON v.run = f.run AND v.i = f.i + 1),
t AS (SELECT run, nth, v, row_number() OVER w AS place, avg(v) OVER (PARTITION BY run ORDER BY nth ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM l WHERE kind = 'train' WINDOW w AS (PARTITION BY run ORDER BY nth)),
fl AS (SELECT run, nth, recent, avg(CASE WHEN place <= 5 THEN v END) OVER (PARTITION BY run) AS first, place FROM t)
SELECT run, alarm, min(nth) AS iteration FROM (SELECT run, 'no_improvement' AS alarm, nth FROM f WHERE since >= 3 UNION ALL SELECT run, 'flat', nth FROM fl WHERE place >= 12 AND abs(recent - first) < 0.001
 UNION ALL SELECT run, 'memorising', nth FROM a WHERE kind = 'val' AND v - latest_train > 0.5) GROUP BY run, alarm""")
def run_alarms(spark, sf):
    return monitor.alarms(_log(spark, sf))


@query("SELECT CAST(user_id AS VARCHAR) AS run, round(exp(avg(value / 100)), 4) AS perplexity FROM events GROUP BY 1")
def perplexity(spark, sf):
    losses = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run"), (F.col("value") / 100).alias("loss"))
    return evaluation.perplexity(losses)


@query("""SELECT o_orderpriority AS arm, count(*) AS runs, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS ci95 FROM orders GROUP BY 1""")
def arm_comparison(spark, sf):
    return evaluation.comparison(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "arm"), "arm", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders) WHERE nth <= 2")
def newest_checkpoints(spark, sf):
    return evaluation.newest(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def resume_anti_join(spark, sf):
    """Rows that an interrupted run has still to do."""
    path, rows = folder(spark), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    done = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    files.append_missing(spark, rows.join(done, "c_custkey", "left_semi").withColumn("again", F.lit(False)), path, ["c_custkey"])
    files.append_missing(spark, rows.withColumn("again", F.lit(True)), path, ["c_custkey"])
    return spark.read.parquet(path).where("again").select("c_custkey", "c_nationkey")


@query("""SELECT c_custkey, coalesce(o_orderstatus, c_mktsegment) AS c_mktsegment, o_orderstatus IS NOT NULL AS reviewed FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def patched_gold(spark, sf):
    fixes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("c_mktsegment"))
    return evaluation.patched_gold(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), fixes, "c_custkey", ["c_mktsegment"])
