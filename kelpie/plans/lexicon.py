"""Queries on a lexicon of units and passages that is written from the ``part`` table: labels, training rows, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import facts, fixed, text
from kelpie.operators import graph, lifecycle, tagging
from kelpie.plans.corpus import table
from kelpie.scratch import cut
from kelpie.sources import files

QUERIES, SQL = {}, {}

ROCKS = ["shale", "limestone", "sandstone", "chalk", "marl"]
MINERALS = ["quartz", "pyrite", "calcite"]
INTERVALS = [("Cretaceous", "period", 66.0, 145.0), ("Late Cretaceous", "epoch", 66.0, 100.5), ("Cenomanian", "age", 93.9, 100.5), ("Mesozoic", "era", 66.0, 251.9)]
FILLER = " The name was used in several reports by early workers, for rocks near the type locality, and has been in use ever since that time without any change."


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _name(number) -> F.Column:
    return F.concat(F.lit("Kor"), F.translate(number.cast("string"), "0123456789", "abcdefghij"))


def raw_units(spark, sf):
    """Unit records as a service gives them: four parts make a unit, each a reference summary."""
    key, size = F.col("p_partkey"), F.col("p_size")
    unit = F.floor(key / 4)
    pick = lambda options, at: F.element_at(F.array(*[F.lit(o) for o in options]), (at + 1).cast("int"))
    other = _name((unit * 7 + key % 4 + 1) % 600)
    lead = F.concat(_name(unit), F.lit(" "), pick(["Shale", "Formation", "limestone", "Group"], unit % 4), F.lit(" consists of "), pick(ROCKS, key % 5), F.lit(" and "), pick(ROCKS, size % 5), F.lit("s."))
    relation = (
        F.when(key % 4 == 0, F.concat(F.lit("It  overlies the "), other, F.lit(" Formation in Kansas and west virginia.")))
        .when(key % 4 == 1, F.concat(F.lit("It unconformably overlies "), other, F.lit(" Shale; its age is Late Cretaceous, once Cenomanian.")))
        .when(key % 4 == 2, F.concat(F.lit("Grades laterally into the "), other, F.lit(" member of Texas.")))
        .otherwise(F.concat(F.lit("It is overlain by "), other, F.lit(" group and below Nowhere Limestone.")))
    )
    measure = (
        F.when(size % 3 == 0, F.concat(F.lit(" Total thickness "), size, F.lit(" to "), size + 5, F.lit(" feet; exposed along 9 m of road.")))
        .when(size % 3 == 1, F.concat(F.lit(" Exposed along 200 feet of road. It is about "), size, F.lit(" m thick.")))
        .otherwise(F.lit(" Contains quartz and calcite."))
    )
    tail = F.concat(measure, F.when(key % 10 == 9, "").otherwise(FILLER))
    summary = F.array(F.concat(F.when(key % 3 == 0, "Pg. 12-13. ").otherwise(""), lead), F.lit(None).cast("string"), F.lit(""), F.concat(relation, tail))
    reference = F.struct(
        key.alias("at"), summary.alias("summary"), F.array(F.initcap(pick(ROCKS, key % 5))).alias("lithology"), F.when(key % 2 == 0, F.array(F.lit("Basin"))).alias("province"),
        (1900 + size).alias("reference_year"), F.col("p_brand").alias("publication"),
    )
    made = table(spark, sf, "part").select(unit.cast("long").alias("id"), reference.alias("r")).groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    chain = F.concat(_name(F.col("id")), F.lit(" Shale Member of "), _name(F.col("id") + 1), F.lit(" Limestone in Umber Group"))
    usage = lambda u, s: F.struct(u.alias("usage"), s.alias("states"))
    usages = F.array(
        usage(F.when(F.col("id") % 2 == 0, chain).otherwise(F.lit("A note on usage.")), F.array(F.lit("KS"), F.lit("TX"))),
        usage(F.lit(""), F.array(pick(["KS", "OK", "WV"], F.col("id") % 3))), usage(F.lit(None).cast("string"), F.lit(None).cast("array<string>")),
    )
    age = F.when(F.col("id") % 2 == 1, F.array(F.lit("Late Cretaceous")))
    drop_at = F.transform("r", lambda r: F.struct(r["summary"].alias("summary"), r["lithology"].alias("lithology"), r["province"].alias("province"), r["reference_year"].alias("reference_year"), r["publication"].alias("publication")))
    return made.select("id", F.concat(F.lit(" "), _name(F.col("id"))).alias("name"), F.when(F.col("id") % 5 == 0, "u").alias("url"), age.alias("age_description"), usages.alias("usages"), drop_at.alias("unit_reference_summaries"))


def passages(spark, sf):
    return files.passages(raw_units(spark, sf), where="units/")


#: The same texts, written by DuckDB; ``lex`` has a row for each part, ``pas`` those in the length band.
_LEX = f"""
nm AS (SELECT i, 'Kor' || translate(CAST(i AS VARCHAR), '0123456789', 'abcdefghij') AS nm FROM range(0, 10000000) t(i) WHERE i <= 600 + (SELECT max(p_partkey) // 4 FROM part)),
lex AS (SELECT p_partkey AS k, p_partkey // 4 AS unit_id, u.nm AS unit_name, p_size AS n, p_brand,
 ['shale', 'limestone', 'sandstone', 'chalk', 'marl'][p_partkey % 5 + 1] AS rock, p_partkey // 4 * 100000 + p_partkey % 4 AS ord,
 u.nm || ' ' || ['Shale', 'Formation', 'limestone', 'Group'][p_partkey // 4 % 4 + 1] || ' consists of ' || ['shale', 'limestone', 'sandstone', 'chalk', 'marl'][p_partkey % 5 + 1] || ' and ' || ['shale', 'limestone', 'sandstone', 'chalk', 'marl'][p_size % 5 + 1] || 's. ' ||
 CASE p_partkey % 4 WHEN 0 THEN 'It overlies the ' || o.nm || ' Formation in Kansas and west virginia.' WHEN 1 THEN 'It unconformably overlies ' || o.nm || ' Shale; its age is Late Cretaceous, once Cenomanian.'
  WHEN 2 THEN 'Grades laterally into the ' || o.nm || ' member of Texas.' ELSE 'It is overlain by ' || o.nm || ' group and below Nowhere Limestone.' END ||
 CASE p_size % 3 WHEN 0 THEN ' Total thickness ' || p_size || ' to ' || (p_size + 5) || ' feet; exposed along 9 m of road.' WHEN 1 THEN ' Exposed along 200 feet of road. It is about ' || p_size || ' m thick.' ELSE ' Contains quartz and calcite.' END ||
 CASE WHEN p_partkey % 10 = 9 THEN '' ELSE '{FILLER}' END AS passage
 FROM part JOIN nm u ON u.i = p_partkey // 4 JOIN nm o ON o.i = (p_partkey // 4 * 7 + p_partkey % 4 + 1) % 600),
pas AS (SELECT *, list_sort(list_distinct(['KS', 'TX', ['KS', 'OK', 'WV'][unit_id % 3 + 1]])) AS states FROM lex WHERE length(passage) BETWEEN 200 AND 4000)"""


@query(f"""WITH {_LEX} SELECT unit_id, unit_name, passage, CASE WHEN unit_id % 2 = 1 THEN 'Late Cretaceous' ELSE '' END AS age, array_to_string(states, ',') AS states,
CASE WHEN unit_id % 2 = 0 THEN unit_name || ' Shale Member of ' || nm || ' Limestone in Umber Group' ELSE 'A note on usage.' END AS usages, upper(rock[1]) || rock[2:] AS lithology,
CASE WHEN k % 2 = 0 THEN 'Basin' ELSE '' END AS province, CAST(1900 + n AS INTEGER) AS ref_year, p_brand AS ref_publication, CASE WHEN unit_id % 5 = 0 THEN 'u' ELSE 'units/' || unit_id END AS source_url, ord
FROM pas JOIN nm ON i = unit_id + 1""")
def lexicon_passages(spark, sf):
    """Unit records spread to clean passages in the length band."""
    rows = passages(spark, sf)
    flat = {"age": "age_description", "states": "states", "usages": "usages", "lithology": "ref_lithology", "province": "ref_province"}
    return rows.select("unit_id", "unit_name", "passage", *[F.array_join(c, ",").alias(n) for n, c in flat.items()], "ref_year", "ref_publication", "source_url", "ord")


@query(f"WITH {_LEX} SELECT 'lexicon:' || ord AS id, 'lexicon' AS source, unit_name AS title, CAST(1900 + n AS INTEGER) AS year, passage AS text, ord FROM pas")
def lexicon_documents(spark, sf):
    """Passages as documents of a pretraining source."""
    return files.documents(passages(spark, sf).withColumn("at", F.col("ord")).drop("ord"), "lexicon", "at", "passage", "unit_name", "ref_year")


_SUBJECT = "CASE WHEN strpos(lower(passage), lower(unit_name)) BETWEEN 1 AND 151 THEN unit_name END"
_RANKED = "CASE WHEN regexp_matches(passage, '\\b' || unit_name || ' Group') THEN 'Group' ELSE 'Formation' END"


@query(f"WITH {_LEX} SELECT ord, {_SUBJECT} AS subject, {_RANKED} AS rank FROM pas")
def passage_subjects(spark, sf):
    """The unit that a passage is about, and its rank as the words after the name tell it."""
    rows = passages(spark, sf)
    return rows.select("ord", facts.subject(F.col("passage"), F.col("unit_name")).alias("subject"), facts.infer_rank(F.col("passage"), F.col("unit_name")).alias("rank"))


_MEASURE = r"""
sent AS (SELECT ord, unnest(string_split_regex(passage, '[.;] ')) AS s, unnest(range(1, len(string_split_regex(passage, '[.;] ')) + 1)) AS nth FROM pas),
num AS (SELECT ord, nth, TRY_CAST(regexp_extract(s, '(\d+) to \d+ feet', 1) AS DOUBLE) * 0.3048 AS a, TRY_CAST(regexp_extract(s, '\d+ to (\d+) feet', 1) AS DOUBLE) * 0.3048 AS b,
 TRY_CAST(regexp_extract(s, 'about (\d+) m', 1) AS DOUBLE) AS m FROM sent WHERE contains(s, 'thick')),
thick AS (SELECT ord, arg_min(round(coalesce(a, m), 2), nth) AS min_m, arg_min(round(coalesce(b, m), 2), nth) AS max_m FROM num WHERE coalesce(a, m) > 0 GROUP BY ord)"""


@query(f"WITH {_LEX}, {_MEASURE} SELECT * FROM thick")
def passage_thickness(spark, sf):
    found = passages(spark, sf).select("ord", facts.thickness(F.col("passage")).alias("t"))
    return found.where("t is not null").select("ord", "t.min_m", "t.max_m")


_RELATED = r"""
said AS (SELECT ord, unit_name, kind, unnest(regexp_extract_all(passage, phrase || ' (?:the )?([A-Z][a-z]+ (?:Formation|Shale|Limestone|member|group))', 1)) AS raw FROM pas,
 (VALUES ('unconformable_on', 'unconformably overlies'), ('overlies', 'overlies'), ('grades_into', 'rades laterally into'), ('underlies', 'overlain by'), ('underlies', 'below')) v(kind, phrase)),
rel AS (SELECT DISTINCT ord, kind, split_part(raw, ' ', 1) || ' ' || upper(split_part(raw, ' ', 2)[1]) || split_part(raw, ' ', 2)[2:] AS unit FROM said
 WHERE split_part(raw, ' ', 1) <> unit_name AND split_part(raw, ' ', 1) IN (SELECT unit_name FROM lex))"""


@query(f"WITH {_LEX}, {_RELATED} SELECT * FROM rel")
def passage_relations(spark, sf):
    """Relations to units that the lexicon knows; the unit itself, unknown heads and stop names are none."""
    found = tagging.relations(passages(spark, sf), _heads(spark, sf), "ord", "passage", "unit_name")
    return found.select("ord", F.explode("relations").alias("r")).select("ord", "r.kind", "r.unit")


def _heads(spark, sf):
    return table(spark, sf, "part").select(_name(F.floor(F.col("p_partkey") / 4)).alias("name")).distinct()


def _vocabularies(spark):
    entries = lambda words: spark.createDataFrame([(w, w, i) for i, w in enumerate(words)], "surface string, canonical string, ord int")
    return {
        "lithologies": tagging.gazetteer(entries(ROCKS), plurals=True), "chronostrat": tagging.gazetteer(entries([i[0] for i in INTERVALS])),
        "minerals": tagging.gazetteer(entries(MINERALS)), "states": tagging.gazetteer(tagging.state_entries(spark)),
    }


_OFFSETS = r"""
place AS (SELECT ord, passage, unnest(range(1, length(passage) + 1)) AS i FROM pas),
hit AS (SELECT ord, i, regexp_extract(substr(passage, i, 16), '^([A-Za-z]+)', 1) AS surface FROM place
 WHERE regexp_matches(substr(passage, i, 1), '[A-Za-z]') AND (i = 1 OR NOT regexp_matches(substr(passage, i - 1, 1), '[A-Za-z''-]')))
SELECT ord, regexp_extract(lower(surface), '^(shale|limestone|sandstone|chalk|marl)', 1) AS canonical, CAST(i - 1 AS INTEGER) AS "start", CAST(i - 1 + length(surface) AS INTEGER) AS "end", surface
FROM hit WHERE regexp_full_match(lower(surface), '(shale|limestone|sandstone|chalk|marl)(s|es)?')"""


@query(f"WITH {_LEX}, {_OFFSETS}")
def tag_offsets(spark, sf):
    """Where each passage names a rock, by the vocabulary sent to the tasks."""
    return tagging.tag(passages(spark, sf), _vocabularies(spark)["lithologies"], "ord", "passage")


@query(f"WITH {_LEX}, {_OFFSETS}")
def tag_offsets_joined(spark, sf):
    """The same by the vocabulary as a joined table."""
    return tagging.tag_joined(passages(spark, sf), _vocabularies(spark)["lithologies"], "ord", "passage")


_TARGET = r"""
lab AS (SELECT pas.*, CASE WHEN strpos(lower(passage), lower(unit_name)) BETWEEN 1 AND 151 THEN unit_name END AS subject, CASE WHEN regexp_matches(passage, '\b' || unit_name || ' Group') THEN 'Group' ELSE 'Formation' END AS rnk,
 list_sort(list_filter(['shale', 'limestone', 'sandstone', 'chalk', 'marl'], lambda r: regexp_matches(lower(passage), '(^|[^a-z])' || r || '(s|es)?([^a-z]|$)'))) AS rocks,
 list_sort(list_filter(['Cenomanian', 'Late Cretaceous'], lambda r: contains(passage, r))) AS ages, list_sort(list_filter(['quartz', 'pyrite', 'calcite'], lambda r: contains(passage, r))) AS mins,
 list_sort(list_transform(list_filter([['Kansas', 'KS'], ['west virginia', 'WV'], ['Texas', 'TX']], lambda r: contains(passage, r[1])), lambda r: r[2])) AS found_states, min_m, max_m,
 (SELECT list(kind || '|' || unit ORDER BY kind, lower(unit)) FROM rel WHERE rel.ord = pas.ord) AS rels
 FROM pas LEFT JOIN thick USING (ord)),
sig AS (SELECT *, CAST(len(rocks) > 0 AS INT) + CAST(len(ages) > 0 AS INT) + CAST(len(mins) > 0 AS INT) + CAST(coalesce(len(rels), 0) > 0 AS INT) + CAST(len(found_states) > 0 AS INT) + CAST(min_m IS NOT NULL AS INT) + CAST(rnk <> 'Unknown' AS INT) AS filled FROM lab),
js AS (SELECT *, '{"unit_name": ' || coalesce('"' || subject || '"', 'null') || ', "rank": "' || rnk || '", "lithologies": [' || array_to_string(list_transform(rocks, lambda r: '"' || r || '"'), ', ') ||
 '], "chronostrat": [' || array_to_string(list_transform(ages, lambda r: '"' || r || '"'), ', ') || '], "minerals": [' || array_to_string(list_transform(mins, lambda r: '"' || r || '"'), ', ') ||
 '], "thickness": ' || coalesce('{"min_m": ' || CAST(min_m AS VARCHAR) || ', "max_m": ' || CAST(max_m AS VARCHAR) || '}', 'null') ||
 ', "relations": [' || array_to_string(list_transform(coalesce(rels, []), lambda r: '{"kind": "' || split_part(r, '|', 1) || '", "unit": "' || split_part(r, '|', 2) || '"}'), ', ') ||
 '], "states": [' || array_to_string(list_transform(found_states, lambda r: '"' || r || '"'), ', ') || ']}' AS target FROM sig)"""


def _labelled(spark, sf):
    rows = passages(spark, sf)
    return rows, tagging.label(rows, _vocabularies(spark), _heads(spark, sf), "ord")


@query(f"WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET} SELECT ord, target, CAST(filled AS INTEGER) AS filled, len(rocks) + len(ages) + len(mins) + coalesce(len(rels), 0) = 0 AND min_m IS NULL AS empty FROM js")
def labelled_passages(spark, sf):
    """Each passage's extraction as canonical JSON, and how much of it was found."""
    _, labels = _labelled(spark, sf)
    t = F.col("target")
    return labels.select("ord", facts.extraction_json(t).alias("target"), facts.filled_fields(t).alias("filled"), facts.is_empty(t).alias("empty"))


_ROWS = r"""
first AS (SELECT * FROM js QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(passage), '[^\p{L}\p{N}]', '', 'g') ORDER BY ord) = 1),
good AS (SELECT * FROM first WHERE filled >= 5),
grp AS (SELECT unit_id, row_number() OVER (ORDER BY md5('17|' || unit_id), unit_id) - 1 AS place, count(*) OVER () AS n_units FROM (SELECT DISTINCT unit_id FROM good)),
tr AS (SELECT good.*, CASE WHEN place < floor(n_units * 0.1) THEN 'test' WHEN place < 2 * floor(n_units * 0.1) THEN 'valid' ELSE 'train' END AS split FROM good JOIN grp USING (unit_id))"""


def _training(spark, sf):
    return lifecycle.training_rows(passages(spark, sf), _vocabularies(spark), _heads(spark, sf), least_filled=5)


@query(f"WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET}, {_ROWS} SELECT ord, unit_id, split, md5('Passage:' || chr(10) || passage || '|' || target) AS turns, 3 AS n_turns, true AS same_prompt FROM tr")
def training_rows(spark, sf):
    """The labelled build: first copies, low signal out, units never in two splits, chat turns."""
    rows = _training(spark, sf)
    turns = F.md5(F.concat_ws("|", F.col("messages")[1]["content"], F.col("messages")[2]["content"]))
    return rows.select("ord", "unit_id", "split", turns.alias("turns"), F.size("messages").alias("n_turns"), lifecycle.same_prompt(rows).alias("same_prompt"))


@query(f"WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET}, {_ROWS} SELECT split, count(*) AS rows, count(DISTINCT unit_id) AS units, (SELECT count(*) FROM tr) AS kept, (SELECT count(*) FROM pas) AS passages FROM tr GROUP BY split")
def training_card(spark, sf):
    return lifecycle.dataset_card(passages(spark, sf), _training(spark, sf))


@query(f"WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET}, {_ROWS} SELECT unit_id, unit_name, passage FROM tr WHERE split = 'train'")
def task_texts(spark, sf):
    """Texts of the train split alone, labels dropped."""
    return files.task_texts(_training(spark, sf))


@query(f"""WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET}, {_ROWS}, kept AS (SELECT * FROM tr WHERE split <> 'train' UNION ALL (SELECT * FROM tr WHERE split = 'train' ORDER BY md5('17|' || ord), ord LIMIT 100))
SELECT ord, split FROM kept""")
def sub_sampled_rows(spark, sf):
    """A smaller training set with the same validation and test rows."""
    return lifecycle.sub_sampled(_training(spark, sf), "ord", 100).select("ord", "split")


@query(f"WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET}, {_ROWS} SELECT ord, 2 AS prompt_turns, 'assistant' AS last_role, target AS completion FROM tr")
def prompts_and_completions(spark, sf):
    from kelpie.operators import evaluation

    rows = _training(spark, sf).select("ord", evaluation.prompt_completion(F.col("messages")).alias("x"))
    return rows.select("ord", F.size("x.prompt").alias("prompt_turns"), F.col("x.completion.role").alias("last_role"), F.col("x.completion.content").alias("completion"))


@query(f"""WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET}, a AS (SELECT *, len(list_intersect(found_states, states)) AS tp, len(found_states) AS p, len(states) AS c, unit_id % 2 = 1 AND len(ages) > 0 AS aged FROM js)
SELECT count(*) AS n_passages, round(100 * count(subject) / count(*), 1) AS unit_name_kept_pct, round(100 * count_if(aged AND list_has_any(ages, ['Late Cretaceous'])) / nullif(count_if(aged), 0), 1) AS chronostrat_consistency_pct,
 coalesce(round(sum(tp) / nullif(sum(p), 0), 3), 0.0) AS states_precision, coalesce(round(sum(tp) / nullif(sum(c), 0), 3), 0.0) AS states_recall,
 round(100 * count_if(len(rocks) > 0) / count(*), 1) AS lithologies_pct, round(100 * count_if(len(ages) > 0) / count(*), 1) AS chronostrat_pct, round(100 * count_if(len(mins) > 0) / count(*), 1) AS minerals_pct,
 round(100 * count_if(coalesce(len(rels), 0) > 0) / count(*), 1) AS relations_pct, round(100 * count_if(len(found_states) > 0) / count(*), 1) AS states_pct, round(100 * count(min_m) / count(*), 1) AS thickness_pct, 100.0::DOUBLE AS rank_pct FROM a""")
def label_audit(spark, sf):
    """Extractions against the curated columns of the units."""
    rows, labels = _labelled(spark, sf)
    return tagging.agreement(rows.join(labels, "ord"))


def _graph(spark, sf):
    rows, labels = _labelled(spark, sf)
    rows, labels = cut(rows), cut(labels)
    intervals = spark.createDataFrame(INTERVALS, "name string, rank string, t_age double, b_age double")
    ages = rows.groupBy("unit_id").agg(F.first("age_description").alias("a")).select("unit_id", F.array_join("a", " ").alias("text"))
    tags = tagging.tag(ages, _vocabularies(spark)["chronostrat"], "unit_id", "text").select("unit_id", F.col("canonical").alias("interval")).distinct()
    made = graph.build(rows, intervals, tags, labels)
    return made | {n: cut(made[n]) for n in ("units", "edges")}  # read by several plans


#: Units of the graph: those with a passage in the band. Names are unique, so a core has one unit.
_GRAPH = r"""
head AS (SELECT unit_id, min(ord) AS ord, 'geolex:' || unit_id AS key, any_value(unit_name) AS unit_name, arg_min(rock, ord) AS rock, arg_min(k, ord) AS k, any_value(states) AS states, arg_min(CASE WHEN unit_id % 5 = 0 THEN 'u' ELSE 'units/' || unit_id END, ord) AS url FROM pas GROUP BY unit_id),
numbered AS (SELECT js.*, h.key, unit_id || ':' || (row_number() OVER (PARTITION BY unit_id ORDER BY js.ord) - 1) AS pid FROM js JOIN (SELECT unit_id, key FROM head) h USING (unit_id)),
known AS (SELECT lower(unit_name) AS core, key FROM head),
up AS (SELECT h.key, h.ord, h.unit_name || ' Shale Member' AS a, nm.nm || ' Limestone' AS b, coalesce(k.key, 'name:' || lower(nm.nm)) AS b_key FROM head h JOIN nm ON nm.i = h.unit_id + 1 LEFT JOIN known k ON k.core = lower(nm.nm) WHERE h.unit_id % 2 = 0),
rl AS (SELECT numbered.key AS own, pid, numbered.ord, rel.kind, rel.unit, coalesce(k.key, 'name:' || lower(split_part(rel.unit, ' ', 1))) AS to_key FROM rel JOIN numbered ON numbered.ord = rel.ord LEFT JOIN known k ON k.core = lower(split_part(rel.unit, ' ', 1)) WHERE subject IS NOT NULL),
raw AS (
 SELECT 'OCCURS_IN' AS type, key AS src, 'state:' || unnest(states) AS dst, 'geolex' AS source, NULL::VARCHAR AS passage, NULL::VARCHAR AS usage, NULL::BOOLEAN AS unconformable, ord FROM head
 UNION ALL SELECT 'IN_PROVINCE', key, 'province:Basin', 'geolex', NULL, NULL, NULL, ord FROM head WHERE k % 2 = 0
 UNION ALL SELECT 'HAS_LITHOLOGY', key, 'lithology:' || rock, 'geolex', NULL, NULL, NULL, ord FROM head
 UNION ALL SELECT 'HAS_AGE', key, 'interval:Late Cretaceous', 'geolex', NULL, NULL, NULL, ord FROM head WHERE unit_id % 2 = 1
 UNION ALL SELECT 'WITHIN', 'interval:' || a, 'interval:' || b, NULL, NULL, NULL, NULL, 0 FROM (VALUES ('Cenomanian', 'Late Cretaceous'), ('Late Cretaceous', 'Cretaceous'), ('Cretaceous', 'Mesozoic')) v(a, b)
 UNION ALL SELECT 'PART_OF', key, b_key, 'geolex', NULL, a || ' of ' || b || ' of Umber Group', NULL, ord FROM up
 UNION ALL SELECT 'PART_OF', b_key, 'name:umber', 'geolex', NULL, a || ' of ' || b || ' of Umber Group', NULL, ord FROM up
 UNION ALL SELECT CASE kind WHEN 'grades_into' THEN 'GRADES_INTO' ELSE 'OVERLIES' END, CASE kind WHEN 'underlies' THEN to_key ELSE own END, CASE kind WHEN 'underlies' THEN own ELSE to_key END, 'text', pid, NULL, kind = 'unconformable_on', ord FROM rl
 UNION ALL SELECT 'MENTIONS', 'passage:' || pid, to_key, NULL, NULL, NULL, NULL, ord FROM rl
 UNION ALL SELECT 'DESCRIBES', 'passage:' || pid, key, NULL, NULL, NULL, NULL, ord FROM numbered
 UNION ALL SELECT 'HAS_LITHOLOGY', key, 'lithology:' || unnest(rocks), 'text', NULL, NULL, NULL, ord FROM numbered WHERE subject IS NOT NULL
 UNION ALL SELECT 'HAS_MINERAL', key, 'mineral:' || unnest(mins), 'text', NULL, NULL, NULL, ord FROM numbered WHERE subject IS NOT NULL),
edges AS (SELECT type, src, dst, coalesce(list_sort(list_distinct(list(source) FILTER (source IS NOT NULL))), []) AS sources, coalesce(list_sort(list_distinct(list(passage) FILTER (passage IS NOT NULL))), []) AS passages,
 arg_min(usage, ord) FILTER (usage IS NOT NULL) AS usage, coalesce(bool_or(unconformable), false) AS unconformable FROM raw WHERE src <> dst GROUP BY type, src, dst)"""
_ALL = f"WITH {_LEX}, {_MEASURE}, {_RELATED}, {_TARGET}, {_GRAPH}"


@query(f"{_ALL} SELECT type, src, dst, array_to_string(sources, ',') AS sources, array_to_string(passages, ',') AS passages, usage, unconformable FROM edges")
def graph_build_edges(spark, sf):
    """All edges of the graph that the passages and their extractions make."""
    edges = _graph(spark, sf)["edges"]
    return edges.withColumns({c: F.array_join(c, ",") for c in ("sources", "passages")})


@query(f"""{_ALL}, holes AS (SELECT 'name:' || lower(split_part(b, ' ', 1)) AS key, b AS name, 0 AS s, ord FROM up WHERE b_key LIKE 'name:%' UNION ALL SELECT 'name:umber', 'Umber Group', 0, ord FROM up
 UNION ALL SELECT to_key, unit, 1, ord FROM rl WHERE to_key LIKE 'name:%'),
named AS (SELECT key, arg_min(name, (s, ord)) AS name FROM holes GROUP BY key),
th AS (SELECT key, min(min_m) AS lo, max(max_m) AS hi FROM numbered WHERE subject IS NOT NULL GROUP BY key)
SELECT key, unit_name AS name, CASE WHEN unit_id % 2 = 0 THEN unit_name || ' Shale Member' ELSE unit_name END AS full_name, CASE WHEN unit_id % 2 = 0 THEN 'Member' ELSE 'Unknown' END AS rank, true AS geolex,
 array_to_string(states, ',') AS states, CASE WHEN unit_id % 2 = 0 THEN unit_name || ' Shale Member' ELSE '' END AS aliases, url, lo AS thickness_min_m, hi AS thickness_max_m FROM head LEFT JOIN th USING (key)
UNION ALL SELECT key, name, name, CASE split_part(name, ' ', 2) WHEN 'Limestone' THEN 'Formation' WHEN 'Shale' THEN 'Formation' ELSE split_part(name, ' ', 2) END, false, '', name, NULL, NULL, NULL FROM named""")
def graph_build_units(spark, sf):
    """Curated units and the placeholders of names that only texts have."""
    units = _graph(spark, sf)["units"]
    return units.select("key", "name", "full_name", "rank", "geolex", F.array_join("states", ",").alias("states"), F.array_join("aliases", ",").alias("aliases"), "url", "thickness_min_m", "thickness_max_m")


@query(f"{_ALL} SELECT pid AS id, key AS unit_key, unit_name, passage AS text, CAST(1900 + n AS INTEGER) AS year, p_brand AS publication FROM numbered")
def graph_build_passages(spark, sf):
    """Passages numbered within their unit, with its key."""
    return _graph(spark, sf)["passages"].select("id", "unit_key", "unit_name", "text", "year", "publication")


@query(f"{_ALL} SELECT DISTINCT key, other FROM (SELECT src AS key, dst AS other FROM edges WHERE type = 'GRADES_INTO' UNION ALL SELECT dst, src FROM edges WHERE type = 'GRADES_INTO')")
def lateral_neighbours(spark, sf):
    return graph.lateral(_graph(spark, sf)["edges"])


@query(f"""{_ALL}, lists AS (SELECT key, direction, type, list_sort(list(DISTINCT other)) AS others FROM (SELECT src AS key, 'out' AS direction, type, dst AS other FROM edges UNION ALL SELECT dst, 'in', type, src FROM edges) GROUP BY ALL)
SELECT key, direction, type, array_to_string(others, ',') AS others FROM lists""")
def graph_neighbours(spark, sf):
    """Sorted neighbours out of and into every node."""
    made = graph.adjacency(_graph(spark, sf)["edges"])
    return made.select("key", "direction", "type", F.array_join("neighbours", ",").alias("others"))


@query(f"""{_ALL}, nodes AS (SELECT unnest([src, dst]) AS ref FROM edges), lbl AS (SELECT key, CASE WHEN unit_id % 2 = 0 THEN unit_name || ' Shale Member (Member)' ELSE unit_name || ' (Unknown)' END AS long FROM head),
inside AS (SELECT dst AS key, coalesce(long, src) AS child FROM edges LEFT JOIN lbl ON lbl.key = src WHERE type = 'PART_OF' AND src LIKE 'geolex:%'),
gone AS (SELECT key, list_sort(list(DISTINCT child))[1:30] AS contains, count(DISTINCT child) AS everything FROM inside GROUP BY key),
mins AS (SELECT src AS key, list_sort(list(DISTINCT substr(dst, 9)))[1:10] AS minerals FROM edges WHERE type = 'HAS_MINERAL' GROUP BY src)
SELECT h.key, coalesce(array_to_string(minerals, ','), '') AS minerals, CASE WHEN h.unit_id % 2 = 1 THEN 'Cretaceous,Mesozoic' END AS age_context, coalesce(array_to_string(contains, ','), '') AS contains FROM head h LEFT JOIN gone USING (key) LEFT JOIN mins USING (key)""")
def unit_card_lists(spark, sf):
    """Capped lists of the cards of curated units, and the ages above their own."""
    g = _graph(spark, sf)
    cards = graph.unit_cards(g["units"].where("geolex"), g["edges"], graph.closure(graph.within(g["intervals"])))
    return cards.select("key", F.array_join("minerals", ",").alias("minerals"), F.nullif(F.array_join("age_context", ","), F.lit("")).alias("age_context"), F.array_join("contains", ",").alias("contains"))
