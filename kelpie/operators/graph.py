"""Property graphs as tables: units, passages, intervals and typed edges; resolution, closure, cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import fixed, text
from kelpie.scratch import cut

RAW_EDGE = "type string, src string, dst string, source string, passage string, usage string, unconformable boolean, ord long"
#: Node kinds by the prefix of their reference; for units the whole reference is the key.
KINDS = {"geolex": "Unit", "name": "Unit", "passage": "Passage", "interval": "Interval", "lithology": "Lithology", "mineral": "Mineral", "state": "State", "province": "Province"}
EPSILON = 0.01
CELLS = 64
CHUNK = 256
BUCKETS = 256


def merge_edges(raw: DataFrame) -> DataFrame:
    """One edge of each (type, src, dst): sorted sets of sources and passages, the first usage, any unconformable; no self-loops."""
    return (
        raw.where("src <> dst")
        .groupBy("type", "src", "dst")
        .agg(
            F.array_sort(F.collect_set("source")).alias("sources"),
            F.array_sort(F.collect_set("passage")).alias("passages"),
            F.min_by("usage", F.when(F.col("usage").isNotNull(), F.col("ord"))).alias("usage"),
            F.coalesce(F.bool_or("unconformable"), F.lit(False)).alias("unconformable"),
        )
    )


def edge(rows: DataFrame, kind: Column | str, src: Column, dst: Column, source: str | None = None, passage: Column | None = None, usage: Column | None = None, unconformable: Column | None = None, order: str = "ord") -> DataFrame:
    """Raw edges from rows; see ``RAW_EDGE``."""
    none = F.lit(None).cast("string")
    return rows.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), src.alias("src"), dst.alias("dst"), F.lit(source).cast("string").alias("source"),
        (none if passage is None else passage).alias("passage"), (none if usage is None else usage).alias("usage"),
        (F.lit(None).cast("boolean") if unconformable is None else unconformable).alias("unconformable"), F.col(order).cast("long").alias("ord"),
    )


def directed(rows: DataFrame, own: str, kind: str, other: str) -> DataFrame:
    """``rows`` with type, src, dst, unconformable: relation kinds in their one direction."""
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in fixed.RELATION_EDGES.items() for x in (k, v[i])])
    turn = F.try_element_at(pick(1), F.col(kind))
    return rows.withColumns(
        {
            "type": F.try_element_at(pick(0), F.col(kind)), "unconformable": F.try_element_at(pick(2), F.col(kind)),
            "src": F.when(turn, F.col(other)).otherwise(F.col(own)), "dst": F.when(turn, F.col(own)).otherwise(F.col(other)),
        }
    )


def resolve(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """``mentions`` (ord, name, states) with key, outcome: the curated unit that each name means.

    Equal cores are candidates; the one that shares most states with the mention wins (ties: the
    first unit). Names without any become placeholders ``name:<core>``. Outcomes are resolved (one
    candidate), by_state, guess (several, none shares a state) and placeholder.
    """
    cores = units.where("geolex").select(text.core_name(F.col("name")).alias("core"), F.col("key"), F.col("states").alias("unit_states"), F.col("ord").alias("unit_ord"))
    asked = mentions.withColumn("core", text.core_name(F.col("name")))
    shared = F.size(F.array_intersect(F.coalesce("states", F.array().cast("array<string>")), F.coalesce("unit_states", F.array().cast("array<string>"))))
    pairs = asked.select("core", "states").distinct().join(cores, "core").withColumn("shared", shared)
    best = pairs.groupBy("core", "states").agg(F.max_by(F.struct("key", "shared"), F.struct("shared", -F.col("unit_ord"))).alias("x"), F.count("*").alias("n"))
    best = best.select(F.col("core").alias("c"), F.col("states").alias("s"), F.col("x.key").alias("found"), F.col("x.shared").alias("shared"), "n")
    out = asked.join(best, F.col("core").eqNullSafe(F.col("c")) & F.col("states").eqNullSafe(F.col("s")), "left")
    outcome = F.when(F.col("n").isNull(), "placeholder").when(F.col("n") == 1, "resolved").when(F.col("shared") > 0, "by_state").otherwise("guess")
    return out.select(*mentions.columns, "core", F.coalesce("found", F.concat(F.lit("name:"), F.col("core"))).alias("key"), outcome.alias("outcome"))


def placeholders(resolved: DataFrame) -> DataFrame:
    """(key, name, rank) of the placeholder units: the first mention of a core gives name and rank."""
    some = resolved.where("outcome = 'placeholder'")
    first = F.min_by(F.struct(text.clean_name(F.col("name")).alias("name"), text.rank_of(F.col("name")).alias("rank")), "ord").alias("x")
    return some.groupBy("key").agg(first).select("key", "x.name", "x.rank")


def within(intervals: DataFrame) -> DataFrame:
    """(child, parent): each interval's containers of the next higher rank that has any.

    The range join is one of distinct spans (rank and ages), however many intervals have them. It is
    an equi-join on ``BUCKETS`` equal parts of all ages: a child is in the part of its top, a parent in
    all parts that it covers; a span whose base is younger than its top holds none. Names of a span
    travel as lists of about ``CHUNK``, and become pairs only in the last stage. A parent span is dealt
    to cells by its share of all pairs, of ``CELLS``: ``a`` parts of its children by ``b`` of its own
    names, so that it is no single task and few lists are repeated. Rows come list by list, which
    Parquet stores in little space. A task holds the pairs of one child with one list at a time.
    """
    ranks = F.array(*[F.lit(r) for r in fixed.INTERVAL_RANKS])
    leveled = intervals.withColumn("level", F.array_position(ranks, F.col("rank"))).where("level > 0").select("name", "t_age", "b_age", "level")
    spans = cut(leveled.groupBy("t_age", "b_age", "level").agg(F.count("*").alias("n")))
    c, p = spans.toDF("ct", "cb", "cl", "cn"), spans.toDF("pt", "pb", "pl", "pn")
    ends = spans.agg(F.min("t_age").alias("low"), F.max("b_age").alias("high")).first()
    low = ends["low"] or 0.0
    width = max(((ends["high"] or 0.0) - low) / BUCKETS, EPSILON)
    bucket = lambda age: F.floor((age - low) / width)
    c = c.withColumn("bucket", bucket(F.col("ct")))
    p = p.where("pb >= pt").withColumn("bucket", F.explode(F.sequence(bucket(F.col("pt") - EPSILON), bucket(F.col("pb") + EPSILON))))
    holds = (F.col("pl") > F.col("cl")) & (F.col("pt") - EPSILON <= F.col("ct")) & (F.col("cb") <= F.col("pb") + EPSILON)
    pairs = cut(c.join(p, "bucket").where(holds).drop("bucket"))
    child, parent = ["ct", "cb", "cl"], ["pt", "pb", "pl"]
    least = pairs.groupBy(*child, "cn").agg(F.min("pl").alias("pl"))
    pairs = pairs.join(least.drop("cn"), [*child, "pl"])
    dealt = cut(pairs.groupBy(*parent, "pn").agg(F.sum("cn").alias("cn")).withColumn("span", F.monotonically_increasing_id()))
    most = dealt.agg(F.sum(F.col("cn").cast("double") * F.col("pn")).alias("n")).first()["n"] or 1.0
    dealt = dealt.withColumn("cells", F.ceil(F.col("cn").cast("double") * F.col("pn") * CELLS / most).cast("int"))
    dealt = dealt.withColumn("a", F.expr(f"cast(greatest(1, least(cells, ceil(cn / {CHUNK}), round(sqrt(cells * cn / pn)))) as int)"))
    dealt = dealt.withColumn("b", F.expr(f"cast(greatest(1, least(ceil(pn / {CHUNK}), cells div a)) as int)"))
    part = lambda name, n: F.pmod(F.xxhash64(name), F.ceil(F.col(n) / CHUNK)).alias("part")
    listed = lambda name: F.sort_array(F.collect_list(F.struct(name))).alias(name)  # noqa: E731  (a list of names alone would lose nulls)
    cell = lambda key, n: F.pmod(F.xxhash64(*key, "part"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    children = leveled.toDF("child", *child).join(least, child).withColumn("least", F.min("pl").over(Window.partitionBy("child"))).where("pl = least")
    children = children.groupBy(*child, "pl", part("child", "cn")).agg(listed("child"))
    children = children.join(pairs.select(*child, *parent), [*child, "pl"]).join(dealt.select(*parent, "span", "a", "b"), parent)
    children = children.select("span", cell(child, "a").alias("i"), every("b").alias("j"), F.col("child.child").alias("child"))
    parents = leveled.toDF("parent", *parent).join(dealt.select(*parent, "pn", "span", "a", "b"), parent)
    parents = parents.groupBy("span", "a", "b", part("parent", "pn")).agg(listed("parent"))
    parents = parents.select("span", every("a").alias("i"), cell(["span"], "b").alias("j"), F.col("parent.parent").alias("parent"))
    key = ["span", "i", "j"]  # whole numbers: a join on doubles would shuffle once more, into few partitions
    met = children.repartition(CELLS, *key).join(parents.repartition(CELLS, *key).hint("shuffle_hash"), key)
    # Generated code holds all rows that come of one input row. transform() has no generated code, so children come out one by one.
    met = met.select(F.explode(F.transform("child", lambda name: name)).alias("child"), "parent")
    return met.select("child", F.explode("parent").alias("parent"))


def with_extra_interval(intervals: DataFrame) -> DataFrame:
    extra = intervals.sparkSession.createDataFrame([fixed.EXTRA_INTERVAL], "name string, rank string, t_age double, b_age double")
    return intervals.join(extra.select("name"), "name", "left_anti").select("name", "rank", "t_age", "b_age").unionByName(extra)


def closure(edges: DataFrame, most: int = 6) -> DataFrame:
    """(desc, anc, depth): all paths of up to ``most`` steps over (child, parent), least depth of each pair; depth 0 is the node itself.

    Steps are unrolled joins, bounded by ``most``: hierarchies have no more ranks.
    """
    nodes = edges.select(F.col("child").alias("n")).union(edges.select("parent")).distinct()
    level = nodes.select(F.col("n").alias("desc"), F.col("n").alias("anc"), F.lit(0).alias("depth"))
    levels = [level]
    for depth in range(1, most + 1):
        level = level.join(edges, F.col("anc") == F.col("child")).select("desc", F.col("parent").alias("anc"), F.lit(depth).alias("depth")).distinct()
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).groupBy("desc", "anc").agg(F.min("depth").alias("depth"))


def lateral(edges: DataFrame, kinds: tuple[str, ...] = ("EQUIVALENT_TO", "GRADES_INTO", "INTERTONGUES_WITH")) -> DataFrame:
    """(key, other): undirected neighbours, by both directions rather than an OR join."""
    some = edges.where(F.col("type").isin(*kinds))
    return some.select(F.col("src").alias("key"), F.col("dst").alias("other")).unionByName(some.select(F.col("dst").alias("key"), F.col("src").alias("other"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(key, type, direction, neighbours): sorted neighbours out of and into each node."""
    ends = edges.select(F.col("src").alias("key"), "type", F.lit("out").alias("direction"), F.col("dst").alias("n")).unionByName(
        edges.select(F.col("dst").alias("key"), "type", F.lit("in").alias("direction"), F.col("src").alias("n"))
    )
    return ends.groupBy("key", "type", "direction").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def node_kind(ref: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(kinds, F.substring_index(ref, ":", 1))


def node_key(ref: Column) -> Column:
    """A unit's whole reference, else what follows the first colon."""
    return F.when(node_kind(ref) == "Unit", ref).otherwise(F.regexp_replace(ref, "^[^:]*:", ""))


def leaf_nodes(edges: DataFrame) -> DataFrame:
    """(kind, key) of the nodes that only edges name."""
    refs = edges.select(F.col("src").alias("ref")).union(edges.select("dst")).distinct()
    return refs.select(node_kind(F.col("ref")).alias("kind"), node_key(F.col("ref")).alias("key")).where(F.col("kind").isin("Lithology", "Mineral", "State", "Province"))


def counts(edges: DataFrame) -> DataFrame:
    """(type, edges, sources): numbers of edges by type, and by each source ('derived' without any)."""
    each = edges.select("type", F.explode(F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit("derived")))).alias("source"))
    return each.groupBy("type", "source").agg(F.count("*").alias("edges"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new, key, "left_anti").select(*old.columns).unionByName(new)


CARD = {  # field: edge type, whether the unit is the target, most values
    "ages": ("HAS_AGE", False, None), "lithologies": ("HAS_LITHOLOGY", False, None), "minerals": ("HAS_MINERAL", False, 10),
    "states": ("OCCURS_IN", False, None), "provinces": ("IN_PROVINCE", False, None), "part_of": ("PART_OF", False, None),
    "contains": ("PART_OF", True, 30), "overlies": ("OVERLIES", False, None), "overlain_by": ("OVERLIES", True, None),
}


def unit_cards(units: DataFrame, edges: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """key, unit, rank and sorted neighbour lists of each unit: one aggregate over its edges, one join.

    ``spans`` is a closure of intervals (desc, anc, depth); ``age_context`` holds ancestors of the
    unit's ages that are no ages of it. Lists are capped as ``CARD`` says.
    """
    label = units.select("key", F.coalesce("full_name", "name").alias("label"), F.concat(F.coalesce("full_name", "name"), F.lit(" ("), F.coalesce("rank", F.lit("Unknown")), F.lit(")")).alias("long"))
    ends = edges.select(F.col("src").alias("key"), "type", F.lit(False).alias("into"), F.col("dst").alias("ref")).unionByName(
        edges.select(F.col("dst").alias("key"), "type", F.lit(True).alias("into"), F.col("src").alias("ref"))
    )
    named = ends.join(label.withColumnRenamed("key", "ref"), "ref", "left")
    value = F.when(F.col("type") == "PART_OF", F.coalesce("long", node_key(F.col("ref")))).otherwise(F.coalesce("label", node_key(F.col("ref"))))
    named = named.withColumn("value", value)
    pick = {f: (F.col("type") == t) & (F.col("into") == i) for f, (t, i, _) in CARD.items()}
    beside = F.col("type").isin("EQUIVALENT_TO", "GRADES_INTO", "INTERTONGUES_WITH")
    lists = [F.array_sort(F.collect_set(F.when(cond, F.col("value")))).alias(f) for f, cond in pick.items()]
    cards = named.groupBy("key").agg(*lists, F.array_sort(F.collect_set(F.when(beside, F.col("value")))).alias("laterally_related"))
    for f, (_, _, most) in CARD.items():
        if most:
            cards = cards.withColumn(f, F.slice(f, 1, most))
    if spans is not None:
        up = cards.select("key", F.explode("ages").alias("desc")).join(spans.where("depth > 0"), "desc").groupBy("key").agg(F.collect_set("anc").alias("up"))
        cards = cards.join(up, "key", "left").withColumn("age_context", F.array_sort(F.array_except(F.coalesce("up", F.array().cast("array<string>")), "ages"))).drop("up")
    return units.select("key", F.coalesce("full_name", "name").alias("unit"), F.coalesce("rank", F.lit("Unknown")).alias("rank")).join(cards, "key", "left")


def card_text(cards: DataFrame) -> Column:
    """'* name (rank): field: a, b; ...' without empty fields."""
    fields = [c for c in cards.columns if c not in ("key", "unit", "rank")]
    part = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(c.replace("_", " ") + ": "), F.array_join(F.col(c).cast("array<string>"), ", ")))
    return F.concat(F.lit("* "), F.col("unit"), F.lit(" ("), F.col("rank"), F.lit("): "), F.concat_ws("; ", *[part(c) for c in fields]))


def members(spans: DataFrame, occurs: DataFrame, key: str = "key", at: str = "desc") -> DataFrame:
    """(anc, members): distinct units that belong to each node or below it; ``occurs`` has (key, desc)."""
    return occurs.join(spans, at).groupBy("anc").agg(F.countDistinct(key).alias("members"))


def thickness_by_unit(measured: DataFrame) -> DataFrame:
    """Least and greatest thickness of each unit (key, thickness); a stored 0 counts."""
    return measured.groupBy("key").agg(F.min("thickness.min_m").alias("thickness_min_m"), F.max("thickness.max_m").alias("thickness_max_m"))


def build(passages: DataFrame, intervals: DataFrame, tags: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """units, passages, edges and intervals of a corpus of passages (see the sources' passage schema).

    ``tags`` has (unit_id, interval) found in the units' age texts, ``labels`` (ord, target) each
    passage's extraction.
    """
    first = F.min_by(F.struct("unit_name", "states", "usages", "age_description", "ref_province", "ref_lithology", "source_url"), "ord").alias("r")
    heads = passages.groupBy("unit_id").agg(first, F.min("ord").alias("ord")).select("unit_id", "ord", "r.*")
    heads = cut(heads.withColumn("key", F.concat(F.lit("geolex:"), F.col("unit_id"))))  # tables that several edges are made of are computed once
    chains = heads.select("key", "states", "ord", F.posexplode("usages").alias("u", "usage"), "unit_name")
    chains = chains.withColumn("chain", text.usage_chain(F.col("usage"), F.col("unit_name"))).where("chain is not null")
    firsts = chains.groupBy("key").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("u", "chain"))), lambda x: F.get(x["chain"], F.lit(0)))).alias("aliases"))
    none = F.array().cast("array<string>")
    units = heads.join(firsts, "key", "left").select(
        "key", F.col("unit_id"), F.col("unit_name").alias("name"), F.coalesce(F.get("aliases", F.lit(0)), "unit_name").alias("full_name"),
        F.coalesce(text.rank_of(F.get("aliases", F.lit(0))), F.lit("Unknown")).alias("rank"), F.lit(True).alias("geolex"),
        F.array_sort("states").alias("states"), F.coalesce("aliases", none).alias("aliases"), F.col("source_url").alias("url"), F.col("age_description").alias("age_text"), "ord",
    )
    units = cut(units)
    each = lambda c: heads.select("key", "ord", F.explode(c).alias("v"))
    ref = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c))
    raw = [
        edge(each("states"), "OCCURS_IN", F.col("key"), ref("state", "v"), "geolex"),
        edge(each("ref_province"), "IN_PROVINCE", F.col("key"), ref("province", "v"), "geolex"),
        edge(each("ref_lithology").withColumn("v", F.lower("v")), "HAS_LITHOLOGY", F.col("key"), ref("lithology", "v"), "geolex"),
        edge(tags.join(heads.select("unit_id", "key", "ord"), "unit_id"), "HAS_AGE", F.col("key"), ref("interval", "interval"), "geolex"),
        edge(within(intervals).withColumn("ord", F.lit(0)), "WITHIN", ref("interval", "child"), ref("interval", "parent")),
    ]
    steps = chains.select("key", "states", "ord", "u", F.array_join("chain", " of ").alias("usage"), F.posexplode("chain").alias("i", "name")).where("i > 0")
    numbered = passages.withColumn("n", F.row_number().over(Window.partitionBy("unit_id").orderBy("ord")) - 1)
    numbered = numbered.withColumn("id", F.concat_ws(":", "unit_id", "n")).join(heads.select("unit_id", "key"), "unit_id")
    stated = cut(numbered.select("ord", "id", F.col("key"), "states").join(labels, "ord").where("target.unit_name is not null"))
    related = stated.select("ord", "id", F.col("key").alias("own"), "states", F.posexplode("target.relations").alias("i", "rel"))
    mentions = steps.select(F.struct(F.lit(0).alias("s"), F.col("ord"), F.col("u").alias("b"), F.col("i").alias("c"), F.col("key").alias("at")).alias("ord"), "name", "states", F.col("usage"), F.lit(None).cast("string").alias("kind"))
    mentions = mentions.unionByName(
        related.select(F.struct(F.lit(1).alias("s"), F.col("ord"), F.col("i").alias("b"), F.lit(0).alias("c"), F.col("own").alias("at")).alias("ord"), F.col("rel.unit").alias("name"), "states", F.col("id").alias("usage"), F.col("rel.kind").alias("kind"))
    )
    found = cut(resolve(mentions, units))
    chain_order = Window.partitionBy("ord.at", "ord.b", "ord.ord").orderBy("ord.c")
    ups = found.where("ord.s = 0").withColumn("below", F.coalesce(F.lag("key").over(chain_order), F.col("ord.at"))).withColumn("o", F.col("ord.ord"))
    raw.append(edge(ups, "PART_OF", F.col("below"), F.col("key"), "geolex", usage=F.col("usage"), order="o"))
    rels = directed(found.where("ord.s = 1").withColumns({"own": F.col("ord.at"), "o": F.col("ord.ord")}).where("key <> own"), "own", "kind", "key")
    raw.append(edge(rels, F.col("type"), F.col("src"), F.col("dst"), "text", passage=F.col("usage"), unconformable=F.col("unconformable"), order="o"))
    raw.append(edge(rels, "MENTIONS", ref("passage", "usage"), F.col("key"), order="o"))
    raw.append(edge(numbered, "DESCRIBES", ref("passage", "id"), F.col("key")))
    raw.append(edge(stated.select("ord", "key", F.explode("target.lithologies").alias("v")).withColumn("v", F.lower("v")), "HAS_LITHOLOGY", F.col("key"), ref("lithology", "v"), "text"))
    raw.append(edge(stated.select("ord", "key", F.explode("target.minerals").alias("v")), "HAS_MINERAL", F.col("key"), ref("mineral", "v"), "text"))
    extra = placeholders(found)
    thick = thickness_by_unit(stated.select("key", "target.thickness").where("thickness is not null"))
    everyone = units.unionByName(extra.select("key", "name", F.col("name").alias("full_name"), "rank", F.lit(False).alias("geolex"), none.alias("states"), F.array("name").alias("aliases")), allowMissingColumns=True)
    return {
        "units": everyone.join(thick, "key", "left"),
        "passages": numbered.select("id", F.col("key").alias("unit_key"), "unit_name", F.col("passage").alias("text"), F.col("ref_year").alias("year"), F.col("ref_publication").alias("publication"), F.col("source_url").alias("url")),
        "edges": merge_edges(reduce(DataFrame.unionByName, raw)),
        "intervals": intervals,
        "resolution": found.groupBy("outcome").agg(F.count("*").alias("mentions")),
    }
