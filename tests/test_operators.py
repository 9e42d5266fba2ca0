import datetime  # noqa: F401
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelpie.functions import fixed
from kelpie.operators import dedup, evaluation, graph, lifecycle, monitor, quality, retrieval, splits, tagging, tokens
from kelpie.plans import corpus, warehouse


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_exact_and_stats(spark):
    docs = frame(spark, [(1, "A b!"), (2, "a B"), (3, None), (4, ""), (5, "c"), (6, "日本")], "doc_id long, text string")
    assert [r.doc_id for r in dedup.exact(docs).orderBy("doc_id").collect()] == [1, 3, 5, 6]
    assert [r.doc_id for r in dedup.exact_by_words(docs).orderBy("doc_id").collect()] == [1, 3, 5]  # no a-z0-9 word: all alike
    row = dedup.stats(docs, dedup.exact(docs), dedup.exact(docs).limit(3)).first()
    assert (row.documents_in, row.exact_removed, row.near_removed, row.documents_out, row.removed_pct) == (6, 2, 1, 3, 50.0)
    assert dedup.exact(docs.limit(0)).count() == 0


def test_bands_and_near(spark):
    assert dedup.band_shape(0.8, 128) == (9, 13)
    base = " ".join(f"word{i}" for i in range(80))
    docs = frame(spark, [(1, base), (2, base.replace("word79", "other")), (3, " ".join(f"else{i}" for i in range(80))), (4, ""), (5, None)], "doc_id long, text string")
    assert [r.doc_id for r in dedup.near(docs).orderBy("doc_id").collect()] == [1, 3, 4]
    sizes = docs.select("doc_id", F.size(dedup.shingles(F.coalesce("text", F.lit("")))).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in sizes] == [76, 76, 76, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_scan(spark, seed):
    rng = random.Random(seed)
    cells = {(i, rng.randrange(12)) for i in range(40) for _ in range(2)}
    kept, dropped = set(), set()
    for i in range(40):
        mine = {c for j, c in cells if j == i}
        (dropped if any(c in mine for j, c in cells if j in kept) else kept).add(i)
    found = dedup.greedy_drop(frame(spark, sorted(cells), "id long, cell long").repartition(seed + 1))
    assert {r.id for r in found.collect()} == dropped


def test_quality(spark):
    docs = frame(spark, [(1, "short"), (2, None), (3, "word " * 200)], "doc_id long, text string")
    rows = {r.reason: (r.documents, r.first_at) for r in quality.rejection_histogram(docs).collect()}
    assert rows == {"too_short": (2, 1), "repetitive": (1, 3)}
    assert quality.kept(docs).count() == 0


def test_tagger_and_labels(spark):
    entries = frame(spark, [("cretaceous", "Cretaceous", 0), ("late cretaceous", "Late Cretaceous", 1), ("shale", "shale", 2), ("shale", "other", 3)], "surface string, canonical string, ord int")
    table = tagging.gazetteer(entries, plurals=True)
    docs = frame(spark, [(1, "Beds of Late, Cretaceous age and shales."), (2, ""), (3, None), (4, "Cretaceous Late Cretaceous shale")], "id long, text string")
    hits = [tuple(r) for r in tagging.tag(docs, table).orderBy("id", "start").collect()]
    assert hits == [(1, "Late Cretaceous", 8, 24, "Late, Cretaceous"), (1, "shale", 33, 39, "shales"), (4, "Cretaceous", 0, 10, "Cretaceous"), (4, "Late Cretaceous", 11, 26, "Late Cretaceous"), (4, "shale", 27, 32, "shale")]
    joined = [(r.id, r.canonical) for r in tagging.tag_joined(docs, table).orderBy("id", "start").collect()]
    assert joined == [(h[0], h[1]) for h in hits]
    heads = frame(spark, [("Vardar",), ("Ostrava",)], "name string")
    passages = frame(spark, [(1, "Ilmen shale member. Below the Vardar member of Ostrava limestone. Overlies Something Unknown. Thickness 100 feet in Texas.", "Ilmen"), (2, "Nothing to see.", "Nowhere")], "id long, passage string, unit_name string")
    empty = table.limit(0)
    vocab = {"lithologies": table, "chronostrat": empty, "minerals": empty, "states": tagging.gazetteer(tagging.state_entries(spark))}
    one, two = (r.target for r in tagging.label(passages, vocab, heads).orderBy("id").collect())
    assert (one.unit_name, one.rank, one.lithologies, one.states) == ("Ilmen", "Member", ["shale"], ["TX"])
    assert [tuple(r) for r in one.relations] == [("underlies", "Vardar Member")] and tuple(one.thickness) == (30.48, 30.48)
    assert (two.unit_name, two.rank, two.relations, two.thickness) == (None, "Unknown", [], None)
    audit = tagging.agreement(tagging.label(passages, vocab, heads).select("target", F.array(F.lit("x")).alias("age_description"), F.array(F.lit("TX"), F.lit("OK")).alias("states"))).first()
    assert (audit.n_passages, audit.unit_name_kept_pct, audit.chronostrat_consistency_pct, audit.states_precision, audit.states_recall) == (2, 50.0, None, 1.0, 0.25)


def test_vocabulary_filters(spark):
    intervals = spark.sql("SELECT 'Amazonian' AS name, 'period' AS int_type, 0d AS t_age, 1d AS b_age, array(named_struct('name', 'Martian time')) AS timescales UNION ALL SELECT 'Jurassic', 'period', 0d, 1d, array(named_struct('name', 'international')) UNION ALL SELECT 'Zone', 'zone', 0d, 1d, NULL")
    minerals, names = frame(spark, [("gold",), ("quartz",)], "mineral string"), frame(spark, [("Abo",), ("Dorna",)], "strat_name string")
    assert [[r[0] for r in t.collect()] for t in tagging.vocabulary_filters(intervals, minerals, names)] == [["Jurassic"], ["quartz"], ["Dorna"]]


def test_linker(spark):
    units = [dict(key="geolex:1", geolex=True, states=["OK"]), dict(key="geolex:2", geolex=True, states=["VA"]), dict(key="name:x", geolex=False, states=[])]
    forms = {"ada": {"geolex:1", "geolex:2"}, "miller run": {"name:x"}}
    link = lambda q: tagging.link(q, units, ["Cretaceous"], ["shale"], forms)
    assert link("How old is the Ada formation in Virginia?") == {"units": ["geolex:2"], "intervals": [], "states": ["VA"], "lithologies": []}
    assert link("Miller Run Shale units in TX")["lithologies"] == [] and link("miller run")["units"] == []
    assert link("Cretaceous shales in west virginia") == {"units": [], "intervals": ["Cretaceous"], "states": ["WV"], "lithologies": ["shale"]}


def test_splits(spark):
    rows = frame(spark, [(i, i % 7) for i in range(100)], "id long, g long")
    split = splits.group_split(rows, "g", 0.3, 0.3)
    parts = {r.split: r.n for r in split.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert parts == {"test": 2, "valid": 2, "train": 3} and split.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert [r.id for r in splits.sample(rows, "id", 5).collect()] == [r.id for r in splits.sample(rows.repartition(7), "id", 5).collect()]
    with pytest.raises(ValueError):
        splits.strict_sample(rows, "id", 101)
    with pytest.raises(ValueError):
        splits.assert_disjoint(rows, rows, "id")
    assert splits.replay_count(6318, 0.15) == 1114
    assert sorted(r.place for r in splits.ranked(rows, "id", 1).collect()) == list(range(100))
    train, valid = splits.hold_out(rows, "id")
    assert (train.count(), valid.count()) == (90, 10)


def test_stream_offsets_with_an_outlier(spark, monkeypatch):
    """Ranges follow the number of rows, not the numbers' spread."""
    monkeypatch.setattr(tokens, "RANGE_ROWS", 50)
    ids = [*range(500), 10**15]
    rows = frame(spark, [(i, i % 7) for i in ids], "ord long, n long")
    found = {r.ord: r.offset for r in tokens.stream_offsets(rows.repartition(5), "ord", "n").collect()}
    assert found == {i: sum(j % 7 for j in ids if j < i) for i in ids}


def test_folds_over_long_groups(spark):
    """One run and one shard of very many rows: each passes one task in order."""
    n = 30_000
    log = spark.range(n).select(F.lit("a").alias("run"), F.col("id").alias("nth"), F.lit("val").alias("kind"), F.col("id").alias("iteration"), F.lit(None).cast("double").alias("train_loss"), (F.lit(1.0) / (F.col("id") + 1)).alias("val_loss"))
    last = monitor.best_validation(log).orderBy(F.desc("nth")).first()
    best, at = float("inf"), None
    for i in range(n):
        if 1.0 / (i + 1) < best - 1e-4:
            best, at = 1.0 / (i + 1), i
    assert (last.best, last.best_iteration, last.since) == (best, at, n - 1 - at)
    texts = spark.range(n).select(F.lit(0).alias("shard"), F.col("id").alias("at"), F.lit("x" * 100).alias("text"))
    made = tokens.greedy_documents(texts, "shard", "at").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("a"), F.max(F.length("text")).alias("b"), F.max("nth").alias("m")).first()
    assert (made.n, made.a, made.b, made.m) == (n // 16, 16 * 101 - 1, 16 * 101 - 1, n // 16 - 1)


def test_scan_of_queries(spark):
    """The first query to see an id owns it; pages are read until a query owns enough, the last one whole."""
    from kelpie.sources import files

    rows = [("a", p, i, 10 * p + i, "t" if i else None) for p in range(3) for i in range(4)] + [("a", 0, 9, 1, "again")] + [("b", 0, i, i, "t") for i in range(4)] + [("b", 1, i, 21 + i, "t") for i in range(3)]
    records = frame(spark, rows, "query string, page int, pos int, id long, text string")
    found = sorted((r.query, r.id) for r in files.scan_queries(records, ["a", "b"], 4).collect())
    assert found == [("a", i) for i in (1, 2, 3, 11, 12, 13)] + [("b", i) for i in (0, 21, 22, 23)]


def test_both_taggers_agree(spark, monkeypatch):
    rng = random.Random(7)
    words = ["Old", "Red", "sand", "Sand", "bed", "beds", "x-y", "o'er", "1", "?"]
    docs = frame(spark, [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "\n"]) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, "")], "id long, text string")
    entries = [(" ".join(rng.choice(words[:8]) for _ in range(rng.randint(1, 4))), f"c{i}", i) for i in range(40)]
    table = tagging.gazetteer(frame(spark, entries, "surface string, canonical string, ord int"))
    sent = sorted(map(tuple, tagging.tag(docs, table).collect()))
    monkeypatch.setattr(tagging, "SENT_ENTRIES", 3)
    assert sorted(map(tuple, tagging.tag(docs, table).collect())) == sent and len(sent) > 100


def test_packing(spark):
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.expr("transform(sequence(1, cast(40 * (id + 1) AS int)), x -> cast(x AS int))").alias("tokens"))
    stream = [t for i in range(6) for t in [*range(1, 40 * (i + 1) + 1), 0]]
    blocks = {r.block: r.tokens for r in tokens.pack_stream(docs.repartition(5), 256, 0).collect()}
    assert blocks == {i: stream[i * 256 : i * 256 + 256] for i in range(len(stream) // 256)}
    one = tokens.pack_stats(docs, 256).first()
    assert (one.tokens, one.blocks, one.padding_tokens, one.dropped_tail_tokens, one.efficiency_pct) == (846, 3, 0, 78, 100.0)
    two = tokens.pack_stats(docs, 256, separate=True).first()
    assert (two.retention_pct, two.blocks) == (100.0, 6) and two.efficiency_pct < 70
    separate = tokens.pack_separate(docs, 256, 0).collect()
    assert len(separate) == 6 and all(len(r.tokens) == 256 for r in separate)
    assert tokens.pack_separate(docs, 256, None).count() == 0
    x, y = spark.range(1).select(*tokens.shifted(F.array(F.lit(1), F.lit(2), F.lit(3)))).first()
    assert x == [1, 2] and y == [2, 3]
    texts = frame(spark, [(0, i, "x" * 900) for i in range(5)] + [(0, 9, " ")], "shard int, ord int, text string")
    assert [len(r.text) for r in tokens.greedy_documents(texts, "shard", "ord").orderBy("nth").collect()] == [1801, 1801]


def test_intervals_and_closure(spark):
    rows = [("Cretaceous", "period", 66.0, 145.0), ("Late Cretaceous", "epoch", 66.0, 100.5), ("Cenomanian", "age", 93.9, 100.5), ("Mesozoic", "era", 66.0, 251.9)]
    intervals = graph.with_extra_interval(frame(spark, rows, "name string, rank string, t_age double, b_age double"))
    edges = graph.within(intervals)
    assert {tuple(r) for r in edges.collect()} == {("Cenomanian", "Late Cretaceous"), ("Late Cretaceous", "Cretaceous"), ("Cretaceous", "Mesozoic")}
    spans = {(r.desc, r.anc): r.depth for r in graph.closure(edges).collect()}
    assert spans[("Cenomanian", "Mesozoic")] == 3 and spans[("Cretaceous", "Cretaceous")] == 0 and len(spans) == 10


def test_build_graph(spark):
    s = "unit_id long, unit_name string, passage string, age_description array<string>, usages array<string>, states array<string>, ref_lithology array<string>, ref_province array<string>, ref_year int, ref_publication string, source_url string, ord long"
    rows = [
        (1, "Ilmen", "Ilmen shale. Overlies Vardar limestone.", ["Late Cretaceous"], ["Ilmen Shale Member of Ostrava Limestone of Tessin Group", "A note."], ["KS"], ["Shale"], ["Lone Tree"], 1990, "p", "u", 0),
        (1, "Ilmen", "More on it.", ["Late Cretaceous"], ["Ilmen Shale Member of Ostrava Limestone of Tessin Group"], ["KS"], ["Shale"], [], 1991, "p", "u", 1),
        (2, "Ostrava", "Ostrava limestone. Underlies Ilmen shale.", [], ["Ostrava Limestone of Tessin Group"], ["KS", "OK"], [], [], 1992, "p", "u", 2),
    ]
    passages = frame(spark, rows, s)
    target = lambda name, rel: (name, "Unknown", ["shale"], [], [], None, rel, [])
    labels = frame(spark, [(0, target("Ilmen", [("overlies", "Vardar Limestone")])), (1, target(None, [("overlies", "Ostrava")])), (2, target("Ostrava", [("underlies", "Ilmen Shale")]))], f"ord long, target {fixed.EXTRACTION_SCHEMA}")
    intervals = frame(spark, [("Late Cretaceous", "epoch", 66.0, 100.5)], "name string, rank string, t_age double, b_age double")
    tags = frame(spark, [(1, "Late Cretaceous")], "unit_id long, interval string")
    g = graph.build(passages, intervals, tags, labels)
    edges = {(r.type, r.src, r.dst): r for r in g["edges"].collect()}
    assert len(edges) == g["edges"].count() and all(a != b for _, a, b in edges)
    assert ("PART_OF", "geolex:1", "geolex:2") in edges and ("PART_OF", "geolex:2", "name:tessin") in edges
    assert ("OVERLIES", "geolex:1", "name:vardar") in edges and ("OVERLIES", "geolex:1", "geolex:2") in edges
    assert not any(t == "UNDERLIES" for t, _, _ in edges)
    assert {p for t, p, _ in edges if t == "DESCRIBES"} == {"passage:1:0", "passage:1:1", "passage:2:0"}
    assert edges[("HAS_LITHOLOGY", "geolex:1", "lithology:shale")].sources == ["geolex", "text"]
    units = {r.key: r for r in g["units"].collect()}
    assert units["geolex:1"].full_name == "Ilmen Shale Member" and units["geolex:1"].rank == "Member" and units["name:vardar"].rank == "Formation"
    cards = {r.key: r for r in graph.unit_cards(g["units"], g["edges"], graph.closure(graph.within(intervals))).collect()}
    assert cards["geolex:2"].contains == ["Ilmen Shale Member (Member)"] and cards["geolex:1"].ages == ["Late Cretaceous"]
    asked = evaluation.questions(g["units"], g["edges"], graph.closure(graph.within(intervals)), ["Late Cretaceous"])
    assert {r.category for r in asked.collect()} >= {"states", "parent", "relation"}
    g["edges"].createOrReplaceTempView("edges"), g["units"].createOrReplaceTempView("units")
    context, error = retrieval.ask_graph(spark, "Which units are part of the Ostrava Limestone?", {"units": ["geolex:2"], "intervals": [], "states": [], "lithologies": []})
    assert error is None and "Ilmen Shale Member" in context


def test_homonyms(spark):
    units = frame(spark, [("geolex:1", "Ada", True, ["OK"], 0), ("geolex:2", "Ada", True, ["VA"], 1)], "key string, name string, geolex boolean, states array<string>, ord long")
    asked = frame(spark, [(0, "Ada Formation", ["VA"]), (1, "Ada", ["TX"]), (2, "Nowhere Group", [])], "ord long, name string, states array<string>")
    rows = {r.ord: (r.key, r.outcome) for r in graph.resolve(asked, units).collect()}
    assert rows == {0: ("geolex:2", "by_state"), 1: ("geolex:1", "guess"), 2: ("name:nowhere", "placeholder")}
    assert [tuple(r) for r in graph.placeholders(graph.resolve(asked, units)).collect()] == [("name:nowhere", "Nowhere Group", "Group")]


def test_retrieval(spark):
    rows = [(str(i), "u", [float(i == j) for j in range(4)], "k0" if i < 2 else "k1", 2000, f"text {i}") for i in range(4)] + [("z", "u", [0.0] * 4, "k1", None, "zero")]
    passages = frame(spark, rows, "id string, unit_name string, embedding array<double>, key string, year int, text string")
    describes, passages = passages.select("id", "key"), passages.drop("key")
    assert [r.id for r in retrieval.top_k(passages, [0, 1, 0.5, 0], 2).collect()] == ["1", "2"]
    cards = frame(spark, [("k0", "A"), ("k1", "B")], "key string, unit string")
    out = retrieval.hybrid(passages, describes, cards, ["k1"], [1.0, 0, 0, 0], k=1)
    assert [r.id for r in out["entry"].collect()] == ["0"] and {r.key for r in out["seeds"].collect()} == {"k0", "k1"} and out["routed"].count() == 2
    assert "[0] u (2000): text 0" in retrieval.passage_context(out["entry"]).first().context
    for bad in ("DROP TABLE x", "CREATE TABLE t AS SELECT 1", "insert into t values (1)", "MATCH (n) SET n.x = 1", "SHOW TABLES"):
        with pytest.raises(ValueError):
            retrieval.read_untrusted(spark, bad)
    assert retrieval.read_untrusted(spark, "SELECT id FROM range(10)", limit=3) == [{"id": 0}, {"id": 1}, {"id": 2}]
    frame(spark, [(1, "set the cache"), (2, "b")], "id int, t string").createOrReplaceTempView("seen")
    hostile = [
        "SELECT * FROM text.`/etc/passwd`", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT * FROM other",
        "SELECT (SELECT max(value) FROM text.`/etc/passwd`) FROM seen", "WITH x AS (SELECT * FROM json.`/a`) SELECT * FROM x", "SELECT id FROM seen WHERE EXISTS (SELECT 1 FROM parquet.`/a`)",
        "SELECT input_file_name() FROM seen", "SELECT * FROM read_files('/a')", "FROM seen INSERT INTO t SELECT *", "EXPLAIN SELECT 1", "SELECT id FROM seen WHERE id IN (SELECT reflect('a', 'b'))", "",
        "SELECT TRANSFORM(id) USING 'cat' FROM seen", "SELECT * FROM default.seen",
    ]
    for bad in hostile:
        with pytest.raises(ValueError):
            retrieval.check_read_only(spark, bad)
    kind = "WITH a AS (SELECT id, upper(t) AS u FROM seen WHERE t = 'set the cache' OR t LIKE 'add%'), b AS (SELECT * FROM a) SELECT count(DISTINCT u) AS n, max(id) OVER () AS m FROM b GROUP BY id HAVING count(*) > 0 ORDER BY 1 LIMIT 5"
    assert retrieval.read_untrusted(spark, kind) == [{"n": 1, "m": 1}]
    assert retrieval.read_untrusted(spark, "SELECT s.id FROM seen s JOIN (SELECT max(id) AS id FROM seen) m ON s.id = m.id WHERE s.id IN (SELECT id FROM seen)") == [{"id": 2}]
    assert retrieval.read_untrusted(spark, "SELECT x FROM seen LATERAL VIEW explode(split(t, ' ')) e AS x WHERE id = 2 UNION SELECT 'b'") == [{"x": "b"}]
    with pytest.raises(ValueError):
        retrieval.read_untrusted(spark, "SELECT * FROM seen", views={"edges"})
    assert retrieval.answer("q", "  ") == retrieval.ABSTAIN and retrieval.answer("q", "a\nb") == "a"


def test_scores(spark):
    gold = ("A", "Group", ["shale"], [], [], None, [("overlies", "B")], [])
    rows = frame(spark, [("I cannot answer.", gold), ('{"unit_name":"a","rank":"Group","lithologies":["Shale"],"relations":[{"kind":"overlies","unit":"b"}]}', gold)], f"raw_output string, gold {fixed.EXTRACTION_SCHEMA}")
    scored = evaluation.score_rows(rows)
    fields = {r.field: (r.tp, r.fp, r.fn) for r in evaluation.field_scores(scored).collect()}
    assert fields["lithologies"] == (1, 0, 1) and fields["relations"] == (1, 0, 1) and fields["minerals"] == (0, 0, 0)
    assert evaluation.macro_f1(evaluation.field_scores(scored)).first().fields == 2
    g = evaluation.gates(scored).first()
    assert (g.parse_rate, g.strict_json_rate, g.unit_name_accuracy, g.thickness_accuracy) == (0.5, 0.5, 0.5, 1.0)
    m = lambda t, i: spark.range(1).select(evaluation.mentions(F.lit(t), F.lit(i)).alias("x")).first().x
    assert m("the Ostrava beds", "Ostrava Limestone") and m("in TX.", "Texas") and m("Paleocene", "Late Paleocene") and not m("Ostravas", "Ostrava")
    verdicts = spark.createDataFrame([('{"correct": 1, "reason": "x"}',), ("no",), ('so "correct": 1',)], "r string").select(evaluation.judge_verdict(F.col("r")).alias("v")).collect()
    assert [r.v for r in verdicts] == [1, 0, 1]
    recall = lambda k: spark.range(1).select(evaluation.context_recall(F.lit(k), F.array(F.lit("Ada")), F.lit(7), F.lit("s"), F.lit("Count: 7"), F.array(F.lit("s"))).alias("x")).first().x
    assert recall("judge") == 1.0 and recall("count") == 1.0 and recall("all") == 0.0


def _log(spark):
    rows = [("a", i, "train", i, 1.0 if i < 15 else float("nan"), None) for i in range(16)]
    rows += [("a", 20 + i, "val", 20 + i, None, 2.0) for i in range(5)] + [("b", 0, "train", 0, 3.0, None), ("b", 1, "val", 1, None, 3.2)]
    return frame(spark, rows, "run string, nth long, kind string, iteration long, train_loss double, val_loss double")


def test_monitor(spark):
    found = {(r.run, r.alarm): r.iteration for r in monitor.alarms(_log(spark)).collect()}
    assert found[("a", "diverged")] == 15 and found[("a", "flat")] == 11 and found[("a", "no_improvement")] == 23
    assert not any(run == "b" for run, _ in found)


def test_monitor_stream(spark, tmp_path):
    from kelpie.streaming.monitor import alarm_stream

    log = _log(spark).where("nth <> 15")
    for part in range(2):
        log.where(f"(nth >= 20) = {bool(part)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = alarm_stream(stream).writeStream.format("memory").queryName("alarms_seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    seen = {(r.run, r.alarm): r.iteration for r in spark.table("alarms_seen").collect()}
    assert seen == {(r.run, r.alarm): r.iteration for r in monitor.alarms(log).collect()}


def test_probes(spark):
    docs = frame(spark, [(0, "Too short. The formation consists of grey and very thin Limestone beds near the old river."), (1, "x")], "ord long, text string")
    vocab = frame(spark, [(t,) for t in ("limestone", "shale", "chalk", "marl")], "term string")
    row = tagging.cloze_probes(docs, vocab, 5).first()
    assert tagging.cloze_probes(docs, vocab.where("term <> 'marl'"), 5).count() == 0  # too few other terms
    assert row.answer == "Limestone" and row.prompt.endswith("thin") and sorted(row.distractors) == ["chalk", "marl", "shale"]


def test_training_rows(spark):
    words = ["shale", "chalk", "marl"]
    rows = [(i, i // 2, f"Unit{i // 2}", f"Unit{i // 2} Group of {words[i % 3]}, {i + 1} feet thick.", "u", 1990) for i in range(20)]
    rows += [(20, 0, "Unit0", rows[0][3].upper(), "u", 1990), (21, 30, "Dull", "Nothing of note here.", "u", 1990)]
    passages = frame(spark, rows, "ord long, unit_id long, unit_name string, passage string, source_url string, ref_year int")
    entries = frame(spark, [(w, w, i) for i, w in enumerate(words)], "surface string, canonical string, ord int")
    empty = tagging.gazetteer(entries.limit(0))
    vocab = {"lithologies": tagging.gazetteer(entries), "chronostrat": empty, "minerals": empty, "states": empty}
    made = lifecycle.training_rows(passages, vocab, frame(spark, [], "name string"), test=0.2, valid=0.2)
    assert made.count() == 20 and made.where(~lifecycle.same_prompt(made)).count() == 0
    assert made.groupBy("unit_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    card = {r.split: (r.rows, r.units, r.kept, r.passages) for r in lifecycle.dataset_card(passages, made).collect()}
    assert card == {"test": (4, 2, 20, 22), "valid": (4, 2, 20, 22), "train": (12, 6, 20, 22)}
    assert all(r.messages[2].content.startswith('{"unit_name": "Unit') for r in made.collect())


def test_intervals_of_all_parts(spark):
    sf = "/root/testdata/sf0.01"
    found = sorted(tuple(r) for r in warehouse.interval_within(spark, sf).collect())
    part = [(r.p_partkey, r.p_size) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    ages = {0: lambda n: (n * 10.0 + 1, n * 10.0 + 9), 1: lambda n: (n // 5 * 50.0, n // 5 * 50.0 + 50), 2: lambda n: (n // 10 * 100.0, n // 10 * 100.0 + 100), 3: lambda n: (0.0, 600.0)}
    rows = [(f"p{k}", k % 4, *ages[k % 4](n)) for k, n in part]
    want = []
    for name, level, t, b in rows:
        over = [(x, m) for x, m, s, e in rows if m > level and s - 0.01 <= t and b <= e + 0.01]
        want += [(name, x) for x, m in over if m == min(m for _, m in over)]
    assert found == sorted(want) and any(int(k[1:]) >= 200 for k, _ in found)


def test_spans_shared_by_many_intervals(spark):
    many = [(f"c{i}", "age", 1.0, 2.0) for i in range(3000)] + [("e", "era", 0.0, 9.0), ("f", "era", 0.0, 9.0), ("g", "eon", 0.0, 9.0), ("c1", "period", 0.0, 5.0)]
    found = graph.within(frame(spark, many, "name string, rank string, t_age double, b_age double"))
    # The least rank is one of a name's rows together: c1 as a period has only eras above.
    assert sorted(tuple(r) for r in found.collect()) == sorted([*((f"c{i}", "c1") for i in range(3000)), ("e", "g"), ("f", "g")])


def test_pairs_of_large_spans_need_little_disk(spark, tmp_path):
    def shuffled():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    many = spark.range(4000).select(F.concat(F.lit("p"), "id").alias("name"), F.when(F.col("id") % 2 == 0, "age").otherwise("era").alias("rank"), F.lit(1.0).alias("t_age"), F.lit(2.0).alias("b_age"))
    many, before = many.repartition(4), shuffled()
    graph.within(many).write.parquet(path := f"{tmp_path}/pairs")
    assert sum(n for k, n in shuffled().items() if k not in before) < 3 * 4000 + 4000  # rows; lists of names go to cells, not each name
    found = spark.read.parquet(path)
    assert found.count() == found.distinct().count() == 2000 * 2000
    assert found.where("int(substr(child, 2)) % 2 = 1 or int(substr(parent, 2)) % 2 = 0").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2000 * 2000  # under a byte a pair


def test_first_pair_comes_before_all_of_a_cell(spark):
    def made(plan):
        own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
        if plan.nodeName() == "AdaptiveSparkPlan":
            return made(plan.executedPlan())
        if plan.nodeName() == "ResultQueryStage":
            return made(plan.plan())
        below = plan.children()
        return own + [n for i in range(below.size()) for n in made(below.apply(i))]

    many = spark.range(24000).select(F.concat(F.lit("p"), "id").alias("name"), F.when(F.col("id") < 4000, "age").otherwise("era").alias("rank"), F.lit(1.0).alias("t_age"), F.lit(2.0).alias("b_age"))
    first = graph.within(many).limit(1)
    assert len(first.collect()) == 1
    rows = made(first._jdf.queryExecution().executedPlan())
    assert len(rows) == 2 and 0 < max(rows) < graph.CELLS * 2 * graph.CHUNK  # a list for each task, not a child list by all names of a cell


def test_intervals_of_any_shape(spark):
    rng = random.Random(5)
    ranks = ["age", "epoch", "period", "era", "eon", "stage", None]
    rows = [(rng.choice([None, f"n{rng.randrange(400)}"]) if i % 50 == 0 else f"n{i % 700}", rng.choice(ranks), float(t := rng.randrange(40)), t + float(rng.choice([0, 1, 5, 20]))) for i in range(900)]
    rows += [("x", "era", None, 9.0), ("y", "age", 3.0, None), *[("many", "era", 0.0, 50.0)] * 600, *[(f"c{i}", "age", 0.5 + i / 100, 1.0 + i / 100) for i in range(1500)]]
    level = {r: i for i, r in enumerate(fixed.INTERVAL_RANKS)}
    known = [(n, level[r], t, b) for n, r, t, b in rows if r in level and t is not None and b is not None]
    over = {x: [(y[0], y[1]) for y in known if y[1] > x[1] and y[2] - 0.01 <= x[2] and x[3] <= y[3] + 0.01] for x in set(known)}
    least = {}
    for x, above in over.items():
        least[x[0]] = min([least.get(x[0], 99), *(r for _, r in above)])
    want = Counter((x[0], n) for x in known for n, r in over[x] if r == least[x[0]] == min(r for _, r in over[x]))
    found = graph.within(frame(spark, rows, "name string, rank string, t_age double, b_age double"))
    assert Counter(tuple(r) for r in found.collect()) == want and (None in {n for n, _ in want})


def test_core_of_very_many_units(spark):
    units = spark.range(20000).select(F.concat(F.lit("geolex:"), "id").alias("key"), F.lit("Ada").alias("name"), F.lit(True).alias("geolex"), F.array(F.concat(F.lit("s"), F.col("id") % 50)).alias("states"), F.col("id").alias("ord"))
    asked = spark.range(200).select(F.col("id").alias("ord"), F.lit("Ada Group").alias("name"), F.array(F.concat(F.lit("s"), "id")).alias("states"))
    found = {r.ord: (r.key, r.outcome) for r in graph.resolve(asked, units).collect()}
    assert found == {i: (f"geolex:{i}", "by_state") if i < 50 else ("geolex:0", "guess") for i in range(200)}


def test_near_copies_leave_the_corpus(spark, tmp_path):
    rng = random.Random(8)
    rows, n = [], 0
    for lang in ("en", "en", "en", "de"):
        for _ in range(12):
            words = [f"{rng.choice('abcdefgh')}{''.join(rng.choice('abcdefghijklmnop') for _ in range(6))}{'.' if i % 30 == 29 else ''}" for i in range(240)]
            texts = [" ".join(words), " ".join(words).upper(), " ".join([*words[:120], "edited", *words[121:]]), " ".join([*words[:60], *reversed(words[60:])])]
            rows += [(n := n + 1, t, lang) for t in texts]
    rng.shuffle(rows)
    frame(spark, rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def shingles(text):
        w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def firsts(some):
        kept = []
        for i, text, _ in sorted(some):
            mine = shingles(text)
            if all(len(mine & s) < 0.8 * len(mine | s) for _, s in kept):
                kept.append((i, mine))
        return [i for i, _ in kept]

    exact = len({"".join(filter(str.isalnum, t.lower())) for _, t, _ in rows})
    left = len(firsts(rows))
    row = corpus.dedup_stats(spark, str(tmp_path)).first()
    assert (row.documents_in, row.exact_removed, row.near_removed, row.documents_out) == (len(rows), len(rows) - exact, exact - left, left) and row.near_removed > 0
    order = lambda i: (hashlib.md5(f"17|{i}".encode()).hexdigest(), i)
    unique = sorted(firsts([r for r in rows if r[2] == "en"]), key=order)
    train = unique[max(1, len(unique) // 10) :]
    replay = sorted((r[0] for r in rows if r[2] != "en"), key=order)[: int(len(train) * 0.15 / (1 - 0.15))]
    found = {tuple(r) for r in corpus.pretraining_corpus(spark, str(tmp_path)).collect()}
    assert found == {(i, "domain") for i in train} | {(i, "replay") for i in replay}
    card = {r.origin: r.documents for r in corpus.pretraining_card(spark, str(tmp_path)).collect()}
    assert card == {"domain": len(train), "replay": len(replay)}
