from pyspark.sql import functions as F

from kelpie.functions import facts, html, json_recovery, text


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(make(*[F.col(n) for n in names]).alias("x")).first().x


def test_names(spark):
    cores = {"Miller Run Clay": "miller run", "Ostrava Limestone": "ostrava", "Lone Tree Group": "lone tree", "Chalk": "chalk", "/Quill subgroup [local use]": "quill", "Dorn Shales": "dorn"}
    for name, core in cores.items():
        assert one(spark, text.core_name, name) == core
    assert one(spark, text.clean_name, "/Quill subgroup [local use]") == "Quill subgroup"
    ranks = {"Ilmen Shale Member": "Member", "Ostrava Limestone": "Formation", "Tessin Group": "Group", "Nowhere": "Unknown", "": "Unknown", "Some gneiss": "Unknown", "Some series": "Unknown"}
    for name, rank in ranks.items():
        assert one(spark, text.rank_of, name) == rank
    chain = one(spark, text.usage_chain, "Ilmen sandstone in Vardar Formation of Tessin Group", "Ilmen")
    assert chain == ["Ilmen sandstone", "Vardar Formation", "Tessin Group"]
    assert one(spark, text.usage_chain, "Written Vadar in an older map.", "Vardar") is None
    assert one(spark, text.relation_name, "Tessin group") == "Tessin Group"
    assert one(spark, text.relation_name, "Dorn of.") == "Dorn"
    assert one(spark, text.relation_name, "Dorn Sandstone of") == "Dorn Sandstone"


def test_cleaning(spark):
    assert one(spark, text.clean_passage, "Pg. 12-13. Some  text\n here ") == "Some text here"
    assert one(spark, text.clean_passage, None) == ""
    assert one(spark, html.strip_html, "<p>a&nbsp;<b>b</b></p><script>x</script>") == "a b"
    assert one(spark, text.strip_html_native, "<p>a&nbsp;<b>b</b></p><script>x</script>") == "a b"
    assert one(spark, text.strip_html_native, "1 &lt; 2  ok") == one(spark, html.strip_html, "1 &lt; 2  ok")
    assert one(spark, text.normal, " A-b  C? ") == "a b c"
    assert one(spark, text.normal, None) == ""
    assert one(spark, text.alnum_lower, "Ä b-1!") == "äb1"
    assert one(spark, text.first_number, "about 1,234 units of 5") == 1234
    assert one(spark, text.fenced_code, "so:\n```cypher\nMATCH (n) RETURN n;\n```") == "MATCH (n) RETURN n"
    assert one(spark, text.sorted_set, ["b ", "a", "", "b"]) == ["a", "b"]
    assert one(spark, text.long_words, ["Late Cretaceous age", "late"]) == ["late", "cretaceous"]
    assert spark.range(1).select(text.sparkline(F.array(F.lit(0.0), F.lit(7.0), F.lit(float("nan")))).alias("x")).first().x == "▁█ "


def test_reasons(spark):
    prose = ("The formation consists of grey shale and thin limestone beds near the river. It rests upon older sandstone with a sharp contact there. " * 3) + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + "."
    cases = {"short": "too_short", "1234567890 " * 200: "low_alpha_ratio", "word " * 200: "repetitive", prose: None, "a" * 50_001: "too_long", "": "too_short"}
    for value, reason in cases.items():
        assert one(spark, text.reject_reason, value) == reason
    assert one(spark, lambda c: text.reject_reason(c, 0), "") == "low_alpha_ratio"


def test_thickness(spark):
    cases = {
        "Thickness 50 feet.": (15.24, 15.24), "It is 3 to 9 feet thick here.": (0.91, 2.74), "Beds of 12 to 40 m in thickness.": (12.0, 40.0),
        "Lies 12 km south of town; seen for 40 feet in a quarry.": None, "It is thick. About 1,000 ft thick elsewhere.": (304.8, 304.8),
    }
    for passage, found in cases.items():
        got = one(spark, facts.thickness, passage)
        assert (got and tuple(got)) == found


def test_rank_and_subject(spark):
    cases = [("Ilmen shale member of Ostrava limestone.", "Ilmen", "Member"), ("Dorn chalk is seen nearby.", "Dorn", "Formation"), ("Dorn Group has several parts.", "Dorn", "Group"), ("Nothing.", "A+b (c)", "Unknown"), ("x", None, "Unknown")]
    for passage, name, rank in cases:
        assert one(spark, facts.infer_rank, passage, name) == rank
    assert one(spark, facts.subject, "The Dorn chalk.", "dorn") == "dorn"
    assert one(spark, facts.subject, "x" * 160 + " Dorn", "Dorn") is None
    assert one(spark, facts.subject, "Nothing here", "Nowhere") is None


def test_json(spark):
    assert json_recovery.parse('```json\n{"a": 1}\n```') == {"a": 1}
    assert json_recovery.parse('<think>{x}</think>Sure: {"a": 1} done') == {"a": 1}
    assert json_recovery.parse("I cannot answer.") is None and json_recovery.parse("[1]") is None and json_recovery.parse(None) is None
    assert json_recovery.strict('{"a": NaN}') and not json_recovery.strict('{"a":1} x')
    assert json_recovery.valid({"rank": "Member", "extra": 1}) and not json_recovery.valid({"rank": "Nope"})


def test_extraction_json(spark):
    e = "named_struct('unit_name', 'A \"b\"', 'rank', 'Group', 'lithologies', array('shale','chalk','shale'), 'chronostrat', array(), 'minerals', cast(array() as array<string>), 'thickness', named_struct('min_m', 1.0d, 'max_m', cast(null as double)), 'relations', array(named_struct('kind','underlies','unit','Taylor Group'), named_struct('kind','overlies','unit','Eagle Ford'), named_struct('kind','underlies','unit','taylor group')), 'states', array('TX'))"
    row = spark.sql(f"SELECT {e} AS e").select(facts.extraction_json(F.col("e")).alias("j"), facts.filled_fields(F.col("e")).alias("n"), facts.is_empty(F.col("e")).alias("z")).first()
    assert row.j == '{"unit_name": "A \\"b\\"", "rank": "Group", "lithologies": ["chalk", "shale"], "chronostrat": [], "minerals": [], "thickness": {"min_m": 1.0, "max_m": null}, "relations": [{"kind": "overlies", "unit": "Eagle Ford"}, {"kind": "underlies", "unit": "taylor group"}], "states": ["TX"]}'
    assert row.n == 5 and row.z is False
    with_target, without = (spark.createDataFrame([(" p ", "{}")], "p string, t string").select(facts.messages(F.col("p"), t).alias("m")).first().m for t in (F.col("t"), None))
    assert with_target[:2] == without and without[1].content == "Passage:\np"
