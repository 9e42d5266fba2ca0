import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelpie.sources import files, http


def test_passages(spark):
    ref = lambda s: {"summary": s, "lithology": ["Shale"], "province": None, "reference_year": 1990, "publication": "p"}
    unit = {"id": 7, "name": " Ada ", "url": None, "age_description": None, "usages": [{"usage": "Ada Formation", "states": ["OK", "KS"]}, {"usage": "", "states": None}], "unit_reference_summaries": [ref(["x" * 150, None, "y" * 150]), ref(["short"])]}
    units = spark.read.schema(files.RAW_UNIT).json(spark.sparkContext.parallelize([json.dumps(unit)]))
    rows = files.passages(units, where="http://units/").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.unit_id, r.unit_name, r.usages, r.states, r.source_url, r.ref_province) == (7, "Ada", ["Ada Formation"], ["KS", "OK"], "http://units/7", [])
    assert r.passage == "x" * 150 + " " + "y" * 150


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id long, v string").count() == 2
    path = str(tmp_path / "r")
    assert [files.append_missing(spark, df, path, ["id"]) for _ in range(2)] == [2, 0]
    assert files.append_missing(spark, df.unionByName(df.withColumn("id", F.col("id") + 10)), path, ["id"]) == 2
    made = []
    for _ in range(2):
        files.once(spark, str(tmp_path / "o"), lambda: made.append(1) or df)
    assert len(made) == 1
    files.report(df, str(tmp_path / "rep"))
    assert "| 1 | a |" in files.markdown(df) and spark.read.text(str(tmp_path / "rep/json")).count() == 1


def test_paged_source(spark, tmp_path):
    for i, items in enumerate(([{"id": 1}, {"id": 2}], [{"id": 3}], [{"id": 4}])):
        (tmp_path / f"{i}.json").write_text(json.dumps({"success": {"data": items}, "next": "more" if i == 0 else None}))
    (tmp_path / "3.json").write_text(json.dumps({"success": {"data": []}}))
    spark.dataSource.register(http.PagedJson)
    pages = spark.read.format("paged_json").option("pages", 5).option("fixture", str(tmp_path)).option("items", "success.data").option("next", "next").load()
    rows = pages.orderBy("page", "pos").collect()
    assert [json.loads(r.body)["id"] for r in rows if r.body] == [1, 2, 3, 4] and "FileNotFoundError" in rows[-1].error
    # The second page names no next one, so the third isn't read; and no more items than asked for.
    assert [json.loads(r.body)["id"] for r in http.index_rows(pages, 100).collect()] == [1, 2, 3]
    assert [json.loads(r.body)["id"] for r in http.index_rows(pages, 2).collect()] == [1, 2]
    assert http.pages_needed(101) == 2


def test_repeats():
    calls = []

    def fetch(url, params):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("busy")
        return '{"ok": 1}'

    assert http.get_json("u", {"a": 1}, delay=0, fetch=fetch) == {"ok": 1} and len(calls) == 3
    with pytest.raises(OSError):
        http.get_json("u", {}, attempts=2, delay=0, fetch=lambda u, p: (_ for _ in ()).throw(OSError("gone")))


def test_records_and_their_cache(spark, tmp_path):
    """A record that fails is a row with its error; answers are asked for once."""
    asked = str(tmp_path / "asked")
    (tmp_path / "asked").mkdir()

    def fetch(url, params):
        import os
        import uuid

        open(os.path.join(asked, f"{url}-{uuid.uuid4().hex}"), "w").close()
        if url == "u3":
            raise OSError("broken")
        return json.dumps({"id": url, "p": params.get("p")})

    requests = spark.createDataFrame([(f"u{i}", '{"p": %d}' % i if i else None) for i in range(6)] * 2, "url string, params string")
    for _ in range(2):
        found = {r.url: r for r in http.fetched(spark, requests, str(tmp_path / "cache"), tasks=2, attempts=2, delay=0, fetch=fetch).collect()}
        assert len(found) == 6 and json.loads(found["u2"].body) == {"id": "u2", "p": 2}
        assert found["u3"].body is None and found["u3"].error == "OSError: broken"
    times = Counter(f.name.split("-")[0] for f in (tmp_path / "asked").iterdir())
    assert times == {"u0": 1, "u1": 1, "u2": 1, "u4": 1, "u5": 1, "u3": 4}
