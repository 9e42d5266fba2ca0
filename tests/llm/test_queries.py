"""Every registered query of this subpackage: columns, types and rows on odd and on empty tables."""

import zlib

import pytest

from kelpie.llm import registry

CONTRACT = {
    "op1_superminhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_backoff_automaton": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_compression_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_pii_boosted": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_kd_top5": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_media_sniff": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op7_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_best_fit": "doc_id bigint, shard int, bin bigint, offset bigint, from_word bigint, n_words bigint",
    "op9_url_trie": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_byte_cnn": "doc_id bigint, held_out boolean, score double, predicted int",
}
HELD = {"op2_backoff_automaton": 7, "op3_compression_language": 4, "op10_byte_cnn": 4}


@pytest.fixture(scope="module")
def folders(spark, odd_docs, tmp_path_factory):
    odd, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    tables = {
        "documents": odd_docs,
        "labels": spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, None), (None, 1, 0), (9, None, 0), (77, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://a.net/x", "<p>"), (1, "http://a.net/x", "<p>"), (None, None, None), (2, "no url", "")], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(0, [0.5, 1.0]), (1, [1.0, None]), (2, None), (None, [1.0, 2.0]), (50, [float("nan"), 0.0]), (3, [0.25, -1.0])], "vec_id long, embedding array<float>"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{odd}/{name}.parquet")
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return odd, empty


def test_every_query_has_a_contract():
    assert set(registry.queries()) == set(CONTRACT) and set(registry.oracle_sql()) <= set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query(spark, folders, odd_docs, name):
    odd, empty = folders
    made = registry.queries()[name](spark, odd)
    kinds = dict(made.dtypes)
    for column in CONTRACT[name].split(", "):
        column, kind = column.split(" ")
        assert kinds[column] == kind
    rows = made.collect()
    if name == "op5_kd_top5":
        assert [tuple(r) for r in rows] == [(0, 1, 3, 128 * 64 + 256 * -256)]
    elif name == "op9_url_trie":
        assert sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in rows) == [(0, "", None, "allow"), (1, "a.net", "net/", "block"), (1, "a.net", "net/", "block"), (2, "", None, "allow")]
    elif name == "op8_best_fit":
        assert sum(r.n_words for r in rows) == sum(len((r.text or "").encode().split()) for r in odd_docs.collect())
    else:
        by_id = lambda some: sorted(-1 if r.doc_id is None else r.doc_id for r in some)
        assert by_id(rows) == by_id(odd_docs.collect())
    for r in rows if name in HELD else ():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % HELD[name] == 2)
    if name == "op10_byte_cnn":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op7_source_mix":
        size = {}
        for r in rows:
            size.setdefault(r.source, [0, 0, r.target])
            size[r.source][0] += r.taken
            size[r.source][1] += r["size"]
            assert 0 <= r.taken <= 2 * r["size"]
        assert all(abs(taken - target) <= 0.5 for taken, _, target in size.values())
    assert registry.queries()[name](spark, empty).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, folders, odd_docs):
    import corpus_pipeline

    odd, empty = folders
    docs = {r.doc_id for r in odd_docs.collect()}
    rows = corpus_pipeline.run(spark, odd).collect()
    assert {r.doc_id for r in rows} <= docs and all(r.n_words == len(r.text.encode().split()) for r in rows)
    assert corpus_pipeline.run(spark, empty).count() == 0
