import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.llm import language_id, ngram_lm, quality_cnn, samples
from kelpie.llm.boosting import BoostedTrees


def brute(rows, train, order, mu):
    end = "\0end"
    toks = [(t or "").encode().lower().split() + [end] for t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for w, use in zip(toks, train, strict=True):
        if use:
            s = [end, *w]
            counts[1].update((x,) for x in w)
            for k in range(2, order + 1):
                counts[k].update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    out = []
    for w in toks:
        s, total = [end, *w], 0.0
        for i in range(1, len(s)):
            p = (counts[1][(s[i],)] + 1) / (n + v + 1)
            for k in range(2, min(order, i + 1) + 1):
                gram = tuple(s[i - k + 1 : i + 1])
                p = (counts[k][gram] + mu * p) / (counts[k - 1][gram[:-1]] + mu)
            total += math.log10(p)
        base = sum(math.log10((counts[1][(x,)] + 1) / (n + v + 1)) for x in w)
        out.append((len(w), sum(counts[1][(x,)] > 0 for x in w), n, base, total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("a b c d the E").upper() if rng.random() < 0.2 else rng.choice(["a", "b", "c", "the", f"r{i}"]) for _ in range(rng.randrange(30))) for i in range(60)] + [None, "", "unseen words only"]
    train = [i % 5 != 0 and i < 60 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, train boolean")
    found = {r.doc_id: r for r in ngram_lm.score_texts(df.repartition(3), F.col("train"), order, 7.0).collect()}
    for i, (n, known, total, base, score) in enumerate(brute(texts, train, order, 7.0)):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_scores_with_few_grams_a_range(spark, monkeypatch):
    """Blocks have n-grams in some ranges only; rows of the exchange are bounded by their n-grams."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "c", f"r{i}"]) for _ in range(rng.randrange(12))) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(ngram_lm, "LEAST_RANGES", 5000)
    found = {r.doc_id: r for r in ngram_lm.score_texts(df, F.col("doc_id") % 3 != 0, 3, 7.0).collect()}
    for i, (n, known, total, base, score) in enumerate(brute(texts, [i % 3 != 0 for i in range(40)], 3, 7.0)):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    blocks = df.select("text", (F.col("doc_id") > 0).alias("train"), F.pmod("doc_id", F.lit(4)).cast("int").alias("block"))
    asked = blocks.groupBy("block").applyInArrow(ngram_lm._ask(5000, 3), ngram_lm.ASKED).select("block", "part").collect()
    assert len(set(asked)) == len(asked) <= 3 * sum(len(t.split()) + 1 for t in texts)


def test_probabilities_sum_to_one(spark):
    train = ["a b a c", "b a"]
    words = ["a", "b", "c", "never"]
    df = spark.createDataFrame([(0, train[0], True), (1, train[1], True), *[(2 + i, f"a {w}", False) for i, w in enumerate(words)], (9, "a", False)], "doc_id long, text string, train boolean")
    parts = brute([*train, "a"], [True, True, False], 2, 5.0)
    assert parts[2][0] == 2
    found = {r.doc_id: r.score for r in ngram_lm.score_texts(df, F.col("train"), 2, 5.0).collect()}
    assert len(found) == 7 and all(s < 0 for s in found.values())
    counts = {"a": 3, "b": 2, "c": 1, "end": 2}
    n, v = 8, 4
    follow = {"b": 1, "c": 1, "end": 1}
    p = {w: (follow.get(w, 0) + 5 * (counts.get(w, 0) + 1) / (n + v + 1)) / (3 + 5) for w in ["a", "b", "c", "end", "never"]}
    assert sum(p.values()) == pytest.approx(1.0)


def test_lm_odd_rows(odd_docs, no_docs):
    rows = ngram_lm.score_texts(odd_docs, samples.remainder("doc_id", 7) != 2).collect()
    assert len(rows) == odd_docs.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert ngram_lm.score_texts(no_docs, F.lit(True)).count() == 0
    untrained = ngram_lm.score_texts(odd_docs, F.lit(None).cast("boolean")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_held_out_rule(spark):
    rows = spark.range(50).select(F.col("id"), samples.remainder("id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("label"), F.concat(F.lit("t"), "id").alias("text"))
    one = samples.sample_by_label(rows, "label", 50)
    assert {k: len(v) for k, v in one.items()} == {"x": 50, "y": 50}
    assert one == samples.sample_by_label(rows.repartition(7), "label", 50)
    assert samples.sample_by_label(rows.limit(0), "label", 50) == {}
    same = rows.select(F.lit(1).alias("id"), "label", F.lit("one text").alias("text"))
    assert samples.sample_by_label(same, "label", 50) == {"x": [["one text"]], "y": [["one text"]]}
    nulls = rows.select(F.lit(None).cast("long").alias("id"), "label", "text")
    assert {k: len(v) for k, v in samples.sample_by_label(nulls, "label", 50).items()} == {"x": 50, "y": 50}


def test_pieces_come_from_all_over_a_text(spark):
    n = 40_000
    long = "".join(chr(0x4E00 + i % 20_000) for i in range(n))
    rows = spark.createDataFrame([(i, "x", long + str(i)) for i in range(60)] + [(99, "x", "short")], "id long, label string, text string")
    found = samples.sample_by_label(rows, "label", 100)["x"]
    assert ["short"] in found and len(found) == 61
    for part in range(4):
        starts = {p[part][:8] for p in found if len(p) == 4}
        places = [long.find(s) for s in starts]
        assert len(starts) > 30 and all(len(p[part]) == 512 for p in found if len(p) == 4) and max(places) - min(places) > n // 8


def _language(rng, stems):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(rng.randint(15, 60))).capitalize() + "."


def test_language_id(spark, odd_docs, no_docs):
    rng = random.Random(2)
    stems = {"en": ["the", "ing", "tion", "wh", "ea"], "de": ["sch", "ung", "keit", "ein", "ß"], "fr": ["eau", "é", "ment", "oi", "ç"]}
    rows = [(i, _language(rng, stems[k]), k if i % 50 else "de") for i, k in enumerate(rng.choice(sorted(stems)) for _ in range(600))]
    truth = {i: next(k for k in stems if any(s in t.lower() for s in stems[k][1:3])) for i, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs, language_id.learn(docs)).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in found)
    odd = language_id.identify(odd_docs, language_id.learn(odd_docs), keep=tuple(odd_docs.columns)).collect()
    assert len(odd) == odd_docs.count() and all(r.lang_pred == "und" and r.rejected for r in odd if r.doc_id in (3, 4, 5))
    assert language_id.identify(no_docs, language_id.learn(no_docs)).count() == 0
    again = language_id.Coder(language_id.Model({"a": b"x" * 100, "b": b"x" * 100}))
    assert again.predict("xxxx")[2] and again.predict("xxxx")[0] == "a" and again.predict("12 !")[0] == "und"


def test_language_margins():
    rng = random.Random(6)
    stems = {"en": ["the", "ing", "tion", "wh", "ea", "st", "or"], "de": ["sch", "ung", "keit", "ein", "er", "st", "au"], "fr": ["eau", "ment", "oi", "que", "ai", "er", "on"]}
    coder = language_id.Coder(language_id.fit({k: [[_language(rng, v)] for _ in range(300)] for k, v in stems.items()}))
    for size in (2_000, 20_000):
        noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(size // 6)) for _ in range(30)]
        assert sum(coder.predict(x)[2] for x in noise) >= 28
    whole = [(k, " ".join(_language(rng, v) for _ in range(n))) for k, v in stems.items() for n in (1, 5, 20) for _ in range(10)]
    assert all(coder.predict(x)[::2] == (k, False) for k, x in whole)
    tied = [(k, x) for k in stems for x in sorted({a + b for a in stems[k][:3] for b in stems[k][:3]}) if len(set(coder.lengths(language_id.letters(x)))) == 1]
    assert len(tied) >= 5 and all(coder.predict(x)[::2] == (k, False) for k, x in tied)


def test_narrow_leads_are_rejected():
    """The least lead decides, as a share of the code length, at every size of text."""
    rng = random.Random(3)
    stems = {"en": ["the", "ing", "tion", "wh", "ea", "st", "or"], "fr": ["eau", "ment", "oi", "que", "ai", "er", "on"]}
    model = language_id.fit({k: [[_language(rng, v)] for _ in range(300)] for k, v in stems.items()})
    assert len(model.leads) == len(language_id.SIZES) and max(model.leads) < 0.5
    text = " ".join(_language(rng, stems["en"]) for _ in range(40))
    _, lead = language_id.Coder(model).lead(language_id.letters(text))
    for share, rejected in ((0.9, False), (1.1, True)):
        coder = language_id.Coder(model._replace(leads=(lead * share,) * len(language_id.SIZES)))
        assert coder.predict(text)[::2] == ("en", rejected)
    mixed = " ".join(x for _ in range(200) for x in (rng.choice(stems["en"]) * 2, rng.choice(stems["fr"]) * 2))
    scores = [language_id.Coder(model).predict(t)[1] for t in (text, mixed)]
    assert scores[0] > scores[1]


def test_code_lengths_equal_a_plain_loop():
    import zstandard

    rng = random.Random(8)
    dictionaries = {k: " ".join(rng.choice(v) for _ in range(400)).encode() for k, v in {"a": ["ab", "ba", "aab"], "b": ["xy", "yx", "xxy"]}.items()}
    coder = language_id.Coder(language_id.Model(dictionaries))
    for n in (1, 400, 3000):
        data = language_id.letters(" ".join(rng.choice(["ab", "xy", "qq"]) for _ in range(n)))
        want = []
        for k in sorted(dictionaries):
            params = zstandard.ZstdCompressionParameters.from_level(3, source_size=1024, dict_size=len(dictionaries[k]), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            whole = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            want.append(sum(len(whole.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
        assert all(abs(a - b) <= 2 for a, b in zip(coder.lengths(data), want, strict=True))


def test_network_equals_a_plain_loop():
    net = quality_cnn.Network(5)
    texts = [b"", b"a short one", bytes(range(1, 200)) * 9]
    got = net.probability(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    step, size, lap = quality_cnn.STEP, quality_cnn.CHUNK, quality_cnn.OVERLAP
    for text, p in zip(texts, got, strict=True):
        pooled, at = [], 0
        while True:
            chunk = text[at : at + size].ljust(size, b"\0")
            best = np.full(quality_cnn.FILTERS, -np.inf)
            for i in range(0, size - step, step):
                window = np.concatenate([net.p["embed"][b] for b in chunk[i : i + 2 * step]])
                best = np.maximum(best, window @ np.concatenate(list(net.p["kernel"])))
            pooled.append(np.maximum(best + net.p["bias"], 0))
            at += size - lap
            if at + lap >= len(text):
                break
        pooled = np.array(pooled)
        z = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0), pooled.min(axis=0)]) @ net.p["weight"] + net.p["shift"][0]
        assert p == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_network_gradients():
    net = quality_cnn.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.training = True
    raw = [b"hello world, this is text " * 30, b"", b"$$$ *** ###"]
    made, rows = quality_cnn.chunks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.combined(net.pooled(made)[0], rows) @ net.p["weight"] + net.p["shift"]
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    grads = net.gradients(made, rows, labels)
    for name, at in (("kernel", (0, 3, 5)), ("embed", (ord("l"), 2)), ("weight", (4,)), ("bias", (7,)), ("shift", (0,))):
        before = net.p[name][at]
        ends = []
        for step in (1e-5, -1e-5):
            net.p[name][at] = before + step
            ends.append(loss())
        net.p[name][at] = before
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=0.02, abs=2e-5)


def test_chunks_cover_texts():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 511, 512, 513, 960, 961, 5000]
    data, offsets = rng.integers(1, 256, sum(sizes), dtype=np.uint8), np.cumsum([0, *sizes])
    made, rows = quality_cnn.chunks(data, offsets)
    for i, n in enumerate(sizes):
        mine = made[rows[i] : rows[i + 1]]
        whole = np.concatenate([c if j == 0 else c[quality_cnn.OVERLAP :] for j, c in enumerate(mine)])
        assert (whole[:n] == data[offsets[i] : offsets[i + 1]]).all() and not whole[n:].any()


def test_quality(spark, sf, odd_docs, no_docs):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "and", "the", "moves", "under"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["river", "stone", "and", "the"]).upper() + "!!" for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    scores = {r.doc_id: r.score for r in quality_cnn.score_quality(docs, quality_cnn.learn(docs, labels)).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((scores[i] >= quality_cnn.GOOD) == (i % 3 != 0) for i in held)
    untrained = quality_cnn.learn(docs, labels.limit(0))
    odd = quality_cnn.score_quality(odd_docs, untrained).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (3, 4)}) == 1
    assert quality_cnn.score_quality(no_docs, untrained).count() == 0


def test_boosting_learns_an_exclusive_or():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:600], y[:600])
    assert ((model.probability(x[600:]) > 0.5) == y[600:]).mean() > 0.95
