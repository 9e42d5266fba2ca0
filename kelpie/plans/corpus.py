"""Queries on documents, pages, conversations and benchmark: filters, dedup, splits, tokens, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import text
from kelpie.functions.html import strip_html
from kelpie.operators import dedup, lifecycle, quality, splits, tagging, tokens
from kelpie.scratch import cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_REASON = r"""
CASE WHEN length(text) < 300 THEN 'too_short' WHEN length(text) > 50000 THEN 'too_long'
 WHEN length(regexp_replace(text, '[^\p{L}\s\x{85}\p{Z}\x{1c}-\x{1f}]', '', 'g')) / length(text) < 0.70 THEN 'low_alpha_ratio'
 WHEN length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) / length(text) > 0.20 THEN 'digit_heavy'
 WHEN len(regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']*')) < 50 THEN 'too_few_words'
 WHEN len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']*'), lambda w: lower(w)))) / len(regexp_extract_all(text, '[A-Za-z][A-Za-z\-'']*')) < 0.25 THEN 'repetitive'
 WHEN length(text) - length(replace(text, '.', '')) < 3 THEN 'no_sentences' ELSE 'kept' END"""


@query(f"""
WITH r AS (SELECT doc_id, text, {_REASON} AS reason FROM documents)
SELECT reason, count(*) AS documents, min(doc_id) AS first_at, min_by(substr(text, 1, 160), doc_id) AS example FROM r GROUP BY reason""")
def quality_reasons(spark, sf):
    return quality.rejection_histogram(table(spark, sf, "documents"))


@query(f"SELECT doc_id, lang, source FROM documents WHERE {_REASON} = 'kept'")
def quality_kept(spark, sf):
    return quality.kept(table(spark, sf, "documents")).select("doc_id", "lang", "source")


@query(r"""
SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')""")
def exact_dedup(spark, sf):
    return dedup.exact(table(spark, sf, "documents")).select("doc_id")


@query("""
SELECT min(doc_id) AS doc_id FROM documents GROUP BY array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')""")
def exact_dedup_by_words(spark, sf):
    return dedup.exact_by_words(table(spark, sf, "documents")).select("doc_id")


@query()
def dedup_stats(spark, sf):
    """The counts of exact removal, then of near-duplicate removal (exact by words, then by signature bands)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    unique = cut(dedup.exact(docs))
    return dedup.stats(docs, unique, dedup.near(unique))


@query()
def near_dup_kept(spark, sf):
    return dedup.near(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id")


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS g FROM w)
SELECT doc_id, CAST(len(g) AS INTEGER) AS shingles, md5(array_to_string(g, '|')) AS digest FROM g""")
def shingle_counts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.array_sort(dedup.shingles(F.col("text"))).alias("g"))
    return rows.select("doc_id", F.size("g").alias("shingles"), F.md5(F.array_join("g", "|")).alias("digest"))


@query("SELECT min(doc_id) AS doc_id, lang, source FROM documents GROUP BY lang, source")
def first_by_source(spark, sf):
    docs = table(spark, sf, "documents").withColumn("key", F.concat_ws("|", "lang", "source"))
    return dedup.first_by_id(docs, "key", "doc_id").select("doc_id", "lang", "source")


_PAGE = r"""
trim(regexp_replace(replace(CASE WHEN contains(html, '<') THEN
 replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'),
 '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') ELSE html END, chr(160), ' '), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {_PAGE} AS text FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html_native(F.col("html")).alias("text"))


@query()
def html_text_parsed(spark, sf):
    return table(spark, sf, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('17|' || source), source) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN place < floor(n * 0.1) THEN 'test' WHEN place < floor(n * 0.1) + floor(n * 0.1) THEN 'valid' ELSE 'train' END AS split
FROM documents JOIN g USING (source)""")
def group_split(spark, sf):
    return splits.group_split(table(spark, sf, "documents").select("doc_id", "source"), "source")


@query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('17|' || source), source) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source FROM documents JOIN g USING (source) WHERE place < floor(n * 0.1)
ORDER BY md5('17|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 150""")
def gold_slice(spark, sf):
    rows = splits.group_split(table(spark, sf, "documents").select("doc_id", "source"), "source")
    return splits.gold_slice(rows, "doc_id").select("doc_id", "source")


@query("""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('17|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN place < least(300, greatest(n // 10, 1)) THEN 'valid' ELSE 'train' END AS part FROM p""")
def hold_out(spark, sf):
    train, valid = splits.hold_out(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


@query("""
WITH d AS (SELECT doc_id FROM documents WHERE lang = 'en'), k AS (SELECT CAST(floor(count(*) * 0.15 / (1 - 0.15)) AS BIGINT) AS k FROM d),
g AS (SELECT doc_id, row_number() OVER (ORDER BY md5('17|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents WHERE lang <> 'en')
SELECT doc_id, 'domain' AS origin, md5('17|' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM d
UNION ALL SELECT doc_id, 'replay', md5('17|' || CAST(doc_id AS VARCHAR)) FROM g, k WHERE place <= k""")
def corpus_mix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return splits.replay_mix(docs.where("lang = 'en'").drop("lang"), docs.where("lang <> 'en'").drop("lang"), "doc_id", 0.15)


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT array_to_string(w[i:i+7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)),
hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)) JOIN bg USING (g))
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)""")
def leakage_guard(spark, sf):
    docs, guard = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text")
    return splits.without_overlap(docs, guard).select("doc_id")


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 10""")
def per_category_limit(spark, sf):
    return splits.per_category(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 10)


@query("""
WITH s AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('0|' || source), source LIMIT 5)
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM s)""")
def limit_groups(spark, sf):
    return splits.limit_groups(table(spark, sf, "documents").select("doc_id", "source"), "source", 5)


_TOKENS = r"list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: length(w))"


def _tokenised(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.transform(words, F.length).alias("tokens"))


@query(f"""
WITH t AS (SELECT doc_id, list_append({_TOKENS}, 0) AS t FROM documents),
f AS (SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS i FROM t),
p AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM f)
SELECT pos // 512 AS block, md5(string_agg(CAST(tok AS VARCHAR), ',' ORDER BY pos)) AS digest FROM p GROUP BY 1 HAVING count(*) = 512""")
def pack_blocks(spark, sf):
    blocks = tokens.pack_stream(_tokenised(spark, sf), 512, 0)
    return blocks.select("block", F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query(f"""
WITH t AS (SELECT doc_id, list_append({_TOKENS}, 0) AS t FROM documents),
b AS (SELECT doc_id, nth, t[nth * 512 + 1 : nth * 512 + 512] AS part FROM (SELECT doc_id, t, unnest(range((len(t) - 1) // 512 + 1)) AS nth FROM t)),
p AS (SELECT doc_id, nth, list_concat(part, list_transform(range(512 - len(part)), lambda x: 0)) AS block FROM b)
SELECT doc_id AS ord, CAST(nth AS INTEGER) AS nth, md5(array_to_string(block, ',')) AS digest, CAST(len(block) AS INTEGER) AS size FROM p""")
def pack_separate(spark, sf):
    blocks = tokens.pack_separate(_tokenised(spark, sf), 512, 0)
    return blocks.select("ord", "nth", F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"), F.size("tokens").alias("size"))


@query(f"""
WITH n AS (SELECT count(*) AS documents, CAST(sum(len({_TOKENS}) + 1) AS BIGINT) AS tokens FROM documents), b AS (SELECT *, tokens // 512 AS blocks FROM n)
SELECT documents, tokens, blocks, CAST(0 AS BIGINT) AS padding_tokens, tokens - blocks * 512 AS dropped_tail_tokens,
 round(100 * (blocks * 512) / greatest(tokens, 1), 2) AS retention_pct, round(100 * (blocks * 512) / greatest(blocks * 512, 1), 2) AS efficiency_pct FROM b""")
def pack_stats(spark, sf):
    return tokens.pack_stats(_tokenised(spark, sf), 512)


@query(r"""
WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role FROM conversations)
SELECT conv_id, turn, CAST(len(regexp_extract_all(before, '\S+')) AS INTEGER) AS loss_from, CAST(len(regexp_extract_all(before, '\S+')) + len(regexp_extract_all(text, '\S+')) + 1 AS INTEGER) AS tokens
FROM c WHERE role = 'assistant' AND before_role = 'user'""")
def loss_offsets(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.length).alias("t"))
    turns = turns.withColumns({"before": F.lag("t").over(order), "before_role": F.lag("role").over(order)}).where("role = 'assistant' and before_role = 'user'")
    pair = tokens.prompt_and_answer(F.col("before"), F.col("t"), 0)
    return turns.select("conv_id", "turn", pair.alias("x")).select("conv_id", "turn", "x.loss_from", F.size("x.tokens").alias("tokens"))


@query(r"""
SELECT CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words,
 round(sum((length(text) + 3) // 4) / sum(len(regexp_extract_all(text, '\S+'))), 3) AS fertility FROM documents""")
def fertility(spark, sf):
    quarters = lambda c: F.regexp_extract_all(c, F.lit(r"(?s).{1,4}"), F.lit(0))
    return tokens.fertility(table(spark, sf, "documents"), "text", quarters)


_WORDS = r"""
s AS (SELECT surface, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*')) AS surface FROM documents) GROUP BY 1),
t AS (SELECT lower(surface) AS word, CAST(sum(n) AS BIGINT) AS freq, arg_min(surface, (-n, surface)) AS surface FROM s GROUP BY 1)"""


@query(f"WITH {_WORDS} SELECT word, freq, surface FROM t")
def word_table(spark, sf):
    return tokens.word_table(table(spark, sf, "documents"))


@query(f"""
WITH {_WORDS},
g AS (SELECT lower(term) AS word, min(term) AS listed FROM (SELECT unnest(string_split(p_name, ' ')) AS term FROM part) WHERE NOT regexp_matches(term, '[ -]') GROUP BY 1),
p AS (SELECT coalesce(t.word, g.word) AS word, coalesce(freq, 0) AS freq, coalesce(surface, listed) AS term, listed IS NOT NULL AS in_gazetteer FROM t FULL JOIN g USING (word))
SELECT term, freq, CAST((length(term) + 3) // 3 AS INTEGER) AS base_tokens, freq * ((length(term) + 3) // 3 - 1) AS savings, in_gazetteer
FROM p WHERE (in_gazetteer OR freq >= 20) AND freq >= 20 AND (length(term) + 3) // 3 >= 3""")
def vocab_candidates(spark, sf):
    terms = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    pieces = lambda c: F.regexp_extract_all(c, F.lit("(?s).{1,3}"), F.lit(0))
    return tokens.vocabulary_candidates(table(spark, sf, "documents"), terms, pieces)


_VOCAB = r"""
w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*') AS w FROM benchmark),
g AS (SELECT item_id, i, n, array_to_string(w[i:i+n-1], ' ') AS surface FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), (VALUES (1), (2)) AS k(n) WHERE i + n - 1 <= len(w)),
v AS (SELECT lower(surface) AS phrase FROM g GROUP BY 1, n HAVING count(*) >= CASE WHEN n = 1 THEN 12 ELSE 3 END),
best AS (SELECT item_id, i, max(n) AS n FROM g JOIN v ON lower(surface) = phrase GROUP BY 1, 2)"""


@query(f"""
WITH RECURSIVE {_VOCAB},
scan(item_id, i) AS (SELECT item_id, CAST(1 AS BIGINT) FROM w UNION ALL
 SELECT s.item_id, s.i + coalesce(b.n, 1) FROM scan s JOIN w USING (item_id) LEFT JOIN best b ON b.item_id = s.item_id AND b.i = s.i WHERE s.i <= len(w.w))
SELECT s.item_id, lower(g.surface) AS canonical, count(*) AS hits FROM scan s JOIN best b ON b.item_id = s.item_id AND b.i = s.i
JOIN g ON g.item_id = s.item_id AND g.i = s.i AND g.n = b.n GROUP BY ALL""")
def benchmark_tags(spark, sf):
    """Benchmark items by phrases of one and two words that are frequent there."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return tagging.tag(items, _benchmark_vocabulary(items)).groupBy(F.col("id").alias("item_id"), "canonical").agg(F.count("*").alias("hits"))


def _benchmark_vocabulary(items):
    words = items.select(F.regexp_extract_all("text", F.lit(text.WORD), F.lit(0)).alias("w"))

    def grams(n: int):
        return words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.lower(F.array_join(F.slice("w", i, n), " ")))).alias("p"))

    each = [grams(1), grams(2)]
    often = [e.groupBy("p").count().where(f"count >= {least}") for e, least in zip(each, (12, 3), strict=True)]
    entries = often[0].unionByName(often[1]).select(F.col("p").alias("surface"), F.col("p").alias("canonical"), F.crc32("p").alias("ord"))
    return tagging.gazetteer(entries)


def _tag_digest(hits):
    """Hits of each document and phrase, with a digest of their places and forms."""
    place = F.concat_ws(":", "start", "end", "surface")
    return hits.groupBy(F.col("id").alias("doc_id"), "canonical").agg(F.count("*").alias("hits"), F.md5(F.array_join(F.array_sort(F.collect_list(place)), "|")).alias("places"))


@query()
def gazetteer_tags(spark, sf):
    """All documents by the phrases of the benchmark, sent to the tasks."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return _tag_digest(tagging.tag(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), _benchmark_vocabulary(items)))


@query()
def gazetteer_tags_joined(spark, sf):
    """The same by a join, for vocabularies of any size."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return _tag_digest(tagging.tag_joined(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), _benchmark_vocabulary(items)))


@query(r"""
WITH v AS (SELECT lower(w) AS low, arg_min(w, (-n, w)) AS term FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*')) AS w FROM benchmark) GROUP BY 1) GROUP BY 1 HAVING length(lower(w)) >= 8),
pl AS (SELECT *, row_number() OVER (ORDER BY md5('17|' || term), term) - 1 AS place, count(*) OVER () AS terms FROM v),
sn AS (SELECT doc_id, unnest(s) AS sent, unnest(range(len(s))) AS nth FROM (SELECT doc_id, string_split(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)),
wd AS (SELECT DISTINCT doc_id, nth, sent, unnest(regexp_extract_all(sent, '[A-Za-z][A-Za-z\-]+')) AS word FROM sn WHERE len(regexp_extract_all(sent, '[A-Za-z][A-Za-z\-]+')) >= 8),
dr AS (SELECT * FROM wd JOIN v ON lower(word) = low QUALIFY row_number() OVER (PARTITION BY doc_id, nth ORDER BY md5('17|' || doc_id || '|' || nth || '|' || word)) = 1),
ft AS (SELECT * FROM dr WHERE strpos(sent, word) > 21 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY nth) = 1),
f AS (SELECT * FROM ft ORDER BY doc_id LIMIT 50),
c AS (SELECT f.doc_id, f.sent, f.word, f.low, pl.term, pl.low AS other, k FROM f, range(4) t(k), pl WHERE pl.place = (CAST('0x' || substr(md5('17|' || f.doc_id), 1, 8) AS BIGINT) + k) % pl.terms)
SELECT doc_id AS ord, trim(substr(any_value(sent), 1, strpos(any_value(sent), any_value(word)) - 1), ' ') AS prompt, any_value(word) AS answer, array_to_string((list(term ORDER BY k) FILTER (other <> low))[1:3], ',') AS distractors
FROM c GROUP BY doc_id HAVING count(*) FILTER (other <> low) >= 3""")
def cloze_probes(spark, sf):
    vocabulary = tokens.word_table(table(spark, sf, "benchmark")).where("length(word) >= 8").select(F.col("surface").alias("term"))
    probes = tagging.cloze_probes(table(spark, sf, "documents").withColumn("ord", F.col("doc_id")), vocabulary, 50)
    return probes.withColumn("distractors", F.array_join("distractors", ","))


@query("""
WITH b AS (SELECT lang, source, length(text) AS n FROM documents)
SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chars, round(avg(n), 4) AS mean_chars, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most,
 CAST(quantile_disc(n, 0.5) AS INTEGER) AS median, CAST(sum(n) // 4 AS BIGINT) AS tokens_estimate, count(DISTINCT source) AS sources FROM b GROUP BY lang""")
def corpus_profile(spark, sf):
    n = F.length("text")
    docs = table(spark, sf, "documents").select("lang", "source", n.alias("n"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("n").alias("chars"), F.round(F.avg("n"), 4).alias("mean_chars"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("int").alias("median"), F.floor(F.sum("n") / 4).cast("long").alias("tokens_estimate"), F.countDistinct("source").alias("sources"),
    )


@query("""
SELECT part, documents, chars, chars // 4 AS tokens_estimate, round(documents / sum(documents) OVER (), 3) AS share FROM (
 SELECT CASE WHEN lang = 'en' THEN 'domain' ELSE 'replay' END AS part, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1)""")
def corpus_card(spark, sf):
    from pyspark.sql import Window

    part = F.when(F.col("lang") == "en", "domain").otherwise("replay")
    sums = table(spark, sf, "documents").groupBy(part.alias("part")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))
    share = F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 3)
    return sums.select("part", "documents", "chars", F.floor(F.col("chars") / 4).cast("long").alias("tokens_estimate"), share.alias("share"))


@query(f"""
WITH k AS (SELECT min(doc_id) AS doc_id FROM documents WHERE lang = 'en' AND {_REASON} = 'kept' GROUP BY array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')),
p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('17|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place, count(*) OVER () AS n FROM k),
t AS (SELECT doc_id FROM p WHERE place >= least(300, greatest(n // 10, 1))),
g AS (SELECT doc_id, row_number() OVER (ORDER BY md5('17|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents WHERE lang <> 'en')
SELECT doc_id, 'domain' AS origin FROM t UNION ALL SELECT doc_id, 'replay' FROM g WHERE place <= (SELECT CAST(floor(count(*) * 0.15 / (1 - 0.15)) AS BIGINT) FROM t)""")
def pretraining_corpus_exact(spark, sf):
    """The build without its near-duplicate step, which SQL can't follow."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    made = lifecycle.pretraining_corpus(docs.where("lang = 'en'").drop("lang"), docs.where("lang <> 'en'").drop("lang"), near=False)
    return made["train"].select("doc_id", "origin")


@query()
def pretraining_corpus(spark, sf):
    """The whole build, which ``pretraining_card`` describes."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return lifecycle.pretraining_corpus(docs.where("lang = 'en'").drop("lang"), docs.where("lang <> 'en'").drop("lang"))["train"].select("doc_id", "origin")


@query()
def pretraining_card(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return lifecycle.pretraining_corpus(docs.where("lang = 'en'").drop("lang"), docs.where("lang <> 'en'").drop("lang"))["card"]
