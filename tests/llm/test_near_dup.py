import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from kelpie.llm import kernels, near_dup
from kelpie.llm.components import components


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def exact_groups(rows, k, percent):
    """As :func:`brute`, by an exact join: sets meet under the rarest shingles of each, one more than may differ."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    often = Counter(s for held in sets.values() for s in held)
    root, index = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in sorted(sets, key=lambda i: len(sets[i])):
        mine = sets[i]
        first = sorted(mine, key=lambda s: (often[s], s))[: len(mine) - -(-percent * len(mine) // 100) + 1]
        for j in {j for s in first for j in index[s]}:
            if find(i) != find(j) and 100 * len(mine & sets[j]) >= percent * len(mine | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for s in first:
            index[s].append(i)
    return {i: (len(held), find(i)) for i, held in sets.items()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    bases = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    shared = [word() for _ in range(40)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + shared
        out.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return out + [(n, ""), (n + 1, " ")]


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 5, 80)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_crowded_buckets(spark, monkeypatch):
    """Very many distinct texts that share most of their words, so buckets hold all of them, with links among some."""
    monkeypatch.setattr(near_dup, "CELL", 100)
    monkeypatch.setattr(near_dup, "ASKING", 20)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(90)]
    rows = []
    for i in range(900):
        own = [word() for _ in range(14)]
        if i % 9 == 4:
            own = rows[rng.randrange(len(rows))][1].split()[90:]
            own[rng.randrange(14)] = word()
        rows.append((i, " ".join(shared + own)))
    rng.shuffle(rows)
    want = exact_groups(rows, 3, 85)
    assert want == brute(rows[:0] + rows, 3, 85)
    groups = Counter(r for _, r in want.values())
    assert len(groups) > 500 and max(groups.values()) > 1
    tables, real = [], near_dup.cut
    monkeypatch.setattr(near_dup, "cut", lambda d, *a: tables.append(real(d, *a)) or tables[-1])
    sizes = []
    monkeypatch.setattr(near_dup, "drop", lambda *t: sizes.extend(r["n"] for x in t if "cell" in x.columns for r in x.selectExpr("size(cell) AS n", "of").where("of > 1").collect()))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert sizes and max(sizes) < 160  # cells of large buckets, none of them a whole bucket


def test_long_signatures(spark):
    """At a low threshold signatures have more slots than a byte can number."""
    assert near_dup.bands_for(60) * near_dup.ROWS > 256
    one = near_dup.superminhash(np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([0, 3999]), 332)
    assert int(one.max() >> np.uint64(40)) < 3  # all slots are filled in the first steps
    single = near_dup.superminhash(np.array([7], np.uint64), np.array([0, 1]), 332)
    assert sorted((single[0] >> np.uint64(40)).tolist()) == list(range(332))
    rows = corpus(4, 60)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 3, 60)
    with pytest.raises(ValueError):
        near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 30)


def test_odd_rows(odd_docs, no_docs):
    rows = near_dup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].component_id == by[7].component_id == 1 and not by[2].kept and by[1].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (3, 4, 5)) and by[6].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    everything = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = everything[:1000], everything[250:1250]  # similarity 0.6
    m = 256
    sig = near_dup.superminhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), m)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12
    one = near_dup.superminhash(a[:1], np.array([0, 1]), 16)
    assert sorted((one[0] >> np.uint64(40)).tolist()) == list(range(16))  # a single element fills each slot in one step


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_follow_the_word_rule():
    texts = ["A b", "a  B\t", "ab", "", "\x0bÄ\x85x\x1c y\n", "a b"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes, rows = kernels.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    words = [w for r in raw for w in r.lower().split()]
    assert np.diff(rows).tolist() == [len(r.split()) for r in raw]
    assert len(set(hashes.tolist())) == len(set(words)) and {w: h for w, h in zip(words, hashes.tolist(), strict=True)} == dict(zip(words, hashes.tolist(), strict=True))
    assert hashes[0] == hashes[2] == hashes[-2]


def test_word_hashes_of_long_texts():
    """Equal to the polynomial at every length around the tables' and on large texts."""
    rng = np.random.default_rng(6)
    low = kernels._LOW
    for n in (1, low - 1, low, low + 1, 3 * low, 5 * low + 17):
        data = rng.choice(np.frombuffer(b"abcXYZ0  \n\xc3\xa4", np.uint8), n)
        hashes, _ = kernels.word_hashes(data, np.array([0, n]))
        want = []
        for w in data.tobytes().lower().split():
            powers = [pow(int(kernels._BASE), i, 1 << 64) for i in range(len(w))]
            total = sum(int(kernels._BYTE[b]) * p for b, p in zip(w, powers, strict=True)) + len(w) * 0xD6E8FEB86659FD93
            want.append(total % (1 << 64))
        assert hashes.tolist() == kernels.mix(np.array(want, np.uint64)).tolist()


KEPT = """
import re
import numpy as np, pyarrow as pa
from kelpie.llm import kernels, near_dup
now = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def task(n):
    rng = np.random.default_rng(n)
    texts = pa.array(" ".join(map(str, rng.integers(0, 1 << 20, 450))) for _ in range(n))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), texts], names=["id", "text"])
    for made in SKETCH(iter([batch])):
        pass
SKETCH = getattr(kernels, "giving_back", lambda run: run)(near_dup._sketch(5, 22))
task(10)
before = now()
task(6000)
print(now() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_worker_gives_memory_back():
    """What a task of 20 MB of text took isn't kept by its worker, which later tasks find beside theirs."""
    done = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 48


if __name__ == "__main__":
    # python tests/llm/test_near_dup.py FOLDER: op1's groups on a folder of tables against those of the exact join.
    import sys

    import pyarrow.parquet as pq
    from pyspark.sql import SparkSession

    folder = sys.argv[1]
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    want = exact_groups(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)), 3, 85)
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "32").getOrCreate()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.op1_superminhash(session, folder).collect()}
    print(len(want), "documents,", len({r for _, r in want.values()}), "groups,", sum(got[i] != x for i, x in want.items()), "documents differ")
