"""Substring removal, near duplicates and decontamination against brute force."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarack.llm import decontamination, ngram_join, substring_dedup
from tamarack.llm.components import components
from tamarack.llm.queries import QUERIES
from tamarack.llm.sizing import row_digest
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def brute_repeats(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("size", [3, 6, 35])
def test_repeats_random(spark, size):
    r = random.Random(size)
    words = ["a", "b", "c", "dé", "e"]
    passage = [r.choices([*words, "x", "y", "z"], k=50) for _ in range(4)]
    texts = [None, "", "   ", "one", LONG, LONG[:9000]]
    for _ in range(60):
        parts = [r.choices([f"q{r.random()}", *words], k=r.randint(0, 60)), r.choice(passage), r.choices(words, k=r.randint(0, 9))]
        texts.append(r.choice([" ", "\n", "\t  "]).join(x for p in parts for x in p))
    texts += texts[6:9]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.remove_repeats(docs_of(spark, texts), "text", size).collect()}
    assert got == dict(enumerate(brute_repeats(texts, size)))


def test_repeats_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 2_000)
    monkeypatch.setattr(substring_dedup, "LEAST_BYTES", 2_000)
    r = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [" ".join([*r.choices([f"k{j}" for j in range(5000)], k=60), *([shared] if i % 3 else [])]) for i in range(120)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 35)))


def test_repeats_shape(spark):
    df = spark.createDataFrame([(1, "a b", 9, 8, 7)], "doc_id long, text string, n_words int, g int, _text int")
    out = substring_dedup.remove_repeats(df, window=5)
    assert out.columns == ["doc_id", "g", "_text", "n_words", "n_removed", "kept_text"] and out.first()[:4] == (1, 8, 7, 2)
    assert substring_dedup.remove_repeats(df.limit(0), window=5).count() == 0


def test_repeats_query(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_substring_dedup"](spark, str(DATA / "sf0.001")).collect()}
    want = {d.doc_id: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, brute_repeats([d.text for d in docs], 35), strict=True)}
    assert got == want


def grams(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(texts, least=0.8):
    sets, parent, n = [grams(t) for t in texts], list(range(len(texts))), [0] * len(texts)

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (root(i), n[i]) for i in range(len(texts))}


def near_texts():
    r = random.Random(4)
    texts = [None, "", "!!", "one two", "One two.", "a b c d e", LONG, LONG + " end"]
    for _ in range(12):
        base = [f"t{r.randint(0, 3000)}" for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            copy = list(base)
            for _ in range(max(1, len(copy) // 90)):
                copy[r.randrange(len(copy))] = f"new{r.random()}"
            texts.append(" ".join(copy))
    return texts + texts[-4:] + texts[:2]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    texts = near_texts()
    found = ngram_join.near_duplicates(docs_of(spark, texts), trees=64).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute_links(texts)
    heads = {r.class_id for r in found if r.row_key == r.class_key and r.class_id == r.doc_id}
    assert heads >= {r.class_id for r in found}


def test_near_query(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_links([d.text for d in docs])
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op7_ngram_jaccard_join"](spark, str(DATA / "sf0.001")).collect()}
    ids = [d.doc_id for d in docs]
    assert got == {ids[i]: (ids[c], n) for i, (c, n) in want.items()}


def exact_links(texts, least=0.8):
    """All links by an index of n-grams: every pair that shares one is counted."""
    holders, shared = {}, Counter()
    sets = [grams(t) for t in texts]
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for found in holders.values():
        shared.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    return {p for p, n in shared.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9}


def test_recall_at_registered_parameters(spark):
    docs = spark.read.parquet(str(DATA / "sf0.1/documents.parquet")).select("doc_id", "text").orderBy("doc_id").collect()
    by_set = {}
    for d in docs:
        if s := grams(d.text):
            by_set.setdefault(frozenset(s), []).append(d)
    distinct = [ds[0].text for ds in by_set.values()]
    copies = [len(ds) for ds in by_set.values()]
    want = exact_links(distinct)
    rows = sum(copies[a] * copies[b] for a, b in want) * 2 + sum(n * (n - 1) for n in copies)
    got = QUERIES["op7_ngram_jaccard_join"](spark, str(DATA / "sf0.1")).agg(F.sum("n_links")).first()[0]
    assert len(want) > 40 and 0.999 * rows <= got <= rows


@pytest.mark.parametrize("block", [4096, 200])
def test_dense_group(spark, monkeypatch, block):
    """Near copies of one text: all pairs are links, and shuffled rows are one a text and block."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", block)
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(400)] * 2 + ["unlike them at all , my friend"]
    found = ngram_join.near_duplicates(docs_of(spark, texts)).collect()
    assert all((r.class_id, r.n_links) == ((0, 799) if r.doc_id < 800 else (800, 0)) for r in found)


def test_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a", "x", {"k": 1}), (1, None, "a", {"k": 1}), (1, "", "a", None), (1, "", "a", None)], "doc_id long, text string, row_key string, m map<string,int>")
    assert df.select(row_digest(df).alias("k")).distinct().count() == 3
    out = ngram_join.near_duplicates(df)
    assert out.columns == ["doc_id", "class_id", "n_links", "row_key", "class_key"] and out.where("n_links > 0").count() == 0


def test_near_empty_and_null_ids(spark):
    assert ngram_join.near_duplicates(docs_of(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()) == [(3, 2)] * 3


def test_prefix_shortening():
    assert ngram_join.shortest_needed(0.8, 12, 40, 0.98) == 10
    assert ngram_join.recall(0.8, 10, 40) >= 0.98
    crowded = {(t, n): 10**6 if t < 10 else 5 for t in range(44) for n in range(13)}
    lengths = ngram_join.prefix_lengths(crowded, 0.8, 12, 44, 0.999)
    missed = 1.0
    for n in lengths:
        missed *= 1 - 0.8**n
    assert missed <= 0.001 and min(lengths) == 8  # the trees with many matches keep the longer prefixes
    assert min(lengths[:10]) >= max(lengths[10:]) and lengths[0] > 8


def test_matches_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    entries = sorted((bytes([0, r.randrange(3), *r.choices(b"abc", k=12)]), bytes([i // 256, i % 256])) for i in range(800))

    def linked(parts, n):
        import pyarrow as pa

        out, tied = set(), {}
        for part in parts:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.binary()) for k in (0, 1)], names=["entry", "node"])
            for b in ngram_join._matches(iter([batch]), 4):
                for t, length, u, v, open_ in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if open_ is None and length >= n:
                        out.add(frozenset((u, v)))
                    elif open_ is not None and length == n:
                        tied.setdefault(open_, set()).add(u)
        for nodes in tied.values():
            out.update(frozenset((u, min(nodes))) for u in nodes if u != min(nodes))
        parent = {node: node for _, node in entries}

        def root(x):
            return x if parent[x] == x else root(parent[x])

        for a, b in map(tuple, out):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        return {x: root(x) for x in parent}

    for n in (4, 6):
        whole = linked([entries], n)
        assert whole == linked([entries[i : i + 37] for i in range(0, 800, 37)], n) and len(set(whole.values())) < 800


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (7, 8), (20, 4)], "u int, v int")
    assert {r.node: r.label for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def brute_contamination(texts, items):
    windows = {}
    for name, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(name))
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(LOW))
        hit, names = [False] * len(w), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit[i : i + size] = [True] * size
                    names |= found
        out.append((len(w), sum(hit), sorted(names)))
    return out


@pytest.mark.parametrize("literals", [50_000, 3])
def test_contamination(spark, literals):
    r = random.Random(8)
    words = ["the", "of", "É", "Kelvin", "straße", "x1", "a", "b"]
    items = [(i, " ".join(r.choices([*words, f"u{i}"], k=r.choice([1, 4, 10, 11, 30])))) for i in range(12)] + [(99, None), (98, ""), (97, "--"), (3, "the of the of")]
    texts = [None, "", "THE OF the, of!", LONG] + [" ".join([*r.choices(words, k=r.randint(0, 20)), r.choice(items)[1] or "", *r.choices(words, k=5)]).upper() if i % 4 else " ".join(r.choices(words, k=40)) for i in range(40)]
    texts += texts[4:6]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find_contamination(docs_of(spark, texts), table, max_literals=literals)
    assert {x.doc_id: (x.n_words, x.n_hit, x.item_ids) for x in out.collect()} == dict(enumerate(brute_contamination(texts, items)))
    assert all(x.contaminated == (x.n_hit > 0) and x.n_items == len(x.item_ids) for x in out.collect())


def test_contamination_edges(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    twice = spark.createDataFrame([(1, "a b", "k")] * 2, "doc_id long, text string, n_hit string")
    out = decontamination.find_contamination(twice, items)
    assert sorted(out.columns) == sorted(["doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"])
    assert [(r.doc_id, r.n_words, r.n_hit) for r in out.collect()] == [(1, 2, 0)] * 2
    odd = spark.createDataFrame([(1, "a b", "s", {"x": 1}, 5), (1, "a b", "s", {"x": 1}, 5), (None, None, None, None, None)], "doc_id long, text string, _src string, m map<string,int>, key int")
    for literals in (100, 0):
        out = decontamination.find_contamination(odd, spark.createDataFrame([(7, "B")], "item_id long, text string"), max_literals=literals)
        assert out.columns == ["doc_id", "_src", "m", "key", "n_words", "n_hit", "n_items", "item_ids", "contaminated"]
        assert sorted((r._src or "", r.m, r.key or 0, r.n_hit, r.item_ids) for r in out.collect()) == [("", None, 0, 0, []), ("s", {"x": 1}, 5, 1, ["7"]), ("s", {"x": 1}, 5, 1, ["7"])]
    assert decontamination.find_contamination(twice.limit(0), items).count() == 0


def test_contamination_query(spark):
    sf = DATA / "sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(str(sf / "benchmark.parquet")).collect()]
    docs = spark.read.parquet(str(sf / "documents.parquet")).select("doc_id", "text").collect()
    want = {d.doc_id: (n, h, hashlib.sha256(",".join(k).encode()).hexdigest()) for d, (n, h, k) in zip(docs, brute_contamination([d.text for d in docs], items), strict=True)}
    rows = QUERIES["op9_benchmark_decontamination"](spark, str(sf)).select("doc_id", "n_words", "n_hit", F.col("items_sha256"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in rows.collect()} == want


def test_rows_repeated_whole_are_spread(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_BYTES", 64)
    df = spark.createDataFrame([(1, "a b c d e f g")] * 60 + [(2, "h i j k l m n")], "doc_id long, text string").repartition(8)
    out = substring_dedup.remove_repeats(df, window=5).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 7)] * 60 + [(2, 0)]


def test_copies_are_spread_by_any_id(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 64)
    monkeypatch.setattr(substring_dedup, "LEAST_BYTES", 64)
    df = spark.createDataFrame([(i, "a b c d e f g", {"k": i}) for i in range(40)], "row_id long, text string, extra map<string,int>")
    out = substring_dedup.remove_repeats(df, window=5)
    assert re.search(r"xxhash64\(text#\d+, row_id#\d+L?, SPARK_PARTITION_ID\(\), 42\)", out._jdf.queryExecution().analyzed().toString())
    assert {(r.n_words, r.n_removed, r.kept_text) for r in out.collect()} == {(7, 7, "")} and out.count() == 40
