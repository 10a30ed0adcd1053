"""Hard negatives, source divergence and quality rules against plain Python: given tables, small fixtures and edges."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import hard_negatives as H
from tamarack.llm import quality_rules as Q
from tamarack.llm import queries
from tamarack.llm import source_divergence as S
from tests.conftest import DATA

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, positives=5, negatives=3):
    used = [(i, v, lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    vectors = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in used]
    out = []
    for a, (i, _, lab) in enumerate(used):
        if i % 50:
            continue
        score = [sum(x * y for x, y in zip(vectors[a], v, strict=False)) for v in vectors]
        others = sorted((-score[b], used[b][0], used[b][2] == lab) for b in range(len(used)) if b != a)
        for p, pid, _ in [x for x in others if x[2]][:positives]:
            fit = [(-s, n) for s, n, same in others if not same and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, pid, k + 1, n, -p, s) for k, (s, n) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 50 == 0).collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(H, "BLOCK_CELLS", 200)
    monkeypatch.setattr(H, "BATCH_ANCHORS", 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_of_random_vectors(spark, small_blocks, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(3)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in centres[i % 3]], r.randrange(4)) for i in range(250)]
    rows += [rows[0], rows[50], rows[7], rows[7], (1000, [0.0] * 6, 1), (1050, [0.5] * 3, 2), (None, [1.0] * 6, 1), (2000, None, 1), (2001, [1.0] * 6, None), (2002, [1.0, None], 1), (2050, [float("nan")] * 6, 1), (2003, [float("-inf")] * 6, 2), (2100, [], 3)]
    want = plain_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 50


def test_negatives_of_large_components_and_no_rows(spark, small_blocks):
    r = random.Random(5)
    rows = [(i, [r.uniform(-9e5, 9e5) for _ in range(4)], r.randrange(2)) for i in range(120)]
    assert mined(spark, rows) == plain_negatives(rows) != []
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == []


def test_scan_stops_early_and_misses_nothing():
    r = np.random.default_rng(3)
    for _ in range(20):
        matrix = np.floor(r.normal(0, 40, (400, 3)))
        anchor = np.floor(r.normal(0, 40, 3))
        lists, ids, met = H.Lists(matrix), r.permutation(400), 0
        order = sorted(range(400), key=lambda i: (-(matrix[i] @ anchor), ids[i]))[:5]
        assert H.top(lists, ids, anchor, 5)[1].tolist() == [ids[i] for i in order]
        for rows, scores, threshold in lists.scan(anchor):
            met += len(rows)
            rest = np.setdiff1d(np.arange(400), rows)
            assert (scores == matrix[rows] @ anchor).all() and len(rest)
            if threshold < (matrix @ anchor).max():
                break
        assert met < 400  # a strong row is found without reading all


def plain_divergence(rows, least, ranks=50):
    docs = [tuple(x or "" for x in row) for row in rows]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(t)) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(d[2], w) for d, w in zip(docs, terms, strict=True) if d[1] == lang]
        seen = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t, n in seen.items() if n >= least)
        v, sources = len(kept), sorted({s for s, _ in mine}, key=lambda s: s.encode())
        count = {s: Counter(t for x, w in mine if x == s for t in w if t in set(kept)) for s in sources}
        count[None] = sum(count.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * v) for t in kept} for s, c in count.items()}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[h][t]) for t in kept), h) for h in sources if h != s]
            term = [(p[s][t] - p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < ranks]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    for name, value in (("POSTINGS", 40), ("CELLS", 20), ("HELD", 30)):
        monkeypatch.setattr(S, name, value)
    r = random.Random(4)
    vocabulary = ["der", "Die", "ein", "öl", "ÖL", "x1y", "the", "And", "z", "straße", "日本", "rare"]
    rows = [(" ".join(r.choices(vocabulary, k=r.randint(0, 30))), r.choice(["de", "en", None, ""]), r.choice(["a", "b", "ä", "c", None, "zz"])) for _ in range(150)]
    rows += [(None, "de", "silent"), ("", "xx", "one"), ("", "xx", "two"), ("123 -- !!", "yy", "only"), rows[3], rows[3], ("der " * 5000, "de", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "value": F.lit(None).cast("string"), "p": F.lit(2)})
    got = sorted(map(tuple, S.audit(df, least_docs=8).collect()))
    assert got == plain_divergence(rows, 8) and len({x[2] for x in got}) == 2
    assert S.audit(df.limit(0)).collect() == []


def test_registered_queries_on_given_tables(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    for name in ("op11_hard_negatives", "op12_source_divergence"):
        got, want = queries.QUERIES[name](spark, f"{DATA}/sf0.01"), c.execute(queries.ORACLE[name])
        order = [x[0] for x in want.description]
        assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.fetchall())


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_posterior(votes):
    """The label model over single documents, in plain Python."""
    rules, n = len(votes[0]), len(votes)
    prior, good, bad, seen = Q.PRIOR, [Q.ON_GOOD] * rules, [Q.ON_BAD] * rules, Q.BELIEF * n + 1

    def odds(v):
        return math.log(prior / (1 - prior)) + sum(math.log(g / b) if x == 1 else math.log((1 - g) / (1 - b)) if x == -1 else 0 for x, g, b in zip(v, good, bad, strict=True))

    for _ in range(Q.ROUNDS):
        p = [1 / (1 + math.exp(-odds(v))) for v in votes]
        before = [prior, *good, *bad]

        def share(w, j, start):
            yes, no = (sum(x for x, v in zip(w, votes, strict=True) if v[j] == side) for side in (1, -1))
            return (yes + seen * start) / (yes + no + seen)

        prior = (sum(p) + seen * Q.PRIOR) / (n + seen)
        good = [min(0.999, max(0.5, share(p, j, Q.ON_GOOD))) for j in range(rules)]
        bad = [min(0.999, max(0.001, share([1 - x for x in p], j, Q.ON_BAD)), good[j]) for j in range(rules)]
        if max(abs(x - y) for x, y in zip(before, [prior, *good, *bad], strict=True)) < Q.TOLERANCE:
            break
    return [1 / (1 + math.exp(-odds(v))) for v in votes]


def test_quality_rules_on_given_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.judge(docs, "text").join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    names = [r.name for r in Q.RULES]
    for r in rows:
        assert tuple(r[c] for c in Q.COUNTS) == plain_counts(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    votes = [tuple(r[n] for n in names) for r in rows if r.n_words]
    for r, p in zip([r for r in rows if r.n_words], plain_posterior(votes), strict=True):
        assert r.probability == pytest.approx(p, abs=2e-6)
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad) and len(good) > 100 and len(bad) > 20


def test_quality_rules_at_the_edges(spark):
    long = "wort " * 400_000 + "ende"
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "ab " * 30, "x\x0by\x0cz w v", "a\n\na\n \n\n", "É É é #1 <b>", long, "Same line here.\nSame line here.\n" * 3]
    rows = [(i, t, 7) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumn("n_words", F.lit("x"))
    out = Q.judge(df, "text", keep_text=False).collect()
    assert len(out) == len(rows) and not {"text"} & set(out[0].asDict())
    for r in out:
        text = texts[r.doc_id] or ""
        assert tuple(r[c] for c in Q.COUNTS) == (plain_counts(text) if len(text) < 10_000 else (400_001, 1_600_004, 0, 0, 400_000))
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.kept or not r.base_failed)
    assert len({(r.doc_id, r.probability, r.kept) for r in out}) == len(texts)
    empty = Q.judge(df.limit(0), "text")
    assert empty.collect() == [] and empty.columns == Q.judge(df, "text").columns


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", "x.y")], "doc_id long, text string, `odd name` string")
    assert {"doc_id", "text", "odd name", *Q.FEATURES, "kept"} <= set(Q.judge(df).columns)
