"""The classifier against plain Python: n-grams as text, no hashing."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tamarack.llm import quality_classifier as Q
from tamarack.llm.queries import QUERIES
from tests.conftest import DATA

WORDS, MARKS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(rb"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")


def plain_features(text):
    words, marks = WORDS.findall((text or "").encode().lower()), MARKS.findall((text or "").encode())
    found = {("word", w) for w in words} | {("pair", *p) for p in zip(words, words[1:], strict=False)}
    found |= {("head", n, w[:n]) for w in words for n in Q.PREFIXES}
    found |= {("mark", m) for m in marks} | {("marks", *p) for p in zip(marks, marks[1:], strict=False)}
    return found | {("stutter",) for i in range(len(words) - Q.STUTTER + 1) if len(set(words[i : i + Q.STUTTER])) == 1}


def plain_weights(rows, good):
    features = [plain_features(t) for _, t in rows]
    raw, target = Counter(), Counter()
    for (i, _), f in zip(rows, features, strict=True):
        raw.update(f)
        if i in good:
            target.update(f)
    share = sum(target.values()) / sum(raw.values())

    def evidence(x):
        e, t = raw[x] * share, target[x]
        ratio = math.log((t + 1) / (e + 1))
        return ratio if ratio <= -math.log(Q.LEAST_FACTOR) and e - t >= Q.Z_LIMIT * math.sqrt(e + 1) else 0.0

    return [sum(map(evidence, f)) for f in features]


def fixture():
    """Good texts and junk, few enough n-grams (about a hundredth of the buckets) that hardly any share both buckets."""
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ber", "lo", "ma", "tik") for b in ("na", "ro", "sé") for c in ("n", "st", "", "ling")]
    rows = [None, "", " ", "one"] + [" ".join(r.choices(words, k=r.randint(3, 40))).capitalize() + "." for _ in range(120)]
    junk = ["Buy!!! spamword now", "$$$ spamword &&& spamwords", "xx xx xx xx xx xx", "$$$ &&& ***"]
    rows += [" ".join(r.choices([*words[:9], *junk], k=r.randint(5, 30))) for _ in range(80)]
    return list(enumerate(rows)), {i for i in range(4, 124) if i % 3}


def test_weights_are_the_plain_ones(spark):
    rows, good = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"))
    got = {r.doc_id: r.log_weight for r in Q.log_weights(docs, model).collect()}
    want = plain_weights(rows, good)
    wrong = [(i, got[i], w) for (i, _), w in zip(rows, want, strict=True) if abs(got[i] - w) > 0.01]
    assert len(wrong) <= 4 and sum(w < -5 for w in want) > 30 and sum(w == 0 for w in want) > 60, wrong[:5]


def test_counts_of_any_number_of_partitions(spark):
    """More partitions than fan_in ** levels: levels are added, no counts are lost."""
    rows, good = fixture()
    flagged = spark.createDataFrame([(t, i in good) for i, t in rows], "text string, good boolean")

    def counts(n, **how):
        blocks, n_raw, n_target = Q.sum_blocks(flagged.repartition(n).mapInArrow(Q._count, Q._COUNTED_DDL), **how)
        found = blocks.collect()
        assert len({r.block for r in found}) == len(found) > 0
        return n_raw, n_target, {r.block: (bytes(r.at), bytes(r.raw), bytes(r.target)) for r in found}

    one = counts(1)
    assert one == counts(11, fan_in=2, levels=1) == counts(11, fan_in=3, levels=2)
    found = [plain_features(t) for _, t in rows]
    assert abs(one[0] - 2 * sum(map(len, found))) <= 4 and abs(one[1] - 2 * sum(len(f) for i, f in enumerate(found) if i in good)) <= 4
    assert max(len(raw) for _, raw, _ in one[2].values()) < 8 * Q.BLOCK / 10  # only buckets that rows have


def test_no_counts(spark):
    empty = spark.createDataFrame([], "text string, good boolean").mapInArrow(Q._count, Q._COUNTED_DDL)
    blocks, n_raw, n_target = Q.sum_blocks(empty)
    assert (blocks.count(), n_raw, n_target) == (0, 0, 0)


def test_draw_takes_the_largest_keys(spark):
    sf = f"{DATA}/sf0.01"
    kept = {r.doc_id: (r.log_weight, r.sample_key) for r in QUERIES["op5_quality_classifier"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    weights = {r.doc_id: r.log_weight for r in Q.log_weights(docs, Q.fit(docs, good)).collect()}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", Q.gumbel(17, F.col("doc_id"), F.col("text")).alias("g")).collect()}
    keys = {i: 4 * w + noise[i] for i, w in weights.items()}
    k = round(sum(round(math.exp(4 * w), 6) for w in weights.values()))
    largest = sorted(keys, key=keys.get, reverse=True)[:k]
    assert set(kept) == set(largest) and all(abs(kept[i][1] - keys[i]) < 1e-5 for i in kept)


def test_names_stay(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8), (None, None, 7, 8)], "doc_id long, text string, noise int, good int")
    out = Q.resample(df, spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert out.columns == ["doc_id", "text", "noise", "good", "log_weight", "sample_key"] and out.count() == 2
