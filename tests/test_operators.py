import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tamarack.operators.aggregates import nearest_rank_by, rejection_flags, session_stats, tenant_usage
from tamarack.operators.graph import precedent_chain
from tamarack.operators.scans import first_truthy, upsert
from tamarack.operators.windows import best_per_key, merged_per_key
from tamarack.plans import corpus
from tamarack.sources.files import docx_paragraphs, mime_of, read_cases, read_documents
from tamarack.streaming.rollups import run_once, run_updates, session_rollup, sliding_log, sliding_log_sorted, sliding_log_state, tumbling_counts
from tamarack.tables import conform
from tests.conftest import DATA


def test_chain_with_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (2, None), (1, 4)], "source_id int, cited_id int")
    got = {(r.source_id, r.cited_id, r.depth) for r in precedent_chain(e, [1], 4).collect()}
    assert got == {(1, 2, 1), (1, 4, 1), (2, 3, 2), (4, 4, 2)}  # a self-loop off the start is taken once


def test_rejection_thresholds(spark):
    rows = [("a", i == 0) for i in range(4)] + [("b", i == 0) for i in range(5)] + [("c", i < 2) for i in range(5)]
    out = {r.s: r.flagged for r in rejection_flags(spark.createDataFrame(rows, "s string, rejected boolean"), "s").collect()}
    assert out == {"a": False, "b": False, "c": True}


def test_session_fan_out(spark):
    s = spark.createDataFrame([(1, 10.0), (2, 5.0)], "session_id int, cost double")
    m = spark.createDataFrame([(1, 1, 10, 0.5, True), (1, 2, 20, 0.7, False), (2, 3, 30, 0.9, False)], "session_id int, message_id int, latency int, confidence double, escalated boolean")
    a = spark.createDataFrame([(1, 2, 1), (1, 2, 2)], "message_id int, cited int, verified int")
    r = session_stats(s, m, a).first()
    assert (r.total_sessions, r.total_queries, r.total_cost, r.verified_rate) == (2, 4, 35.0, 0.75)
    assert session_stats(s, m, a, dedup_cost=True).first().total_cost == 15.0


def test_empty_tenant(spark):
    t = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    u = spark.createDataFrame([(1, 7), (1, 8)], "tenant_id int, user_id int")
    c = spark.createDataFrame([], "tenant_id int, case_id int")
    s = spark.createDataFrame([(1, 1, 2.0, 5)], "tenant_id int, session_id int, cost double, created_at int")
    out = {r.tenant_id: (r.user_count, r.case_count, r.session_count, r.total_cost) for r in tenant_usage(t, u, c, s).collect()}
    assert out == {1: (2, 0, 1, 4.0), 2: (0, 0, 0, None)}


def test_nearest_rank(spark):
    import random

    r = random.Random(2)
    groups = {"a": [0, 1, 2, 3, 4], "b": [r.gauss(0, 1) for _ in range(5000)], "c": [r.choice([0, 1, 5]) for _ in range(3000)], "d": [7], "e": [0]}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("e", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {x.k: x.percentile for x in nearest_rank_by(df, ["k"], "x", p).collect()}
        want = {k: sorted(x for x in xs if x)[round((len([x for x in xs if x]) - 1) * p)] for k, xs in groups.items() if any(xs)}
        assert got == want, p  # an index halfway rounds to the even one


def test_policies(spark):
    df = spark.createDataFrame([("k", 0, 0.5, None), ("k", 1, 0.9, None), ("k", 2, 0.1, "t")], "k string, ord int, score double, title string")
    assert best_per_key(df, "k", [F.desc("score"), F.col("ord")]).first().ord == 1
    r = merged_per_key(df, "k", "score", "ord", ["title"]).first()
    assert (r.ord, r.score, r.title) == (0, 0.9, "t")


def test_small_helpers(spark):
    df = spark.createDataFrame([("", "b", 1)], "a string, b string, n int")
    assert df.select(first_truthy("a", "b").alias("x")).first().x == "b"
    from pyspark.sql import types as T

    schema = T.StructType().add("id", "long").add("name", "string").add("when", "timestamp")
    assert conform(df, schema, {"id": ["n"], "name": ["b"]}).first() == (1, "b", None)
    new = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "k int, v int")
    assert {(r.k, r.v) for r in upsert(spark.createDataFrame([(1, 9)], "k int, v int"), new, ["k"], "v").collect()} == {(1, 6), (2, 1)}


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("grüß \xff".encode() + b"\xff")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:document>')
    out = {r.kind: r.text for r in read_documents(spark, str(tmp_path)).collect()}
    assert out["docx"] == "One\n\nTwo" and out["text"].endswith("�")
    assert docx_paragraphs(b"no zip") == ""
    assert spark.range(1).select(mime_of(F.lit("x/y.PDF")).alias("m")).first().m == "pdf"
    (tmp_path / "cases.json").write_text('[{"id": "1", "question": "q", "expected_articles": ["5"]}]')
    r = read_cases(spark, str(tmp_path / "cases.json")).first()
    assert (r.jurisdiction, r.difficulty, r.expected_articles) == ("laos", "medium", ["5"])


def test_sliding_log_as_stream(spark, tmp_path):
    rows = pd.DataFrame({"key": ["a"] * 5 + ["b"], "id": range(6), "s": [0.0, 1.0, 2.0, 60.5, 61.5, 3.0]})
    batch = sliding_log(2, 60)(rows[rows.key == "a"])
    assert batch["allowed"].tolist() == [True, True, False, True, True]
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, id long, s double").parquet(str(tmp_path / "in"))
    out = stream.groupBy("key").applyInPandasWithState(sliding_log_state(2, 60), "key string, id long, allowed boolean", "log array<double>", "append", "NoTimeout")
    got = {r.id: r.allowed for r in run_once(out, "append", "sliding", str(tmp_path / "cp")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def test_sliding_log_over_batches(spark):
    rows = pd.DataFrame([(i % 7 % 3, i, float(i * 37 % 500)) for i in range(400)], columns=["user_id", "id", "s"])
    want = pd.concat([sliding_log(2, 60)(g) for _, g in rows.groupby("user_id")]).set_index("id")["allowed"].to_dict()
    batches = pa.Table.from_pandas(rows.sort_values(["user_id", "s", "id"]), preserve_index=False).to_batches(max_chunksize=7)
    out = list(sliding_log_sorted(2, 60)(iter(batches)))
    assert [b.num_rows for b in out] == [b.num_rows for b in batches]  # no user's rows are gathered
    got = {r["id"]: r["allowed"] for b in out for r in b.to_pylist()}
    assert got == want and 0 < sum(got.values()) < 400


def test_sliding_log_query_gathers_no_user(spark):
    out = corpus.rate_limit_sliding_log(spark, f"{DATA}/sf0.001")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s")).toPandas()
    want = {i: a for _, g in e.groupby("user_id") for i, a in zip(*sliding_log(2, 6 * 3600)(g)[["id", "allowed"]].to_numpy().T)}
    assert {r.event_id: r.allowed for r in out.collect()} == want


def test_session_rollup_stays_off_the_driver(spark):
    out = corpus.stream_session_rollup(spark, f"{DATA}/sf0.001")
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())  # a memory sink has none
    want = session_rollup(spark.read.parquet(f"{DATA}/sf0.001/conversations.parquet"))
    assert out.count() == want.count() and out.exceptAll(want).count() == 0


def test_rollup_of_several_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "user"), ("b", "yy", "assistant"), ("a", "zzz", "assistant")], "conv_id string, text string, role string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing is new the second time
        got = run_updates(session_rollup(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "conv_id")
        assert sorted(got.collect()) == [("a", 2, 4, 1), ("b", 1, 2, 1)]
    written = [len(list(d.rglob("*.parquet"))) and spark.read.parquet(str(d)).count() for d in sorted((tmp_path / "out").glob("query=*/batch=*"))]
    assert sum(written) == 3  # a batch writes the keys that it changed, not all


def test_tumbling_windows_as_stream(spark, tmp_path):
    """Windows change over batches while the watermark has not passed them; each row of a window counts once."""
    at = [("a", 0), ("a", 59), ("a", 60), ("b", 61), ("a", 30), ("b", 3599), ("b", 3600)]
    for i, (k, s) in enumerate(at):
        df = spark.createDataFrame([(k, s)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    counts = tumbling_counts(stream, "k").select(F.unix_seconds("window.start").alias("start"), "k", "n")
    got = run_updates(counts, str(tmp_path / "out"), str(tmp_path / "cp"), "start", "k")
    assert sorted(got.collect()) == [(0, "a", 3), (60, "a", 1), (60, "b", 1), (3540, "b", 1), (3600, "b", 1)]


def test_knn_join_is_the_plain_expression_without_its_pairs(spark):
    from pyspark.sql import Window as W

    from tamarack.functions.vector import cosine
    from tamarack.plans.retrieval import knn_join

    nan = float("nan")
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0]), (7, [-1.0, 3.0]), (8, [nan, 1.0]), (9, [0.5, 0.5])]
    vectors = spark.createDataFrame(v, "id long, embedding array<double>")
    queries = vectors.select((F.col("id") * 10).alias("query_id"), F.col("embedding").alias("query"))
    met = vectors.crossJoin(queries).select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("similarity"))
    for k in (1, 4, 20):
        want = met.withColumn("rk", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")).cast("long")).where(F.col("rk") <= k)
        got = knn_join(vectors, queries, k)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = knn_join(vectors, queries.where("query_id = 90"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # no row for each pair


def test_knn_join_in_blocks(spark):
    """Queries beyond the broadcast's bytes meet the vectors in blocks, with the same rows."""
    from tamarack.plans.retrieval import knn_join

    e = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where("id % 9 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    whole, parts = knn_join(e, queries, 3), knn_join(e, queries, 3, most_bytes=4000)
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 3 * queries.count() > 0
    assert knn_join(e, queries.limit(0), 3).count() == 0
