"""Stored tables, views, caches and streams: what a change leaves alone, what readers see, what a replay does."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators.graph import precedent_chain, precedent_chains
from tamarack.plans import corpus, sql_functions, stored
from tamarack.sources.cache import Cache
from tamarack.sources.stored import Stored
from tamarack.sources.views import ROWS, Summary, View
from tamarack.streaming import ingestion as G
from tamarack.streaming import sinks as K
from tests.conftest import DATA

ROW = "k long, name string, v int"


def contents(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_changes_rewrite_only_their_buckets(spark):
    rows = [(i, f"n{i}", i % 5) for i in range(200)] + [(None, "null", 0), (7, "again", 1)]
    t = Stored.create(spark.createDataFrame(rows, ROW), ["k"], buckets=16)
    assert contents(t) == sorted(rows, key=str)
    bucket = {r.k: r.b for r in t._bucketed(spark.createDataFrame(rows, ROW)).select("k", F.col("bucket").alias("b")).collect()}

    def changed(act, keys):
        """Does the change, and holds that files of other buckets keep their names."""
        before = t.files()
        act()
        hit = {f"bucket={bucket[k]}/" for k in keys}
        untouched = lambda files: {f for f in files if not any(h in f for h in hit)}
        assert untouched(before) == untouched(t.files()) and len(untouched(before)) > 5

    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    changed(lambda: t.update(key(3, 9), {"name": F.concat("name", F.lit("!")), "v": F.col("v") + 10}), [3, 9])
    rows = [(k, n + "!", v + 10) if k in (3, 9) else (k, n, v) for k, n, v in rows]
    changed(lambda: t.delete(key(7, 12)), [7, 12])
    rows = [r for r in rows if r[0] not in (7, 12)]
    new = [(5, "one", 1), (5, "two", 2), (None, "other", 3)]
    changed(lambda: t.upsert(spark.createDataFrame(new, ROW), "v"), [5, None])
    rows = [r for r in rows if r[0] not in (5, None)] + [(5, "two", 2), (None, "other", 3)]
    t.insert_missing(spark.createDataFrame([(5, "no", 0), (12, "back", 0), (12, "twice", 0), (None, "no", 1)], ROW))
    rows.append((12, "back", 0))
    assert contents(t) == sorted(rows, key=str)
    assert sorted(map(tuple, t.lookup(key(5, 12, 9999)).collect())) == [(5, "two", 2), (12, "back", 0)]
    t.upsert(spark.createDataFrame(new, ROW), "v")  # again
    assert contents(t) == sorted(rows, key=str)


def test_a_bucket_can_become_empty(spark):
    t = Stored.create(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], ROW), ["k"], buckets=64)
    t.delete(spark.createDataFrame([(1,)], "k long"))
    assert contents(t) == [(2, "b", 2)]
    t.delete(spark.createDataFrame([(2,)], "k long"))
    assert contents(t) == []
    t.append(spark.createDataFrame([(3, "c", 3)] * 5, ROW), batch_rows=2)
    assert len(t.files()) >= 3 and len(contents(t)) == 5
    with pytest.raises(ValueError):
        t.update(spark.createDataFrame([(3,)], "k long"), {"k": F.lit(1)})
    with pytest.raises(ValueError):
        Stored.create(spark.createDataFrame([(1, 2)], "k long, Bucket int"), ["k"])


def summary():
    return Summary(("g",), {"total": F.col("x"), "odd": F.col("x") % 2}, {"most": F.col("x"), "last": F.col("d")})


def test_refresh_by_changes_equals_a_full_one(spark):
    r = random.Random(5)
    row = lambda i: (i, r.choice(["a", "b", "c", None, "z"]), r.choice([None, *range(20)]), dt.date(2024, 1, 1 + r.randrange(28)))
    base = {i: row(i) for i in range(120)}
    df = lambda rows: spark.createDataFrame(list(rows), "id long, g string, x long, d date")
    view = View.create(df(base.values()), summary())
    assert view.version() == 1
    for step in range(4):
        gone = {i: base[i] for i in r.sample(sorted(base), 30)} if step < 3 else {i: x for i, x in base.items() if x[1] == "z" or x[2] is None}
        new = {i: row(i) for i in [*list(gone)[:10], 1000 + step]} if step < 3 else {}
        base = {i: x for i, x in base.items() if i not in gone} | new
        open_before = view.read()
        seen = sorted(map(str, open_before.collect()))
        view.refresh_changes(df(new.values()), df(gone.values()), df(base.values()))
        assert sorted(map(str, open_before.collect())) == seen  # who has it open keeps the old version
        columns = ["g", ROWS, "total", "odd", "most", "last"]
        assert sorted(map(str, view.read().select(*columns).collect())) == sorted(map(str, summary().of(df(base.values())).select(*columns).collect()))
    assert view.version() == 5 and view.vacuum(2) == [1, 2, 3] and view.read().count() > 0


def test_a_failed_refresh_is_not_seen(spark):
    view = View.create(spark.createDataFrame([(1, "a", 1, None)], "id long, g string, x long, d date"), summary())
    seen = view.read().collect()
    bad = spark.createDataFrame([("a", 1)], "g string, n_rows long").withColumn("total", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        view.publish(bad)
    assert view.version() == 1 and view.read().collect() == seen
    view.refresh(spark.createDataFrame([], "id long, g string, x long, d date"))
    assert view.version() == 2 and view.read().count() == 0


def test_cache_against_a_dict(spark):
    r = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    ttl = {"qa": 300, "session": 1000}
    cache, model = Cache.create(spark, ttl, otherwise=600, buckets=4), {}
    as_of = lambda t: F.lit(str(t)).cast("timestamp")
    spaces = ["qa", "session", "other/space"]

    def live(now):
        return {k: v for k, (v, at) in model.items() if (now - at).total_seconds() < ttl.get(k[0], 600)}

    for step in range(9):
        now = start + dt.timedelta(seconds=150 * step)
        if step in (3, 6):
            keys = [(r.choice(spaces), f"k{r.randrange(6)}", now) for _ in range(4)]
            cache.delete(spark.createDataFrame(keys, "namespace string, key string, at timestamp"))
            for n, k, _ in keys:
                model.pop((n, k), None)
        elif step == 5:
            cache.clear(spark.createDataFrame([("qa", now)], "namespace string, at timestamp"))
            model = {k: v for k, v in model.items() if k[0] != "qa"}
        else:
            rows = {(r.choice(spaces), f"k{r.randrange(6)}"): f"v{step}{i}" for i in range(8)}
            cache.set(spark.createDataFrame([(n, k, v, now) for (n, k), v in rows.items()] + [("qa", None, "x", now), (None, "k", "x", now)], "namespace string, key string, value string, at timestamp"))
            model |= {k: (v, now) for k, v in rows.items()}
        if step == 7:
            cache.compact(as_of(now))
        want = live(now)
        assert {(x.namespace, x.key): x.value for x in cache.entries(as_of(now)).collect()} == want
    now = start + dt.timedelta(seconds=1200)
    got = {x.key: x.value for x in cache.get("session", ["k0", "k1", "none"], as_of(now)).collect()}
    assert got == {k: v for (n, k), v in live(now).items() if n == "session" and k in ("k0", "k1")}
    asked = spark.createDataFrame([(n, f"k{i}") for n in spaces for i in range(6)], "namespace string, key string")
    assert {(x.namespace, x.key): x.value for x in cache.get_many(asked, as_of(now)).collect()} == live(now)
    assert cache.exists("qa", "none", as_of(now)) is False
    assert {x.namespace: x.entries for x in cache.stats(as_of(now)).collect()} == {n: sum(k[0] == n for k in live(now)) for n in spaces if any(k[0] == n for k in live(now))}


def test_a_repeated_batch_writes_nothing_twice(spark, tmp_path):
    log = K.AppendLog(spark, str(tmp_path / "log"), "k long, n long")
    assert log.read().collect() == []
    rows = spark.createDataFrame([(1, 1), (2, 5)], "k long, n long")
    assert log.put(rows, 0) and not log.put(rows, 0) and not log.put(rows.limit(0), 0)
    assert log.put(rows, 1) and log.put(rows, 0, "other")
    assert {(r.k, r.n) for r in K.totals(log, "k").collect()} == {(1, 3), (2, 15)}
    for act in (log.update, log.delete, log.overwrite):
        with pytest.raises(K.AppendOnlyError):
            act(rows)
    done = K.AppendLog(spark, str(tmp_path / "done"), "i long")
    table = Stored.create(spark.createDataFrame([(1, "a", 1)], ROW), ["k"])
    put = K.merged(table, "v", done)
    put(spark.createDataFrame([(1, "b", 2)], ROW), 0)
    put(spark.createDataFrame([(1, "c", 3)], ROW), 1)
    put(spark.createDataFrame([(1, "b", 2)], ROW), 0)  # an old batch again
    assert contents(table) == [(1, "c", 3)]
    short = K.compacted(log, "k", str(tmp_path / "short"))
    assert {(r.k, r.n) for r in K.totals(short, "k").collect()} == {(1, 3), (2, 15)}


def test_flags_over_several_batches(spark):
    r = random.Random(9)
    rows = [(s, i, r.random() < 0.3) for i in range(60) for s in range(3)]
    schema = "session_id long, at int, rejected boolean"
    whole = {tuple(x) for x in stored.rejection_events(spark.createDataFrame(rows, schema), spark.createDataFrame([], "session_id long, total long, rejections long"), "session_id", ["at"]).collect()}
    parts, before = set(), {}
    for a in range(0, 60, 20):
        batch = [x for x in rows if a <= x[1] < a + 20]
        known = spark.createDataFrame([(s, n, k) for s, (n, k) in before.items()], "session_id long, total long, rejections long")
        parts |= {tuple(x) for x in stored.rejection_events(spark.createDataFrame(batch, schema), known, "session_id", ["at"]).collect()}
        for s, _, x in batch:
            n, k = before.get(s, (0, 0))
            before[s] = (n + 1, k + x)
    assert parts == whole and len(whole) > 5
    want = {(s, i) for s in range(3) for i in range(4, 60) if rows[i * 3 + s][2] and sum(x[2] for x in rows if x[0] == s and x[1] <= i) > 0.2 * (i + 1)}
    assert {x[:2] for x in whole} == want


def test_rate_limit_stream_equals_the_batch_form(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = stored.stream_rate_limit(spark, f"{DATA}/{sf}").collect()
        want = corpus.rate_limit_sliding_log(spark, f"{DATA}/{sf}").collect()
        assert sorted(map(tuple, got)) == sorted((r.user_id, r.event_id, r.allowed) for r in want) and len({r.allowed for r in got}) == 2


def test_rate_limit_state_is_read_and_written_by_chunks(monkeypatch):
    import random
    from types import SimpleNamespace as Bag

    import pandas as pd

    from tamarack.streaming import limits as R

    calls, timers, kept, value = [], set(), {}, []
    waiting = Bag(keys=lambda: list(kept), containsKey=lambda k: calls.append("has") or k in kept, getValue=lambda k: calls.append("get") or kept[k], updateValue=lambda k, v: calls.append("put") or kept.__setitem__(k, v), removeKey=lambda k: kept.pop(k))
    log = Bag(exists=lambda: bool(value), get=lambda: value[0], update=lambda v: value.__setitem__(slice(None), [v]), clear=value.clear)
    monkeypatch.setattr(R, "CHUNK", 100)
    state = R.SlidingLog(3, 500)
    state.init(Bag(getMapState=lambda *_: waiting, getValueState=lambda *_: log, registerTimer=timers.add))
    r, got, seen, mark = random.Random(4), [], [], 0

    def told(frames):
        for f in frames:
            got.extend(zip(f["s"], f["id"], f["allowed"], strict=True))

    for batch in range(6):
        at = Bag(getCurrentWatermarkInMs=lambda: mark * 1000)
        rows = [(float(r.randint(mark, mark + 2500)), batch * 1000 + i) for i in range(250)] if batch < 5 else []
        seen += rows
        told(state.handleInputRows(("a",), iter([pd.DataFrame(rows[k : k + 125], columns=["s", "id"]) for k in (0, 125)] if rows else []), at))
        for t in sorted(x for x in timers if x <= mark * 1000):
            timers.discard(t)
            told(state.handleExpiredTimer(("a",), at, Bag(getExpiryTimeInMs=lambda: t)))
        mark += 1200 if batch < 4 else 100_000
    log_, want = [], []
    for s, i in sorted(seen):
        log_ = [x for x in log_ if x > s - 500]
        want.append((s, i, len(log_) < 3))
        log_ += [s] * want[-1][2]
    assert sorted(got) == want and not kept and not value
    assert len(calls) < 200, len(calls)  # of 1,250 requests; each was read and written before


def test_state_of_the_rate_limit_expires(spark, tmp_path):
    from tamarack.streaming.limits import ROCKS, limited

    source, before = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    for i, rows in enumerate([[(k, k, day(1)) for k in range(50)], [(99, 99, day(3))], [(99, 100, day(5))], [(99, 101, day(7))]]):
        spark.createDataFrame(rows, "key long, id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        del i
    stream = spark.readStream.schema("key long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    log = K.AppendLog(spark, str(tmp_path / "out"), "key string, id long, s double, allowed boolean")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = K.run_available(limited(stream, 1, 3600), log.sink(), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 50 and rows[-1] < 10, rows  # 50 users' state is gone
    assert log.read().where("key <> '99'").count() == 50


def test_ingestion_of_new_files_only(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("Article 1 Land of the people. " * 20)
    (inbox / "b.txt").write_text("short")
    (inbox / "c.bin").write_bytes(b"\x00\x01")
    log, checkpoint = G.IngestionLog(spark, str(tmp_path / "log")), str(tmp_path / "checkpoint")

    def run():
        query = K.run_available(G.file_stream(spark, str(inbox)), log.sink(G.uploads, "inbox"), checkpoint)
        return sum(p["numInputRows"] for p in query.recentProgress)

    name = lambda path: path.rsplit("/", 1)[-1]
    assert run() == 3 and run() == 0  # a second run reads nothing
    assert {name(r.id): r.status for r in log.jobs().collect()} == {"a.txt": "indexed", "b.txt": "failed", "c.bin": "failed"}
    (inbox / "d.md").write_text("Section 2 Rights of tenants. " * 30)
    assert run() == 1
    assert [(r.files, r.indexed, r.status) for r in log.batches().orderBy("batch").collect()] == [(3, 1, "completed_with_errors"), (1, 1, "indexed")]
    chunks = log.chunks().count()
    (inbox / "b.txt").write_text("Article 3 It is longer now, and long enough to be read. " * 5)
    files = spark.read.format("binaryFile").load(str(inbox))
    assert log.retry(G.uploads(files)) == 2
    jobs = {name(r.id): (r.status, r.attempt) for r in log.jobs().collect()}
    assert jobs == {"a.txt": ("indexed", 1), "b.txt": ("indexed", 2), "c.bin": ("failed", 2), "d.md": ("indexed", 1)}
    assert log.chunks().count() > chunks and log.failed().count() == 1
    batch = G.chunk_rows(G.ingest(G.uploads(files)))
    got = sorted((name(r.source_id), r.chunk_index, r.content) for r in log.chunks().collect())
    assert got == sorted((name(r.source_id), r.chunk_index, r.content) for r in batch.collect())


@pytest.mark.parametrize("test_source", [False, True])
def test_chains_from_a_table_of_seeds(spark, test_source):
    r = random.Random(10)
    rows = [(r.randrange(12), r.choice([None, *range(12)])) for _ in range(40)] + [(1, x) for x in range(12)] + [(3, 3), (None, 2)]
    edges = spark.createDataFrame(sorted(set(rows), key=str), "source_id long, cited_id long")
    seeds = spark.createDataFrame([(1,), (3,), (3,), (None,), (77,)], "start_id long")
    columns = ["start_id", "source_id", "cited_id", "depth", "path"]
    got = precedent_chains(edges, seeds, 4, test_source, hub=3).select(*columns).collect()
    want = precedent_chain(edges, [1, 3, 77], 4, test_source).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 50
    assert precedent_chains(edges, seeds.limit(0), 3).collect() == []


def test_arguments_of_table_functions_reach_the_scan(spark):
    sql_functions.register(spark, f"{DATA}/sf0.001")
    df = spark.sql("SELECT * FROM hybrid_document_chunk_search(array('the'), (SELECT embedding FROM chunk_vectors WHERE vec_id = 7), 'en', 1, 3)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and df.count() <= 3


def test_the_shared_folder(spark, monkeypatch, tmp_path):
    from types import SimpleNamespace

    from tamarack import shared

    def session(master, warehouse, checkpoint=None):
        conf = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": warehouse}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: conf[k] if conf[k] or not d else d[0]), sparkContext=SimpleNamespace(master=master, applicationId="a"))

    assert shared.shared_dir(session("local[4]", "/w")) == "/w/tamarack_checkpoints"
    assert shared.shared_dir(session("spark://m:7077", "hdfs://n/w")) == "hdfs://n/w/tamarack_checkpoints"
    assert shared.shared_dir(session("yarn", "file:/w", "s3a://b/c")) == "s3a://b/c"
    for master in ("yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master, "file:/w"))
    monkeypatch.setattr(shared, "_made", {})
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    one, two = shared.new_path(spark, "x"), shared.new_path(spark, "y")
    for path in (one, two):
        spark.range(3).write.parquet(path)
    assert shared.clear(spark, keep=(two,)) == 1 and spark.read.parquet(two).count() == 3 and shared.clear(spark) == 1 and shared.clear(spark) == 0
