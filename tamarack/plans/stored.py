"""Queries over tables that change: stored updates, refreshed views, caches, and streams with sinks that replays can't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import new_path
from ..sources.cache import Cache
from ..sources.stored import Stored
from ..sources.views import ROWS, Summary, View
from ..streaming.ingestion import IngestionLog
from ..streaming.limits import ROCKS, limited
from ..streaming.sinks import AppendLog, counters, keyed_totals, run_available, totals
from ..tables import table
from .ingestion import example_items
from .registry import ORACLE, query


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'hidden' ELSE c_name END AS c_name, c_acctbal, 1 AS v FROM customer WHERE c_custkey % 10 <> 0),
u AS (SELECT c_custkey + 1000 AS c_custkey, 'new' AS c_name, 0.0 AS c_acctbal, c_custkey % 3 AS v FROM customer WHERE c_custkey % 2 = 0),
k AS (SELECT * FROM u UNION ALL SELECT * FROM c ANTI JOIN u USING (c_custkey)),
i AS (SELECT DISTINCT c_custkey * 3 AS c_custkey, 'seed' AS c_name, 1.0 AS c_acctbal, 0 AS v FROM customer)
SELECT * FROM k UNION ALL SELECT * FROM i ANTI JOIN k USING (c_custkey)""")
def stored_changes(spark, sf_dir):
    """A stored table after an update, a delete, an upsert and an insert of what is missing; each rewrites only the
    buckets of its keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    stored = Stored.create(c.withColumn("v", F.lit(1).cast("long")), ["c_custkey"])
    stored.update(c.where("c_acctbal < 0"), {"c_name": F.lit("hidden")})
    stored.delete(c.where("c_custkey % 10 = 0"))
    stored.upsert(c.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 1000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"), (F.col("c_custkey") % 3).alias("v")), "v")
    stored.insert_missing(c.select((F.col("c_custkey") * 3).alias("c_custkey"), F.lit("seed").alias("c_name"), F.lit(1.0).alias("c_acctbal"), F.lit(0).cast("long").alias("v")))
    return stored.read()


def customer_orders() -> Summary:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return Summary(("o_custkey",), {"cents": cents, "open_orders": (F.col("o_orderstatus") == "O").cast("long")}, {"newest": F.col("o_orderdate")})


@query("""
SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, count(*) AS n_rows, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders, max(o_orderdate) AS newest FROM orders GROUP BY 1""")
def refreshed_view(spark, sf_dir):
    """A materialised summary, refreshed from the rows that an update removed and added."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    view = View.create(orders, customer_orders())
    moved = orders.where("o_orderkey % 7 = 0")
    added = moved.withColumn("o_custkey", F.col("o_custkey") + 1)
    view.refresh_changes(added, moved, orders.where("o_orderkey % 7 <> 0").unionByName(added))
    return view.read().select("o_custkey", ROWS, "cents", "open_orders", "newest")


_TTL = {"click": 432_000, "view": 86_400, "error": 864_000, "purchase": 1_728_000}


@query("""
WITH o AS (SELECT event_type AS ns, user_id::VARCHAR AS key, event_id::VARCHAR AS value, ts AS w, 1 AS b FROM events
  UNION ALL SELECT DISTINCT 'click', user_id::VARCHAR, NULL, TIMESTAMP '2024-01-26', 2 FROM events WHERE user_id % 5 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY w DESC, b DESC, value DESC) AS rn FROM o WHERE w <= TIMESTAMP '2024-01-29')
SELECT ns AS namespace, key, value FROM l WHERE rn = 1 AND value IS NOT NULL AND NOT (ns = 'error' AND w <= TIMESTAMP '2024-01-25')
  AND epoch_us(TIMESTAMP '2024-01-29') - epoch_us(w) < 1000000::BIGINT * CASE ns WHEN 'click' THEN 432000 WHEN 'view' THEN 86400 WHEN 'error' THEN 864000 WHEN 'purchase' THEN 1728000 ELSE 2592000 END""")
def cache_entries(spark, sf_dir):
    """Sets, deletes and a clear by namespace, compacted on the way; what lives in the end."""
    e = table(spark, sf_dir, "events")
    cache = Cache.create(spark, _TTL, otherwise=2_592_000)
    at = lambda text: F.lit(text).cast("timestamp")
    cache.set(e.select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("at")))
    cache.compact(at("2024-01-15"))
    cache.delete(e.where("user_id % 5 = 0").select(F.lit("click").alias("namespace"), F.col("user_id").cast("string").alias("key"), at("2024-01-26").alias("at")).distinct())
    cache.clear(spark.range(1).select(F.lit("error").alias("namespace"), at("2024-01-25").alias("at")))
    return cache.entries(at("2024-01-29")).select("namespace", "key", "value")


def _stream(spark, sf_dir, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_audit_log(spark, sf_dir):
    """K4: an append-only log; a stream that starts over from nothing writes its batches no second time."""
    log = AppendLog(spark, new_path(spark, "audit"), "event_id long, user_id long, event_type string")
    for _ in range(2):
        run_available(_stream(spark, sf_dir, "events"), log.sink(), new_path(spark, "stream"))
    return log.read().select("event_id", "user_id", "event_type")


@query(ORACLE["stream_session_rollup"])
def stream_session_totals(spark, sf_dir):
    """Counters as increments of batches: a batch writes the keys that it holds, once."""
    sums = {"message_count": F.lit(1), "n_chars": F.char_length("text"), "assistant_turns": (F.col("role") == "assistant").cast("int")}
    log = AppendLog(spark, new_path(spark, "totals"), "conv_id long, message_count long, n_chars long, assistant_turns long")
    run_available(_stream(spark, sf_dir, "conversations"), keyed_totals(log, counters("conv_id", sums)), new_path(spark, "stream"))
    return totals(log, "conv_id").select("conv_id", "message_count", "n_chars", "assistant_turns")


def rejection_events(batch: DataFrame, before: DataFrame, session: str, order: list[str], least: int = 5, share: float = 0.2) -> DataFrame:
    """The rejected citations of a batch (session, order, rejected) that fire the flag: those at which the session has at
    least `least` citations and more than `share` of them rejected, itself included; before: (session, total, rejections)
    of earlier batches."""
    so_far = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    told = batch.join(before, session, "left").withColumns({
        "total_now": F.coalesce("total", F.lit(0)) + F.count("*").over(so_far),
        "rejected_now": F.coalesce("rejections", F.lit(0)) + F.sum(F.col("rejected").cast("long")).over(so_far),
    })
    return told.where(F.col("rejected") & (F.col("total_now") >= least) & (F.col("rejected_now") > F.col("total_now") * share)).select(session, *order, "total_now", "rejected_now")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS r, count(*) OVER w AS total_now, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS rejected_now
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey AS session_id, l_linenumber, total_now, rejected_now::BIGINT AS rejected_now FROM l WHERE r AND total_now >= 5 AND rejected_now > total_now * 0.2""")
def stream_flag_events(spark, sf_dir):
    """K3: the flag fires on every rejection that finds the session over the limit, as a trigger does; replays fire none
    again. A batch knows the totals of the batches before it only."""
    base = new_path(spark, "flags")
    counts = AppendLog(spark, f"{base}/counts", "session_id long, total long, rejections long")
    flags = AppendLog(spark, f"{base}/flags", "session_id long, l_linenumber int, total_now long, rejected_now long")

    def put(batch: DataFrame, i: int) -> None:
        rows = batch.select(F.col("l_orderkey").alias("session_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("rejected"))
        before = counts.read().where(F.col("batch") < i).groupBy("session_id").agg(F.sum("total").alias("total"), F.sum("rejections").alias("rejections"))
        flags.put(rejection_events(rows, before, "session_id", ["l_linenumber", "l_partkey", "l_suppkey"]).select("session_id", "l_linenumber", "total_now", "rejected_now"), i)
        counts.put(rows.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if("rejected").alias("rejections")), i)

    run_available(_stream(spark, sf_dir, "lineitem"), put, new_path(spark, "stream"))
    return flags.read().select("session_id", "l_linenumber", "total_now", "rejected_now")


@query(None)
def stream_rate_limit(spark, sf_dir):
    """The sliding log as a stream with timers: at most 2 requests a user in any 6 hours; state expires."""
    requests = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    end, log = new_path(spark, "end"), AppendLog(spark, new_path(spark, "decided"), "key string, id long, s double, allowed boolean")
    # the watermark follows what is seen: a request after all others lets those be decided
    last = table(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("ts")).where("ts is not null")
    last.select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("id"), "ts").write.parquet(end)
    closing = spark.readStream.schema(requests.schema).parquet(end)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        run_available(limited(requests.union(closing), 2, 6 * 3600), log.sink(), new_path(spark, "stream"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return log.read().where("id >= 0").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "allowed")


@query(None)
def stream_ingestion(spark, sf_dir):
    """Documents as they arrive, a job row each; a second run finds nothing new."""
    log = IngestionLog(spark, new_path(spark, "ingestion"))
    stream = _stream(spark, sf_dir, "documents")
    checkpoint = new_path(spark, "stream")
    for _ in range(2):
        run_available(stream, log.sink(lambda rows: example_items(spark, sf_dir, rows), "documents"), checkpoint)
    return log.jobs().select("id", "status", "n_chunks", "attempt")
