"""Operational analytics: sessions, tenants, audit, agents, security; joins and windows behind them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import aggregates as A
from ..operators.access import POLICIES, chosen_value, of_tenant, readable
from ..operators.scans import check_domains, enrich, ilike_any, page, select_rows, tenant_visible
from ..operators.windows import last_n, trailing_count, version_status
from ..tables import CHUNKS_SQL, chunks, table
from .registry import query

AS_OF = "2024-01-31 00:00:00"
#: Labels of events.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view", "export"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _as_of(hours: int):
    return F.lit(AS_OF).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
def scan_ordered(spark, sf_dir):
    """Projection, equality, order, limit."""
    return select_rows(_events(spark, sf_dir), ["event_id", "user_id", "event_type", "value"], {"event_type": "error", "user_id": None}, "value", limit=25, tie="event_id")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42 LIMIT 1")
def point_lookup(spark, sf_dir):
    """S2."""
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment").limit(1)


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def dimension_lookup(spark, sf_dir):
    """Enrichment by a dimension."""
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return enrich(facts, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%an%' OR lower(p_brand) LIKE '%an%' OR lower(p_type) LIKE '%an%'")
def ilike_multi_column(spark, sf_dir):
    """A term in any of several columns."""
    return table(spark, sf_dir, "part").where(ilike_any(["p_name", "p_brand", "p_type"], "an")).select("p_partkey", "p_name")


@query("""
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([
  CASE WHEN NOT (l_discount BETWEEN 0 AND 0.05) THEN 'discount' END, CASE WHEN NOT (l_quantity < 45) THEN 'quantity' END,
  CASE WHEN NOT (l_returnflag IN ('A', 'N')) THEN 'returnflag' END], lambda x: x IS NOT NULL), ',') AS failed FROM lineitem""")
def domain_checks(spark, sf_dir):
    """Rows with the names of the rules they break."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_returnflag")
    rules = {"discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") < 45, "returnflag": F.col("l_returnflag").isin("A", "N")}
    return check_domains(rows, rules).select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed"))


@query("""
SELECT count(DISTINCT o_orderkey) AS total_sessions, count(*) AS total_queries, round(avg(l_extendedprice), 4) AS avg_latency, round(avg(l_discount), 6) AS avg_confidence,
  round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS escalation_rate, round(avg(CASE WHEN p_size > 0 THEN (p_size - p_partkey % 2) / p_size END), 6) AS verified_rate, round(sum(o_totalprice) / 1e6, 3) AS total_cost
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN part ON p_partkey = l_partkey""")
def session_stats(spark, sf_dir):
    """Orders as sessions, returned lines as assistant messages, parts as analytics."""
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_totalprice").alias("cost"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    messages = lines.select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("message_id"), F.col("l_extendedprice").alias("latency"), F.col("l_discount").alias("confidence"), (F.col("l_linestatus") == "F").alias("escalated"))
    analytics = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("message_id"), F.col("p_size").alias("cited"), (F.col("p_size") - F.col("p_partkey") % 2).alias("verified"))
    out = A.session_stats(sessions, messages, analytics)
    places = {"avg_latency": 4, "avg_confidence": 6, "escalation_rate": 6, "verified_rate": 6}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()} | {"total_cost": F.round(F.col("total_cost") / 1e6, 3)})


@query("""
SELECT n_nationkey AS tenant_id, n_name AS name, count(DISTINCT c_custkey) AS user_count, count(DISTINCT s_suppkey) AS case_count, count(DISTINCT o_orderkey) AS session_count,
  max(o_orderdate) AS last_session, round(sum(o_totalprice) / 1e6, 2) AS total_cost
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey
LEFT JOIN (SELECT o_orderkey, o_orderdate, o_totalprice, c_nationkey AS nk FROM orders JOIN customer ON c_custkey = o_custkey) ON nk = n_nationkey GROUP BY 1, 2""")
def tenant_usage_stats(spark, sf_dir):
    """Three independent children of a tenant, aggregated before they are joined."""
    customer = table(spark, sf_dir, "customer")
    tenants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"))
    users = customer.select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("user_id"))
    cases = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tenant_id"), F.col("s_suppkey").alias("case_id"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    sessions = orders.select(F.col("c_nationkey").alias("tenant_id"), F.col("o_orderkey").alias("session_id"), F.col("o_totalprice").alias("cost"), F.col("o_orderdate").alias("created_at"))
    out = A.tenant_usage(tenants, users, cases, sessions)
    return out.withColumn("total_cost", F.round(F.col("total_cost") / 1e6, 2))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_semi(spark, sf_dir):
    """J6, P8."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def anti_conflict(spark, sf_dir):
    """Rows without a match: customers with no large order."""
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')")
def or_of_semis(spark, sf_dir):
    """Membership in either of two sets, as one semi join with their union."""
    either = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    either = either.union(_events(spark, sf_dir).where("event_type = 'error'").select("user_id"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(either, "c_custkey", "left_semi")


@query("""
WITH c AS (SELECT event_id, 'n' || (json_extract_string(props, '$.k')::INT % 30) AS ref FROM events),
m AS (SELECT event_id, ref, 1 AS pri, n_nationkey::BIGINT AS id FROM c JOIN nation ON 'n' || n_nationkey = ref
  UNION ALL SELECT event_id, ref, 2, r_regionkey::BIGINT FROM c JOIN region ON contains(lower(r_name), substr(ref, 1, 1)))
SELECT event_id, ref, pri, id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pri, id) AS rn FROM m) WHERE rn = 1""")
def theta_like_first_match(spark, sf_dir):
    """The first match of a reference, by key before by substring in a small dimension."""
    k = F.get_json_object("props", "$.k").cast("int")
    refs = _events(spark, sf_dir).select("event_id", F.concat(F.lit("n"), (k % 30).cast("string")).alias("ref"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("ref"), F.lit(1).alias("pri"), F.col("n_nationkey").cast("long").alias("id"))
    region = table(spark, sf_dir, "region")
    found = refs.join(nation, "ref").unionByName(
        refs.join(region, F.contains(F.lower("r_name"), F.substring("ref", 1, 1))).select("ref", "event_id", F.lit(2).alias("pri"), F.col("r_regionkey").cast("long").alias("id"))
    )
    return found.withColumn("rn", F.row_number().over(W.partitionBy("event_id").orderBy("pri", "id"))).where("rn = 1").select("event_id", "ref", "pri", "id")


@query("""
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS refs FROM events GROUP BY user_id)
SELECT user_id, list_bool_and(list_transform(['click', 'view'], lambda q: list_bool_or(list_transform(refs, lambda r: contains(q, r) OR contains(r, q))))) AS grounded FROM s""")
def contains_both_ways(spark, sf_dir):
    """Each required reference contains, or is contained in, one of the row's."""
    sets = _events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("refs"))
    needed = F.array(F.lit("click"), F.lit("view"))
    return sets.select("user_id", F.forall(needed, lambda q: F.exists("refs", lambda r: F.contains(q, r) | F.contains(r, q))).alias("grounded"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) || ['memory'])), ',') AS merged FROM events GROUP BY user_id")
def lateral_distinct(spark, sf_dir):
    """Distinct elements of two concatenated arrays."""
    sets = _events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return sets.select("user_id", F.array_join(F.array_sort(F.array_distinct(F.concat("t", F.array(F.lit("memory"))))), ",").alias("merged"))


@query("""
SELECT 'documents' AS kpi, (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM benchmark) AS n
UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'queue', count(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT 'models', count(DISTINCT event_type) FROM events""")
def kpi_counts(spark, sf_dir):
    """Exact counts over several tables."""
    e = _events(spark, sf_dir)
    count = lambda df, name, agg: df.agg(agg.alias("n")).select(F.lit(name).alias("kpi"), "n")
    docs = [table(spark, sf_dir, t).select(F.lit(1)) for t in ("documents", "pages", "benchmark")]
    out = count(docs[0].union(docs[1]).union(docs[2]), "documents", F.count("*")).union(count(e, "users", F.countDistinct("user_id")))
    return out.union(count(e.where("event_type = 'error'"), "queue", F.count("*"))).union(count(e, "models", F.countDistinct("event_type")))


@query("""
SELECT CASE WHEN count(DISTINCT user_id) > 0 THEN count(DISTINCT user_id) ELSE count(*) END AS sessions, round(avg(CASE WHEN value <> 0 THEN value END), 4) AS avg_latency,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS escalation_rate, round(greatest(0, 1 - count(*) FILTER (WHERE event_type = 'signup') / count(*)), 4) AS verified_rate FROM events""")
def audit_kpis(spark, sf_dir):
    """KPIs from audit rows alone."""
    users = F.countDistinct("user_id")
    return _events(spark, sf_dir).agg(
        F.when(users > 0, users).otherwise(F.count("*")).alias("sessions"), F.round(A.nonzero_avg(F.col("value")), 4).alias("avg_latency"),
        F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 4).alias("escalation_rate"),
        F.round(F.greatest(F.lit(0.0), 1 - F.count_if(F.col("event_type") == "signup") / F.count("*")), 4).alias("verified_rate"),
    )


@query("""
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS queries, count(*) FILTER (WHERE role = 'assistant') AS answers, round(avg(length(text)) FILTER (WHERE role = 'assistant'), 4) AS avg_answer,
  max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def user_dashboard(spark, sf_dir):
    """Conditional counts and averages by session."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("queries"), F.count_if(F.col("role") == "assistant").alias("answers"),
        F.round(F.avg(F.when(F.col("role") == "assistant", F.char_length("text"))), 4).alias("avg_answer"), F.max("turn").alias("last_turn"),
    )


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'N') AS verified, count(*) FILTER (WHERE l_returnflag = 'R') AS rejected, count(*) FILTER (WHERE l_returnflag = 'A') AS unverified,
  round(100.0 * count(*) FILTER (WHERE l_returnflag = 'N') / count(*), 4) AS accuracy FROM lineitem""")
def citation_stats(spark, sf_dir):
    """A9, A21."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("total"), F.count_if(flag == "N").alias("verified"), F.count_if(flag == "R").alias("rejected"), F.count_if(flag == "A").alias("unverified"),
        F.round(F.count_if(flag == "N") * 100.0 / F.count("*"), 4).alias("accuracy"),
    )


@query(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS security_events, count(DISTINCT user_id) AS unique_users, count(*) FILTER (WHERE user_id % 10 = 0) AS system_actions
FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}'""")
def audit_stats_24h(spark, sf_dir):
    """A10, P10."""
    last = _events(spark, sf_dir).where((F.col("ts") >= _as_of(24)) & (F.col("ts") <= _as_of(0)))
    return last.agg(F.count("*").alias("total"), F.count_if(F.col("event_type").isin("error", "signup")).alias("security_events"), F.countDistinct("user_id").alias("unique_users"), F.count_if(F.col("user_id") % 10 == 0).alias("system_actions"))


@query("""
WITH s AS (SELECT event_type, count(*) AS calls, round(avg(CASE WHEN value <> 0 THEN value END), 4) AS avg_latency FROM events GROUP BY 1),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value <> 0)
SELECT event_type, calls, avg_latency, value AS p95 FROM s JOIN r USING (event_type) WHERE rn = round_even((n - 1) * 0.95, 0) + 1""")
def agent_status_p95(spark, sf_dir):
    """Calls, average and nearest-rank p95 of nonzero latencies by agent; groups of any size."""
    e = _events(spark, sf_dir)
    means = e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(A.nonzero_avg(F.col("value")), 4).alias("avg_latency"))
    return means.join(A.nearest_rank_by(e, ["event_type"], "value", 0.95), "event_type").withColumnRenamed("percentile", "p95")


@query("""
SELECT ord, event_type, coalesce(n, 0) AS n FROM (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view'), (5, 'export')) d(ord, event_type)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)""")
def distribution_zero_filled(spark, sf_dir):
    """Counts over a fixed domain."""
    return A.zero_filled(_events(spark, sf_dir), "event_type", EVENT_TYPES)


@query(f"""
WITH {CHUNKS_SQL.strip()}
SELECT source_table, count(*) AS chunks, count(*) FILTER (WHERE chunk_id < 300) AS embedded, count(*) FILTER (WHERE status = 'active' AND review_status = 'approved') AS searchable,
  round(count(*) FILTER (WHERE chunk_id < 300) / count(*), 6) AS coverage FROM chunks GROUP BY ROLLUP (source_table)""")
def rag_health_rollup(spark, sf_dir):
    """A14."""
    out = A.rag_health(chunks(spark, sf_dir), "source_table", F.col("chunk_id") < 300, (F.col("status") == "active") & (F.col("review_status") == "approved"))
    return out.withColumn("coverage", F.round("coverage", 6))


@query("""
WITH v AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT greatest(0, 100 - 10 * count(*) FILTER (WHERE n > 2400) - 2 * count(*) FILTER (WHERE n <= 2400)) AS posture, count(*) FILTER (WHERE n > 2400) AS high, count(*) FILTER (WHERE n <= 2400) AS unresolved FROM v""")
def security_score(spark, sf_dir):
    """A17."""
    v = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    high, rest = F.count_if(F.col("n") > 2400), F.count_if(F.col("n") <= 2400)
    return v.agg(F.greatest(F.lit(0), 100 - 10 * high - 2 * rest).alias("posture"), high.alias("high"), rest.alias("unresolved"))


@query("""
SELECT l_orderkey AS session_id, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS rejected, count(*) >= 5 AND count(*) FILTER (WHERE l_returnflag = 'R') / count(*) > 0.2 AS flagged
FROM lineitem GROUP BY 1""")
def rejection_flag(spark, sf_dir):
    """A4, K3 in batch."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_returnflag") == "R").alias("rejected"))
    return A.rejection_flags(rows, "session_id")


@query("""
SELECT source, arg_max(lang, struct_pack(a := n_chars, b := doc_id)) AS strongest, round(least(0.95, 0.7 + 0.1 * count(*) FILTER (WHERE lang = 'en') / count(*)), 6) AS confidence,
  array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') AS first_gaps FROM documents GROUP BY source""")
def evidence_rollup(spark, sf_dir):
    """Strongest item, confidence, first five gaps."""
    docs = table(spark, sf_dir, "documents")
    # the limit goes before the shuffle: each task hands on five rows of a source at most
    first = docs.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rn <= 5")
    gaps = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    whole = docs.groupBy("source").agg(
        F.max_by("lang", F.struct("n_chars", "doc_id")).alias("strongest"),
        F.round(F.least(F.lit(0.95), F.count_if(F.col("lang") == "en") * 0.1 / F.count("*") + 0.7), 6).alias("confidence"),
    )
    return whole.join(first.groupBy("source").agg(gaps.alias("first_gaps")), "source")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def last_n_per_session(spark, sf_dir):
    """W6."""
    return last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'active' WHEN l_linenumber < max(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) THEN 'previous' ELSE 'draft' END AS status
FROM lineitem""")
def active_version_status(spark, sf_dir):
    """W8."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("on"))
    return version_status(rows, "l_orderkey", "l_linenumber", "on").drop("on")


@query("""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def trailing_window_count(spark, sf_dir):
    """Events of a user in the last hour."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") / 1_000_000
    return trailing_count(e, "user_id", seconds, 3600).drop("ts")


@query("SELECT lang, min(doc_id) FILTER (WHERE contains(text, 'token')) AS first_match, count(*) AS n FROM documents GROUP BY lang")
def first_match_rank(spark, sf_dir):
    """W5."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.min(F.when(F.contains("text", F.lit("token")), F.col("doc_id"))).alias("first_match"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def paged_audit(spark, sf_dir):
    """P11."""
    return page(_events(spark, sf_dir), [F.desc("ts"), F.col("event_id")], 40, 20).select("event_id", "user_id", "event_type")


@query("""
SELECT event_id, CASE WHEN value < 100 THEN 1 WHEN value < 200 THEN 2 WHEN value < 300 THEN 3 WHEN value < 400 THEN 4 ELSE 5 END AS priority
FROM events WHERE event_type = 'error' ORDER BY 2, ts DESC, event_id LIMIT 30""")
def priority_queue(spark, sf_dir):
    """The review queue, by priority, then newest."""
    v = F.col("value")
    level = F.when(v < 100, 1).when(v < 200, 2).when(v < 300, 3).when(v < 400, 4).otherwise(5)
    rows = _events(spark, sf_dir).where("event_type = 'error'").select("event_id", level.alias("priority"), "ts")
    return rows.orderBy("priority", F.desc("ts"), "event_id").limit(30).drop("ts")


@query("""
SELECT hour(ts) // 4 * 4 AS bucket, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
  count(*) FILTER (WHERE event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1""")
def calls_timeline(spark, sf_dir):
    """Calls by four-hour bucket and class."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("click", "error", "view"))
    return e.groupBy((F.floor(F.hour("ts") / 4) * 4).alias("bucket")).pivot("event_type", ["click", "error", "view"]).count().fillna(0)


@query("""
SELECT b::BIGINT AS bucket, coalesce(v, 0) AS latency FROM (VALUES (0), (4), (8), (12), (16), (20)) x(b)
LEFT JOIN (SELECT hour(ts) // 4 * 4 AS b, round(avg(CASE WHEN value <> 0 THEN value END), 4) AS v FROM events WHERE event_type = 'error' GROUP BY 1) USING (b)""")
def latency_buckets(spark, sf_dir):
    """Zero-filled mean latency by bucket."""
    frame = spark.range(0, 24, 4).select(F.col("id").alias("bucket"))
    e = _events(spark, sf_dir).where("event_type = 'error'").groupBy((F.floor(F.hour("ts") / 4) * 4).alias("bucket")).agg(F.round(A.nonzero_avg(F.col("value")), 4).alias("latency"))
    return frame.join(e, "bucket", "left").fillna(0.0, ["latency"])


@query(f"""
SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-28', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS d)
LEFT JOIN (SELECT ts::DATE AS d, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) USING (d)""")
def trend_7d(spark, sf_dir):
    """A zero-filled week."""
    frame = spark.sql("SELECT explode(sequence(DATE '2024-01-28', DATE '2024-02-03')) AS d")
    e = _events(spark, sf_dir).where("event_type = 'error'").groupBy(F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return frame.join(e, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {CHUNKS_SQL.strip()} SELECT chunk_id, tenant_id, review_status FROM chunks WHERE tenant_id = (SELECT max(user_id % 3) FROM events WHERE user_id = 7)")
def tenant_secure_scan(spark, sf_dir):
    """Only rows of the tenant that the current user belongs to (a scalar subquery)."""
    user = _events(spark, sf_dir).where("user_id = 7").select((F.col("user_id") % 3).alias("tenant_id"))
    return chunks(spark, sf_dir).where(of_tenant(chosen_value(user, "tenant_id"))).select("chunk_id", "tenant_id", "review_status")


@query(f"WITH {CHUNKS_SQL.strip()} SELECT chunk_id, tenant_id, review_status FROM chunks WHERE tenant_id IS NULL OR tenant_id = 1")
def tenant_visible_search(spark, sf_dir):
    """A search also finds the rows of no tenant."""
    return chunks(spark, sf_dir).where(tenant_visible(1)).select("chunk_id", "tenant_id", "review_status")


@query(f"WITH {CHUNKS_SQL.strip()} SELECT chunk_id, tenant_id FROM chunks WHERE tenant_id = 2 AND NOT coalesce(status = 'superseded', false)")
def privileged_docs(spark, sf_dir):
    """Privileged rows stay hidden from clients."""
    rows = chunks(spark, sf_dir).withColumn("is_privileged", F.col("status") == "superseded")
    return readable(rows, POLICIES["documents"], 2, "client").select("chunk_id", "tenant_id")
