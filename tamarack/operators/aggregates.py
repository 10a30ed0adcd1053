"""Aggregates: session and tenant statistics, KPIs, distributions, percentiles, rejection flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nonzero_avg(x: Column) -> Column:
    """Average of the values that are neither NULL nor zero."""
    return F.avg(F.when(x != 0, x))


#: Accuracy of the sketch that brackets a percentile: its rank is off by one part in so many at most.
_ACCURACY = 10_000


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """Nearest-rank percentile of the nonzero values by group: the one at index bround((n - 1) * p) of the sorted ones.

    A sketch (combined before the shuffle) brackets it; values below the bracket are only counted, and those inside it,
    a few in a thousand, are counted by value and ranked. So a group of any size is spread over all tasks.
    """
    some = df.where(F.col(value) != 0).select(*keys, F.col(value).alias("_v"))
    slack = 3 / _ACCURACY
    quantiles = F.percentile_approx("_v", [max(0.0, p - slack), min(1.0, p + slack)], _ACCURACY)
    bracket = some.groupBy(*keys).agg(F.count("*").alias("_n"), quantiles.alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    low = F.col("_min") if p <= slack else F.col("_q")[0]
    high = F.col("_max") if p >= 1 - slack else F.col("_q")[1]
    bracket = bracket.select(*keys, low.alias("_low"), high.alias("_high"), (F.bround((F.col("_n") - 1) * F.lit(p)) + 1).alias("_rank"))
    placed = some.join(bracket, keys).where("_v <= _high").withColumn("_in", F.when(F.col("_v") >= F.col("_low"), F.col("_v")))
    counts = placed.groupBy(*keys, "_in").agg(F.count("*").alias("_c"), F.first("_rank").alias("_rank"))
    ranked = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys).orderBy(F.col("_in").asc_nulls_first())))
    return ranked.where("_upto >= _rank and _in is not null").groupBy(*keys).agg(F.min("_in").alias("percentile"))


def session_stats(sessions: DataFrame, messages: DataFrame, analytics: DataFrame, dedup_cost: bool = False) -> DataFrame:
    """One row: sessions(session_id, cost) by messages(session_id, message_id, latency, confidence, escalated) by
    analytics(message_id, cited, verified).

    The cost is summed over the join, so a session counts once for each of its messages; dedup_cost counts it once.
    """
    joined = sessions.join(messages, "session_id").join(analytics, "message_id", "left")
    cost = F.sum("cost")
    out = joined.agg(
        F.countDistinct("session_id").alias("total_sessions"),
        F.count("message_id").alias("total_queries"),
        F.avg("latency").alias("avg_latency"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg(F.when(F.col("escalated"), 1.0).otherwise(0.0)).alias("escalation_rate"),
        F.avg(F.when(F.col("cited") > 0, F.col("verified") / F.col("cited"))).alias("verified_rate"),
        cost.alias("total_cost"),
    )
    if not dedup_cost:
        return out
    once = sessions.join(messages.select("session_id").distinct(), "session_id", "left_semi").agg(F.sum("cost").alias("total_cost"))
    return out.drop("total_cost").crossJoin(once)  # one row by one row


def tenant_usage(tenants: DataFrame, users: DataFrame, cases: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each tenant: numbers of users, cases and sessions, cost and last session. All by tenant_id.

    The reference query joins the three children and so repeats each session for every pair of user and case; here the
    children are aggregated first and the sum is multiplied, which gives the same without the blow-up.
    """
    u = users.groupBy("tenant_id").agg(F.countDistinct("user_id").alias("user_count"))
    c = cases.groupBy("tenant_id").agg(F.countDistinct("case_id").alias("case_count"))
    s = sessions.groupBy("tenant_id").agg(F.countDistinct("session_id").alias("session_count"), F.sum("cost").alias("_cost"), F.max("created_at").alias("last_session"))
    out = tenants.join(u, "tenant_id", "left").join(c, "tenant_id", "left").join(s, "tenant_id", "left")
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("user_count", "case_count", "session_count")}
    repeated = F.col("_cost") * F.greatest("user_count", F.lit(1)) * F.greatest("case_count", F.lit(1))
    return out.withColumns(zero).withColumn("total_cost", repeated).drop("_cost")


def rejection_flags(citations: DataFrame, key: str, at_least: int = 5, above: float = 0.2) -> DataFrame:
    """Per key: total and rejected citations, and whether they are to be flagged."""
    out = citations.groupBy(key).agg(F.count("*").alias("total"), F.count_if("rejected").alias("rejected"))
    return out.withColumn("flagged", (F.col("total") >= at_least) & (F.col("rejected") / F.col("total") > above))


def zero_filled(df: DataFrame, label: str, domain: list[str]) -> DataFrame:
    """Counts for a fixed domain of labels, zero where there are none."""
    frame = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(domain)], f"ord int, {label} string")
    return frame.join(df.groupBy(label).agg(F.count("*").alias("n")), label, "left").select("ord", label, F.coalesce("n", F.lit(0)).alias("n"))


def rag_health(chunks: DataFrame, source: str, embedded: Column, searchable: Column) -> DataFrame:
    """Chunks, embedded and searchable ones by source and (NULL) in all, with coverage, in one pass."""
    out = chunks.rollup(source).agg(F.count("*").alias("chunks"), F.count_if(embedded).alias("embedded"), F.count_if(searchable).alias("searchable"))
    return out.withColumn("coverage", F.col("embedded") / F.col("chunks"))
