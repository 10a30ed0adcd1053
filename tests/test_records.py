"""Versions, access, cascades and memory on small rows: nulls, ties, repeated rows and empty tables."""

from pyspark.sql import functions as F

from tamarack.operators.access import POLICIES, Policy, chosen_value, of_tenant, readable
from tamarack.plans import records as R


def test_activation_leaves_groups_without_a_choice(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("b", 1, True), (None, 3, False)], "k string, v int, is_active boolean")
    out = R.activate(rows, "k", (F.col("k") == "a") & (F.col("v") == 2), F.col("v")).collect()
    assert sorted((str(r.k), r.v, r.is_active) for r in out) == [("None", 3, False), ("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 1, True)]


def test_next_versions(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 4), ("b", None)], "k string, v int")
    assert {r.k: r.next_version for r in R.next_versions(rows, "k", "v").collect()} == {"a": 5, "b": 1}
    assert R.next_versions(rows.limit(0), "k", "v").count() == 0


def test_policies_are_strict(spark):
    rows = spark.createDataFrame([(1, None, 7, False), (2, 1, 7, True), (3, 2, 7, False), (4, 1, 8, None), (5, 1, None, False)], "id int, tenant_id int, user_id int, is_privileged boolean")

    def ids(name, tenant, role, user=None):
        return sorted(r.id for r in readable(rows, POLICIES.get(name, Policy()), tenant, role, user).collect())

    for role in ("super_admin", "admin", "auditor", "lawyer", "client", None):
        assert ids("messages", 1, role) == [2, 4, 5]  # never another tenant's, never rows of no tenant
        assert ids("messages", None, role) == ids("audit_log", None, role) == []
        assert ids("documents", 1, role) == ([2, 4, 5] if role in ("super_admin", "admin", "lawyer") else [4, 5])
        assert ids("audit_log", 1, role) == ([2, 4, 5] if role in ("super_admin", "admin", "auditor") else [])
        assert ids("query_analytics", 1, role) == ([2, 4, 5] if role in ("super_admin", "admin") else [])
        assert ids("feedback", 1, role, 7) == ([2, 4, 5] if role in ("super_admin", "admin") else [2])
        assert ids("feedback", 1, role) == ([2, 4, 5] if role in ("super_admin", "admin") else [])
    user = spark.createDataFrame([(2,)], "t int")
    assert [r.id for r in rows.where(of_tenant(chosen_value(user, "t"))).collect()] == [3]
    assert rows.where(of_tenant(chosen_value(user.limit(0), "t"))).count() == 0


def test_cascade_takes_the_first_tier_with_rows(spark):
    tier = lambda *rows: spark.createDataFrame(list(rows), "id int, score double")
    none = tier((1, 1.0)).limit(0)
    got = R.cascade([none, tier((1, 1.0), (2, 2.0), (3, 2.0)), tier((9, 9.0))], "id", 2).collect()
    assert sorted((r.id, r.score, r.tier) for r in got) == [(2, 2.0, 1), (3, 2.0, 1)]
    assert R.cascade([none, none], "id", 2).count() == 0
    both = R.supplemented(tier((1, 1.0), (2, 2.0)), tier((1, 5.0), (3, 0.5)), "id", 2).collect()
    assert [(r.id, r.score) for r in both] == [(1, 5.0), (2, 2.0)]


def test_target_tables_and_vectors(spark):
    rows = spark.createDataFrame([("Judgment", [1.0, -0.5]), ("template", []), (None, None)], "t string, v array<float>")
    got = rows.select(R.target_table(F.col("t")).alias("t"), R.vector_literal(F.col("v")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("cases", "[1.00000000,-0.50000000]"), ("legal_forms", "[]"), ("laws", None)]


def test_session_memory_keeps_the_last_messages_in_order(spark):
    rows = spark.createDataFrame([(1, t, "user", f"m{t}\n x") for t in range(12)] + [(2, 0, "user", None)], "s int, t int, role string, text string")
    got = {r.s: r for r in R.session_memory(rows, "s", "t", 3).collect()}
    import hashlib

    assert got[1].n_messages == 3 and got[1].digest == hashlib.sha256(b"user: m9 x\nuser: m10 x\nuser: m11 x").hexdigest()
    assert got[2].digest == hashlib.sha256(b"user: ").hexdigest()


def test_cache_entries_expire(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:59"), ("b", "2024-01-01 00:00:59"), ("a", None)], "ns string, at string")
    rows = rows.withColumn("at", F.col("at").cast("timestamp"))
    out = R.live(rows, "ns", "at", F.lit("2024-01-01 00:01:00").cast("timestamp"), {"a": 60})
    assert [(r.ns, r["at"].second) for r in out.collect()] == [("a", 59)]


def test_vector_literals_round_stored_numbers_half_to_even(spark):
    rows = spark.createDataFrame([(1, [0.103515625, 0.107421875, 5e-9, -0.0]), (2, [1.5, None, float("nan"), float("-inf"), 1e23]), (3, []), (4, None)], "id int, v array<double>")
    assert {r.id: r.v for r in rows.select("id", R.vector_literal(F.col("v")).alias("v")).collect()} == {
        1: "[0.10351562,0.10742188,0.00000001,-0.00000000]", 2: "[1.50000000,nan,-inf,99999999999999991611392.00000000]", 3: "[]", 4: None,
    }
    floats = rows.select("id", R.vector_literal(F.col("v").cast("array<float>")).alias("v")).where("id = 1").first()
    assert floats.v.startswith("[0.10351562,0.10742188,")
