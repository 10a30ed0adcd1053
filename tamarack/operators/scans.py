"""Scans, point lookups, tenant predicates and changes to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_truthy(*cols: Column | str) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in (F.col(x) if isinstance(x, str) else x for x in cols)])


def equals_if(name: str, value) -> Column:
    """column = value, or no condition if value is None (kept out of the plan, so that pushdown sees only real ones)."""
    return F.lit(True) if value is None else F.col(name) == F.lit(value)


def tenant_visible(tenant_id, column: str = "tenant_id") -> Column:
    """Rows of all tenants (NULL) and of one's own."""
    shared = F.col(column).isNull()
    return shared if tenant_id is None else shared | (F.col(column) == F.lit(tenant_id))


def select_rows(df: DataFrame, columns: list[str], where: dict | None = None, order_by: str | None = None, desc: bool = True, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Projection with equalities, order and limit."""
    out = df.where(reduce(lambda a, b: a & b, [equals_if(k, v) for k, v in (where or {}).items()], F.lit(True))).select(*columns)
    if order_by:
        keys = [F.col(order_by).desc_nulls_last() if desc else F.col(order_by).asc_nulls_last()]
        out = out.orderBy(*keys, *([F.col(tie)] if tie else []))
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, keys: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset+limit-1 in the order of keys (which must be total)."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def ilike_any(columns: list[str], term: str) -> Column:
    """Whether any of the columns contains the term, case folded."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])


def enrich(facts: DataFrame, dims: DataFrame, key: str, dim_key: str, columns: list[str]) -> DataFrame:
    """Left lookup of a dimension; Spark broadcasts it if its statistics allow."""
    return facts.join(dims.select(F.col(dim_key).alias(key), *columns), key, "left")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The union with one row a key: changes before table, newer versions first."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(version))
    return both.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_new")


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key isn't in table (ON CONFLICT DO NOTHING)."""
    return rows.join(table.select(*keys), keys, "left_anti")


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def check_domains(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with failed: the names of the rules that a row breaks (a NULL result passes, as a CHECK does)."""
    return df.withColumn("failed", F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])))
