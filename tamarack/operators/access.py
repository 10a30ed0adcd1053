"""Row policies of tables: a tenant's own rows, by role.

Every policy asks for the reader's own tenant, whatever the role; rows of no tenant are visible in searches only
(scans.tenant_visible), never here. A policy may also ask for a role, for one's own rows, or hide privileged rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMINS = ("admin", "super_admin")


@dataclass(frozen=True)
class Policy:
    """Who reads a table: only `roles` (None: all) or, with an owner column, whose row it is; `privileged` rows only
    `counsel`."""

    roles: tuple[str, ...] | None = None
    owner: str | None = None
    privileged: str | None = None
    counsel: tuple[str, ...] = (*ADMINS, "lawyer")


# The policies by table; tables that aren't named are open to all roles of the tenant.
POLICIES = {
    "documents": Policy(privileged="is_privileged"),
    "audit_log": Policy((*ADMINS, "auditor")),
    "expert_reviews": Policy((*ADMINS, "expert_reviewer", "lawyer")),
    "feedback": Policy(ADMINS, owner="user_id"),
    "query_analytics": Policy(ADMINS),
}


def of_tenant(tenant_id, column: str = "tenant_id") -> Column:
    """Rows of just that tenant; a reader without a tenant sees none. tenant_id may be a column (a scalar subquery)."""
    value = tenant_id if isinstance(tenant_id, Column) else F.lit(tenant_id)
    return F.coalesce(F.col(column) == value, F.lit(False))


def may_read(policy: Policy, tenant_id, role: str | None, user_id=None) -> Column:
    """Whether a reader of that tenant, role and id sees a row."""
    out = of_tenant(tenant_id)
    if policy.roles is not None and role not in policy.roles:
        out = out & (F.coalesce(F.col(policy.owner) == F.lit(user_id), F.lit(False)) if policy.owner and user_id is not None else F.lit(False))
    if policy.privileged and role not in policy.counsel:
        out = out & ~F.coalesce(F.col(policy.privileged), F.lit(False))
    return out


def readable(df: DataFrame, policy: Policy, tenant_id, role: str | None, user_id=None) -> DataFrame:
    """The rows of df that a reader sees."""
    return df.where(may_read(policy, tenant_id, role, user_id))


def chosen_value(rows: DataFrame, column: str) -> Column:
    """The one value of a column of a one-row table (the current tenant, say) as a scalar subquery; NULL for no row."""
    return rows.agg(F.max(column)).scalar()
