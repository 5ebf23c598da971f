"""Named query plans (Spark) and their SQL oracles."""

from forumlens.plans.registry import oracle_sql, queries  # noqa: F401
