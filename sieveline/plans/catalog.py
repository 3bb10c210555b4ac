"""The registry of queries and of the SQL that checks them."""

from __future__ import annotations

from ..session import prepared
from . import audit_plans, metric_plans, resampling_plans, split_plans

MODULES = (metric_plans, audit_plans, split_plans, resampling_plans)
QUERIES = {name: prepared(f) for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "step0_run_metrics"
