"""Time-series tables on PySpark: scans, merges, tiers and a small SQL dialect."""

from .errors import SqlSyntaxError, TidemarkError, is_code
from .functions import interval
from .functions.retention import Tier, parse_retention
from .operators import aggregates
from .operators.aggregates import Accumulator
from .operators.scan import Scan, scan
from .plans.sql import parse as parse_sql
from .sources.definitions import StorageTier, define_collapsing, define_log, define_summing, define_upsert
from .sources.store import Store
from .sources.table import Table

__all__ = [
    "Accumulator",
    "Scan",
    "SqlSyntaxError",
    "StorageTier",
    "Store",
    "Table",
    "TidemarkError",
    "Tier",
    "aggregates",
    "define_collapsing",
    "define_log",
    "define_summing",
    "define_upsert",
    "interval",
    "is_code",
    "parse_retention",
    "parse_sql",
    "scan",
]
