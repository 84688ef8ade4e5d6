"""Audit log queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F


def audit_filter(log: DataFrame, username=None, action=None, since=None, until=None) -> DataFrame:
    """Rows by user, action and time. A date as ``until`` includes that day, a moment does not."""
    if username:
        log = log.where(F.col("username") == username)
    if action:
        log = log.where(F.col("action") == action)
    if since is not None:
        log = log.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        if isinstance(until, dt.date) and not isinstance(until, dt.datetime):
            until = until + dt.timedelta(days=1)
        log = log.where(F.col("created_at") < F.lit(until).cast("timestamp"))
    return log


def audit_page(log: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """One page, newest first, at most 500 rows."""
    rows = audit_filter(log, **filters).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.offset(max(0, offset)).limit(max(1, min(limit, 500)))


def audit_count(log: DataFrame, **filters) -> DataFrame:
    return audit_filter(log, **filters).agg(F.count("*").alias("c"))
