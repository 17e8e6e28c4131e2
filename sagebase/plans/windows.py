"""Queries over time windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebase.plans.views import frame
from sagebase.streaming import windows as W


def rate_limit_bucket(spark, sf):
    return W.calendar_rate(frame(spark, sf, "events"), 3600)


def rate_limit_first_open(spark, sf):
    return W.folded(frame(spark, sf, "events"), ["user_id"], W.RATE, "allowed")


def dedup_window(spark, sf):
    rows = frame(spark, sf, "events").withColumn("digest", F.sha2(F.col("event_type").cast("binary"), 256))
    return W.folded(rows, ["user_id", "digest"], W.DUPLICATE, "duplicate").drop("digest")


def login_lock(spark, sf):
    rows = frame(spark, sf, "events").where("event_type in ('error', 'signup')").withColumn("failed", F.col("event_type") == "error")
    return W.folded(rows, ["user_id"], W.LOCK, "refused", "failed")


def event_sessions(spark, sf):
    return W.sessions(frame(spark, sf, "events"), 86400)


QUERIES = {f.__name__: f for f in (rate_limit_bucket, rate_limit_first_open, dedup_window, login_lock, event_sessions)}

ORACLE_SQL = {
    "rate_limit_bucket": "select user_id, time_bucket(interval '3600 seconds', ts) as start, count(*) as n from events group by all",
    "event_sessions": """with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '86400 seconds' then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
      s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) as "end", count(*) as n from s group by user_id, k""",
}
