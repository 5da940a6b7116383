"""Queries about time: decay and validity of facts, and metrics, sessions and states of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.sources.tables import table
from tessera.streaming import events as stream
from tessera.streaming import jobs

REFERENCE = "2001-08-05 12:00:00"
#: Cost of a thousand tokens by operation.
RATES = {"view": 0.0001, "click": 0.002, "purchase": 0.0005}
KINDS = ("exponential", "linear", "step", "logarithmic")


def _facts(spark, sf):
    at = F.to_timestamp_ntz(F.lit(REFERENCE))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") / 1000000, 8).alias("confidence"))
    return o.withColumn("days", temporal.days(F.col("o_orderdate"), at)).withColumn("reference", at)


def temporal_decay(spark: SparkSession, sf: str) -> DataFrame:
    rows = _facts(spark, sf)
    return rows.select("o_orderkey", "days", *(F.round(temporal.decayed(F.col("confidence"), F.col("days"), k), 9).alias(k) for k in KINDS))


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("o_orderkey", F.round(temporal.freshness(F.col("days")), 6).alias("boost"))


def validity(spark: SparkSession, sf: str) -> DataFrame:
    """Facts hold for five years."""
    until = F.col("o_orderdate") + F.expr("INTERVAL 5 YEARS")
    return _facts(spark, sf).select("o_orderkey", F.round(temporal.valid_confidence(F.col("confidence"), until, F.col("reference")), 9).alias("confidence"))


def temporal_rank(spark: SparkSession, sf: str) -> DataFrame:
    """0.7 base + 0.3 decayed and freshened confidence."""
    t = temporal.decayed(F.col("confidence"), F.col("days"), "exponential") * temporal.freshness(F.col("days"))
    rows = _facts(spark, sf).withColumn("final", F.round(F.col("confidence") * 0.7 + t * 0.3, 9))
    return rows.orderBy(F.desc("final"), "o_orderkey").limit(100).select("o_orderkey", "final")


def _events(spark, sf):
    return stream.timed(table(spark, sf, "events"))


def window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return stream.percentiles(_events(spark, sf), "1 day")


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stream.windowed(_events(spark, sf)).select(F.unix_seconds("start").alias("start"), "n", "mean", "errors")


def last_hundred(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each user's last hundred values at each event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 9).alias("mean"))


def slow_traces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value > 300 or event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(50).select("event_id", "value", (F.col("event_type") == "error").alias("failed"))


def trace_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Steps and time between the first and last step of each user's day."""
    e = table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("day"))
    return e.agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("value"), 4).alias("total"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"))


def costs(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.create_map(*(F.lit(x) for pair in RATES.items() for x in pair))
    e = table(spark, sf, "events").where(F.col("event_type").isin(*RATES))
    rows = e.groupBy("event_type").agg(F.sum(F.floor("value")).alias("tokens"))
    return rows.select("event_type", "tokens", F.round(F.col("tokens") / 1000 * F.element_at(rate, F.col("event_type")), 6).alias("cost"))


def job_states(spark: SparkSession, sf: str) -> DataFrame:
    return stream.latest_state(table(spark, sf, "events")).select("user_id", "state", "changes")


def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = stream.sessions(_events(spark, sf))
    return rows.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("upto").alias("upto"), "n")


def job_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Each job's runs that have ended as a day went by without a change."""
    rows = jobs.expired(_events(spark, sf))
    return rows.select("job", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "state", "changes")


def active_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs heard of within the last day of events whose state is one of work."""
    return jobs.active(_events(spark, sf)).select("job", "state", F.unix_micros("last").alias("last"))


QUERIES = {f.__name__: f for f in (job_expiry, active_jobs, temporal_decay, freshness, validity, temporal_rank, window_metrics, window_counts, last_hundred, slow_traces, trace_durations, costs, job_states, session_windows)}

_F = f"WITH f AS (SELECT o_orderkey, o_orderdate, round(o_totalprice / 1000000, 8) AS c, CAST(floor((epoch(TIMESTAMP '{REFERENCE}') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days FROM orders)"
_FACTOR = {"exponential": "0.5 ** (days / 180)", "linear": "greatest(0, 1 - days / 360)", "step": "CASE WHEN days <= 180 THEN 1.0 WHEN days <= 360 THEN 0.5 ELSE 0.25 END", "logarithmic": "greatest(0, 1 - ln(1 + days) / ln(361))"}
_DECAY = {k: f"CASE WHEN days <= 0 THEN c ELSE greatest(0.1, c * ({v})) END" for k, v in _FACTOR.items()}
_FRESH = "CASE WHEN days <= 7 THEN 1 + 0.2 * (1 - days / 7) ELSE 1.0 END"
_DAY = "epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT"

ORACLE_SQL = {
    "temporal_decay": f"{_F} SELECT o_orderkey, days, " + ", ".join(f"round(CAST({v} AS DOUBLE), 9) AS {k}" for k, v in _DECAY.items()) + " FROM f",
    "freshness": f"{_F} SELECT o_orderkey, round(CAST({_FRESH} AS DOUBLE), 6) AS boost FROM f",
    "validity": f"{_F} SELECT o_orderkey, round(CAST(CASE WHEN TIMESTAMP '{REFERENCE}' > o_orderdate + INTERVAL 5 YEARS THEN 0.1 ELSE c END AS DOUBLE), 9) AS confidence FROM f",
    "temporal_rank": f"{_F} SELECT o_orderkey, round(c * 0.7 + ({_DECAY['exponential']}) * ({_FRESH}) * 0.3, 9) AS final FROM f ORDER BY final DESC, o_orderkey LIMIT 100",
    "window_metrics": f"SELECT {_DAY} AS start, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (50, 95, 99)) + ", round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate FROM events GROUP BY 1",
    "window_counts": "SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS start, count(*) AS n, round(avg(value), 9) AS mean, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "last_hundred": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean FROM events",
    "slow_traces": "SELECT event_id, value, event_type = 'error' AS failed FROM events WHERE value > 300 OR event_type = 'error' ORDER BY value DESC, event_id LIMIT 50",
    "trace_durations": "SELECT user_id, day(ts) AS day, count(*) AS steps, round(sum(value), 4) AS total, datediff('microsecond', min(ts), max(ts)) // 1000000 AS seconds FROM events GROUP BY ALL",
    "costs": "SELECT event_type, CAST(sum(floor(value)) AS BIGINT) AS tokens, round(CAST(sum(floor(value)) AS DOUBLE) / 1000 * CASE event_type WHEN 'view' THEN 0.0001::DOUBLE WHEN 'click' THEN 0.002 ELSE 0.0005 END, 6) AS cost FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY event_type",
    "job_states": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS changes FROM events GROUP BY user_id",
    "job_expiry": f"""WITH e AS (SELECT user_id AS job, epoch_us(ts) AS moment, event_id, event_type, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {jobs.TTL * 1000000}, true) AS new FROM events),
      r AS (SELECT *, sum(CAST(new AS BIGINT)) OVER (PARTITION BY job ORDER BY moment, event_id) AS run FROM e), g AS (SELECT job, run, min(moment) AS start, max(moment) AS last, arg_max(event_type, (moment, event_id)) AS state, count(*) AS changes FROM r GROUP BY ALL),
      f AS (SELECT *, lead(start) OVER (PARTITION BY job ORDER BY run) AS following FROM g) SELECT job, start, last, state, changes FROM f WHERE following IS NOT NULL OR last + {jobs.TTL * 1000000} <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""",
    "active_jobs": f"SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS state, epoch_us(max(ts)) AS last FROM events GROUP BY user_id HAVING (SELECT max(epoch_us(ts)) FROM events) - epoch_us(max(ts)) <= {jobs.TTL * 1000000} AND arg_max(event_type, (ts, event_id)) IN ('view', 'signup', 'click')",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
      SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTES) AS upto, count(*) AS n FROM s GROUP BY user_id, s""",
}
