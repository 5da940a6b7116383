"""Jobs with a time to live: state by key with timers in a stream, and the same in one batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.streaming.events import WATERMARK

#: Seconds after its last change when a job is forgotten.
TTL = 86_400
OUT = "job long, start timestamp, last timestamp, state string, changes long"


class _Jobs(StatefulProcessor):
    """A job's run: when it began, its last change, and a timer that ends it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, last long, number long, state string, changes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["at", "event_id"])
        own = self.run.get() if self.run.exists() else None
        ended = []
        for at, number, state in zip(seen["at"].astype("datetime64[us]").astype("int64"), seen["event_id"], seen["event_type"], strict=True):
            at, number = int(at), int(number)
            if own and at - own[1] > self.ttl * 1_000_000:  # its timer is due but has not gone off yet
                ended.append(own)
                own = None
            if own is None:
                own = (at, at, number, state, 1)
            else:  # an event from before the last one counts, but changes nothing
                last = (at, number, state) if (at, number) >= (own[1], own[2]) else (own[1], own[2], own[3])
                own = (min(own[0], at), *last, own[4] + 1)
        self.run.update(own)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(own[1] // 1000 + self.ttl * 1000)
        yield _told(key[0], ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self.run.get() if self.run.exists() else None
        self.run.clear()
        yield _told(key[0], [own] if own else [])

    def close(self) -> None:
        pass


def _told(job: int, runs: list[tuple]) -> pd.DataFrame:
    stamp = lambda i: pd.to_datetime(pd.Series([r[i] for r in runs], dtype="int64"), unit="us")
    return pd.DataFrame({"job": pd.Series([job] * len(runs), dtype="int64"), "start": stamp(0), "last": stamp(1), "state": pd.Series([r[3] for r in runs], dtype=object), "changes": pd.Series([r[4] for r in runs], dtype="int64")})


def expired_stream(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """job, start, last, state, changes of each run of a job (user_id) of a stream of events, once `ttl` seconds have passed without a change.

    Needs the RocksDB state store, in UTC. A run is put out when the watermark passes its end, or when an event beyond its end comes; events later than
    the watermark are dropped, other late ones count. A job that is heard of again begins a new run.
    """
    rows = events.withWatermark("at", WATERMARK).select(F.col("user_id").alias("job"), "at", "event_id", "event_type").groupBy("job")
    return rows.transformWithStateInPandas(_Jobs(ttl), OUT, "Append", "EventTime")


def expired(events: DataFrame, ttl: int = TTL, upto=None) -> DataFrame:
    """The same of all events at once: the runs that have ended by `upto` (a timestamp column; none: the last event less the watermark's delay)."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    new = F.coalesce(F.unix_micros("at") - F.lag(F.unix_micros("at")).over(w) > ttl * 1_000_000, F.lit(True))
    rows = events.withColumn("run", F.sum(new.cast("long")).over(w))
    runs = rows.groupBy(F.col("user_id").alias("job"), "run").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.max_by("event_type", F.struct("at", "event_id")).alias("state"), F.count(F.lit(1)).alias("changes"))
    following = F.lead("start").over(Window.partitionBy("job").orderBy("run"))
    end = F.timestamp_micros(F.unix_micros("last") + ttl * 1_000_000)
    now = upto if upto is not None else F.col("now")
    if upto is None:
        delay = int(WATERMARK.split()[0]) * 60_000_000
        runs = runs.join(F.broadcast(events.agg(F.timestamp_micros(F.max(F.unix_micros("at")) - delay).alias("now"))))  # one row
    return runs.withColumn("following", following).where((end <= now) | F.col("following").isNotNull()).select("job", "start", "last", "state", "changes")


def active(events: DataFrame, ttl: int = TTL, states: tuple[str, ...] = ("view", "signup", "click")) -> DataFrame:
    """job, state, last of the jobs whose last change is no older than `ttl` before the last event of all, and leaves them in one of the states of work."""
    last = events.groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("at", "event_id")).alias("state"), F.max("at").alias("last"))
    now = events.agg(F.max("at").alias("now"))  # one row
    return last.join(F.broadcast(now)).where((F.unix_micros("now") - F.unix_micros("last") <= ttl * 1_000_000) & F.col("state").isin(*states)).select("job", "state", "last")
