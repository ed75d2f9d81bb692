"""Missed occurrences of a stream of log lines, judged as the watermark passes them.

An occurrence is judged once the watermark is past it by the tolerance, which is when a batch scan
judges it too. Lines later than the watermark's delay are late data and dropped. The state of a job is
the time up to which it was judged and the runs an occurrence to come may still claim.
"""
from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import expressions, schedule
from ..functions.text import one_space
from ..sources import logs

_FIELDS = expressions.FIELDS
_EPOCH = datetime(1970, 1, 1)


def _due(plan, after: int, until: int) -> list[int]:
    """Occurrences of a plan, in microseconds, later than after and not later than until."""
    lo, hi = (_EPOCH + timedelta(microseconds=us) for us in (after + 1, until))
    return [(t - _EPOCH) // timedelta(microseconds=1) for t in expressions.times(plan, lo, hi)]


def missed(lines: DataFrame, jobs: DataFrame, tolerance_s: int = 120, delay: str = "10 minutes") -> DataFrame:
    """Stream of (job_id, ts), from a stream of lines (source, lineno, value) with full stamps and jobs (job_id, user, command, schedule.SCHEMA).

    A job is watched from its first run on.
    """
    tol = tolerance_s * 1_000_000
    runs = logs.cron_commands(logs.parse(lines, None)).select("user", one_space(F.col("command")).alias("command"), F.col("ts").cast("timestamp").alias("start"))
    runs = runs.withWatermark("start", delay).join(F.broadcast(jobs), ["user", "command"]).withColumn("us", F.unix_micros("start"))

    def judge(key, frames, state: GroupState):
        judged, pending, plan = state.get if state.exists else (None, [], None)
        for f in frames:
            if not len(f):
                continue
            plan = plan or {k: (None if f[k].iloc[0] is None else f[k].iloc[0].tolist() if hasattr(f[k].iloc[0], "tolist") else f[k].iloc[0]) for k in _FIELDS}
            pending = sorted([*pending, *map(int, f["us"])])
        if judged is None:
            judged = pending[0] - tol - 1
        until = state.getCurrentWatermarkMs() * 1000 - tol
        lost = []
        for t in _due(plan, judged, until):
            near = [r for r in pending if abs(r - t) <= tol]
            if near:
                pending.remove(min(near, key=lambda r: (abs(r - t), r)))
            else:
                lost.append(t)
        judged = max(judged, until)
        state.update((judged, [r for r in pending if r > judged - tol], plan))
        # a silent job is judged when the watermark has moved on by a minute
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 60_000)
        yield pd.DataFrame({"job_id": [key[0]] * len(lost), "ts": pd.to_datetime(pd.Series(lost, dtype="int64"), unit="us")})

    kinds = ", ".join(f"{k}:{c.split()[1]}" for k, c in zip(_FIELDS, schedule.SCHEMA.split(", ")))
    job = jobs.schema["job_id"].dataType.simpleString()
    return runs.groupBy("job_id").applyInPandasWithState(judge, f"job_id {job}, ts timestamp_ntz", f"judged long, pending array<long>, plan struct<{kinds}>", "append", GroupStateTimeout.EventTimeTimeout)


def per_hour(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of (user, command, hour, runs): commands started per hour, each hour once the watermark is past it."""
    runs = logs.cron_commands(logs.parse(lines, None)).select("user", one_space(F.col("command")).alias("command"), F.col("ts").cast("timestamp").alias("start"))
    n = runs.withWatermark("start", delay).groupBy(F.window("start", "1 hour").alias("w"), "user", "command").agg(F.count("*").alias("runs"))
    return n.select("user", "command", F.col("w.start").cast("timestamp_ntz").alias("hour"), "runs")
