"""Schedules of tables: expressions parsed on executors, and `expand_schedule` as a table function for SQL.

parsed() gives the columns of schedule.SCHEMA for a column of expressions of either dialect, with an
error instead where an expression cannot be read; schedule.expand() takes it from there as a plan.
expand_schedule() is for lateral joins in SQL and gives the same rows.
"""
from __future__ import annotations

from datetime import datetime, timedelta
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calendar, cron, schedule

FIELDS = [c.split()[0] for c in schedule.SCHEMA.split(", ")]
KIND = schedule.SCHEMA + ", error string, zone boolean"
DIALECTS = {"cron": cron.common, "systemd": calendar.common}


@lru_cache(maxsize=1 << 14)
def read(dialect: str | None, expr: str | None) -> tuple:
    """The values of KIND for one expression."""
    try:
        if expr is None or dialect not in DIALECTS:
            raise ValueError("no expression" if expr is None else f"no dialect {dialect!r}")
        return *DIALECTS[dialect](expr), None, False
    except ValueError as e:
        return *[None] * len(FIELDS), str(e), isinstance(e, calendar.ZoneError)


def parsed(dialect, expr):
    """Column of structs with the fields of KIND; equal expressions are read once per worker."""
    @F.pandas_udf("struct<" + ", ".join(":".join(c.split()) for c in KIND.split(", ")) + ">")
    def of(d: pd.Series, e: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(*x) for x in zip(d, e)], columns=[*FIELDS, "error", "zone"], dtype=object)

    return of(dialect, expr)


def plans(jobs: DataFrame) -> DataFrame:
    """jobs (dialect, expr, ...) with the columns of KIND."""
    return jobs.withColumn("_p", parsed(F.col("dialect"), F.col("expr"))).select(*[F.col(f"`{c}`") for c in jobs.columns], "_p.*")


def times(plan: dict, start: datetime, end: datetime) -> list[datetime]:
    """Occurrences of one plan (fields of schedule.SCHEMA) in the closed window, ascending."""
    if start > end:
        return []
    days = np.arange(np.datetime64(start, "D"), np.datetime64(end, "D") + 1)
    d = pd.DatetimeIndex(days)
    among = lambda field, values: np.ones(len(d), bool) if plan[field] is None else np.isin(values, list(plan[field]))
    dom, dow = among("doms", d.day), among("dows", (d.dayofweek + 1) % 7)
    fires = among("months", d.month) & among("years", d.year) & ((dom | dow) if plan["either"] else (dom & dow))
    clock = [timedelta(hours=int(h), minutes=int(m), seconds=int(s)) for h, m, s in product(sorted(plan["hours"]), sorted(plan["minutes"]), sorted(plan["seconds"]))]
    every = (day + t for day in d[fires].to_pydatetime() for t in clock)
    return [t for t in every if start <= t <= end]


class Expand:
    """expand_schedule(dialect, expr, start, end): (ts, problem); one row with a problem where nothing can be told."""

    def eval(self, dialect, expr, start, end):
        *values, error, _ = read(dialect, expr)
        if error is None and None not in (start, end) and start <= end:
            plan = dict(zip(FIELDS, values))
            if len(plan["hours"]) * len(plan["minutes"]) * len(plan["seconds"]) * ((end.date() - start.date()).days + 1) > schedule.MAX_FIRINGS:
                error = schedule.TOO_OFTEN
            else:
                yield from ((t, None) for t in times(plan, start, end))
        if error is not None:
            yield None, error


def register(spark: SparkSession) -> None:
    """Makes expand_schedule and parse_schedule known to spark.sql()."""
    spark.udtf.register("expand_schedule", F.udtf(Expand, returnType="ts timestamp_ntz, problem string"))

    @F.pandas_udf("struct<" + ", ".join(":".join(c.split()) for c in KIND.split(", ")) + ">")
    def parse_schedule(d: pd.Series, e: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(*x) for x in zip(d, e)], columns=[*FIELDS, "error", "zone"], dtype=object)

    spark.udf.register("parse_schedule", parse_schedule)
