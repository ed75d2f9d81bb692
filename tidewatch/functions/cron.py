"""Cron expressions: a parser for the few distinct schedules, and their occurrences as a plan."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schedule

# fixed values: macros and names of the crontab language
MACROS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
UNTIMED = ("@reboot",)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
MAX_FIRINGS = schedule.MAX_FIRINGS

SCHEMA = "minutes array<int>, hours array<int>, doms array<int>, months array<int>, dows array<int>, dom_star boolean, dow_star boolean"
_ITEM = re.compile(r"(?:\*|(?P<from>[0-9]+|[a-z]+)(?:-(?P<to>[0-9]+|[a-z]+))?)(?:/(?P<step>[0-9]+))?", re.IGNORECASE)


def field(text: str, low: int, high: int, names=(), first: int = 0) -> list[int]:
    """Values of one field: items `*`, `a` or `a-b`, each with `/step`, joined by commas; ValueError else."""
    of = {n: k for k, n in enumerate(names, first)} | {str(k).zfill(w): k for k in range(low, high + 1) for w in (1, 2)}
    out: set[int] = set()
    for item in text.split(","):
        m = _ITEM.fullmatch(item)
        ends = [x.lower() for x in (m["from"], m["to"]) if x] if m else ["?"]
        values = [of.get(x if x.isalpha() else str(int(x))) if x.isalnum() else None for x in ends]
        if None in values or m["step"] and int(m["step"]) == 0:
            raise ValueError(f"{item!r} is no item of a field from {low} to {high}")
        start = values[0] if values else low
        # a step without an end runs to the last value
        stop = values[-1] if values and (m["to"] or not m["step"]) else high
        if start > stop:
            raise ValueError(f"{item!r} ends before it starts")
        out |= set(range(start, stop + 1, int(m["step"] or 1)))
    return sorted(out)


def parse(expr: str) -> tuple:
    """The columns of SCHEMA; Sunday is 0. @reboot has no predictable time and raises."""
    parts = MACROS.get(expr.strip().lower(), expr).split()
    if expr.strip().lower() in UNTIMED:
        raise ValueError(f"{expr.strip()} has no predictable time")
    if len(parts) != 5:
        raise ValueError(f"not five fields or a known macro: {expr!r}")
    mi, ho, dm, mo, dw = parts
    return (field(mi, 0, 59), field(ho, 0, 23), field(dm, 1, 31), field(mo, 1, 12, MONTHS, 1),
            sorted({d % 7 for d in field(dw, 0, 7, DAYS)}), dm.startswith("*"), dw.startswith("*"))


def common(expr: str) -> tuple:
    """The columns of schedule.SCHEMA."""
    mi, ho, dm, mo, dw, dm_star, dw_star = parse(expr)
    return ho, mi, [0], dm, mo, None, dw, not (dm_star or dw_star)


def occurrences(schedules: DataFrame, start: str, end: str) -> DataFrame:
    """(job_id, ts) of schedules (job_id, *SCHEMA) in the closed window; see schedule.expand."""
    s = schedules.select("job_id", "hours", "minutes", F.array(F.lit(0)).alias("seconds"), "doms", "months",
                         F.lit(None).cast("array<int>").alias("years"), "dows", (~(F.col("dom_star") | F.col("dow_star"))).alias("either"))
    return schedule.expand(s, start, end)
