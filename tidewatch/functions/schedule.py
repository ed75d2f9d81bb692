"""Occurrences of schedules as a plan; both dialects, crontab and calendar, come to the same columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A null array means any value. dows: Sunday is 0. either: a day matches by doms or by dows, else by both.
SCHEMA = ("hours array<int>, minutes array<int>, seconds array<int>, doms array<int>, months array<int>, "
          "years array<int>, dows array<int>, either boolean")
#: Fixed value: more potential firings in a window than this are refused.
MAX_FIRINGS = 200_000
TOO_OFTEN = "schedule fires too often to enumerate over the requested window"


def _window(start, end):
    return (x if not isinstance(x, str) else F.lit(x).cast("timestamp_ntz") for x in (start, end))


def potential(start, end):
    """Firings a schedule could have in the window if every day matched."""
    s, e = _window(start, end)
    days = F.datediff(F.to_date(e), F.to_date(s)) + 1
    return F.size("hours").cast("long") * F.size("minutes") * F.size("seconds") * days


def gap(plan: str = ""):
    """Seconds that occurrences of one schedule are apart at least; plan is a prefix of its columns, like `p.`."""
    def least(field, n, unit):
        f = f"{plan}{field}"
        return f"array_min(transform(array_sort({f}), (x, i) -> pmod(if(i = 0, x - array_max({f}), x - array_sort({f})[i - 1]), {n}))) * {unit}"

    return F.expr(f"""case when size({plan}seconds) > 1 then {least("seconds", 60, 1)} when size({plan}minutes) > 1 then {least("minutes", 60, 60)}
        when size({plan}hours) > 1 then {least("hours", 24, 3600)} else 86400 end""")


def refused(schedules: DataFrame, start, end) -> DataFrame:
    """(job_id, problem) of the schedules that expand() leaves out."""
    s, e = _window(start, end)
    return schedules.where((s <= e) & (potential(start, end) > MAX_FIRINGS)).select("job_id", F.lit(TOO_OFTEN).alias("problem"))


def matches(day):
    """Whether a schedule fires on a date."""
    has = lambda field, value: F.col(field).isNull() | F.coalesce(F.array_contains(field, value), F.lit(False))
    dom, dow = has("doms", F.dayofmonth(day)), has("dows", F.dayofweek(day) - 1)
    return has("months", F.month(day)) & has("years", F.year(day)) & F.when(F.col("either"), dom | dow).otherwise(dom & dow)


def expand(schedules: DataFrame, start, end, single: bool = False) -> DataFrame:
    """(job_id, ts), distinct, of schedules (job_id, SCHEMA) in the closed window; start and end are strings or columns.

    Days are filtered before hours, minutes and seconds multiply out. A window that ends before it
    starts has no occurrence; a schedule above MAX_FIRINGS is left out, see refused(). The days are dealt
    out to all tasks before that, as a table of schedules is small and would be multiplied in one task.
    single says that every job_id has one schedule, without equal values: nothing occurs twice then.
    """
    d = clock(days(schedules, start, end))
    return d.select("job_id", "ts") if single else d.select("job_id", "_day", "ts").distinct().select("job_id", "ts")


def days(schedules: DataFrame, start, end) -> DataFrame:
    """schedules of expand(), a row for every _day of the window that they fire on, dealt out by (job_id, _day)."""
    s, e = _window(start, end)
    dealt = int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = schedules.where((s <= e) & (potential(start, end) <= MAX_FIRINGS))
    d = d.withColumn("_s", s).withColumn("_e", e).withColumn("_day", F.explode(F.sequence(F.to_date("_s"), F.greatest(F.to_date("_s"), F.to_date("_e")))))
    return d.where(matches(F.col("_day"))).repartition(dealt, "job_id", "_day")


def clock(d: DataFrame, more: tuple[str, ...] = (), of_hour=lambda d: d) -> DataFrame:
    """(job_id, _day, ts, *more) of the occurrences on days(); of_hour is applied to the rows of (day, hour _h)."""
    d = of_hour(d.select("job_id", "_s", "_e", "_day", F.explode("hours").alias("_h"), "minutes", "seconds", *more))
    d = d.select("job_id", "_s", "_e", "_day", "_h", F.explode("minutes").alias("_m"), "seconds", *more)
    d = d.select("job_id", "_s", "_e", "_day", "_h", "_m", F.explode("seconds").alias("_sec"), *more)
    ts = F.expr("cast(_day as timestamp_ntz) + ((_h * 60 + _m) * 60 + _sec) * interval '1' second")
    return d.withColumn("ts", ts).where("ts between _s and _e").select("job_id", "_day", "ts", *more)
