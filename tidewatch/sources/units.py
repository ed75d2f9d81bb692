"""Property blocks of `systemctl show`, what they say of a unit, and the jobs of timers."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.text import duration, timestamp


def parse(lines: DataFrame) -> DataFrame:
    """(source, block, ord, unit, props) from (source, lineno, value); ord is the line the block begins at.

    A blank line or a repeated Id ends a block, a line without `=` is skipped, the last of equal
    keys wins, and blocks without an Id are dropped.
    """
    w = Window.partitionBy("source").orderBy("lineno")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.coalesce("value", F.lit(""))
    d = lines.withColumn("_blank", F.trim(v) == "").withColumn("_key", F.when(F.contains(v, F.lit("=")), F.trim(F.substring_index(v, "=", 1))))
    d = d.withColumn("_val", F.trim(F.expr("substring(value, instr(value, '=') + 1)")))
    # an Id opens a block where the present stretch has one already
    d = d.withColumn("_part", F.sum(F.col("_blank").cast("int")).over(upto))
    ids = F.sum(F.coalesce((F.col("_key") == "Id").cast("int"), F.lit(0))).over(
        Window.partitionBy("source", "_part").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("block", F.struct("_part", F.greatest(ids, F.lit(1)).alias("nth"))).where("_key is not null and not _blank")
    one = d.groupBy("source", "block", "_key").agg(F.max_by("_val", "lineno").alias("_val"), F.min("lineno").alias("_at"))
    out = one.groupBy("source", "block").agg(F.min("_at").alias("ord"), F.map_from_entries(F.collect_list(F.struct("_key", "_val"))).alias("props"))
    return out.withColumn("unit", F.expr("props['Id']")).where("coalesce(unit, '') <> ''").select("source", "block", "ord", "unit", "props")


def get(props, key: str):
    """A property; null where it is missing or empty."""
    return F.nullif(F.try_element_at(props, F.lit(key)), F.lit(""))


def exit_status(props):
    """The main process' exit status; null unless it is a whole number."""
    raw = F.trim(get(props, "ExecMainStatus"))
    return F.when(F.regexp_like(raw, F.lit("^-*[0-9]+$")), raw.try_cast("int"))


def failed(props):
    """ActiveState failed; else a Result other than success; else, without one, a main status other than 0."""
    return F.when(get(props, "ActiveState") == "failed", True).when(get(props, "Result").isNotNull(), get(props, "Result") != "success").otherwise(
        F.coalesce(exit_status(props) != 0, F.lit(False)))


def latest(states: DataFrame) -> DataFrame:
    """One row per unit of states (source, ord, unit, props): the last one."""
    at = F.struct(*[c for c in ("src", "source", "ord") if c in states.columns])
    return states.groupBy("unit").agg(F.max_by("props", at).alias("props"))


def tolerance(props):
    """Seconds a timer may be late: its accuracy and its random delay."""
    of = lambda name: duration(F.coalesce(get(props, name + "USec"), get(props, name + "Sec")))
    return of("Accuracy") + of("RandomizedDelay")


def timers(states: DataFrame) -> DataFrame:
    """(id, timer, unit, schedules, problem, ord) of the timer units of states; one without calendar has a problem."""
    t = states.where("endswith(unit, '.timer')")
    found = F.transform(F.regexp_extract_all(F.coalesce(get("props", "TimersCalendar"), F.lit("")), F.lit("OnCalendar=([^;}]+)"), F.lit(1)), lambda x: F.trim(x))
    service = F.coalesce(get("props", "Unit"), F.concat(F.expr("substring(unit, 1, length(unit) - 6)"), F.lit(".service")))
    d = once(t.withColumn("schedules", found).withColumn("_s", service))
    problem = F.when(F.size("schedules") == 0, F.concat("unit", F.lit(": no OnCalendar= (a monotonic timer has no calendar)")))
    return d.select(F.concat(F.lit("systemd:"), "unit").alias("id"), F.col("unit").alias("timer"), F.col("_s").alias("unit"), "schedules", problem.alias("problem"), "ord")


def descriptions(states: DataFrame) -> DataFrame:
    """(ord, description, unit) of the services that have one."""
    return states.where("endswith(unit, '.service')").select("ord", get("props", "Description").alias("description"), "unit").where("description is not null")


def state(states: DataFrame) -> DataFrame:
    """(unit, failed, exited, exit_code, result, active, props) of the latest states."""
    d = latest(states)
    return d.select("unit", failed("props").alias("failed"), timestamp(get("props", "ExecMainExitTimestamp")).alias("exited"), exit_status("props").alias("exit_code"),
                    get("props", "Result").alias("result"), get("props", "ActiveState").alias("active"), "props")
