"""Detectors: missed occurrences, overlapping runs, failed runs and units."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schedule

#: Width of the time buckets in which overlapping runs meet.
BUCKET_S = 86_400
#: Width of the buckets in which an occurrence looks for a run.
NEAR_BUCKET_S = 3600
#: Clusters of at most so many (occurrence, run) pairs are matched by expressions.
SMALL = 1024


def _seconds(col):
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)


def overlaps(runs: DataFrame) -> DataFrame:
    """Every pair of runs of one job in which the earlier one ends strictly after the later one starts.

    A run without an end can be covered but covers nothing. Runs meet in the bucket of the later one's
    start, so a job's runs are compared within a bucket and with the runs that reach into it.
    """
    p = runs.select("job_id", *[F.col(c).alias("p_" + c) for c in ("start", "end", "ord")]).where("p_end > p_start")
    bucket = lambda c: F.floor(_seconds(F.col(c)) / BUCKET_S)
    p = p.withColumn("bucket", F.explode(F.sequence(bucket("p_start"), bucket("p_end"))))
    c = runs.select("job_id", *[F.col(c).alias("c_" + c) for c in ("start", "end", "ord")]).withColumn("bucket", bucket("c_start"))
    before = F.struct("p_start", "p_end", "p_ord") < F.struct("c_start", F.coalesce("c_end", "c_start"), "c_ord")
    out = p.join(c, ["job_id", "bucket"]).where((F.col("p_end") > F.col("c_start")) & before).drop("bucket")
    return out.withColumn("overlap_s", F.timestamp_diff("SECOND", "c_start", F.least("p_end", F.coalesce("c_end", "p_end"))))


def run_failed(result, exit_code):
    """A non-empty result decides; without one, a non-zero exit code does."""
    return F.when(F.coalesce(result, F.lit("")) != "", result != "success").otherwise(F.coalesce(exit_code != 0, F.lit(False)))


def _unclaimed(occ, runs, tol: int) -> list[int]:
    """The occurrences that find no free run; both ascend, and only runs within tol are looked at."""
    occ, runs = np.asarray(occ, np.int64), np.asarray(runs, np.int64)
    free, lost = np.ones(len(runs), bool), []
    for t, lo, hi in zip(occ, np.searchsorted(runs, occ - tol), np.searchsorted(runs, occ + tol, "right")):
        near = np.flatnonzero(free[lo:hi])
        if len(near):
            free[lo + near[np.argmin(np.abs(runs[lo:hi][near] - t))]] = False
        else:
            lost.append(int(t))
    return lost


def missed(occurrences: DataFrame, runs: DataFrame, tolerance_s, reach: DataFrame | None = None) -> DataFrame:
    """Occurrences (job_id, ts) that no run claims; tolerance_s is a number, or a column of occurrences.

    Occurrences ascend and each takes the unclaimed run with the least distance within tolerance,
    the earlier on a tie. Where a boolean column `apart` says that a job's occurrences lie more than
    twice the tolerance apart, no run can serve two and any near run will do, see missed_apart().
    reach (job_id, tolerance), a row per job, spares a second reading of occurrences for their tolerances.
    """
    if "apart" not in occurrences.columns:
        return missed_close(occurrences, runs, tolerance_s)
    return missed_apart(occurrences.where("apart"), runs, tolerance_s, reach).unionByName(missed_close(occurrences.where("not coalesce(apart, false)"), runs, tolerance_s))


def missed_apart(occurrences: DataFrame, runs: DataFrame, tolerance_s, reach: DataFrame | None = None) -> DataFrame:
    """missed() of occurrences more than twice the tolerance apart: those without any run within it.

    A range anti-join in buckets of NEAR_BUCKET_S: a run stands in every bucket that its tolerance reaches.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width, micros = NEAR_BUCKET_S * 1_000_000, lambda tol: (tol * 1_000_000).cast("long")
    tol = tolerance_s if isinstance(tolerance_s, F.Column) else F.lit(float(tolerance_s))
    occ = occurrences.select("job_id", "ts", micros(tol).alias("tol"), us("ts").alias("_t"))
    r = runs.select("job_id", us("start").alias("_r"))
    if isinstance(tolerance_s, F.Column):
        most = occ.groupBy("job_id").agg(F.max("tol").alias("_tol")) if reach is None else reach.select("job_id", micros(F.col("tolerance")).alias("_tol"))
        r = r.join(most, "job_id")
    else:
        r = r.withColumn("_tol", micros(tol))
    r = r.select("job_id", "_r", F.explode(F.sequence(F.floor((F.col("_r") - F.col("_tol")) / width), F.floor((F.col("_r") + F.col("_tol")) / width))).alias("bucket"))
    # dealt by bucket once, for distinct rows and for the join
    dealt = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    occ = occ.withColumn("bucket", F.floor(F.col("_t") / width)).repartition(dealt, "job_id", "bucket").distinct().alias("o")
    near = (F.col("o.job_id") == F.col("r.job_id")) & (F.col("o.bucket") == F.col("r.bucket")) & (F.abs(F.col("o._t") - F.col("r._r")) <= F.col("o.tol"))
    return occ.join(r.alias("r"), near, "left_anti").select("job_id", "ts")


def missed_planned(schedules: DataFrame, runs: DataFrame, start, end) -> DataFrame:
    """(job_id, tolerance, ts): missed_apart() of schedules (job_id, tolerance, schedule.SCHEMA) in the window, one of a job_id.

    runs: job_id, start and the job's tolerance; those of other jobs do no harm.

    Schedules meet runs as days, before hours, minutes and seconds multiply out; occurrences are never
    shuffled, sorted or joined. A run stands on every day that its tolerance reaches. Of the runs that start in
    one second the first and the last are kept, as occurrences are whole seconds, so a day has a bounded list.
    """
    epoch, day, dealt = F.lit("1970-01-01"), 86_400_000_000, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    micros = lambda c: F.timestamp_diff("MICROSECOND", epoch.cast("timestamp_ntz"), c)
    tol = (F.col("tolerance") * 1_000_000).cast("long").alias("_tol")
    schedules = schedules.withColumn("_tol", tol)
    r = runs.select("job_id", micros(F.col("start")).alias("_r"), tol)
    r = r.select("job_id", "_r", F.explode(F.sequence(F.floor((F.col("_r") - F.col("_tol")) / day), F.floor((F.col("_r") + F.col("_tol")) / day))).alias("_n"))
    r = r.select("job_id", F.date_add(epoch.cast("date"), F.col("_n").cast("int")).alias("_day"), "_r", F.floor(F.col("_r") / 1_000_000).alias("_sec")).repartition(dealt, "job_id", "_day")
    r = r.groupBy("job_id", "_day", "_sec").agg(F.min("_r").alias("a"), F.max("_r").alias("b"))
    r = r.groupBy("job_id", "_day").agg(F.array_distinct(F.concat(F.collect_list("a"), F.collect_list("b"))).alias("_near"))
    d = schedule.days(schedules, start, end).join(r, ["job_id", "_day"], "left")
    begin = f"(datediff(_day, date '1970-01-01') * {day} + _h * 3600000000)"
    in_hour = lambda d: d.withColumn("_near", F.expr(f"filter(_near, r -> r between {begin} - _tol and {begin} + 3600000000 + _tol)"))
    occ = schedule.clock(d, ("tolerance", "_tol", "_near"), in_hour).withColumn("_t", micros(F.col("ts")))
    return occ.where("not coalesce(exists(_near, r -> abs(_t - r) <= _tol), false)").select("job_id", "tolerance", "ts")


def missed_close(occurrences: DataFrame, runs: DataFrame, tolerance_s) -> DataFrame:
    """missed() of any occurrences, by greedy choice.

    Occurrences and runs of a job more than the tolerance apart in time cannot meet, so a job's timeline
    is cut there into clusters, each matched by itself.
    """
    us = lambda col: F.unix_micros(col.cast("timestamp"))
    tol = (F.lit(tolerance_s) if not isinstance(tolerance_s, F.Column) else tolerance_s) * 1_000_000
    occ = occurrences.select("job_id", us(F.col("ts")).alias("t"), tol.cast("long").alias("tol")).distinct()
    both = occ.withColumn("due", F.lit(True)).unionByName(
        runs.select("job_id", us(F.col("start")).alias("t"), F.lit(None).cast("long").alias("tol"), F.lit(False).alias("due")))
    w = Window.partitionBy("job_id").orderBy("t")
    both = both.withColumn("tol", F.max("tol").over(Window.partitionBy("job_id"))).where("tol is not null")
    both = both.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > F.col("tol")).cast("long"), F.lit(1)))
    both = both.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = both.groupBy("job_id", "cluster").agg(
        F.array_sort(F.collect_list(F.when(F.col("due"), F.col("t")))).alias("occ"), F.array_sort(F.collect_list(F.when(~F.col("due"), F.col("t")))).alias("runs"), F.first("tol").alias("tol"))
    c = c.where("size(occ) > 0")
    small = F.expr("""aggregate(occ,
        named_struct('used', cast(array() as array<int>), 'out', cast(array() as array<bigint>)),
        (acc, e) -> transform(array(array_min(filter(
            transform(runs, (r, i) -> named_struct('d', abs(r - e), 'i', i)),
            x -> x.d <= tol and not array_contains(acc.used, x.i)))),
          b -> named_struct('used', if(b is null, acc.used, array_append(acc.used, b.i)),
                            'out', if(b is null, array_append(acc.out, e), acc.out)))[0]).out""")

    @F.pandas_udf("array<bigint>")
    def large(o: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([_unclaimed(*x) for x in zip(o, r, t)], dtype=object)

    fits = F.size("occ") * F.size("runs") <= SMALL
    lost = c.where(fits).select("job_id", small.alias("m")).unionByName(c.where(~fits).select("job_id", large("occ", "runs", "tol").alias("m")))
    return lost.select("job_id", F.explode("m").alias("t")).select("job_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))


def failures(runs: DataFrame, states: DataFrame, near_s: int = 5) -> DataFrame:
    """(job_id, evidence, when, started, exit_code, result): failed runs, and failed states that no run's end tells of.

    runs: job_id, start, end, exit_code, result. states: job_id, failed, exited (null where unknown),
    exit_code, result. A state within near_s of a failed run's end is the same failure.
    """
    bad = runs.where(run_failed(F.col("result"), F.col("exit_code")))
    seen = bad.select("job_id", F.lit("journalctl").alias("evidence"), F.coalesce("end", "start").alias("when"), F.col("start").alias("started"), "exit_code", "result")
    slot = lambda c, more=0: F.floor((_seconds(c) + more) / 60)
    # an end stands in every minute that near_s reaches
    ends = seen.select(F.col("job_id").alias("_j"), F.col("when").alias("_at"), F.explode(F.sequence(slot(F.col("when"), -near_s - 1), slot(F.col("when"), near_s + 1))).alias("_slot"))
    close = (F.col("job_id") == F.col("_j")) & (slot(F.col("exited")) == F.col("_slot")) & (F.abs(F.timestamp_diff("MICROSECOND", "exited", "_at")) <= near_s * 1_000_000)
    standing = states.where("failed").join(ends, close, "left_anti")
    return seen.unionByName(standing.select("job_id", F.lit("systemctl show").alias("evidence"), F.col("exited").alias("when"),
                                            F.lit(None).cast("timestamp_ntz").alias("started"), "exit_code", "result"))


def in_window(runs: DataFrame, start, end, tolerance_s) -> DataFrame:
    """Runs that start from tolerance_s before the window to its end."""
    s, e = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return runs.where((F.timestamp_diff("MICROSECOND", F.col("start"), s) <= tolerance_s * 1_000_000) & (F.col("start") <= e))
