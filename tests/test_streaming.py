"""The stream finds what a batch scan finds, batch by batch."""
from datetime import datetime, timedelta

from tidewatch.functions import cron, schedule
from tidewatch.streaming import watch


def test_missed_and_hours_of_a_stream(spark, tmp_path):
    start = datetime(2026, 2, 1)
    line = lambda m, c: f"{(start + timedelta(minutes=m)).isoformat()}+0100 h CRON[{m + 1}]: (root) CMD ({c})"
    ran = [m for m in range(0, 300, 15) if m not in (45, 60, 210)]
    feed = [[line(m, "tick  a") for m in ran if m < 120], [line(m, "tick a") for m in ran if 120 <= m], [line(600, "other")], ["noise"]]
    jobs = spark.createDataFrame([(7, "root", "tick a", *cron.common("*/15 * * * *"))], "job_id int, user string, command string, " + schedule.SCHEMA)
    (tmp_path / "in").mkdir()
    for k, batch in enumerate(feed):
        spark.createDataFrame([("s", n, v) for n, v in enumerate(batch)], "source string, lineno long, value string").coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    lines = spark.readStream.schema("source string, lineno long, value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    for name, df in (("lost", watch.missed(lines, jobs)), ("hours", watch.per_hour(lines))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(180)
    lost = sorted(r.ts for r in spark.table("lost").collect())
    assert [start + timedelta(minutes=m) for m in (45, 60, 210)] == lost[:3] and all(t >= start + timedelta(minutes=300) for t in lost[3:])
    hours = {r.hour: r.runs for r in spark.table("hours").where("command = 'tick a'").collect()}
    assert [hours[start + timedelta(hours=h)] for h in range(5)] == [3, 3, 4, 3, 4]
