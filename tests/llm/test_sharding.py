"""Tiers, manifests, conflicting writers and lost jobs."""
import pytest
from pyspark.sql import functions as F

from tidewatch.llm.sharding import Store


def batch(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_runs_of_a_tier_are_merged_and_every_version_stays_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.append([batch(spark, 10 * k, 10 * k + 10) for k in range(3)]) == 1
    assert store.compact() == 2 and len(store.manifest(2)) == 3  # a run is too short
    assert store.append([batch(spark, 30, 40), batch(spark, 0, 10), batch(spark, 0, 0)]) == 3
    assert store.compact() == 4
    (one,) = store.manifest()
    assert (one.rows, one.tier) == (50, 1)
    want = sorted(rows(batch(spark, 0, 40)) + rows(batch(spark, 0, 10)))
    assert rows(store.read()) == rows(store.read(3)) == want and rows(store.read(1)) == rows(batch(spark, 0, 30))


def test_shards_at_the_target_size_are_left_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), target_bytes=100)
    store.append([batch(spark, k, k + 1) for k in range(5)])
    before = sorted(r.shard for r in store.manifest())
    store.compact()
    assert sorted(r.shard for r in store.manifest()) == before


def test_one_of_two_writers_fails_and_a_lost_job_is_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append([batch(spark, 0, 3)])
    batch(spark, 90, 99).write.parquet(f"{store.root}/shard-lost")
    assert store.append([batch(spark, 3, 5)], base=1) == 2
    with pytest.raises(RuntimeError):
        store.append([batch(spark, 5, 7)], base=1)
    assert store.version() == 2 and rows(store.read()) == rows(batch(spark, 0, 5))
