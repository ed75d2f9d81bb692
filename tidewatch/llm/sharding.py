"""Size-tiered compaction of small immutable shards under a versioned manifest.

append() writes arrivals as one shard per batch; compact() puts runs of FAN_IN or more shards of one
size tier (powers of FAN_IN) together into files of about TARGET_BYTES and commits a new manifest.
Shards that have reached TARGET_BYTES are left alone, so rows are rewritten once per tier below it. A
manifest is one file `manifest-N` with a line (shard, rows, bytes, tier) per shard; it is written
under a private name and renamed into place without overwriting, and a version that exists already
makes the commit fail: readers see a whole version or the one before. The rename is atomic where the
store's is (HDFS; not on object stores that copy). Shards are never changed; a lost job leaves files
that no manifest names.

Every row is kept, repeated and null ones too, with all of its columns; read() replaces a column named
version by its own. Texts of any length are only written. An empty arrival makes an empty shard.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

TARGET_BYTES, FAN_IN, BATCHES = 128 << 20, 4, 8
_MANIFEST = "shard string, rows long, bytes long, tier int"


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("."))]
        return max([int(n[9:]) for n in names if n.startswith("manifest-")], default=0)

    def manifest(self, version: int | None = None) -> list:
        v = self.version() if version is None else version
        return self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest-{v}").collect() if v else []

    def _commit(self, rows: list, base: int) -> int:
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        private = self._path(f"new-{uuid.uuid4().hex}")
        out = self._fs.create(private, False)
        out.write(bytearray("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(private.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(private, self._path(f"manifest-{base + 1}"), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(private, False)
            raise RuntimeError(f"version {base + 1} was committed by another writer") from e
        return base + 1

    def tier(self, size: int) -> int:
        out, step = 0, 1 << 20
        while size > step:
            out, step = out + 1, step * self.fan_in
        return out

    def _write(self, df: DataFrame, files: int | None = None) -> tuple:
        name, seen = f"shard-{uuid.uuid4().hex}", Observation()
        (df.coalesce(files) if files else df).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{name}")
        size = self._fs.getContentSummary(self._path(name)).getLength()
        return name, seen.get["n"], size, self.tier(size)

    def append(self, batches: list[DataFrame], base: int | None = None) -> int:
        """Commits the batches on top of version base, the newest one unless given."""
        base = self.version() if base is None else base
        old = [tuple(r) for r in self.manifest(base)]
        return self._commit(old + [self._write(b) for b in batches], base)

    def compact(self, base: int | None = None) -> int:
        """Merge runs of shards of one tier until none is left."""
        base = self.version() if base is None else base
        rows = [tuple(r) for r in self.manifest(base)]
        while True:
            tiers = {}
            for r in rows:
                if r[2] < self.target:
                    tiers.setdefault(r[3], []).append(r)
            run = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)
            if run is None:
                break
            size = sum(r[2] for r in run)
            merged = self.spark.read.parquet(*[f"{self.root}/{r[0]}" for r in run])
            new = self._write(merged, -(-size // self.target))
            # a merged run rises at least one tier, so the rounds end
            rows = [r for r in rows if r not in run] + [(*new[:3], max(new[3], run[0][3] + 1))]
        return self._commit(rows, base)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        parts = self.manifest(v)
        df = self.spark.read.parquet(*[f"{self.root}/{r.shard}" for r in parts])
        return df.withColumn("version", F.lit(v).cast("long"))


def op7_sharding(spark, sf_dir):
    """The documents after BATCHES arrivals and a compaction: doc_id, text hash and version."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BATCHES))
    store.append([docs.where(lot == b) for b in range(BATCHES)])
    store.compact()
    return store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "version")


ORACLES = {"op7_sharding": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST(2 AS BIGINT) AS version FROM documents"}
