"""The merge as a stream: each micro-batch is merged into a versioned corpus table.

The table is cut into buckets by key.  A batch reads and writes the buckets its
keys fall into only; a manifest, written last, says which version of each bucket
counts.  What isn't in a manifest was never committed, so a batch that fails is
taken in again, and a new process goes on from the last manifest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import upsert


class CorpusTable:
    """A corpus in a folder; a batch that runs twice gives the same version."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.folder, self.keys, self.order, self.buckets, self.keep = spark, folder.rstrip("/"), keys, order, buckets, keep

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The committed versions in order."""
        fs, path = self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    @property
    def version(self) -> int | None:
        done = self.versions()
        return done[-1] if done else None

    def manifest(self, version: int) -> dict[str, int]:
        """The version in which each bucket was last written."""
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/v{version:09d}.json", wholetext=True).first().value)

    def _read(self, buckets: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/v{v}/bucket={b}" for b, v in sorted(buckets.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The corpus as of a version, by default the last one; None before the first."""
        version = self.version if version is None else version
        return None if version is None else self._read(self.manifest(version))

    def take_in(self, batch: DataFrame, number: int) -> None:
        """Merge a batch as version ``number``; earlier records keep their decisions.  An empty batch changes nothing."""
        last = self.version
        if last is not None and number <= last:
            return
        held = self.manifest(last) if last is not None else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.dropDuplicates([*self.keys, *self.order])
        touched = [str(r.b) for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        now = self._read({b: held[b] for b in touched if b in held})
        base = rows.limit(0) if now is None else now
        for c in self.order:
            if c not in base.columns:
                base = base.withColumn(c, F.lit(0).cast(dict(rows.dtypes)[c]))
        merged = upsert(base.select(rows.columns), rows, self.keys, self.order).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v{number}")
        written = {r.bucket for r in self.spark.read.parquet(f"{self.folder}/data/v{number}").select(F.col("bucket").cast("string").alias("bucket")).distinct().collect()} if touched else set()
        self._commit(number, held | {b: number for b in written})

    def _commit(self, number: int, buckets: dict[str, int]) -> None:
        fs, path = self._path(f"manifest/v{number:09d}.json")
        _, part = self._path(f"manifest/.v{number:09d}.part")
        out = fs.create(part, True)
        out.writeBytes(json.dumps(buckets))
        out.close()
        fs.rename(part, path)
        self._sweep()

    def _sweep(self) -> None:
        """Delete manifests but the last ``keep``, and data that none of those names."""
        versions = self.versions()
        for v in versions[: -self.keep]:
            fs, path = self._path(f"manifest/v{v:09d}.json")
            fs.delete(path, False)
        kept = {v for m in versions[-self.keep :] for v in self.manifest(m).values()}
        fs, data = self._path("data")
        for status in fs.listStatus(data) if fs.exists(data) else []:
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:]) not in kept and int(name[1:]) < versions[-1]:
                fs.delete(status.getPath(), True)


def start(stream: DataFrame, table: CorpusTable, checkpoint: str) -> StreamingQuery:
    """Run the merge over what a stream of records has to offer now."""
    return stream.writeStream.foreachBatch(table.take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
