"""A table of feature vectors whose ids can be replaced at once: buckets of files, and a manifest that names the current ones.

Files are never changed. A write puts whole buckets into a folder of its own and then creates the next manifest, which
names for every bucket the folder that holds it now. Readers take the newest manifest, so they see all of a write or
nothing of it, and a write that fails leaves only a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.shared import written


class FeatureStore:
    """Rows (protein_id, position, embedding) in a folder that the driver and every executor can reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self._manifest()["buckets"] if self.version() is not None else buckets

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int | None:
        """The newest version; none of a store that holds nothing."""
        return max(self.versions(), default=None)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None:
            return {"buckets": self.buckets, "held": {}}
        lines = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True)
        return json.loads(lines.first()["value"])

    def read(self, version: int | None = None) -> DataFrame:
        """protein_id, position, embedding as of a version, the newest unless given."""
        held = self._manifest(version)["held"]
        folders = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, folder in held.items()]
        schema = "protein_id string, position int, embedding array<float>"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, before: int | None, manifest: dict) -> int:
        """Create the manifest after before; if someone else did, refuse. The file gets its name when it is complete."""
        after = 0 if before is None else before + 1
        draft, final = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{after:012d}.json")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError("another write was committed meanwhile; nothing of this one is seen")
        return after

    def write(self, rows: DataFrame, overwrite: bool = False) -> int | None:
        """Add the ids of rows that the store lacks, or with overwrite put all of them in the place of what it has.

        Only buckets with such ids are written anew, with the other ids they hold. The new version, or the old one if
        there was nothing to write.
        """
        before = self.version()
        manifest = self._manifest(before)
        at = F.pmod(F.xxhash64("protein_id"), F.lit(self.buckets)).cast("int")
        new = rows.select(F.col("protein_id").cast("string").alias("protein_id"), F.col("position").cast("int").alias("position"), F.col("embedding").cast("array<float>").alias("embedding")).withColumn("bucket", at)
        held = self.read(before).withColumn("bucket", at)
        if not overwrite:
            new = new.join(held.select("protein_id").distinct(), "protein_id", "left_anti")
        new = written(new, "features-new")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return before
        rest = held.where(F.col("bucket").isin(touched)).join(new.select("protein_id").distinct(), "protein_id", "left_anti")
        folder = uuid.uuid4().hex
        whole = rest.select("protein_id", "position", "embedding", "bucket").unionByName(new)
        whole.repartition("bucket").sortWithinPartitions("bucket", "protein_id", "position").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        manifest["held"] |= {str(b): folder for b in touched}
        return self._commit(before, manifest)

    def clear_old(self) -> None:
        """Delete the manifests before the newest one and the folders that it doesn't name."""
        versions = self.versions()
        kept = set(self._manifest()["held"].values())
        for v in versions[:-1]:
            self._files.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        for status in self._files.listStatus(self._path(f"{self.path}/data")) if versions else ():
            if status.getPath().getName() not in kept:
                self._files.delete(status.getPath(), True)
