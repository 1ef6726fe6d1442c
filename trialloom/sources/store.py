"""Keyed tables that grow: hash buckets of Parquet, of which a change rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.functions.folders import delete, scratch


class BucketStore:
    """A table in ``buckets`` parts by hash of its keys, kept in numbered versions.

    A version is the list of each bucket's folder; folders are written once and
    shared by later versions until their bucket is touched. A merge that is lost
    or runs again leaves no trace in the version before it, so a streaming batch
    may use its number as the version. Readers see whole versions only. Driver
    and tasks handle one path a bucket, never the keys.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), keys, buckets, keep
        self.schema = T.StructType.fromDDL(schema)
        self._folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def versions(self) -> list[int]:
        """Whole versions, at most ``keep`` of them."""
        done = (n for n in self._names("versions") if self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{n}/_SUCCESS")))
        return sorted(int(n) for n in done)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Each bucket's folder in a version (the latest one); at most ``buckets`` entries."""
        if version is None:
            have = self.versions()
            version = have[-1] if have else None
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.path}/versions/{version:012d}").collect()
        return {r.bucket: r.folder for r in rows}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table in a version (the latest one), or some of its buckets."""
        folders = [f for b, f in sorted(self.manifest(version).items()) if only is None or b in set(only)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of the changes' keys."""
        return sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """Write the next version: ``combine(old rows, changes)`` gives all rows of the touched buckets.

        Old rows are those of touched buckets alone. Changes are read more than
        once and should be a written table. Returns the touched buckets."""
        before = self.versions()
        if version is None:
            version = before[-1] + 1 if before else 0
        before = [v for v in before if v < version]
        held = self.manifest(before[-1]) if before else {}
        touched = self.touched(changes)
        if touched or not before:
            old = self.read(before[-1], touched) if before else self.spark.createDataFrame([], self.schema)
            rows = combine(old, changes).select(*self.schema.names)
            run = f"data/{version:012d}"
            rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{run}")
            written = {int(n.split("=")[1]) for n in self._names(run) if n.startswith("bucket=")}
            held = {b: f for b, f in held.items() if b not in touched} | {b: f"{run}/bucket={b}" for b in written}
        listed = self.spark.createDataFrame([(b, f) for b, f in held.items()], "bucket int, folder string")
        listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/{version:012d}")
        self._forget()
        return touched

    def upsert(self, changes: DataFrame, order: list[str] | None = None, version: int | None = None) -> list[int]:
        """Rows of ``changes`` replace those of their keys; of several with one key the greatest in ``order`` stays."""
        path = scratch(self.spark, "changes")
        names = self.schema.names
        rank = F.struct(*(order or [n for n in names if n not in self.keys] or self.keys))
        changes.select(*names).groupBy(*self.keys).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*").write.parquet(path)
        changes = self.spark.read.schema(self.schema).parquet(path)

        def replace(old: DataFrame, new: DataFrame) -> DataFrame:
            same = [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in self.keys]
            kept = old.alias("_old")
            for_keys = new.select(*self.keys).alias("_new")
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            return kept.join(for_keys, condition, "left_anti").unionByName(new)

        touched = self.merge(changes, replace, version)
        delete(self.spark, path)
        return touched

    def _forget(self) -> None:
        """Remove versions beyond the last ``keep``, and data that none of them uses."""
        have = self.versions()
        for v in have[: -self.keep]:
            delete(self.spark, f"{self.path}/versions/{v:012d}")
        used = {f for v in have[-self.keep :] for f in self.manifest(v).values()}
        runs = {f.split("/")[1] for f in used}
        for run in self._names("data"):
            if run not in runs and int(run) <= have[-1]:
                delete(self.spark, f"{self.path}/data/{run}")
            elif run in runs:
                for name in self._names(f"data/{run}"):
                    if name.startswith("bucket=") and f"data/{run}/{name}" not in used:
                        delete(self.spark, f"{self.path}/data/{run}/{name}")
