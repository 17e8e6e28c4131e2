"""Keyed tables in buckets of files: a merge rewrites the buckets that it touches, the others stay as they are.

    data/version=5/bucket=17/part-*   rows of bucket 17, as version 5 wrote them
    manifest/00000005                 for each bucket the version that holds it

A write reads the buckets of its keys, writes them anew as a version, and ends with a manifest; readers see one version as a whole, old ones can be read
until `vacuum`, and of two writers from the same version one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sagebase.sources import store
from sagebase.sources.store import settings

BUCKETS = 32
#: Parts of the touched buckets for each core, about: what a task sorts.
SPREAD = 4
#: Spark drops the shuffle files of a query when it ends: the steps of a write don't add up on disk.
CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class KeyedTable:
    """A table with at most one row for each key."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return [int(n) for n in store.names(self.spark, f"{self.path}/manifest")]

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        content = store.get(self.spark, f"{self.path}/manifest/{version:08d}") if version else None
        if version and content is None:
            raise ValueError(f"there is no version {version}")
        return {"version": version, "buckets": {int(k): v for k, v in json.loads(content)["buckets"].items()} if content else {}}

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows(self.manifest(version)["buckets"])

    def rows(self, buckets: dict[int, str]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{name}/bucket={b}" for b, name in sorted(buckets.items())])

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of some keys, BUCKETS at most."""
        with settings(self.spark, CLEAN_UP):
            return sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def dealt(self, rows: DataFrame, touched: list[int]) -> DataFrame:
        """Rows with `bucket` and `part`, moved so that each part of a bucket is in one task: a bucket may be larger than that."""
        parts = max(1, SPREAD * self.spark.sparkContext.defaultParallelism // max(1, len(touched)))
        return rows.withColumn("bucket", self.bucket()).withColumn("part", F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(parts))).repartition("bucket", "part")

    def replace(self, before: dict, touched: list[int], rows: DataFrame) -> None:
        """Writes rows, as `dealt` gives them, as all that the touched buckets hold, and a manifest."""
        name = f"version={before['version'] + 1}-{uuid.uuid4().hex[:8]}"
        with settings(self.spark, CLEAN_UP):
            rows.drop("part").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        full = set(store.names(self.spark, f"{self.path}/data/{name}"))
        after = {b: v for b, v in before["buckets"].items() if b not in touched} | {b: name for b in touched if f"bucket={b}" in full}
        content = json.dumps({"buckets": after}).encode()
        store.put(self.spark, f"{self.path}/manifest/{before['version'] + 1:08d}", content)

    def upsert(self, rows: DataFrame, order: list | None = None, write_id: str | None = None) -> bool:
        """Rows in place of those with their keys. Of rows with the same key the first in `order` counts (else the greatest); keys may hold nulls.

        With a `write_id`, a write that was made before changes nothing and gives False: a replayed batch is one write.
        """
        if write_id is not None and store.get(self.spark, f"{self.path}/writes/{write_id}") is not None:
            return False
        rest = [c for c in self.schema.fieldNames() if c not in self.key]
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        best = F.max(F.struct("_new", *rest))
        if order:
            ranked = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], F.struct(*order).alias("_order"))
            new = ranked.groupBy(*self.key).agg(F.min_by(F.struct(*rest) if rest else F.lit(1), "_order").alias("_row")).select(*self.key, *[F.col(f"_row.{c}").alias(c) for c in rest])
            best = F.max_by(F.struct("_new", *rest), "_new")
        before = self.manifest()
        touched = self.touched(new)
        if touched:
            old = self.rows({b: v for b, v in before["buckets"].items() if b in touched})
            # Old and new rows move once, to the parts that they are written in; there a key's new row counts.
            both = self.dealt(old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))), touched)
            found = both.groupBy("bucket", "part", *self.key).agg(best.alias("_row"))
            self.replace(before, touched, found.select(*self.key, *[F.col(f"_row.{c}").alias(c) for c in rest], "bucket", "part"))
        if write_id is not None:
            store.put(self.spark, f"{self.path}/writes/{write_id}", b"", overwrite=True)
        return True

    def without(self, old: DataFrame, gone: DataFrame) -> DataFrame:
        keys = gone.select(*[F.col(c).alias(f"_{c}") for c in self.key]).distinct()
        same = F.lit(True)
        for c in self.key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return old.join(keys, same, "left_anti")

    def delete(self, gone: DataFrame) -> None:
        """Removes rows by key."""
        before = self.manifest()
        keys = gone.select(*self.key).distinct()
        touched = [b for b in self.touched(keys) if b in before["buckets"]]
        if touched:
            old = self.rows({b: v for b, v in before["buckets"].items() if b in touched})
            self.replace(before, touched, self.dealt(self.without(old, keys), touched))

    def vacuum(self) -> None:
        """Deletes what the latest version doesn't hold. Not while others read older versions or write."""
        now, keep = self.manifest(), self.manifest()["buckets"]
        for name in store.names(self.spark, f"{self.path}/data"):
            held = {f"bucket={b}" for b, v in keep.items() if v == name}
            for bucket in store.names(self.spark, f"{self.path}/data/{name}"):
                if bucket.startswith("bucket=") and bucket not in held:
                    store.delete(self.spark, f"{self.path}/data/{name}/{bucket}")
            if not held:
                store.delete(self.spark, f"{self.path}/data/{name}")
        for v in self.versions():
            if v != now["version"]:
                store.delete(self.spark, f"{self.path}/manifest/{v:08d}")
