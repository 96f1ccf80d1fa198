"""A stored table with one row a key, into which increments are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class UpsertTable:
    """upsert_by_rank over all increments so far: of each key the row of highest rank, of those the first; its order is that of the key's first row.

    Keys are dealt to buckets by hash. An increment reads the buckets of its keys and
    writes them anew, into a folder of its own; the others stay as they are. A
    bucket's rows are those of the last finished increment that has it, so a write
    that breaks off leaves the table as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _folders(self, pattern: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return [x.getPath().toString() for x in found or ()]

    def _increments(self) -> list[int]:
        return sorted(int(x.rpartition("increment=")[2]) for x in self._folders("increment=*"))

    def versions(self) -> dict[int, int]:
        """The increment that each bucket is to be read from."""
        done = {int(x.rpartition("increment=")[2].partition("/")[0]) for x in self._folders("increment=*/_SUCCESS")}
        out: dict[int, int] = {}
        for folder in self._folders("increment=*/bucket=*"):
            increment, bucket = (int(part.partition("=")[2]) for part in folder.split("/")[-2:])
            if increment in done:
                out[bucket] = max(increment, out.get(bucket, increment))
        return out

    def _stored(self, buckets: set[int] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/increment={i}/bucket={b}" for b, i in sorted(self.versions().items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*folders) if folders else None

    def merge(self, rows: DataFrame, rank: Column) -> None:
        """Takes in an increment; rank is a number of its rows."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = rows.select("*", rank.cast("double").alias("__rank"), F.col(self.order).alias("__at"), bucket.alias("bucket"))
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # a number a bucket
        if not touched:
            return
        old = self._stored(touched)
        both = new if old is None else new.unionByName(old.withColumn("bucket", bucket))
        rest = [c for c in new.columns if c not in (*self.keys, self.order, "bucket")]
        best = F.min_by(F.struct(*rest), F.struct(-F.col("__rank"), "__at"))
        merged = both.groupBy("bucket", *self.keys).agg(best.alias("__row"), F.min(self.order).alias(self.order))
        flat = merged.select("bucket", *self.keys, self.order, "__row.*")
        number = max(self._increments(), default=0) + 1
        flat.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/increment={number}")

    def rows(self) -> DataFrame:
        stored = self._stored()
        if stored is None:
            raise ValueError(f"nothing has been merged into {self.path}")
        return stored.drop("__rank", "__at")

    def forget_old(self) -> None:
        """Deletes what no bucket is read from any more."""
        now = {f"increment={i}/bucket={b}" for b, i in self.versions().items()}
        for folder in self._folders("increment=*/bucket=*"):
            if "/".join(folder.split("/")[-2:]) not in now:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
