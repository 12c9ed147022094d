"""Key-value facade over sorted Parquet: point and range reads, upserts with deletes, size estimates.

A table is key, value, version, deleted; the newest version of a key counts. Every write appends a file set, ``compact``
rewrites. Key ranges are pushed down to the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyValueTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, puts: DataFrame, version: int, deletes: DataFrame | None = None, mode: str = "append") -> None:
        rows = puts.select("key", "value").withColumn("deleted", F.lit(False))
        if deletes is not None:
            rows = rows.unionByName(deletes.select("key", F.lit(None).cast(puts.schema["value"].dataType).alias("value"), F.lit(True).alias("deleted")))
        rows.withColumn("version", F.lit(version).cast("long")).repartitionByRange("key").sortWithinPartitions("key").write.mode(mode).parquet(self.path)

    def scan(self, low=None, high=None, at_version: int | None = None) -> DataFrame:  # noqa: ANN001
        """(key, value) of low <= key < high, as of a version (default: the newest), unordered; orderBy(key) iterates."""
        return latest(_between(self.spark.read.parquet(self.path), low, high, at_version))

    def get(self, keys: DataFrame) -> DataFrame:
        """Values of the given keys; missing ones are absent."""
        return latest(self.spark.read.parquet(self.path).join(keys.select("key").distinct(), "key", "left_semi"))

    def compact(self, path: str) -> KeyValueTable:
        self.scan().withColumns({"deleted": F.lit(False), "version": F.lit(0).cast("long")}).repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        return KeyValueTable(self.spark, path)

    def iterate(self, start, n: int, back: bool = False) -> DataFrame:  # noqa: ANN001
        """(place, key, value) of the n entries from start on in key order, or of those before it from the nearest down.

        A top-n by key: tasks keep n rows each, and the files' key ranges are pushed down.
        """
        rows = self.scan(high=start) if back else self.scan(low=start)
        order = F.desc("key") if back else F.asc("key")
        top = rows.orderBy(order).limit(n)
        return top.select(F.row_number().over(Window.orderBy(order)).cast("long").alias("place"), "key", "value")

    def _files(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length")

    def approximate_size(self, low=None, high=None) -> int:  # noqa: ANN001
        """Bytes of the files, each in the share of its rows that the range holds; only keys are read."""
        every = self.spark.read.parquet(self.path).select("key", F.col("_metadata.file_name").alias("file"))
        inside = (F.lit(True) if low is None else F.col("key") >= low) & (F.lit(True) if high is None else F.col("key") < high)
        shares = every.groupBy("file").agg((F.count_if(inside) / F.count("*")).alias("share"))
        return int(self._files().join(shares, "file").agg(F.sum(F.col("length") * F.col("share"))).first()[0] or 0)

    def properties(self) -> dict[str, int]:
        """Files, bytes, versions, rows, live keys of the table."""
        files = self._files().agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
        rows = self.spark.read.parquet(self.path).agg(F.countDistinct("version").alias("versions"), F.count("*").alias("rows")).first()
        return {**files.asDict(), **rows.asDict(), "keys": self.scan().count()}

    def destroy(self) -> None:
        """Removes the table's files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _between(rows: DataFrame, low, high, at_version: int | None) -> DataFrame:  # noqa: ANN001
    for bound, test in ((low, lambda: F.col("key") >= low), (high, lambda: F.col("key") < high), (at_version, lambda: F.col("version") <= at_version)):
        if bound is not None:
            rows = rows.where(test())
    return rows


def latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "version").alias("r")).where("not r.deleted").select("key", "r.value")
