"""Shared pieces: the shared scratch folder, materialised intermediates and connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that goes to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session in one process (tests) may leave it unnamed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """While active, Spark removes an action's shuffle files as soon as the action ends."""
    before = spark.conf.get(_CLEANUP, None)
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            if before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


class Tables:
    """Intermediates written as Parquet in the shared folder: lineage is cut and lost executors cost nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch", None)
        if path:
            delete_path(self.spark, path)
            self.paths.remove(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches in bytes, unless it has a bound: 10,000 rows of whole texts have none.

    It stays set, since the frames that operators return are run later.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows of df, those of least hash of the keys (ties by the keys).

    A threshold from the row count lets about twice as many rows through first, so no task sends more than its share.
    """
    total = df.count()
    if total > 4 * most:
        df = df.where(F.xxhash64(*keys) < F.lit(-(1 << 63) + (1 << 64) * 2 * most // total))
    return df.orderBy(F.xxhash64(*keys), *keys).limit(most)


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src long, dst long) -> (id, root): root is the smallest id of the component.

    Alternating large-star and small-star steps; each is one grouped minimum and one equi-join whose other side has
    one row per node, so a hub with very many neighbours can be split by adaptive execution. Ids that are in no edge
    are not returned. An empty input gives an empty result.
    """
    tables = Tables(spark)
    cur = tables.keep(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        # large star: every neighbour above the node is linked to the smallest neighbour (or the node itself)
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below the node, and the node, are linked to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = tables.keep(small, "edges")
        stat = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.drop(cur)
        cur = new
        if tuple(stat) == before:
            break
        before = tuple(stat)
    else:
        raise RuntimeError("components did not converge")
    roots = cur.select("v").distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("root"))
    )
