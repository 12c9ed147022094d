"""Reports over hash files and traces, and evaluation of defenses and auxiliary snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.hashing import size_text
from tracewright.operators.counting import with_beside
from tracewright.operators.defense import as_stream, combined, last_plain, minhash_encrypt, scramble
from tracewright.operators.inference import Snapshot, all_numbers, as_number, basic_summary, locality_summary, snapshot
from tracewright.operators.lineage import dropped, kept
from tracewright.operators.segments import segment
from tracewright.operators.store import simulate_store
from tracewright.sources.hashfile import HEADER_BYTES, read_header
from tracewright.sources.traces import format_fp


_HEADER = "version int, files long, root string, chunks long, chunking string, chunk_size long, algorithm string, window long, prime long, modulus long, bits long, pattern long, smallest long, largest long, hashing string, hash_bits int, sysid string, start_time long, end_time long, bytes long"


def header_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per hash file: every header field. Only the bytes of a header go to Python."""
    fields = [x.split() for x in _HEADER.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [read_header(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([h[n] for h in heads], kinds[k]) for n, k in fields)], ["snapshot", *(n for n, _ in fields)])

    files = spark.read.format("binaryFile").load(path)
    heads = files.select(F.element_at(F.split("path", "/"), -1).alias("snapshot"), F.substring("content", 1, HEADER_BYTES).alias("head"))
    return heads.mapInArrow(run, f"snapshot string, {_HEADER}")


def file_report(files: DataFrame) -> DataFrame:
    return files.select("snapshot", "path", size_text(F.col("file_size")).alias("size"), "uid", "gid", F.conv(F.col("perm").cast("string"), 10, 8).alias("perm"), F.date_format("mtime", "EEE MMM dd HH:mm:ss yyyy").alias("mtime"), "chunks")


def chunk_report(chunks: DataFrame) -> DataFrame:
    return chunks.select("snapshot", "path", "chunk_no", F.concat(format_fp(F.col("fp")), F.lit("\t\t"), F.col("size"), F.lit(" \t\t\t"), F.col("cratio")).alias("line"))


def totals_report(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.sum("chunks").alias("chunks"))


def scan_totals(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files and links of a scan (kind), bytes and chunks of what was chunked."""
    kinds = entries.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "link").alias("links"))
    sizes = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("chunks"))
    return kinds.crossJoin(sizes)  # one row on either side


def latency_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, bounds, mean, standard deviation and percentiles of a measured value."""
    show = lambda c, name: F.round(c, 6).alias(name)
    quantile = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), show(F.min(value), "least"), show(F.max(value), "most"), show(F.avg(value), "mean"), show(F.stddev_pop(value), "deviation"),
        show(quantile(0.5), "median"), show(quantile(0.95), "p95"), show(quantile(0.99), "p99"),
    )


def evaluate_defense(aux: DataFrame | Snapshot, target: DataFrame, scheme: str = "combined", seg_min: int = 1 << 20, seg_max: int = 4 << 20, v: int = 30, **how) -> DataFrame:  # noqa: ANN003
    """Summary of locality-based inference against a transformed target (plain, minhash, scramble or combined); the auxiliary
    stream stays as it is."""
    if scheme == "plain":
        return locality_summary(aux, target, v=v, **how).withColumn("scheme", F.lit(scheme))
    return evaluate_segments(aux, segment(target, seg_min, seg_max), scheme, v, **how)


def evaluate_segments(aux: DataFrame | Snapshot, parts: DataFrame, scheme: str, v: int = 30, numbers: bool | None = None, **how) -> DataFrame:  # noqa: ANN003
    """evaluate_defense of a target that has been cut into segments; what it writes on the way is deleted. numbers: all
    fingerprints have 12 hex digits (looked up where not given); then they and those beside them are written as numbers, once."""
    made = {"minhash": minhash_encrypt, "scramble": scramble, "combined": combined}[scheme](parts)
    hidden = scheme != "scramble"
    name, place = "c_fp" if hidden else "fp", "seq" if scheme == "minhash" else "new_seq"
    if numbers is None:
        numbers = all_numbers(parts)
    fp = as_number if numbers else F.col
    made = made.select("stream", F.col("seg_id").alias("block"), F.col(place).alias("seq"), fp(name).alias("fp"), *([fp("fp").alias("plain"), F.col("seq").alias("was")] if hidden else []))
    made = kept(with_beside(made) if numbers else made, "made")
    target = snapshot(made.drop("plain", "was"), v)
    truth = last_plain(made) if hidden else None
    dropped(made)
    found = locality_summary(aux, target, truth=truth, v=v, **how)
    out = kept(found.withColumn("scheme", F.lit(scheme)), "evaluated")
    target.drop()
    if hidden:
        dropped(truth)
    return out


def sweep(aux: dict[str, DataFrame], target: DataFrame, attack: str = "locality", **how) -> DataFrame:  # noqa: ANN003
    """One summary row for each auxiliary snapshot; snapshots that are None are left out."""
    one = (lambda a: basic_summary(a, target)) if attack == "basic" else (lambda a: locality_summary(a, target, **how))
    return reduce(DataFrame.unionByName, [one(a).withColumn("aux", F.lit(k)) for k, a in aux.items() if a is not None])


def snapshot_matrix(chunks: DataFrame, user: str, snapshot: str) -> DataFrame:
    """Basic frequency analysis of each user's last snapshot by each of the ones before: (user, aux, unique_chunks, correct, rate).

    All cells at once: ranks are windows within (user, snapshot), and equal ranks are joined. A user with one snapshot has
    no cell; snapshots that are not there leave none.
    """
    f = chunks.groupBy(user, snapshot, "fp").agg(F.count("*").alias("cnt"))
    ranked = f.withColumn("rank", F.row_number().over(Window.partitionBy(user, snapshot).orderBy(F.desc("cnt"), "fp")))
    last = f.groupBy(user).agg(F.max(snapshot).alias("last"))
    ranked = ranked.join(last, user)
    target = ranked.where(F.col(snapshot) == F.col("last")).select(user, "rank", F.col("fp").alias("c_fp"))
    unique = target.groupBy(user).agg(F.count("*").alias("unique_chunks"))
    pairs = ranked.where(F.col(snapshot) < F.col("last")).join(target, [user, "rank"])
    cells = pairs.groupBy(user, F.col(snapshot).alias("aux")).agg(F.count_if(F.col("fp") == F.col("c_fp")).alias("correct")).join(unique, user)
    return cells.select(user, "aux", "unique_chunks", "correct", F.round(F.lit(100.0) * F.col("correct") / F.col("unique_chunks"), 6).alias("rate"))


def store_by_scheme(target: DataFrame, seg_min: int, seg_max: int, **how) -> DataFrame:  # noqa: ANN003
    """Store accesses of the plain stream and of the combined scheme."""
    target = kept(target, "trace")
    made = as_stream(combined(segment(target, seg_min, seg_max)), "c_fp", "new_seq")
    return simulate_store(target, **how).withColumn("scheme", F.lit("plain")).unionByName(simulate_store(made, **how).withColumn("scheme", F.lit("combined")))
