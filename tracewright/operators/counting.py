"""Frequencies, neighbours, duplicates and ranks of chunk streams, on built-in operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(chunks: DataFrame) -> DataFrame:
    """(fp, cnt)"""
    return chunks.groupBy("fp").agg(F.count("*").alias("cnt"))


def numbered(rows: DataFrame, cls: Column, *order) -> DataFrame:  # noqa: ANN002
    """rows with number 0, 1, ... by (class, order): windows within classes, and offsets from a row for each class.

    The classes must ascend with the order; only their counts are numbered in one task.
    """
    rows = rows.withColumn("_class", cls)
    before = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_class").agg(F.count("*").alias("n")).select("_class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_class").orderBy(*order))
    return rows.withColumn("_own", own).join(base, "_class").withColumn("number", F.col("_base") + F.col("_own") - 1).drop("_class", "_own", "_base")


def adjacent(chunks: DataFrame, spread: int = 4096) -> DataFrame:
    """chunks and prev: the fingerprint before, within the stream (null for a stream's first).

    The window is over a block of a stream. Between blocks the last fingerprint is carried by windows over a row for each
    block, `spread` block numbers at a time, and between those by a row for each, so a single long stream still spreads
    over all tasks.
    """
    inside = Window.partitionBy("stream", "block").orderBy("seq")
    last = chunks.groupBy("stream", "block").agg(F.max_by("fp", "seq").alias("last"))
    rows = chunks.withColumns({"own": F.lag("fp").over(inside), "first": F.row_number().over(inside) == 1})
    carried = with_before(last, spread).select("stream", "block", "before")
    return rows.join(carried, ["stream", "block"]).withColumn("prev", F.when(F.col("first"), F.col("before")).otherwise(F.col("own"))).drop("own", "first", "before")


def with_beside(chunks: DataFrame) -> DataFrame:
    """chunks with own and nxt: the fingerprints before and behind within the block of the stream (null at its ends)."""
    w = Window.partitionBy("stream", "block").orderBy("seq")
    return chunks.withColumns({"own": F.lag("fp").over(w), "nxt": F.lead("fp").over(w)})


def with_before(last: DataFrame, spread: int = 4096) -> DataFrame:
    """last, a row for each block with its last fingerprint, and before: that of the block before in the stream."""
    last = last.withColumn("part", F.floor(F.col("block") / spread))
    ends = last.groupBy("stream", "part").agg(F.max_by("last", "block").alias("end"))
    ends = ends.select("stream", "part", F.lag("end").over(Window.partitionBy("stream").orderBy("part")).alias("outer"))
    near = F.lag("last").over(Window.partitionBy("stream", "part").orderBy("block"))
    return last.withColumn("near", near).join(ends, ["stream", "part"]).withColumn("before", F.coalesce("near", "outer")).drop("near", "outer", "part")


def nul_truncated(fp: Column) -> Column:
    """Bytes from the first zero byte on become zero bytes."""
    return F.rpad(F.regexp_extract(fp, "^((?:0[1-9a-f]|[1-9a-f].)*)", 1), 12, "0")


def neighbors(chunks: DataFrame, side: str, nul_truncate: bool = False) -> DataFrame:
    """(fp, nfp, cnt, first_seq): co-occurrence with the left or right neighbour; first_seq is the later chunk's place.

    nul_truncate: neighbours (not the fingerprints that they stand beside) end at their first zero byte.
    """
    pairs = adjacent(chunks).where("prev is not null")
    fp, nfp = ("fp", "prev") if side == "left" else ("prev", "fp")
    beside = nul_truncated(F.col(nfp)) if nul_truncate else F.col(nfp)
    return pairs.groupBy(F.col(fp).alias("fp"), beside.alias("nfp")).agg(F.count("*").alias("cnt"), F.min("seq").alias("first_seq"))


def top_neighbors(nbr: DataFrame, v: int) -> DataFrame:
    """The v most frequent neighbours of each fingerprint; rk counts from the most frequent, up from the least of those."""
    w = Window.partitionBy("fp").orderBy(F.desc("cnt"), "first_seq", "nfp")
    kept = nbr.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= v)
    return kept.withColumn("up", F.count("*").over(Window.partitionBy("fp")) - F.col("rk") + 1)


def frequency_rank(freq: DataFrame, digits: int = 3) -> DataFrame:
    """freq with rank 1, 2, ... by (cnt descending, fp).

    No global sort: rows are ranked within (cnt, first digits of fp) and shifted by the number of rows of the classes
    before, which come from one small aggregate. A count has 16 ** digits classes: take more digits where those of a
    single count would be too large for a task.
    """
    rows = freq.withColumn("cls", F.substring("fp", 1, digits))
    sizes = rows.groupBy("cnt", "cls").agg(F.count("*").alias("n"))
    higher = sizes.groupBy("cnt").agg(F.sum("n").alias("n"))
    above = higher.select("cnt", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    shift = sizes.join(above, "cnt").select(
        "cnt", "cls", (F.col("above") + F.coalesce(F.sum("n").over(Window.partitionBy("cnt").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("shift")
    )
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("cnt", "cls").orderBy("fp")))
    return ranked.join(shift, ["cnt", "cls"]).select("fp", "cnt", (F.col("own") + F.col("shift")).alias("rank"))


def top_frequencies(freq: DataFrame, u: int) -> DataFrame:
    """The u most frequent fingerprints with their rank."""
    top = freq.orderBy(F.desc("cnt"), "fp").limit(u)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "fp")))


def dedup_stats(chunks: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """One row: chunks, bytes, duplicates and logical / physical ratios; duplicate bytes are those of later occurrences."""
    rows = chunks.where(~F.col("fp").isin(*skip)) if skip else chunks
    per = rows.groupBy("fp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min_by("size", F.struct("stream", "seq")).alias("first"))
    total = per.agg(F.sum("n").alias("chunks"), F.sum("bytes").alias("bytes"), F.sum(F.col("n") - 1).alias("dup_chunks"), F.sum(F.col("bytes") - F.col("first")).alias("dup_bytes"))
    files = rows.select("stream", "block").distinct().agg(F.count("*").alias("files"))
    return files.crossJoin(total).select(  # one row on either side
        "files", "chunks", "bytes", "dup_chunks", "dup_bytes",
        F.round(F.col("chunks") / (F.col("chunks") - F.col("dup_chunks")), 6).alias("chunk_ratio"),
        F.round(F.col("bytes") / (F.col("bytes") - F.col("dup_bytes")), 6).alias("byte_ratio"),
    )


def first_occurrences(chunks: DataFrame) -> DataFrame:
    """Each fingerprint's first place by (stream, seq), and its size there."""
    return chunks.groupBy("fp").agg(F.min(F.struct("stream", "seq", "size")).alias("p")).select("fp", "p.stream", "p.seq", "p.size")


def xor_hash(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Bytewise XOR of the fingerprints of each group, as 12 hex digits."""
    value: Column = F.conv("fp", 16, 10).cast("long")
    return chunks.groupBy(*keys).agg(F.lpad(F.lower(F.hex(F.bit_xor(value))), 12, "0").alias("xor_hash"))
