"""Bytes to chunks: fixed, Rabin, simple-match and random cuts, and the scan that hashes and measures them."""

from __future__ import annotations

import math
import os
import random
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.hashing import hash_column, ratio_column

RABIN_PRIME = 1048583  # fixed value
RABIN_MODULUS = 1 << 30  # fixed value
#: Bytes that a file is read by.
READ_BYTES = 8 << 20


@dataclass(frozen=True)
class VariableParams:
    """Defaults are fixed values: window 48, 13 bits of pattern 1fff, chunks of 2048 to 16384 bytes."""

    window: int = 48
    bits: int = 13
    pattern: int = 0x1FFF
    smallest: int = 2048
    largest: int = 16384
    tails: bool = True
    seed: int = 0

    def __post_init__(self) -> None:
        if self.largest < self.smallest:
            raise ValueError("the largest chunk is smaller than the smallest")

    @classmethod
    def parse(cls, text: str) -> VariableParams:
        """'win_size=48:match_bits=13:pattern=1fff:min_csize=2048:max_csize=16384:tails=on'"""
        names = {"win_size": "window", "match_bits": "bits", "min_csize": "smallest", "max_csize": "largest"}
        out: dict = {}
        for item in filter(None, text.split(":")):
            k, v = item.split("=", 1)
            out[names.get(k, k)] = v == "on" if k == "tails" else int(v, 16) if k == "pattern" else int(v)
        return cls(**out)

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1


def rabin_marks(data: bytes, p: VariableParams) -> np.ndarray:
    """Window ends (exclusive) whose polynomial matches. Modulus and mask are powers of two, so 64-bit wrap-around is exact."""
    if len(data) < p.window:
        return np.empty(0, np.int64)
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    value = np.zeros(len(x) - p.window + 1, np.uint64)
    for j in range(p.window):
        value = value * np.uint64(RABIN_PRIME) + x[j : j + len(value)]
    value &= np.uint64(RABIN_MODULUS - 1)
    return np.flatnonzero(value & np.uint64(p.mask) == np.uint64(p.pattern & p.mask)) + p.window


def simple_marks(data: bytes, p: VariableParams) -> np.ndarray:
    """Ends of the first bytes whose little-endian value matches in the mask."""
    n = -(-p.bits // 8)
    if len(data) < n:
        return np.empty(0, np.int64)
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    value = sum((x[j : len(x) - n + 1 + j] << np.uint64(8 * j) for j in range(n)), np.zeros(len(x) - n + 1, np.uint64))
    return np.flatnonzero(value & np.uint64(p.mask) == np.uint64(p.pattern & p.mask)) + n


def _cut(data: bytes, p: VariableParams, marks: np.ndarray, window: int, latest: int) -> list[tuple[int, int]]:
    """From each cut on: the first mark at least `smallest` (a window, if that is larger) and below `latest` bytes on, else
    `largest` bytes; what is left at the end is a chunk if tails are kept."""
    out, at = [], 0
    first = max(p.smallest, window)
    while at < len(data):
        k = np.searchsorted(marks, at + first)
        if k < len(marks) and marks[k] < at + latest and len(data) - at >= p.smallest:
            end = int(marks[k])
        elif len(data) - at >= p.largest:
            end = at + p.largest
        else:
            break
        out.append((at, end - at))
        at = end
    if at < len(data) and p.tails:
        out.append((at, len(data) - at))
    return out


def rabin_chunks(data: bytes, p: VariableParams = VariableParams()) -> list[tuple[int, int]]:
    return _cut(data, p, rabin_marks(data, p), p.window, p.largest)


def simple_chunks(data: bytes, p: VariableParams = VariableParams()) -> list[tuple[int, int]]:
    return _cut(data, p, simple_marks(data, p), -(-p.bits // 8), p.largest)


def random_chunks(data: bytes, p: VariableParams = VariableParams(), path: str | None = None) -> list[tuple[int, int]]:
    """Each place from `smallest` on is a cut with probability 2^-bits; repeatable for equal seed, path and length.

    How far the next cut is comes from one draw of the geometric distribution.
    """
    draw = random.Random(f"{p.seed}-{path}-{len(data)}")
    chance = 1 / (p.mask + 1)
    out, at = [], 0
    while len(data) - at >= p.smallest:
        end = p.smallest + (int(math.log(1 - draw.random()) / math.log1p(-chance)) if chance < 1 else 0)
        if end >= min(len(data) - at + 1, p.largest):
            if len(data) - at < p.largest:
                break
            end = p.largest
        out.append((at, end))
        at += end
    if at < len(data) and p.tails:
        out.append((at, len(data) - at))
    return out


def fixed_chunks(data: bytes, size: int = 4096, tails: bool = True) -> list[tuple[int, int]]:
    return [(i, min(size, len(data) - i)) for i in range(0, len(data), size) if tails or i + size <= len(data)]


CHUNKERS: dict[str, Callable[[bytes, VariableParams], list[tuple[int, int]]]] = {
    "rabin": rabin_chunks,
    "simple": simple_chunks,
    "random": random_chunks,
    "fixed": lambda data, p: fixed_chunks(data, p.smallest, p.tails),
}


def chunk_files(files: DataFrame, method: str = "rabin", params: VariableParams = VariableParams(), hashing: str = "md5-48bit", ratio: str = "none") -> DataFrame:
    """files (path, content) -> (path, chunk_no, offset, size, fp, cratio)."""
    return multi_scan(files, [{"method": method, "params": params, "hashing": hashing, "ratio": ratio}]).drop("config")


def multi_scan(files: DataFrame, configs: list[dict]) -> DataFrame:
    """Several chunkings of the same files in one pass over them, told apart by `config`; each as chunk_files."""
    ways = [(c.get("method", "rabin"), c.get("params", VariableParams())) for c in configs]
    fields = ["config", "path", "chunk_no", "offset", "size", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, (method, params) in enumerate(ways):
                    cuts = random_chunks(data or b"", params, path) if method == "random" else CHUNKERS[method](data or b"", params)
                    for a in range(0, len(cuts), 4096):
                        part = cuts[a : a + 4096]
                        columns = ([k] * len(part), [path] * len(part), range(a, a + len(part)), [o for o, _ in part], [n for _, n in part], [data[o : o + n] for o, n in part])
                        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], fields)

    def own(make, name: str, default: str) -> Column:  # noqa: ANN001
        """make(data, method) by the config of a row."""
        found = {c.get(name, default) for c in configs}
        if len(found) == 1:
            return make(F.col("data"), found.pop())
        return F.coalesce(*[F.when(F.col("config") == k, make(F.col("data"), c.get(name, default))) for k, c in enumerate(configs)])

    cut = files.select("path", "content").mapInArrow(run, "config int, path string, chunk_no long, offset long, size long, data binary")
    return cut.select("config", "path", "chunk_no", "offset", "size", own(hash_column, "hashing", "md5-48bit").alias("fp"), own(ratio_column, "ratio", "none").alias("cratio"))


def stream_chunks(blocks: Iterator[bytes], method: str = "rabin", params: VariableParams = VariableParams()) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the chunks of a file that is read block by block: fixed, rabin or simple.

    Where a chunk ends depends on the longest chunk's bytes behind its start alone, so it is settled once those are there;
    what is held is a block and two such chunks.
    """
    if method == "random":
        raise ValueError("random cuts are drawn for whole files")
    longest = params.smallest if method == "fixed" else params.largest
    inner = replace(params, tails=False)
    held, base = b"", 0
    for block in blocks:
        held += block
        if len(held) < 2 * longest:
            continue
        at = 0
        for start, n in CHUNKERS[method](held, inner):
            if start + longest > len(held):
                break
            yield base + start, held[start : start + n]
            at = start + n
        held, base = held[at:], base + at
    for start, n in CHUNKERS[method](held, params):
        yield base + start, held[start : start + n]


def chunk_paths(paths: DataFrame, method: str = "rabin", params: VariableParams = VariableParams(), hashing: str = "md5-48bit", ratio: str = "none", block: int = READ_BYTES) -> DataFrame:
    """(path, chunk_no, offset, size, fp, cratio) of files that executors open themselves (column path), however large.

    As chunk_files, which needs a whole file in a row but reads whatever Spark reads.
    """

    def blocks(path: str) -> Iterator[bytes]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(name) as f:
            while data := f.read(block):
                yield data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                found = enumerate(stream_chunks(blocks(path), method, params))
                while piece := list(islice(found, 256)):
                    rows = [(path, k, at, len(data), data) for k, (at, data) in piece]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "chunk_no", "offset", "size", "data"])

    cut = paths.select("path").mapInArrow(run, "path string, chunk_no long, offset long, size long, data binary")
    return cut.select("path", "chunk_no", "offset", "size", hash_column(F.col("data"), hashing).alias("fp"), ratio_column(F.col("data"), ratio).alias("cratio"))


def list_entries(root: str, same_device: bool = False) -> Iterator[tuple[str, str, str | None, int]]:
    """(path, kind, target, size) of what is below a local folder: file, link (with its target), device; folders are walked.

    Links are not followed; sockets and pipes are left out; same_device stays on the root's file system.
    """
    here = os.lstat(root).st_dev
    todo = [root]
    while todo:
        with os.scandir(todo.pop()) as found:
            for e in sorted(found, key=lambda e: e.name):
                info = e.stat(follow_symlinks=False)
                if same_device and info.st_dev != here:
                    continue
                if stat.S_ISDIR(info.st_mode):
                    todo.append(e.path)
                elif stat.S_ISLNK(info.st_mode):
                    yield e.path, "link", os.readlink(e.path), info.st_size
                elif stat.S_ISREG(info.st_mode):
                    yield e.path, "file", None, info.st_size
                elif stat.S_ISBLK(info.st_mode):
                    yield e.path, "device", None, info.st_size


def scan_entries(spark: SparkSession, root: str, same_device: bool = False) -> DataFrame:
    """Entries of a folder that every executor sees; each folder directly below it is walked by a task of its own."""
    top = [e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and not (same_device and e.stat().st_dev != os.lstat(root).st_dev)]
    fields = "path string, kind string, target string, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = list_entries(folder, same_device)
                while piece := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece), (pa.string(), pa.string(), pa.string(), pa.int64()))], ["path", "kind", "target", "size"])

    own = spark.createDataFrame([x for x in list_entries_flat(root)], fields)
    below = spark.createDataFrame([(x,) for x in top], "folder string").repartition(max(1, len(top))).mapInArrow(run, fields)
    return own.unionByName(below)


def list_entries_flat(root: str) -> Iterator[tuple[str, str, str | None, int]]:
    """Files and links directly in a folder."""
    with os.scandir(root) as found:
        for e in sorted(found, key=lambda e: e.name):
            info = e.stat(follow_symlinks=False)
            if stat.S_ISLNK(info.st_mode):
                yield e.path, "link", os.readlink(e.path), info.st_size
            elif stat.S_ISREG(info.st_mode):
                yield e.path, "file", None, info.st_size


def scan_directory(spark: SparkSession, root: str, method: str = "rabin", **how) -> DataFrame:  # noqa: ANN003
    """Chunks of every regular file below root; links, devices and pipes have none (scan_entries lists them).

    Folders that executors see themselves are read in blocks; files elsewhere, and for random cuts, come whole through
    Spark's reader.
    """
    local = "://" not in root or root.startswith("file://")
    if local and method != "random":
        found = scan_entries(spark, root.removeprefix("file://")).where("kind = 'file'").select("path")
        return chunk_paths(found, method, **how)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if local:  # Spark's reader follows links
        kinds = scan_entries(spark, root.removeprefix("file://")).where("kind = 'file'").select(F.concat(F.lit("file:"), "path").alias("path"))
        files = files.join(kinds, "path", "left_semi")
    return chunk_files(files, method, **how)
