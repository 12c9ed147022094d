"""SimHash near-duplicate groups with pigeonring candidate filtering.

Fingerprints of 64 bits are cut into ``SEGMENTS`` = 8 bytes laid on a ring. With at most 3 differing bits, the
pigeonring principle says that from some byte on, every chain of l consecutive bytes differs in at most
floor(3 * l / 8) bits: 0, 0, 1, 1, 1, 2, 2, 3 bits. So the two fingerprints agree in the first two bytes and in two of the
next three of some chain: 8 * 3 keys of 32 exact bits, an equi-join. Inside a key, whatever its size, candidates must stay
within the budgets of its chain, longer and longer, before the full Hamming check; a pair that leaves them is found under
the chain that it keeps.

Within a key no pairs are emitted: a task keeps the spanning forest of the links. Keys of over ``HOT`` distinct
fingerprints are cut further by bits that the key leaves free: at most 3 of those differ, so of any four parts one is equal
and four narrower keys hold every link. Each cut fixes a quarter of the free bits (32, 24, 18, 14, 11 ...), and a key with w
free bits holds at most 2**w fingerprints, so no group stays above ``HOT`` = 2**12.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Tables, bound_batches, connected_components

SEED = 42
DISTANCE = 3
SEGMENTS = 8
HOT = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles; no words (null, empty): 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - 2)
    if len(words) < 3:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-3].tolist()] if n > 1 else [0]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist())]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = (counts.reshape(64) * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, fp long[, row long]): one row per row of docs, whole texts, one pass, no shuffle; row is handed through."""
    bound_batches(docs.sparkSession)
    more = [] if row is None else [row.cast("long").alias("row")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(
        _fingerprints, "doc_id long, fp long" + ", row long" * len(more)
    )


def _byte(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, 8 * (k % SEGMENTS)).bitwiseAND(F.lit(255).cast("long"))


def chain_keys(fp: Column) -> Column:
    """The 24 keys (chain number << 32 | 32 exact bits) of a fingerprint."""
    out = []
    for i in range(SEGMENTS):
        for skip in range(3):
            parts = [i, i + 1, *(i + 2 + j for j in range(3) if j != skip)]
            bits = reduce(lambda a, k: F.shiftleft(a, 8).bitwiseOR(_byte(fp, k)), parts, F.lit(i * 3 + skip).cast("long"))
            out.append(bits)
    return F.array(*out)


def _rotated(x: np.ndarray, chain: np.ndarray | int) -> np.ndarray:
    """Byte `chain` first."""
    by = np.uint64(8) * np.asarray(chain, np.uint64)
    return (x >> by) | (x << ((np.uint64(64) - by) & np.uint64(63)))


def _near(d: np.ndarray) -> np.ndarray:
    """Places of the differences, rotated to their chain, that keep its budgets and DISTANCE."""
    at = np.arange(len(d))
    for n in range(1, SEGMENTS + 1):
        budget = DISTANCE * n // SEGMENTS
        if n < SEGMENTS and budget == DISTANCE * (n + 1) // SEGMENTS:
            continue  # the longer chain has the same budget
        kept = np.bitwise_count(d & np.uint64((1 << 8 * n) - 1)) <= budget
        at, d = at[kept], d[kept]
    return at


def _forest(fps: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) of the components of fps under the chain's budgets, without listing pairs."""
    src, dst = [], []
    left = fps
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = _near(_rotated(left ^ front.pop(), chain))
            if len(near):
                got = left[near]
                left = np.delete(left, near)
                front.extend(got)
                src.append(np.full(len(got), root))
                dst.append(got)
    if not src:
        return fps[:0], fps[:0]
    return np.concatenate(src), np.concatenate(dst)


def _chain_of(keys: np.ndarray) -> np.ndarray:
    """First byte of a key's chain; refined keys are negative and end in it."""
    u = keys.view(np.uint64)
    return np.where(keys < 0, u & np.uint64(7), (u >> np.uint64(32)) // np.uint64(3)).astype(np.uint64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the links within each key."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[cut, len(keys)])
        two = cut[size == 2]
        u = fps.view(np.uint64)
        ok = _near(_rotated(u[two] ^ u[two + 1], _chain_of(keys[two])))
        src, dst = [u[two][ok]], [u[two + 1][ok]]
        for a, n in zip(cut[size > 2], size[size > 2]):
            s, d = _forest(np.unique(u[a : a + n]), int(_chain_of(keys[a : a + 1])[0]))
            src.append(s)
            dst.append(d)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(src).view(np.int64)), pa.array(np.concatenate(dst).view(np.int64))], ["src", "dst"]
        )

    for b in batches:
        k = np.r_[held_k, b.column(0).to_numpy()]
        f = np.r_[held_f, b.column(1).to_numpy()]
        if not len(k):
            continue
        whole = np.searchsorted(k, k[-1], "left")  # the last key may go on in the next batch
        held_k, held_f = k[whole:], f[whole:]
        if whole:
            yield solve(k[:whole], f[:whole])
    if len(held_k):
        yield solve(held_k, held_f)


def _sized(keyed: DataFrame, tables: Tables) -> DataFrame:
    """keyed with n, the rows of its key, where that is over 1. The sizes are written, so a hot key can be split in the join."""
    sizes = tables.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return tables.keep(keyed.join(sizes, "key"), "keyed")


def _refine(hot: DataFrame, tables: Tables) -> list[DataFrame]:
    """Groups of over HOT fingerprints: four narrower keys each, again and again. Returns (key, fp) frames to solve."""
    chain = F.expr("cast(shiftright(key, 32) as int)")
    first, skip = F.floor(chain / 3).cast("int"), chain % 3
    byte = lambda k: F.call_function("shiftrightunsigned", F.col("fp"), (k % SEGMENTS * 8).cast("int")).bitwiseAND(F.lit(255).cast("long"))
    free = [byte(first + 2 + skip), *(byte(first + j) for j in (5, 6, 7))]  # the bytes that the key leaves free
    rest = reduce(lambda a, c: F.shiftleft(a, 8).bitwiseOR(c), free)
    hot = hot.select("key", "fp", first.cast("long").alias("chain"), rest.alias("rest"))
    done = []
    width = 8 * len(free)
    while width > DISTANCE:
        part = width // (DISTANCE + 1)
        cuts = []
        for k in range(DISTANCE + 1):
            low = F.col("rest").bitwiseAND(F.lit((1 << part * k) - 1).cast("long"))
            mine = F.shiftright("rest", part * k).bitwiseAND(F.lit((1 << part) - 1).cast("long"))
            high = F.shiftleft(F.shiftright("rest", part * (k + 1)), part * k)
            key = F.xxhash64("key", F.lit(width), F.lit(k), mine).bitwiseAND(F.lit(~7)).bitwiseOR(F.col("chain")).bitwiseOR(F.lit(-(1 << 63)))
            cuts.append(F.struct(key.alias("key"), low.bitwiseOR(high).alias("rest")))
        kept = _sized(hot.select(F.explode(F.array(*cuts)).alias("c"), "fp", "chain").select("c.key", "fp", "chain", "c.rest"), tables)
        width -= part
        done.append(kept.where(F.col("n") <= HOT).select("key", "fp"))
        hot = kept.where(F.col("n") > HOT).drop("n")
        if hot.isEmpty():
            return done
    return [*done, hot.select("key", "fp")]


def candidate_groups(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (key, fp): every pair within 3 bits shares a key of whose chain it keeps the budgets."""
    tables = Tables(fps.sparkSession)
    many = _sized(fps.select(F.explode(chain_keys(F.col("fp"))).alias("key"), "fp"), tables)
    frames = [many.where(F.col("n") <= HOT).select("key", "fp")]
    hot = many.where(F.col("n") > HOT).select("key", "fp")
    if not hot.isEmpty():
        frames += _refine(hot, tables)
    return reduce(DataFrame.unionByName, frames)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (src, dst) whose components are those of all pairs within 3 bits."""
    rows = candidate_groups(fps).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_links, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id[, group_id, row]) for every row of docs.

    * A null text has no words; no words give fingerprint zero, linked like any other.
    * component_id is the smallest non-null doc_id of the rows reachable over links of at most 3 differing bits; it is
      null only where every such row has a null doc_id. Repeated rows stay repeated.
    * Equal fingerprints (exact copies above all) are one node, so a group of copies costs one row in every join.
    * With row, a long made from docs, it is handed through, and group_id tells components apart, those without an id too.
    * Other columns of docs are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = tables.keep(fingerprints(docs, row), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = tables.keep(nodes, "nodes")
    links = tables.keep(link_fingerprints(nodes.select("fp")), "links")
    comp = connected_components(spark, links).withColumnRenamed("id", "fp")
    rooted = nodes.join(comp, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    more = [] if row is None else ["group_id", "row"]
    named = tables.keep(rooted.join(lows, "root").select("fp", "component_id", *([F.col("root").alias("group_id")] if more else [])), "components")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *more
    )
