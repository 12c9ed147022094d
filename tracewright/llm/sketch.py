"""Threshold-scaled document sketches with built-in functions only.

The sketch of a text holds the hash of every shingle of 5 consecutive words (the whole text if it has fewer) that lies
in the lowest 1/``SCALE`` of the hash range, and at least its ``LEAST`` lowest ones (all where it has fewer). Retaining
depends on the hashes alone, so sketches of parts merge by set union, cut by the same rule. Two sketches are compared up to
the hash to which both are complete, so the share of a sketch found in another estimates containment however unequal the
texts are; it is exact where both texts have fewer than ``LEAST`` shingles. A text of n < ``LEAST`` shingles has no hash in reach of a
much longer one's sketch, and so likeness 0, with chance (1 - 1/``SCALE``) ** n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import hashed_sample, shuffle_parts

SHINGLE = 5
SCALE = 8
#: Scale of the sketches of edited_fingerprints.
FINE = 2
LEAST = 64
#: Rows of which the ranges of doc_id are cut, at least.
SAMPLE = 20_000
_LOW = -(1 << 63)
_HIGH = (1 << 63) - 1


def _bound(value: Column, f) -> Column:  # noqa: ANN001
    return F.element_at(F.transform(F.array(value), f), 1)


def _limit(scale: int) -> Column:
    return F.lit(-(1 << 63) + (1 << 64) // scale)


def _lowest(h: Column, scale: int) -> Column:
    """The distinct hashes below the limit, but at least the LEAST lowest ones, sorted."""
    limit = _limit(scale)
    return _bound(
        F.sort_array(F.array_distinct(h)),
        lambda s: F.slice(s, F.lit(1), F.greatest(F.lit(LEAST), F.size(F.filter(s, lambda x: x < limit)))),
    )


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted distinct retained hashes: array<bigint>. A text without words has the hash of the empty string."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", " " * 5), " "), lambda w: w != "")

    def hashes(w: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])
        )
        return F.when(F.size(w) >= SHINGLE, many).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))

    return _bound(words, lambda w: _lowest(hashes(w), scale))


def encode(s: Column) -> Column:
    """Sketch as text: 16 hex digits a hash."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two shingle sets."""
    return _lowest(F.concat(a, b), scale)


def _shared(a: Column, b: Column, scale: int, share) -> Column:  # noqa: ANN001
    """share(a, b) of both sketches up to the hash to which both are complete; 0 where either has nothing up to there."""
    inside = _limit(scale) - 1

    def complete(s: Column) -> Column:
        return F.when(F.size(s) < LEAST, F.lit(_HIGH)).otherwise(F.greatest(F.element_at(s, -1), inside))

    def upto(s: Column, end: Column) -> Column:
        return F.when(F.element_at(s, -1) <= end, s).otherwise(F.filter(s, lambda x: x <= end))

    pair = F.struct(a.alias("a"), b.alias("b"), F.least(complete(a), complete(b)).alias("end"))
    both = _bound(pair, lambda p: F.struct(upto(p["a"], p["end"]).alias("a"), upto(p["b"], p["end"]).alias("b")))
    return _bound(both, lambda p: F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), share(p["a"], p["b"])).otherwise(F.lit(0.0)))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has too."""
    return _shared(a, b, scale, lambda x, y: F.size(F.array_intersect(x, y)) / F.size(x))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The larger of both containments: near 1 where either text is mostly held by the other. Sketches may be finer than scale."""
    return _shared(a, b, scale, lambda x, y: F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).cast("double")


def _sort_text(x: Column) -> Column:
    """16 hex digits in the order of signed numbers."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(_LOW))), 16, "0")


def _range_number(key: Column, cuts: list[str]) -> Column:
    """Number of the sorted cuts at or below key, by binary search in one literal array: the plan does not grow with them."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(cuts)), ",")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.coalesce(F.get(table, at + step - 1), F.lit("")) <= key), at + step).otherwise(at)
    )


def next_rows(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each row with the next one by ascending doc_id, after the last the first.

    Rows are dealt once, by ranges of (doc_id, hash of the text) cut at quantiles of a bounded sample, and sorted inside a
    range. The first row of each range is also dealt to the range before it (to the last one, of the first), so no row
    needs a global window. Null ids come first; rows of one id are ordered by that hash and their text, so they spread over
    ranges too: only rows wholly alike share one.
    """
    parts = parts or shuffle_parts(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("k", F.concat(_sort_text(F.coalesce("doc_id", F.lit(_LOW))), F.when(F.col("doc_id").isNull(), F.lit("0")).otherwise(F.lit("1")), _sort_text(F.xxhash64("text"))))
    n = parts * 4
    sample = sorted(r[0] for r in hashed_sample(rows.select("k"), max(SAMPLE, 20 * n), "k").collect())
    cuts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    placed = rows.withColumn("b", _range_number(F.col("k"), cuts))
    lows = placed.groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()  # a row for each range
    used = [r[0] for r in lows]
    before = dict(zip(used, [*used[-1:], *used]))
    to = F.split(F.lit(",".join(str(before.get(i, 0)) for i in range(len(cuts) + 1))), ",")
    heads = placed.where(F.col("k").isin([r[1] for r in lows])).groupBy("b").agg(F.min(F.struct("k", "text")).alias("r"))
    ghosts = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("r.text").alias("text"), F.col("r.k").alias("k"), F.get(to, F.col("b")).cast("int").alias("b"), F.lit(1).alias("ghost"))
    both = placed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    w = Window.partitionBy("b").orderBy("ghost", "k", "text")
    return both.withColumn("next_text", F.lead("text").over(w)).where("ghost = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, s, e, next_s): sketches (of scale FINE) of every text, of its edited text and of the next text.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next row's.
    Null texts count as empty. A single row is its own next row. Repeated rows stay repeated; rows of one doc_id are ordered
    by the hash of their text. Other columns are ignored; no rows give no rows.
    """
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    rows = next_rows(docs)  # sketches are made where rows have been dealt: they would add to what is dealt
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part))
    return rows.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), FINE).alias("s"),
        sketch(F.col("edited"), FINE).alias("e"),
        sketch(F.col("next_text"), FINE).alias("next_s"),
    )
