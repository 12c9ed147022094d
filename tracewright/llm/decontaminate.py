"""Benchmark decontamination by winnowing, with built-in functions only.

A window is 13 consecutive item words (a shorter item is one window). Texts are fingerprinted by keeping the least 7-word
hash of every 7 consecutive ones: 7 + 7 - 1 = 13 words, so two texts that share 13 words share a kept hash. The join of
kept hashes gives diagonals (document, item, shift); each is extended over the whole item, word by word, and every 13
equal words in a row are a hit. Items of under 13 words are looked up by the hash of all their words.

The fingerprints of the benchmark, and the keys of the texts that hold one, are broadcast only where their counted number is
within ``BROADCAST_ROWS``; beyond that both sides are shuffled, one row per hash or key on the smaller side. Of equal texts
only the rows of the least doc_id are read again, so copies are never dealt by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Tables

WINDOW = 13
GRAM = 7
BROADCAST_ROWS = 200_000
#: ASCII characters that end a word become spaces; A-Z become a-z.
_ENDS = "".join(map(chr, [*range(0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_FROM = _ENDS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = " " * len(_ENDS) + "abcdefghijklmnopqrstuvwxyz"


def bench_words(text: Column) -> Column:
    """Lower-cased A-Z, runs of digits, letters and everything beyond ASCII; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _FROM, _TO), " "), lambda w: w != "")


def _bound(value: Column, f) -> Column:  # noqa: ANN001
    """f(value) with value computed once, where f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of every k consecutive words (none if there are fewer)."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def winnow(words: Column) -> Column:
    """Distinct least hashes of each 7 consecutive 7-word hashes: array<bigint>."""
    span = WINDOW - GRAM + 1

    def least(h: Column) -> Column:
        return F.when(
            F.size(h) >= span,
            F.array_distinct(
                F.transform(F.sequence(F.lit(0), F.size(h) - span), lambda i: F.least(*[F.get(h, i + j) for j in range(span)]))
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return _bound(words, lambda w: _bound(gram_hashes(w, GRAM), least))


def text_key(text: Column) -> Column:
    """What texts are judged by: rows of one key have one verdict."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", bench_words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items, contaminated) for every row of docs; key is text_key of its text.

    n_hit counts the words inside any occurrence of a window, items are the ids (strings, sorted) of the items with
    occurring windows, contaminated means n_hit > 0 and 20 * n_hit >= n_words.

    * A null or empty text has no words and no hit; an item without words has no window; items with a null id count as
      one item without a name: their words are hit, they are not listed.
    * Repeated rows and rows that share a doc_id are judged one by one, by their own text.
    * Other columns are ignored. No documents give no rows; no items give no hit.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    # the text itself is the key of what follows: equal texts are judged once and rows need no unique id
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", text_key(F.col("text")))
    items = tables.keep(_items(benchmark), "items")
    short_sizes = [r[0] for r in items.where(F.size("item_words") < WINDOW).select(F.size("item_words")).distinct().collect()]  # at most 12
    marks = items.where(F.size("item_words") >= WINDOW).select(F.explode(winnow(F.col("item_words"))).alias("fp"))
    for m in short_sizes:
        marks = marks.unionByName(
            items.where(F.size("item_words") == m).select(F.explode(gram_hashes(F.col("item_words"), m)).alias("fp"))
        )
    marks = tables.keep(marks.distinct(), "marks")
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)

    def kept(words: Column) -> Column:
        return F.concat(winnow(words), *[gram_hashes(words, m) for m in short_sizes]) if short_sizes else winnow(words)

    # the one pass over all texts: a row with the word count (no hash), and one for each kept hash of the benchmark's
    words = bench_words(F.col("text"))
    head = F.array(F.xxhash64("key", "doc_id"))  # the row with the count: any number that deals it well
    judged = (
        rows.select("doc_id", "key", _bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(head, kept(w)).alias("fps"))).alias("r"))
        .select("doc_id", "key", "r.n_words", F.posexplode("r.fps").alias("place", "fp"))
        .join(marks.withColumn("known", F.lit(True)), "fp", "left")
        .where("place = 0 or known")
        .select("doc_id", "key", "n_words", (F.col("place") > 0).alias("suspect"))
    )
    judged = tables.keep(judged, "judged")
    counted = judged.where("not suspect").select("doc_id", "key", "n_words")
    row_id = F.coalesce("doc_id", F.lit(-(1 << 63)))
    suspects = tables.keep(judged.where("suspect").groupBy("key").agg(F.min(row_id).alias("row_id")), "suspect-keys")
    texts = rows.withColumn("row_id", row_id).join(_maybe_broadcast(suspects), ["key", "row_id"], "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    texts = tables.keep(texts.select("key", bench_words(F.col("text")).alias("words")), "suspects")

    def positions(side: DataFrame, words_col: str, keep: list[str], name: str) -> DataFrame:
        """Every place of every kept hash."""
        w = F.col(words_col)
        out = side.where(F.size(w) >= GRAM).select(*keep, F.posexplode(_bound(w, lambda x: gram_hashes(x, GRAM))).alias(name, "fp"))
        kept = side.where(F.size(w) >= WINDOW).select(*keep, F.explode(winnow(w)).alias("fp")) if name == "j" else None
        return out if kept is None else out.join(kept.distinct(), [*keep, "fp"], "left_semi")

    long_items = items.where(F.size("item_words") >= WINDOW).withColumn("item_key", F.sha2(F.concat_ws(" ", "item_words"), 256))
    item_bodies = long_items.groupBy("item_key").agg(F.first("item_words").alias("item_words"))
    item_marks = positions(item_bodies, "item_words", ["item_key"], "j")
    doc_marks = positions(texts, "words", ["key"], "i")
    diagonals = doc_marks.join(_maybe_broadcast(item_marks), "fp").select("key", "item_key", (F.col("i") - F.col("j")).alias("shift")).distinct()
    diagonals = tables.keep(diagonals, "diagonals")

    # extend each diagonal over the item
    m = F.size("item_words")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(m, F.size("words") - F.col("shift")) - 1
    # the places that differ cut the diagonal into runs of equal words
    differ = F.filter(F.sequence(first, last), lambda t: F.get("item_words", t) != F.get("words", t + F.col("shift")))
    runs = _bound(
        F.concat(F.array(first - 1), differ, F.array(last + 1)),
        lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda k: F.struct((F.get(x, k) + 1).alias("a"), (F.get(x, k + 1) - F.get(x, k) - 1).alias("n"))),
    )
    extended = (
        diagonals.join(texts, "key")
        .join(item_bodies, "item_key")
        .where(last - first + 1 >= WINDOW)
        .select("key", "item_key", "shift", F.explode(F.filter(runs, lambda r: r["n"] >= WINDOW)).alias("r"))
        .select("key", "item_key", (F.col("r.a") + F.col("shift")).alias("a"), F.col("r.n").alias("n"))
    )
    hits = extended
    for size in short_sizes:
        whole = items.where(F.size("item_words") == size).select(
            F.sha2(F.concat_ws(" ", "item_words"), 256).alias("item_key"), "item_words"
        ).groupBy("item_key").agg(F.first("item_words").alias("item_words"))
        probe = whole.select("item_key", F.get(gram_hashes(F.col("item_words"), size), F.lit(0)).alias("fp"), "item_words")
        found = (
            texts.where(F.size("words") >= size)
            .select("key", "words", F.posexplode(_bound(F.col("words"), lambda x: gram_hashes(x, size))).alias("a", "fp"))
            .join(_maybe_broadcast(probe), "fp")
            .where(F.slice("words", F.col("a") + 1, F.lit(size)) == F.col("item_words"))
        )
        hits = hits.unionByName(found.select("key", "item_key", "a", F.lit(size).alias("n")))
    hits = tables.keep(hits.distinct(), "hits")
    covered = (
        hits.select("key", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("p"))
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n_hit"))
    )
    names = items.select(F.sha2(F.concat_ws(" ", "item_words"), 256).alias("item_key"), F.col("item_id").cast("string").alias("item"))
    listed = (
        hits.select("key", "item_key").distinct().join(names, "item_key").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    verdicts = tables.keep(covered.join(listed, "key", "left"), "verdicts")
    none = F.array().cast("array<string>")
    return counted.join(verdicts, "key", "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) * 20 >= F.col("n_words")).__and__(F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
