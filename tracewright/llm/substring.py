"""Removal of repeated passages with compressed FM-indexes.

1. Anchors. In each window of ``SPAN`` = 20 consecutive words the least of its 15 6-word hashes (leftmost of equals) is
   the window's anchor: equal windows have equal anchors. A run of windows with one anchor is a fragment (at most 34
   words). Only fragments whose anchor occurs twice can hold a repeated window; the others stop here.
2. Equal fragments (128-bit hashes of their words) collapse to their first occurrence, whose text its document cuts out.
3. Shards. Fragments of one anchor go to one shard, or to several of at most ``HOT`` fragments each where it has more (a
   common passage amid changing words). There are as many shards as keep each near ``SHARD_WORDS`` words.
4. Each shard builds an FM-index over its fragments (suffixes sorted by prefix doubling, BWT, wavelet matrix of packed bit
   vectors with block ranks) and streams their windows against it: a table of 3-word intervals starts the backward search of
   all windows at once, which goes on leftwards while an interval holds several places. Its length where it ends is the
   matching statistic of the window's end; windows of 20 or more words matched are repeats, and the least (doc_id, start) of
   the 20-word interval is their first occurrence in the shard.
5. First occurrences of the windows of anchors with several shards are merged by a grouped minimum over their hashes.
6. Every copy of a fragment compares its own place with those firsts; the documents drop what is covered.

Joins whose one side may repeat a key without bound have a written table of one row per key on the other side, so that
adaptive execution can split them.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Tables, bound_batches, shuffle_parts

SPAN = 20
GRAM = 6
#: Different fragments of one anchor in a shard.
HOT = 1000
#: Words of a shard's index; its arrays take about 200 bytes a word at the most.
SHARD_WORDS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = -(1 << 63)
_FIELDS = "h long, f1 long, f2 long, doc_id long, start int, tag long, wins int"
_FRAGMENT = ["h", "f1", "f2"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of any byte range of a buffer in constant time: prefix sums of a polynomial modulo 2^64."""

    inverse = pow(int(_BASE), -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def over(self, data: bytes) -> None:
        n = len(data)
        if len(self.up) <= n:
            self.up = _powers(int(_BASE), n + n // 4)
            self.down = _powers(self.inverse, n + n // 4)
        values = _mix(np.arange(1, 257, dtype=np.uint64))[np.frombuffer(data, np.uint8)]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _wide(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128-bit hashes of ranges of data: (n, 2) int64."""
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist())])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def fragments_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """6-word hashes of one document -> anchor position, first window and number of windows of each fragment."""
    wide = SPAN - GRAM + 1
    n = len(h) - wide + 1
    best, at = h, np.arange(len(h))
    size = 1
    while size < wide:  # leftmost minimum over doubling ranges
        step = min(size, wide - size)
        m = len(best) - step
        right = best[step:] < best[:m]
        best, at = np.where(right, best[step:], best[:m]), np.where(right, at[step:], at[:m])
        size += step
    cut = np.flatnonzero(np.r_[True, at[1:n] != at[: n - 1]])
    return at[cut], cut, np.diff(np.r_[cut, n])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_id, tag, text) -> the fragments of each text."""
    hasher = _Hasher()
    for b in batches:
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for doc, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = _words(text.as_py())
            if len(words) < SPAN:
                continue
            data = b" ".join(words)
            hasher.over(data)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            h = hasher.ranges(starts[: len(words) - GRAM + 1], ends[GRAM - 1 :])
            at, first, wins = fragments_of(h)
            f = _wide(data, starts[first], ends[first + wins + SPAN - 2])
            k = len(at)
            for col, v in zip(out, (h[at].view(np.int64), f[:, 0], f[:, 1], np.full(k, doc), first.astype(np.int32), np.full(k, tag), wins.astype(np.int32))):
                col.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], [x.split()[0] for x in _FIELDS.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (key_id, tag, text) with their own fragments -> those with their words."""
    for b in batches:
        lists = b.column(3)
        own = lists.flatten()
        fields = {f.name: own.field(i) for i, f in enumerate(own.type)}
        start, wins = fields["start"].to_numpy(), fields["wins"].to_numpy()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words: list[bytes] = []
        for i, text in enumerate(b.column(2)):
            own_words = _words(text.as_py())
            data = b" ".join(own_words)
            ends = np.cumsum(np.fromiter(map(len, own_words), np.int64, len(own_words)) + 1) - 1
            s, w = start[cuts[i] : cuts[i + 1]], wins[cuts[i] : cuts[i + 1]]
            begin = np.r_[0, ends[:-1] + 1][s]
            words += [data[x:y] for x, y in zip(begin.tolist(), ends[s + w + SPAN - 2].tolist())]
        doc = pa.array(np.repeat(b.column(0).to_numpy(), np.diff(cuts)))
        columns = [*(fields[c] for c in ("key", "merge", *_FRAGMENT, "wins")), doc, fields["start"], pa.array(words, pa.binary()).cast(pa.string())]
        out = pa.RecordBatch.from_arrays(columns, ["key", "merge", *_FRAGMENT, "wins", "doc_id", "start", "words"])
        for k in range(0, out.num_rows, 20_000):
            yield out.slice(k, 20_000)


class BitVector:
    """Packed bits with a count before each block of 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.uint32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (seq >> bit) & 1
            self.levels.append((bit, BitVector(bits.astype(np.uint8)), int(len(bits) - bits.sum())))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])
        every = np.arange(sigma, dtype=np.int64)
        self.base = self._down(every, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, vec, zeros in self.levels:
            ones = vec.rank1(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of symbol before lo and before hi; where a symbol starts on the last level is known beforehand."""
        base = self.base[symbol]
        return self._down(symbol, lo) - base, self._down(symbol, hi) - base


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each one's dense rank."""
    order = np.argsort(key)
    found = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.r_[0, np.cumsum(found[1:] != found[:-1])]
    return order, rank


def sort_suffixes(grams: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Places in the order of their first `depth` symbols at least, ties as they come.

    grams: each place's first `width` symbols as one number. An FM-index whose suffixes are sorted to a depth is exact for
    patterns up to that length.
    """
    n = len(grams)
    order, rank = _ranks(grams)
    size = width
    while size < depth and n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: max(n - size, 0)] += rank[size:] + 1
        order, rank = _ranks(key)
        size *= 2
    return order


class FMIndex:
    """Over sequences of positive symbols, each closed by symbol 0; for patterns of up to `depth` symbols."""

    def __init__(self, seq: np.ndarray, sigma: int, depth: int):
        bits = max(1, int(sigma - 1).bit_length())
        self.width = max(1, min(3, 62 // bits, depth))
        self.grams = seq.copy()  # a table of short patterns: each place's first symbols as one number
        for j in range(1, self.width):
            self.grams <<= bits
            self.grams[:-j] |= seq[j:]
        order = sort_suffixes(self.grams, self.width, depth)
        self.seq, self.order = seq, order
        self.counts = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))]
        self.tree = WaveletMatrix(seq[order - 1], sigma)
        self.sorted_grams = self.grams[order]

    def matching(self, starts: np.ndarray, stops: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each stop (exclusive) of the index's own sequence, down to its start at the furthest.

        Returns the matching statistics (how many symbols before the stop occur in several places together) and, where that
        is `least` or more, the interval of the last `least` symbols; 0, 0 elsewhere. Nothing of less than the table's width
        is told apart from no match.
        """
        length = np.zeros(len(stops), np.int64)
        first, last = np.zeros(len(stops), np.int64), np.zeros(len(stops), np.int64)
        live = np.flatnonzero(stops - starts >= self.width)
        gram = self.grams[stops[live] - self.width]
        lo, hi = np.searchsorted(self.sorted_grams, gram, "left"), np.searchsorted(self.sorted_grams, gram, "right")
        step = self.width
        while True:
            several = hi - lo > 1
            live, lo, hi = live[several], lo[several], hi[several]
            length[live] = step
            if step == least:
                first[live], last[live] = lo, hi
            more = stops[live] - starts[live] > step
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                return length, first, last
            step += 1
            symbol = self.seq[stops[live] - step]
            a, b = self.tree.rank(symbol, lo, hi)
            lo, hi = self.counts[symbol] + a, self.counts[symbol] + b


def _symbols(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts of words between single spaces -> symbols with a closing 0 each, where each text starts, number of symbols."""
    split = pc.split_pattern(pa.concat_arrays(texts.chunks) if texts.num_chunks != 1 else texts.chunk(0), " ")
    words = split.flatten().dictionary_encode()
    starts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    n = len(split)
    seq = np.zeros(len(words) + n, np.int64)
    seq[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(starts))] = words.indices.to_numpy() + 1
    return seq, starts[:-1] + np.arange(n), len(words.dictionary) + 1


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's fragments: index, stream, report the windows with an earlier first occurrence and their statistic.

    Of fragments whose anchor has several shards every window is reported with its first occurrence here and its hash.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    fragment = [t.column(c).to_numpy() for c in _FRAGMENT]
    merge, wins, doc, start = (t.column(c).to_numpy() for c in ("merge", "wins", "doc_id", "start"))
    texts = t.column("words")
    seq, heads, sigma = _symbols(texts)
    index = FMIndex(seq, sigma, SPAN + SPAN - GRAM)
    frag = np.repeat(np.arange(len(wins)), wins)
    win = np.arange(len(frag)) - np.repeat(np.cumsum(wins) - wins, wins)
    length, lo, hi = index.matching(heads[frag], heads[frag] + win + SPAN, SPAN)
    q_doc, q_start = doc[frag], (start[frag] + win).astype(np.int64)
    e_doc, e_start = q_doc.copy(), q_start.copy()
    # the places of an interval: every window of the shard that it holds is a query of its own, so group by interval
    query = np.flatnonzero(length >= SPAN)
    if len(query):
        order = query[np.lexsort((q_start[query], q_doc[query], lo[query]))]
        head = np.flatnonzero(np.r_[True, lo[order][1:] != lo[order][:-1]])
        group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
        e_doc[order], e_start[order] = q_doc[order][head][group], q_start[order][head][group]
    later = (e_doc < q_doc) | ((e_doc == q_doc) & (e_start < q_start))
    k = np.flatnonzero(later | merge[frag])
    if not len(k):
        return
    f = frag[k]
    hashes = np.zeros((len(k), 2), np.int64)
    for i in np.unique(f[merge[f]]).tolist():
        words = texts[i].as_py().encode().split(b" ")
        mine = slice(*np.searchsorted(f, (i, i + 1)))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begin = np.r_[0, ends[:-1] + 1]
        hashes[mine] = _wide(b" ".join(words), begin[win[k[mine]]], ends[win[k[mine]] + SPAN - 1])
    arrays = [*(pa.array(c[f]) for c in fragment), pa.array(merge[f]), pa.array(win[k].astype(np.int32)), pa.array(e_doc[k]), pa.array(e_start[k]), pa.array(length[k].astype(np.int32)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
    yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _FOUND.split(", ")])


_FOUND = "h long, f1 long, f2 long, merge boolean, win int, e_doc long, e_start long, matched int, w1 long, w2 long"


def remove_repeats(docs: DataFrame, with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, matched[, kept_text], *keep) for every row of docs.

    A word goes if a window of 20 words of its document covers it whose words also start earlier (smaller doc_id, or the
    same document and an earlier word). spans lists the removed word ranges as start, end, start, end ...; matched is the
    greatest matching statistic of its repeated windows (within a fragment: 20 to 34 words), 0 without any.

    * A null text has no words. Documents of under 20 words lose nothing.
    * A null doc_id counts as smaller than any other. Rows that share a doc_id are versions of one document: between
      them only an earlier start counts, so of exactly repeated rows none removes the other.
    * Columns named in keep are handed through, row by row; others are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = Tables(spark)
    text = F.col("text").cast("string")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("key_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"),  # tells apart rows that share a doc_id but not the text
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        *(F.col(c).alias(f"keep_{c}") for c in keep),
    )
    anchors = tables.keep(keyed.select("key_id", "tag", "text").mapInArrow(_anchors, _FIELDS), "anchors")
    twice = tables.keep(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    shared = tables.keep(anchors.join(twice, "h"), "shared")
    tables.drop(anchors)
    place = F.struct("doc_id", "start", "tag", "wins")
    firsts = shared.groupBy(*_FRAGMENT).agg(F.min(place).alias("p")).select(*_FRAGMENT, "p.*")
    firsts = tables.keep(firsts, "firsts")
    hot = firsts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = tables.keep(hot.select("h", F.ceil(F.col("n") / max(HOT, 1)).alias("shards")), "hot")
    shard = F.when(F.col("shards").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.pmod("f1", "shards")))
    owned = (
        firsts.join(hot, "h", "left")
        .groupBy(F.col("doc_id").alias("key_id"), "tag")
        .agg(F.collect_list(F.struct(shard.alias("key"), F.col("shards").isNotNull().alias("merge"), *_FRAGMENT, "start", "wins")).alias("own"))
    )
    whole = ["key_id", "tag"]
    # rows wholly alike give their fragments once
    cut = keyed.select(*whole, "text").join(owned, whole).select(*whole, "text", "own").dropDuplicates(whole)
    n_words = firsts.agg(F.sum(F.col("wins") + (SPAN - 1))).first()[0] or 0
    pieces = cut.mapInArrow(_cut, _PIECES).repartition(max(shuffle_parts(spark), -(-n_words // SHARD_WORDS)), "key")
    found = tables.keep(pieces.mapInArrow(_search, _FOUND), "found")
    hits = found.where("not merge")
    if not hot.isEmpty():
        parted = found.where("merge")
        earliest = parted.groupBy("w1", "w2").agg(F.min(F.struct("e_doc", "e_start")).alias("e"), F.max("matched").alias("most"))
        earliest = tables.keep(earliest, "earliest")
        merged = parted.drop("e_doc", "e_start").join(earliest, ["w1", "w2"]).select(*_FRAGMENT, "win", "e.*", F.greatest("matched", "most", F.lit(SPAN)).alias("matched"))
        hits = hits.select(merged.columns).unionByName(merged)
    hits = hits.groupBy(*_FRAGMENT).agg(F.collect_list(F.struct("win", "e_doc", "e_start")).alias("hits"), F.max("matched").alias("matched"))
    # a copy of a fragment: all its windows occur at the owner's place; the owner and lone fragments: those found
    own = firsts.select(*_FRAGMENT, F.col("doc_id").alias("o_doc"), F.col("start").alias("o_start")).join(hits, _FRAGMENT, "left")
    own = tables.keep(own, "own")
    earlier = (F.col("o_doc") < F.col("doc_id")) | ((F.col("o_doc") == F.col("doc_id")) & (F.col("o_start") < F.col("start")))
    mine = lambda x: (x["e_doc"] < F.col("doc_id")) | (
        (x["e_doc"] == F.col("doc_id")) & (x["e_start"] < F.col("start") + x["win"])
    )
    runs = F.when(
        earlier, F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("wins") + (SPAN - 1)).alias("b")))
    ).otherwise(
        F.transform(
            F.filter("hits", mine),
            lambda x: F.struct((F.col("start") + x["win"]).alias("a"), (F.col("start") + x["win"] + SPAN).alias("b")),
        )
    )
    spans = (
        shared.join(own, _FRAGMENT)
        .select(F.col("doc_id").alias("key_id"), "tag", runs.alias("runs"), F.when(earlier, F.col("wins") + (SPAN - 1)).otherwise(F.col("matched")).alias("matched"))
        .where(F.size("runs") > 0)
        .groupBy(*whole)
        .agg(F.flatten(F.collect_list("runs")).alias("runs"), F.max("matched").alias("matched"))
    )
    spans = tables.keep(spans, "spans")
    joined = keyed.join(spans, whole, "left").select("doc_id", "text", "runs", F.coalesce("matched", F.lit(0)).alias("matched"), *(f"keep_{c}" for c in keep))
    kinds = "".join(f", keep_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = joined.mapInArrow(_apply if with_text else _apply_plain, (_OUT if with_text else _OUT_PLAIN) + kinds)
    return out.withColumnsRenamed({f"keep_{c}": c for c in keep})


_PIECES = "key long, merge boolean, h long, f1 long, f2 long, wins int, doc_id long, start int, words string"
_OUT_PLAIN = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>, matched int"
_OUT = _OUT_PLAIN + ", kept_text string"


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = _words(text)
            if runs:
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, [r["a"] for r in runs], 1)
                np.add.at(cover, [r["b"] for r in runs], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = b" ".join([w for w, x in zip(words, gone.tolist()) if not x])
                edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()
                removed = int(gone.sum())
            else:
                kept, edges, removed = b" ".join(words), [], 0
            for c, v in zip(cols, (len(words), removed, hashlib.sha256(kept).hexdigest(), edges, kept if with_text else None)):
                c.append(v)
        arrays = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int64())), b.column(3)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "matched"]
        if with_text:
            arrays.append(pa.array(cols[4], pa.binary()).cast(pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(arrays + b.columns[4:], names + b.schema.names[4:])


def _apply_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _apply(batches, with_text=False)
