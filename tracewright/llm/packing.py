"""Packing token sequences by shortest-pack-first over the length histogram.

Texts are tokenised and cut into pieces of at most ``CAPACITY`` ids. The histogram of piece lengths (at most CAPACITY rows)
is packed on the driver: lengths longest first, each into the open pattern with most room, with counts of patterns instead
of single sequences. A piece finds its place by its rank among the pieces of its length: the rank within its input
partition, counted where it is cut, plus the pieces of that length in the partitions before. No piece is sorted or
gathered by length, so a length that a third of all pieces have costs no more than any other.
"""

from __future__ import annotations

import functools
import heapq
import string
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import Tables, bound_batches

CAPACITY = 4096
END_ID = 2
#: Words of the young generation of a worker's cache after which it becomes the old one.
CACHE_WORDS = 300_000
#: Stands for ids of what is not letters alone; no ids have one byte.
_ODD = b"-"
#: Below this character letters are the same in every Unicode version that the libraries here know.
_STABLE = "\u0530"
# fixed values: the rules of the public vocabulary under which words may be looked up one by one
_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """ids (little-endian uint32) of texts, white-space token by white-space token, with a cache of two generations.

    Where the file's rules are those of ``_RULES``, white space is dropped and no rule reaches across ASCII white space, so
    the ids of a text are those of its tokens in turn. Letters with ASCII punctuation after them are two pre-tokens; their
    letters go through the file's own normaliser to its model, the punctuation and everything else through the whole
    tokenizer. Arrow splits a batch and finds its distinct words and bodies; Python sees each of these once a batch. A
    vocabulary with other rules is given whole texts.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = all(rules[k] == v for k, v in _RULES.items()) and rules["model"]["type"] == "BPE"
        # letters that the normaliser does not turn into letters alone
        letters = [c for c in map(chr, range(0x80, ord(_STABLE))) if c.isalpha()]
        normal = self.tokenizer.normalizer.normalize_str if self.by_word else str
        self.odd = frozenset(c for c in letters if not normal(c).isalpha())
        self.words: list[dict[str, bytes]] = [{}, {}]  # young and old
        self.parts: list[dict[str, bytes]] = [{}, {}]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    @staticmethod
    def _known(cache: list[dict], keys: list[str], resolve: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Values of keys; those of the old generation move to the young one, new ones are resolved together."""
        young, old = cache
        found = list(map(young.get, keys))
        if None in found:
            rest = [k for k, x in zip(keys, found) if x is None]
            kept = list(map(old.get, rest))
            new = [k for k, x in zip(rest, kept) if x is None]
            if len(new) < len(rest):
                young.update([(k, x) for k, x in zip(rest, kept) if x is not None])
            young.update(zip(new, resolve(new) if new else ()))
            found = list(map(young.__getitem__, keys))
        return found

    def _bodies(self, bodies: list[str]) -> list[bytes]:
        """ids of lower-cased letters; _ODD for what is not letters alone."""
        plain = [h.isalpha() and (h.isascii() or max(h) < _STABLE and self.odd.isdisjoint(h)) for h in bodies]
        normal = iter(self.tokenizer.normalizer.normalize_str(" ".join(h for h, ok in zip(bodies, plain) if ok)).split(" "))
        model, letters = self.model.tokenize, _byte_letters()
        out = []
        for ok in plain:
            if ok:
                n = next(normal)
                found = model(n if n.isascii() else n.encode().decode("latin-1").translate(letters))
                out.append(array("I", [t.id for t in found]).tobytes())
            else:
                out.append(_ODD)
        return out

    def _distinct(self, words: pa.Array) -> pa.Array:
        """ids, packed, of distinct words without white space: of letters and of the punctuation after them, or of the whole."""
        body = pc.ascii_lower(pc.ascii_rtrim(words, string.punctuation))
        tail = pc.subtract(pc.binary_length(words), pc.binary_length(body)).to_numpy()
        body = body.dictionary_encode()
        codes = self._known(self.parts, _strings(body.dictionary), self._bodies)
        head = body.indices.to_numpy().astype(np.int64)
        odd = (np.fromiter(map(len, codes), np.int64, len(codes)) == len(_ODD))[head]
        tailed = np.flatnonzero((tail > 0) & ~odd)
        ends = [w[-n:] for w, n in zip(_strings(words.take(pa.array(tailed))), tail[tailed].tolist())]
        places = {t: i for i, t in enumerate(dict.fromkeys(ends))}
        whole = _strings(words.take(pa.array(np.flatnonzero(odd))))
        units = [*codes, *self._known(self.words, whole, self._whole), *self._known(self.words, list(places), self._whole), b""]
        head[odd] = len(codes) + np.arange(len(whole))
        pairs = np.full((len(words), 2), len(units) - 1)
        pairs[:, 0] = head
        pairs[tailed, 1] = len(codes) + len(whole) + np.fromiter(map(places.__getitem__, ends), np.int64, len(ends))
        both = pa.array(units, pa.large_binary()).take(pa.array(pairs.ravel()))
        _, offsets, data = both.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: 2 * len(words) + 1 : 2].copy()
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), data])

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """ids of each text (null: none) and the end id."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [np.append(np.frombuffer(x, "<u4"), np.uint32(END_ID)) for x in self._whole(texts.to_pylist())]
        for cache in (self.words, self.parts):
            if len(cache[0]) > CACHE_WORDS:
                cache[:] = {}, cache[0]
        # an empty word, as between leading white space and the text's start, has no ids
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        found = self._distinct(words.dictionary).take(words.indices)
        _, offsets, data = found.buffers()
        cuts = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy() - split.offsets[0].as_py()] // 4
        flat = np.frombuffer(data or b"", "<u4", int(cuts[-1]))
        return [np.append(flat[a:b], np.uint32(END_ID)) for a, b in zip(cuts[:-1], cuts[1:])]


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


@functools.cache
def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in turn."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _pieces(path: str, capacity: int, with_ids: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), tok.ids(b.column(1))):
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    n = len(piece)
                    rank = ranks.get(n, 0)
                    ranks[n] = rank + 1
                    rows.append((doc, start, n, zlib.crc32(piece), len(ids), part, rank, piece.tolist() if with_ids else None))
            for k in range(0, len(rows), 5000):
                cols = list(zip(*rows[k : k + 5000]))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"]
                m = len(names) if with_ids else len(names) - 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:m], kinds)], names[:m])

    return run


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """{length: count} -> patterns (count, [(length, times, offset)]). Every count is used up.

    Shortest pack first: the open pattern with most room takes the length; a pattern with more copies than there are
    pieces left is split. One pattern takes a length several times at once while it stays the roomiest.

    A length adds at most three patterns (one split, one of new sequences and one for what is left of them), so there are
    at most 3 * capacity of them, however many pieces there are: what is broadcast does not grow with the corpus.
    """
    heap: list[tuple[int, int, int, tuple]] = []  # (-room, tie, copies, slots)
    done: list[tuple[int, list]] = []
    tie = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, _, copies, slots = heapq.heappop(heap)
                room = -room
                take = min(copies, left)
                if take < copies:
                    tie += 1
                    heapq.heappush(heap, (-room, tie, copies - take, slots))
                times = 1
                if left >= 2 * copies:
                    next_room = -heap[0][0] if heap else 0
                    times = min(room // length, left // copies, (room - next_room) // length + 1)
            else:
                fit = max(1, capacity // length)
                room, slots = capacity, ()
                take = max(1, left // fit)
                times = min(fit, left) if left >= fit else left
            used = capacity - room
            slots = (*slots, (length, times, used))
            left -= take * times
            room -= times * length
            tie += 1
            if room:
                heapq.heappush(heap, (-room, tie, take, slots))
            else:
                done.append((take, list(slots)))
    done += [(copies, list(slots)) for _, _, copies, slots in heap]
    return done


def _places(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, times, offset) of each run of ranks."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    seq = 0
    for copies, slots in patterns:
        for length, times, offset in slots:
            at = used.get(length, 0)
            out.setdefault(length, []).append((at, seq, times, offset))
            used[length] = at + copies * times
        seq += copies
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def _assign(places):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            n = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            seq, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                mine = np.flatnonzero(n == length)
                first, base, times, off = table[int(length)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                within = rank[mine] - first[k]
                seq[mine] = base[k] + within // times[k]
                offset[mine] = off[k] + within % times[k] * length
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset): a row for each piece.

    * A null or empty text is one piece that holds the end id alone. Every id of a document, and its end id, lies in one
      piece; pieces are of ``capacity`` ids but for a document's last.
    * A null doc_id is kept; repeated rows are documents of their own. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = Tables(spark)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(path or vocabulary_path(), capacity, with_ids), fields + (", ids array<long>" if with_ids else "")
    )
    pieces = tables.keep(pieces, "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = tables.keep(by_part.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(pack_histogram(counts, capacity)))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    ranked = pieces.join(by_part.drop("n"), ["length", "part"]).select(*keep, (F.col("rank") + F.col("base")).alias("rank"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    return ranked.mapInArrow(_assign(places), f"{kinds}, sequence_id long, offset long")
