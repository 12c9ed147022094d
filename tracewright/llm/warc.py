"""WARC archives: writing, reading back, and capture histories by an external merge of their indexes.

* A record per page is a line of Spark's text writer whose line separator is the record end (CR LF CR LF), so archives go
  to any store that Spark writes. Equal payloads of at least ``REVISIT_BYTES`` are stored once; the others are revisits.
  An archive is closed once it holds ``ARCHIVE_BYTES``.
* Reading parses each archive by content length into a run: index entries sorted by URL key, time and page. Runs are
  written.
* The written runs are dealt by ranges of the whole sort key (page included, so a url with very many captures spreads out),
  of about ``SECTION_ENTRIES`` each. What arrives of the runs is still sorted piece by piece; a section reads where one
  piece ends and the next begins and merges the pieces by a loser tree, without sorting. The sections in turn are the
  global order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import Tables, bound_batches, scratch_path, shuffle_parts

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
SECTION_ENTRIES = 50_000
CAPTURED = "2000-01-01T00:00:00Z"
_END = "\r\n\r\n"
_ENTRY = "key string, page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, place long"


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _archive_number(most: int):  # noqa: ANN202
    """Number of the archive of a task that a record goes to: the bytes of the task's records before it over `most`."""

    @F.pandas_udf("int")
    def number(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = 0
        for n in sizes:
            ends = held + np.cumsum(n.to_numpy(np.int64))
            yield pd.Series((ends - n.to_numpy(np.int64)) // most, dtype="int32")
            held = int(ends[-1]) if len(ends) else held

    return number


def write_archives(pages: DataFrame, path: str, captured: str | Column = CAPTURED) -> None:
    """pages (page_id, url, html) -> WARC files below path. captured: the time of all records, or a column of pages."""
    spark = pages.sparkSession
    tables = Tables(spark)
    time = F.coalesce(F.regexp_replace(captured.cast("string"), "[\r\n]", " "), F.lit(CAPTURED)) if isinstance(captured, Column) else F.lit(captured)
    body = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), time.alias("captured"))
    body = body.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html").cast("long"))
    digests = tables.keep(body.where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest"), "digests")
    groups = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    groups = tables.keep(groups.drop("c"), "groups")  # written, so that a payload that very many pages share can be split in the join
    # revisits alone, without payloads
    refs = digests.join(groups, "digest").where("page_id is null or page_id <> first").select(
        F.coalesce("page_id", F.lit(-(1 << 63))).alias("pid"), "digest", F.col("first").alias("refers_to")
    ).distinct()
    refs = tables.keep(refs, "revisits")
    rows = body.withColumn("pid", F.coalesce("page_id", F.lit(-(1 << 63)))).join(refs, ["pid", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    safe_url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "%", "%25"), "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", urn(F.col("page_id"))),
        _header("WARC-Date", F.col("captured")),
        _header("WARC-Target-URI", safe_url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", urn(F.col("refers_to"))),
        _header("X-Payload-Length", F.col("n").cast("string")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    size = F.when(revisit, F.lit(0)).otherwise(F.col("n")) + F.coalesce(F.octet_length("url"), F.lit(0)) + 512
    rows.select(record.alias("value"), _archive_number(ARCHIVE_BYTES)(size).alias("archive")).write.mode("overwrite").option("lineSep", _END).partitionBy("archive").text(path)


def url_key(url: str | None) -> str:
    """Sortable form: reversed host labels, then the rest; empty for none."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, payload, place) of each record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[stop + 4 : stop + 4 + n], at
        at = stop + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of byte {at} does not end")
        at += 4


def _number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column(0), b.column(1)):
            rows = []
            name = "/".join(path.as_py().rsplit("/", 2)[-2:])
            for head, payload, place in parse_archive(data.as_py()):
                page = _number(head.get("WARC-Record-ID"))
                url = head.get("WARC-Target-URI")
                if url is not None:
                    url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                digest = head["WARC-Payload-Digest"].split(":", 1)[1]
                kind = head["WARC-Type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of page {page} is damaged")
                key = f"{url_key(url)}\0{head['WARC-Date']}\0{(page if page is not None else -1) + (1 << 63):020d}"
                rows.append((key, page, url, head["WARC-Date"], int(head["X-Payload-Length"]), digest, kind, _number(head.get("WARC-Refers-To")), name, place))
            rows.sort(key=lambda r: r[0])
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _ENTRY.split(", ")])


class LoserTree:
    """k-way merge: inner nodes hold the losers of a knockout, so each entry takes one path of log2(k) comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # first of the two to come: waits here
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One section: finds the sorted pieces in what arrives, merges and numbers them."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    keys = table.column("key")
    cuts = np.flatnonzero(pc.less(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy()) + 1
    keys = keys.to_pylist()
    pieces = [zip(keys[a:b], range(a, b)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])]
    order = np.fromiter((i for _, i in LoserTree(pieces)), np.int64, len(keys))
    out = table.take(pa.array(order))
    section = np.full(len(order), TaskContext.get().partitionId(), np.int32)
    out = out.append_column("section", pa.array(section)).append_column("position", pa.array(np.arange(len(order))))
    yield from out.to_batches(max_chunksize=10_000)


def capture_history(spark: SparkSession, path: str) -> DataFrame:
    """Index of all archives below path in global order: by (section, position)."""
    bound_batches(spark)
    tables = Tables(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").select("path", "content")
    runs = tables.keep(files.mapInArrow(_runs, _ENTRY), "runs")
    sections = max(shuffle_parts(spark), -(-runs.count() // SECTION_ENTRIES))
    return runs.repartitionByRange(sections, "key").mapInArrow(_merge, f"{_ENTRY}, section int, position long")


def archive(pages: DataFrame, path: str | None = None, captured: str | Column = CAPTURED) -> DataFrame:
    """Writes pages to archives, reads them back and returns their capture history, a row for each page.

    Columns: page_id, url, captured, payload_bytes, payload_digest, record_type, refers_to, run, place (archive and byte of
    the record), section, position (global order).

    * A null html is an empty payload; a null url or page_id stays null. Payloads of under 100 bytes are all responses.
    * Of equal longer payloads the least page_id is the response; null ids come after all others, and if all are null,
      all are responses. Repeated rows of that least id are responses all of them.
    * captured is the time of all records, or a column of pages (null: the default).
    * Other columns are ignored. No pages give no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, captured)
    return capture_history(spark, path).drop("key")
