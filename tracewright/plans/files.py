"""Registered queries over written things: hash files, text traces, key-value tables, store states; and scan figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import hashing as H
from tracewright.operators import counting as C
from tracewright.operators import defense as D
from tracewright.operators import store as S
from tracewright.operators.chunking import VariableParams
from tracewright.operators.chunking import multi_scan as multi_scan_files
from tracewright.operators.lineage import kept, scratch_path
from tracewright.operators.segments import pack_containers
from tracewright.plans import reports as R
from tracewright.plans.catalog import CONTAINER, SEG_MAX, SEG_MIN, _CONTAINERS, _MINHASH, _SCRAMBLE, _TRACE, _doc, _docs_files, _segments, query
from tracewright.sources import traces as T
from tracewright.sources.hashfile import VERSIONS, read_hashfile, write_hashfiles
from tracewright.sources.kvstore import KeyValueTable

_RABIN = {"algorithm": "rabin", "window": 48, "prime": 1048583, "modulus": 1 << 30, "bits": 13, "pattern": 0x1FFF, "smallest": 2048, "largest": 16384}


def _written(spark: SparkSession, sf_dir: str, version: int = 7) -> str:
    """Hash files of the document trace, one for each source; returns what names them all."""
    folder = scratch_path(spark, f"hashfiles-v{version}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''")
    files = docs.select(
        F.col("source").alias("snapshot"),
        F.col("doc_id").alias("file_no"),
        F.concat(F.lit("/data/"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("file_size"),
        (F.col("doc_id") % 100).alias("uid"),
        F.lit(0o644).alias("perm"),
        (F.col("doc_id") * 86_400).alias("mtime"),
        F.lit(1).alias("hardlinks"),
    )
    chunks = _doc(spark, sf_dir).select(F.col("stream").alias("snapshot"), F.col("block").alias("file_no"), F.col("seq").bitwiseAND(F.lit((1 << 24) - 1)).alias("chunk_no"), "size", "fp", "cratio")
    write_hashfiles(files, chunks, folder, version, params=_RABIN, root="/data", sysid="host", start=10, end=20).count()
    return f"{folder}/*.hash"


_FILES = _TRACE + """,
files AS (SELECT source || '.hash' AS snapshot, '/data/' || doc_id || '.txt' AS path, doc_id, CAST(strlen(text) AS BIGINT) AS file_size, (length(text) - 1) // 64 + 1 AS chunks
          FROM documents WHERE text <> ''),
chunks AS (SELECT stream || '.hash' AS snapshot, '/data/' || block || '.txt' AS path, seq & 16777215 AS chunk_no, size, fp FROM trace)"""
_SHOWN = "regexp_replace(fp, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"


@query("WITH " + _FILES + " SELECT *, CAST(10 AS BIGINT) AS cratio FROM chunks")
def hashfile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_hashfile(spark, _written(spark, sf_dir)).select("snapshot", "path", "chunk_no", "size", "fp", F.col("cratio").cast("long").alias("cratio"))


@query("WITH " + _FILES + " SELECT snapshot, path, file_size, chunks, doc_id % 100 AS uid, CAST(420 AS BIGINT) AS perm, doc_id * 86400 AS mtime, CAST(1 AS BIGINT) AS hardlinks FROM files")
def hashfile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries alone: chunks are stepped over."""
    return read_hashfile(spark, _written(spark, sf_dir), "files").select("snapshot", "path", "file_size", "chunks", "uid", "perm", F.unix_timestamp("mtime").alias("mtime"), "hardlinks")


@query("WITH " + _FILES + """
SELECT snapshot, CAST(7 AS BIGINT) AS version, count(*) AS files, '/data' AS root, CAST(sum(chunks) AS BIGINT) AS chunks, 'variable' AS chunking, 'rabin' AS algorithm,
       CAST(48 AS BIGINT) AS "window", CAST(1048583 AS BIGINT) AS prime, CAST(1073741824 AS BIGINT) AS modulus, CAST(13 AS BIGINT) AS bits, CAST(8191 AS BIGINT) AS pattern,
       CAST(2048 AS BIGINT) AS smallest, CAST(16384 AS BIGINT) AS largest, 'md5-48bit' AS hashing, CAST(48 AS BIGINT) AS hash_bits, 'host' AS sysid,
       CAST(10 AS BIGINT) AS start_time, CAST(20 AS BIGINT) AS end_time, CAST(sum(file_size) AS BIGINT) AS bytes
FROM files GROUP BY 1""")
def hashfile_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = R.header_report(spark, _written(spark, sf_dir)).drop("chunk_size")
    return heads.withColumns({"version": F.col("version").cast("long"), "hash_bits": F.col("hash_bits").cast("long")})


@query("WITH " + _FILES + """
SELECT snapshot, path, CASE WHEN file_size >= 1024 THEN (file_size // 1024) || ' KB' ELSE file_size || ' B' END AS size, doc_id % 100 AS uid, '644' AS perm,
       strftime(make_timestamp(doc_id * 86400 * 1000000), '%a %b %d %H:%M:%S %Y') AS mtime, chunks FROM files""")
def hashfile_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_hashfile(spark, _written(spark, sf_dir), "files")
    return R.file_report(files.withColumn("mtime", F.to_utc_timestamp("mtime", F.current_timezone()))).select("snapshot", "path", "size", "uid", "perm", "mtime", "chunks")


@query("WITH " + _FILES + f" SELECT snapshot, path, chunk_no, {_SHOWN} || chr(9) || chr(9) || size || ' ' || chr(9) || chr(9) || chr(9) || '10' AS line FROM chunks")
def hashfile_chunk_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_report(read_hashfile(spark, _written(spark, sf_dir)))


@query("WITH " + _FILES + " SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(chunks) AS BIGINT) AS chunks FROM files")
def hashfile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals_report(read_hashfile(spark, _written(spark, sf_dir), "files"))


@query("WITH " + _FILES + """
SELECT version, files, bytes, own, n, CASE WHEN version < 3 THEN 0 ELSE size END AS size, CASE WHEN version < 6 THEN 0 ELSE 10 * n END AS ratio, lpad(printf('%x', x), 12, '0') AS xor_hash
FROM (SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(chunks) AS BIGINT) AS own FROM files),
     (SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS size, bit_xor(('0x' || fp)::BIGINT) AS x FROM chunks), (SELECT unnest(range(1, 8)) AS version)""")
def hashfile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version written and read back; what a version does not store (sizes, ratios) is 0."""

    def one(version: int) -> DataFrame:
        path = _written(spark, sf_dir, version)
        files = read_hashfile(spark, path, "files").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.sum("chunks").alias("own"))
        value = F.lpad(F.lower(F.hex(F.bit_xor(F.conv("fp", 16, 10).cast("long")))), 12, "0")
        chunks = read_hashfile(spark, path).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("cratio").alias("ratio"), value.alias("xor_hash"))
        return files.crossJoin(chunks).withColumn("version", F.lit(version).cast("long"))  # one row on either side

    return reduce(DataFrame.unionByName, map(one, VERSIONS))


@query("WITH RECURSIVE " + _MINHASH + " SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) AS line, c_fp AS fp, size, CAST(10 AS BIGINT) AS cratio FROM enc")
def encrypted_text_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transformed trace written as text, and read again line by line."""
    folder = scratch_path(spark, "text-trace")
    T.write_text_trace(D.as_stream(D.minhash_encrypt(_segments(spark, sf_dir))), folder)
    line = F.row_number().over(Window.partitionBy("stream").orderBy("seq"))
    return T.read_text_trace(spark, folder).select("stream", line.cast("long").alias("line"), "fp", "size", F.col("cratio").cast("long").alias("cratio"))


@query("WITH " + _TRACE + " SELECT fp, substr(md5(unhex('6b6579' || fp)), 1, 12) AS shown FROM (SELECT DISTINCT fp FROM trace)")
def anonymized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(spark, sf_dir).select("fp").distinct().select("fp", H.anonymize_fp(F.col("fp"), "key").alias("shown"))


_NAMES = """
n AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path FROM pages UNION ALL SELECT page_id, url || '.tar.gz.' || page_id FROM pages),
p AS (SELECT *, string_split(string_split(path, '/')[-1], '.') AS p FROM n),
v AS (SELECT *, list_max(list_filter(range(2, len(p) + 1), lambda i: regexp_matches(p[i], '^[A-Za-z0-9]{1,4}$') AND regexp_matches(p[i], '[A-Za-z]'))) AS i FROM p)"""


@query("WITH " + _NAMES + " SELECT page_id, path, CASE WHEN i IS NULL THEN '' ELSE '.' || array_to_string(p[i:], '.') END AS type FROM v WHERE path IS NOT NULL")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null")
    names = p.select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path")).unionByName(p.select("page_id", F.concat("url", F.lit(".tar.gz."), "page_id").alias("path")))
    return names.select("page_id", "path", H.file_type(F.col("path")).alias("type"))


_2_64 = f"{1 << 64}::UHUGEINT"
_BYTES = "d AS MATERIALIZED (SELECT doc_id::VARCHAR AS path, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_BYTES},
w AS (SELECT path, b, len(b) AS n, list_transform(range(0, len(b) // 4), lambda i: (b[4*i+1] + b[4*i+2] * 256 + b[4*i+3] * 65536 + b[4*i+4] * 16777216) * 1540483477 % 4294967296) AS k FROM d),
h AS (SELECT path, b, n, list_reduce(list_prepend(xor(n, {H.BLOOM_SEED}), list_transform(k, lambda x: xor(x, x >> 24) * 1540483477 % 4294967296)), lambda a, x: xor(a * 1540483477 % 4294967296, x)) AS h FROM w),
t AS (SELECT path, b, n, CASE WHEN n % 4 = 0 THEN h ELSE xor(h, list_reduce(list_prepend(0::BIGINT, list_reverse(b[n - n % 4 + 1:])), lambda a, x: a * 256 + x)) * 1540483477 % 4294967296 END AS h FROM h),
f AS (SELECT path, b, xor(h, h >> 13) * 1540483477 % 4294967296 AS h FROM t)
SELECT path, xor(h, h >> 15) AS murmur2, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, ({H._CRC32C})[(xor(c, x) & 255) + 1])), 4294967295) AS crc32c FROM f""")
def byte_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    content = F.col("text").cast("binary")
    return d.select(F.col("doc_id").cast("string").alias("path"), H.murmur2(content).alias("murmur2"), H.crc32c(content).alias("crc32c"))


def _turn(x: str, r: int) -> str:
    """Rotation to the left of 64 bits."""
    return f"(({x}) * {1 << r}::UHUGEINT % {_2_64} + ({x}) // {1 << (64 - r)}::UHUGEINT)"


def _mixed(x: str, a: int, r: int, b: int) -> str:
    product = f"(({x}) * {a}::UHUGEINT % {_2_64})"
    return f"({_turn(product, r)} * {b}::UHUGEINT % {_2_64})"


def _final(x: str) -> str:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = f"(xor({x}, ({x}) // {1 << 33}::UHUGEINT) * {factor}::UHUGEINT % {_2_64})"
    return f"xor({x}, ({x}) // {1 << 33}::UHUGEINT)"


def _number(place: str) -> str:
    return " + ".join(f"b[{place} + {j + 1}]::UHUGEINT * {1 << 8 * j}::UHUGEINT" for j in range(8))


_TAIL = "list_reduce(list_prepend(0::UHUGEINT, list_reverse(CAST({0} AS UHUGEINT[]))), lambda a, x: a * 256::UHUGEINT + x)"
_H1 = f"(({_turn('xor(p.a, q.a)', 27)} + p.b) * 5::UHUGEINT + 1390208809::UHUGEINT) % {_2_64}"
_H2 = f"(({_turn('xor(p.b, q.b)', 31)} + {_H1}) * 5::UHUGEINT + 944331445::UHUGEINT) % {_2_64}"


@query(f"""WITH {_BYTES},
lanes AS (SELECT path, b, len(b) AS n, list_transform(range(0, len(b) // 16), lambda i: {{'a': {_mixed(_number('16 * i'), H._C1, 31, H._C2)}, 'b': {_mixed(_number('16 * i + 8'), H._C2, 33, H._C1)}}}) AS k FROM d),
h AS (SELECT path, n, b[n - n % 16 + 1:] AS t, list_reduce(list_prepend({{'a': {H.MURMUR3_SEED}::UHUGEINT, 'b': {H.MURMUR3_SEED}::UHUGEINT}}, k), lambda p, q: {{'a': {_H1}, 'b': {_H2}}}) AS s FROM lanes),
t AS (SELECT path, n, s, {_TAIL.format('t[1:8]')} AS t1, {_TAIL.format('t[9:]')} AS t2 FROM h),
x AS (SELECT path, xor(xor(s.a, {_mixed('t1', H._C1, 31, H._C2)}), n::UHUGEINT) AS a, xor(xor(s.b, {_mixed('t2', H._C2, 33, H._C1)}), n::UHUGEINT) AS b FROM t),
y AS (SELECT path, (a + b) % {_2_64} AS a, (a + b + b) % {_2_64} AS b FROM x),
z AS (SELECT path, {_final('a')} AS a, {_final('b')} AS b FROM y),
o AS (SELECT path, (a + b) % {_2_64} AS a, (a + b + b) % {_2_64} AS b FROM z)
SELECT path, lower(array_to_string(list_reverse(regexp_extract_all(lpad(hex(a::UBIGINT), 16, '0'), '..')), '') || array_to_string(list_reverse(regexp_extract_all(lpad(hex(b::UBIGINT), 16, '0'), '..')), '')) AS murmur3 FROM o""")
def murmur_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return d.select(F.col("doc_id").cast("string").alias("path"), H.murmur3(F.col("text").cast("binary")).alias("murmur3"))


def _kv(spark: SparkSession, sf_dir: str) -> KeyValueTable:
    """Counts; then newer values below 80; then deletes below 10."""
    f = C.frequencies(_doc(spark, sf_dir)).select(F.col("fp").alias("key"), F.col("cnt").alias("value"))
    table = KeyValueTable(spark, scratch_path(spark, "kv"))
    table.write(f, 0)
    table.write(f.where("key < '80'").withColumn("value", F.col("value") + 1), 1)
    table.write(f.limit(0), 2, deletes=f.where("key < '10'"))
    return table


_KV = _TRACE + """,
f AS (SELECT fp AS key, count(*) AS value FROM trace GROUP BY 1),
kv AS (SELECT key, CASE WHEN key < '80' THEN value + 1 ELSE value END AS value FROM f WHERE key >= '10')"""


@query("WITH " + _KV + " SELECT key, value FROM kv SEMI JOIN (SELECT substr(md5(event_type || '-' || user_id), 1, 12) AS key FROM events UNION SELECT fp FROM trace WHERE seq & 16777215 = 0) USING (key)")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of the first chunk of each document, and of keys that are not there."""
    asked = T.event_trace(spark, sf_dir).select(F.col("fp").alias("key")).unionByName(_doc(spark, sf_dir).where("seq & 16777215 = 0").select(F.col("fp").alias("key")))
    return _kv(spark, sf_dir).get(asked)


@query("WITH " + _KV + " SELECT key, value FROM f WHERE key < 'c0'")
def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the first version, whatever was written later."""
    return _kv(spark, sf_dir).scan(high="c0", at_version=0)


@query("WITH " + _KV + " SELECT * FROM kv")
def kv_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _kv(spark, sf_dir)
    compact = table.compact(scratch_path(spark, "kv-compact"))
    table.destroy()
    return compact.scan()


@query("WITH " + _KV + """, n AS (SELECT 'next' AS way, row_number() OVER (ORDER BY key) AS place, key, value FROM kv WHERE key >= '7' LIMIT 100),
p AS (SELECT 'prev' AS way, row_number() OVER (ORDER BY key DESC) AS place, key, value FROM kv WHERE key < '7')
SELECT * FROM n WHERE place <= 100 UNION ALL SELECT * FROM p WHERE place <= 100""".replace(" LIMIT 100)", ")"))
def kv_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred entries either way from a key: seeking, stepping on and stepping back."""
    table = _kv(spark, sf_dir)
    ways = [table.iterate("7", 100).withColumn("way", F.lit("next")), table.iterate("7", 100, back=True).withColumn("way", F.lit("prev"))]
    return ways[0].unionByName(ways[1]).select("way", "place", "key", "value")


@query("WITH " + _TRACE + ", f AS (SELECT fp, min(stream) AS snapshot FROM trace GROUP BY 1) SELECT snapshot, count(*) AS update_access FROM f GROUP BY 1")
def resumed_update_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store run in three jobs, its state saved and restored between them: unique inserts of each snapshot."""
    trace = kept(_doc(spark, sf_dir).select("stream", "seq", "fp", "size"), "trace")
    cuts = [r[0] for r in trace.select("stream").distinct().orderBy("stream").collect()]  # a row for each snapshot
    bounds = [None, cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3], None] if len(cuts) > 2 else [None, None]
    out, state = [], None
    for low, high in zip(bounds, bounds[1:]):
        rows = trace
        rows = rows.where(F.col("stream") >= low) if low is not None else rows
        rows = rows.where(F.col("stream") < high) if high is not None else rows
        counts, state = S.run_store(rows, state, lru_entries=4096, bloom_entries=1_000_000, container_bytes=CONTAINER)
        out.append(counts)
    return reduce(DataFrame.unionByName, out).where("update_access > 0").select("snapshot", "update_access")


@query(_CONTAINERS + """, asked AS (SELECT DISTINCT stream, container_no FROM fold WHERE fp < '08')
SELECT stream, container_no, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, min(seq) AS first_seq FROM fold SEMI JOIN asked USING (stream, container_no) GROUP BY 1, 2""")
def containers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers written, and those read again that hold a fingerprint below 08."""
    packed = pack_containers(_doc(spark, sf_dir), CONTAINER)
    path = scratch_path(spark, "containers")
    S.write_containers(packed, path)
    asked = S.read_containers(spark, path).where("fp < '08'").select("stream", "container_no")
    found = S.read_containers(spark, path, asked)
    return found.groupBy("stream", "container_no").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq"))


@query("""WITH d AS (SELECT doc_id::VARCHAR AS path, hex(encode(text)) AS h FROM documents WHERE text <> ''),
c AS (SELECT 0 AS config, 512 AS size UNION ALL SELECT 1, 4096),
p AS (SELECT config, path, i AS chunk_no, i * c.size AS "offset", unhex(substr(h, i * c.size * 2 + 1, c.size * 2)) AS piece FROM (SELECT config, size, path, h, unnest(range(0, (length(h) + 2 * size - 1) // (2 * size))) AS i FROM d, c) c)
SELECT config, path, chunk_no, "offset", octet_length(piece) AS size, CASE config WHEN 0 THEN substr(md5(piece), 1, 12) ELSE sha1(piece) END AS fp, CAST(10 AS INTEGER) AS cratio FROM p""")
def multi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunkings with hashes of their own in one pass over the files."""
    configs = [{"method": "fixed", "params": VariableParams(smallest=512)}, {"method": "fixed", "params": VariableParams(smallest=4096), "hashing": "sha1"}]
    return multi_scan_files(_docs_files(spark, sf_dir), configs)


_EVENTS = "SELECT strftime(ts, '%Y-%m-%d') AS stream, event_id AS seq, substr(md5(event_type || '-' || user_id), 1, 12) AS fp, 4096 + event_id % 4096 AS size FROM events"
LRU = 64


# Which chunks are new, and so every container, does not depend on the cache; the walk carries the cache alone: what a list of
# accesses leaves are the last LRU different ones.
@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY stream, seq) AS n FROM ({_EVENTS})),
u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n) AS k FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY fp ORDER BY n) = 1)),
fold AS (SELECT stream, k, n, fp, size AS open, 0 AS box FROM u WHERE k = 1
  UNION ALL SELECT u.stream, u.k, u.n, u.fp, CASE WHEN f.open + u.size > {CONTAINER} THEN u.size ELSE f.open + u.size END, f.box + CASE WHEN f.open + u.size > {CONTAINER} THEN 1 ELSE 0 END
  FROM fold f JOIN u ON u.stream = f.stream AND u.k = f.k + 1),
boxes AS MATERIALIZED (SELECT stream, box, list(fp ORDER BY n) AS members, list(n ORDER BY n) AS born FROM fold GROUP BY 1, 2),
e AS MATERIALIZED (SELECT n.n, n.stream, n.fp, f.n AS first_n, b.members[1:len(list_filter(b.born, lambda x: x <= n.n))] AS loaded, coalesce(n.stream <> lag(n.stream) OVER (ORDER BY n.n), false) AS turn
  FROM n JOIN fold f USING (fp) JOIN boxes b ON b.stream = f.stream AND b.box = f.box),
run AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS lru, CAST(NULL AS VARCHAR) AS stream, 0 AS asked, 0 AS added, 0 AS loaded
  UNION ALL
  SELECT n, CASE WHEN hit THEN list_filter(lru, lambda x: x <> fp) || [fp] WHEN n = first_n THEN lru ELSE (list_filter(lru, lambda x: NOT list_contains(members, x)) || members)[-{LRU}:] END,
         stream, CASE WHEN hit OR n = first_n THEN 0 ELSE 1 END, CASE WHEN NOT hit AND n = first_n THEN 1 ELSE 0 END, CASE WHEN hit OR n = first_n THEN 0 ELSE len(members) END
  FROM (SELECT e.n, e.stream, e.fp, e.first_n, e.loaded AS members, CASE WHEN e.turn THEN list_reverse(r.lru) ELSE r.lru END AS lru, list_contains(r.lru, e.fp) AS hit FROM run r JOIN e ON e.n = r.n + 1))
SELECT stream AS snapshot, CAST(sum(asked) AS BIGINT) AS index_access, CAST(sum(added) AS BIGINT) AS update_access, CAST(sum(loaded) AS BIGINT) AS loading_access FROM run WHERE n > 0 GROUP BY 1""")
def store_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache, filter, index and containers over the days of events: every counter."""
    return S.simulate_store(T.event_trace(spark, sf_dir), lru_entries=LRU, bloom_entries=1_000_000, error=1e-6, container_bytes=CONTAINER)


@query("WITH RECURSIVE " + _SCRAMBLE + """,
low AS (SELECT stream, seg_id, min(fp) AS key_fp FROM segs GROUP BY 1, 2),
made AS (SELECT 'combined' AS scheme, stream, substr(md5(unhex(fp || key_fp)), 1, 12) AS fp FROM mixed JOIN low USING (stream, seg_id) UNION ALL SELECT 'plain', stream, fp FROM base),
first AS (SELECT scheme, fp, min(stream) AS snapshot FROM made GROUP BY 1, 2)
SELECT scheme, snapshot, count(*) AS update_access FROM first GROUP BY 1, 2""")
def store_by_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store under the plain and the combined stream: unique inserts of each snapshot."""
    found = R.store_by_scheme(_doc(spark, sf_dir), SEG_MIN, SEG_MAX, lru_entries=4096, bloom_entries=1_000_000, container_bytes=CONTAINER)
    return found.where("update_access > 0").select("scheme", "snapshot", "update_access")


_DAYS = f"""WITH t AS ({_EVENTS.replace("SELECT strftime", "SELECT event_type AS who, strftime")}), days AS (SELECT who, max(stream) AS last FROM t GROUP BY 1),
f AS (SELECT who, stream, fp, count(*) AS cnt FROM t GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY who, stream ORDER BY cnt DESC, fp) AS rank FROM f),
pairs AS (SELECT a.who, a.stream AS aux, a.fp = b.fp AS ok FROM r a JOIN days d USING (who) JOIN r b ON b.who = a.who AND b.stream = d.last AND b.rank = a.rank WHERE a.stream < d.last),
n AS (SELECT who, count(*) AS unique_chunks FROM r JOIN days USING (who) WHERE stream = last GROUP BY 1)"""


@query(_DAYS + " SELECT who, aux, unique_chunks, count(*) FILTER (ok) AS correct, round(100.0 * count(*) FILTER (ok) / unique_chunks, 6)::DOUBLE AS rate FROM pairs JOIN n USING (who) GROUP BY 1, 2, 3")
def snapshot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's snapshots against the last one: users are event types, snapshots their days."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("who"))
    return R.snapshot_matrix(T.event_trace(spark, sf_dir).join(events, "seq"), "who", "stream")


@query("WITH " + _TRACE + """, aux AS (SELECT DISTINCT fp FROM trace WHERE block < 0.5 * ((SELECT max(block) FROM trace) + 1))
SELECT (SELECT count(*) FROM aux) AS members, CAST(0 AS BIGINT) AS missed, true AS within""")
def bloom_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters over half of the chunks miss none of them, and hold few others (at most twice their error)."""
    trace = _doc(spark, sf_dir).select("block", "fp")
    half = T.in_first(0.5, T.last_block(spark, sf_dir))
    seen = kept(trace.groupBy("fp").agg(F.max(half).alias("member")), "members")
    tested = S.found_by_filters(seen, entries=1_000_000)
    member, found = F.col("member"), F.col("found")
    n = tested.agg(F.count_if(member).alias("members"), F.count_if(member & ~found).alias("missed"), F.count_if(found & ~member).alias("wrong"), F.count_if(~member).alias("others"))
    return n.select("members", "missed", (F.col("wrong") <= 2 * S.BLOOM_ERROR * F.col("others")).alias("within"))


@query("""SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation,
round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latency_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])


@query("WITH " + _FILES + """ SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM pages WHERE url IS NOT NULL) AS links,
CAST((SELECT sum(size) FROM chunks) AS BIGINT) AS bytes, (SELECT count(*) FROM chunks) AS chunks""")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a scan whose files are the documents and whose links are the pages."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").select(F.lit("file").alias("kind"))
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select(F.lit("link").alias("kind"))
    return R.scan_totals(files.unionByName(links), _doc(spark, sf_dir))
