"""Golden micro-traces, sequential models and round trips of the trace engine."""

import os
import random
import sys
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.functions import hashing as H
from tracewright.operators import chunking as K
from tracewright.operators import counting as C
from tracewright.operators import defense as D
from tracewright.operators import inference as I
from tracewright.operators import store as S
from tracewright.operators.lineage import kept
from tracewright.operators.segments import pack_containers, segment
from tracewright.plans import catalog
from tracewright.plans import reports as R
from tracewright.sources import hashfile as X
from tracewright.sources import traces as T
from tracewright.sources.kvstore import KeyValueTable

#: Fingerprints of two events that have equal Murmur2 under every seed.
SHARED = ("8cefb4594c71", "9b91baf2a7f9")
KIND = "stream string, block long, seq long, fp string, size long, cratio short"


def fp(i: int, last: str = "00") -> str:
    return f"{i:010x}{last}"


def trace(spark, streams: dict):
    rows = [(s, i // 3, i, f, n, 10) for s, own in streams.items() for i, (f, n) in enumerate(own)]
    return spark.createDataFrame(rows, KIND)


def test_aba_neighbours(spark):
    t = trace(spark, {"u": [(fp(1), 1), (fp(2), 1), (fp(1), 1)]})
    assert {(r.fp, r.cnt) for r in C.frequencies(t).collect()} == {(fp(1), 2), (fp(2), 1)}
    left = {(r.fp, r.nfp, r.cnt) for r in C.neighbors(t, "left").collect()}
    assert left == {(fp(2), fp(1), 1), (fp(1), fp(2), 1)}


def test_neighbours_stay_in_streams_and_cross_blocks(spark):
    own = [(fp(random.Random(1).randrange(4) + i % 3), 1) for i in range(20)]
    t = trace(spark, {"u": own, "v": own[::-1]})
    want = Counter((b[0], a[0]) for s in (own, own[::-1]) for a, b in zip(s, s[1:]))
    assert {(r.fp, r.nfp): r.cnt for r in C.neighbors(t, "left").collect()} == want
    assert sum(want.values()) == t.count() - 2


def test_carries_reach_over_parts_of_a_stream(spark):
    r = random.Random(4)
    rows = [("u", b, 10 * b + i, fp(r.randrange(9)), 1, 10) for b in (0, 1, 2, 7, 8, 30, 31, 95) for i in range(r.randrange(1, 4))]
    got = {x.seq: x.prev for x in C.adjacent(spark.createDataFrame(rows, KIND), spread=4).collect()}
    assert got == {b[2]: a[3] if a else None for a, b in zip([None, *rows], rows)}


def test_numbers_run_over_classes(spark):
    d = spark.createDataFrame([(i,) for i in random.Random(1).sample(range(1000), 300)], "v long")
    got = {x.v: x.number for x in C.numbered(d, F.floor(F.col("v") / 64), "v").collect()}
    assert got == {v: k for k, v in enumerate(sorted(got))}


def test_empty_and_single(spark):
    for rows in ({}, {"u": [(fp(1), 5)]}):
        t = trace(spark, rows) if rows else spark.createDataFrame([], KIND)
        assert C.neighbors(t, "right").count() == 0
        assert segment(t).count() == t.count() == pack_containers(t).count()
        assert S.simulate_store(t, 10, 1000, 0.01, 100).count() == len(rows)


def test_rank_is_canonical(spark):
    rows = [(fp(i), 1 + i % 3) for i in range(50)]
    got = {r.fp: r.rank for r in C.frequency_rank(spark.createDataFrame(rows, "fp string, cnt long")).collect()}
    want = {f: k + 1 for k, (f, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_segment_boundaries(spark):
    own = [(fp(1, "3f"), 50), (fp(2), 60), (fp(3, "3f"), 10), (fp(4, "ff"), 90), (fp(5, "7f"), 100), (fp(6), 1), (fp(7), 500)]
    got = [r.seg_id for r in segment(trace(spark, {"u": own}), 100, 200).orderBy("seq").collect()]
    assert got == [0, 0, 1, 1, 1, 2, 3]  # the sum of exactly 200 stays; the oversize chunk is alone


def test_minhash_scramble_combined(spark):
    r = random.Random(3)
    t = segment(trace(spark, {s: [(fp(r.randrange(30), "3f" if r.random() < 0.1 else "00"), r.randrange(1, 60)) for _ in range(90)] for s in "uv"}), 100, 400)
    rows = t.collect()
    low = {}
    for x in rows:
        low[x.stream, x.seg_id] = min(low.get((x.stream, x.seg_id), "z"), x.fp)
    import hashlib

    for x in D.minhash_encrypt(t).collect():
        assert x.c_fp == hashlib.md5(bytes.fromhex(x.fp + low[x.stream, x.seg_id])).hexdigest()[:12]
    mixed = D.scramble(t).collect()
    for s in "uv":
        own = sorted((x for x in mixed if x.stream == s), key=lambda x: x.new_seq)
        assert [x.new_seq for x in own] == list(range(90))
        assert [x.seg_id for x in own] == sorted(x.seg_id for x in own)
        assert Counter(x.fp for x in own) == Counter(x.fp for x in rows if x.stream == s)
    assert {x.key_fp for x in D.minhash_encrypt(t, k=3).collect()} <= {x.fp for x in rows}
    assert D.ground_truth(D.combined(t)).count() == D.combined(t).select("c_fp").distinct().count()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("v", [1, 3])
def test_levels_equal_queue(spark, seed, v):
    r = random.Random(seed)
    own = [(fp(r.randrange(25)), 1) for _ in range(120)]
    aux, target = trace(spark, {"u": own[:100]}), trace(spark, {"u": own})
    one = I.locality_inference(aux, target, u=3, v=v)[0]
    two = I.locality_inference(aux, target, u=3, v=v, local_rows=0)[0]
    key = lambda d: [(x.level, x.m_fp, x.c_fp) for x in d.orderBy("pos").collect()]
    assert key(one) == key(two)
    assert one.select("c_fp").distinct().count() == one.count()


@pytest.mark.parametrize("last", ["00", "00aaaa"])
def test_parts_of_a_stream_equal_streams_of_their_own(spark, last):
    """One pass over a target and the parts of it, with fingerprints that are numbers of 12 digits or not."""
    r = random.Random(4)
    whole = trace(spark, {s: [(fp(r.randrange(40), last), 1) for _ in range(150)] for s in ("u", "x")})
    key = lambda d: [tuple(x) for x in d.orderBy("pos").collect()]
    *parts, target = I.snapshots(whole, 4, [F.col("block") < 20, F.col("block") < 45, F.lit(True)])
    for n, part in zip((20, 45), parts):
        want = I.locality_inference(whole.where(F.col("block") < n), whole, u=3, v=4, local_rows=0)
        got = I.locality_inference(part, target, u=3, v=4)
        assert key(got[0]) == key(want[0]) and got[1].collect() == want[1].collect()


def test_sweep_over_snapshots_equals_sweep_over_streams(spark):
    r = random.Random(6)
    whole = trace(spark, {"u": [(fp(r.randrange(30)), 1) for _ in range(150)]})
    shares = {"a": F.col("block") < 20, "b": F.col("block") < 45}
    *parts, target = I.snapshots(whole, 4, [*shares.values(), F.lit(True)])
    rows = lambda d: sorted(tuple(x) for x in d.collect())
    assert rows(R.sweep(dict(zip(shares, parts)), target, u=3, v=4)) == rows(R.sweep({k: whole.where(c) for k, c in shares.items()}, whole, u=3, v=4))


def test_schemes_over_one_set_of_segments(spark):
    """A snapshot of the auxiliary stream and written segments give what streams give, for a scheme with a truth."""
    r = random.Random(9)
    whole = trace(spark, {"u": [(fp(r.randrange(30)), 10) for _ in range(120)]})
    aux = whole.where("block < 30")
    got = R.evaluate_segments(I.snapshot(aux, 4), segment(whole, 40, 90), "combined", v=4, u=3).collect()
    parts = D.combined(segment(whole, 40, 90))
    want = I.locality_inference(aux, D.as_stream(parts, "c_fp", "new_seq"), u=3, v=4, truth=D.ground_truth(parts), local_rows=0)[1]
    assert got == want.withColumn("scheme", F.lit("combined")).collect()


@pytest.mark.parametrize("scheme", ["minhash", "scramble", "combined"])
def test_schemes_write_numbers_and_neighbours_once(spark, monkeypatch, scheme):
    """No window over a written scheme, and its truth is that of ground_truth, also where plaintexts share a ciphertext."""
    names = []
    for at in (R, I, D):
        monkeypatch.setattr(at, "kept", lambda d, name: names.append((name, dict(d.dtypes).get("fp"))) or kept(d, name))
    r = random.Random(3)
    whole = trace(spark, {s: [(fp(r.randrange(30)), 10) for _ in range(60)] for s in ("u", "x")})
    R.evaluate_segments(I.snapshot(whole.where("block < 30"), 4), segment(whole, 40, 90), scheme, v=4, u=3)
    at = names.index(("made", "bigint"))
    assert "beside" not in [n for n, _ in names[at:]]


def test_last_plaintext_of_a_ciphertext(spark):
    rows = [(9, 1, "u", 5), (9, 2, "u", 7), (9, 3, "t", 8), (4, 6, "u", 1), (4, 6, "x", 2)]
    got = D.last_plain(spark.createDataFrame(rows, "fp long, plain long, stream string, was long"))
    want = D.ground_truth(spark.createDataFrame(rows, "c_fp long, fp long, stream string, seq long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(4, 6), (9, 2)]


def test_long_chain_is_walked_in_one_task(spark):
    """5,000 levels of one pair each, as in long texts: level by level on tables this would take hours."""
    t = trace(spark, {"u": [(fp(i), 1) for i in range(5000)]})
    pairs = I.locality_inference(t, t, u=1, v=2, local_rows=I.LOCAL_ROWS)[0]
    assert pairs.agg(F.count("*"), F.max("level")).first() == (5000, 4999) and I.LOCAL_ROWS > 10**7


def test_lone_neighbours_are_not_ranked(spark):
    """Of 300 fingerprints one has several neighbours on a side; only it has ranked lists, in every part."""
    t = trace(spark, {"u": [(fp(i), 1) for i in [*range(150), 7, 7, *range(150, 300)]]})
    half, whole = I.snapshots(t, 4, [F.col("block") < 40, F.lit(True)])
    assert [{int(x.fp) >> 8 for x in s.lists.collect()} for s in (half, whole)] == [{7}, {7}]
    assert half.lone is whole.lone and (half.lone.count(), whole.size) == (299, 602)


def test_leakage_query_has_no_queue_limit(spark, tmp_path, monkeypatch):
    """Its SQL has none, and with a seed per hundred chunks the queue outgrows any fixed one: an operator's limit must not reach it."""
    r = random.Random(12)
    texts = [(i, "".join(r.choice(["%064d" % r.randrange(2500), "%064d" % (10**6 + i)]) for _ in range(30)), "s") for i in range(150)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for w in (3, 10**9):
        monkeypatch.setattr(I.locality_inference, "__defaults__", (5, 30, w, 0.0, None, I.LOCAL_ROWS))
        got.append(tuple(catalog.locality_leakage_summary(spark, str(tmp_path)).first()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == [db.execute(catalog.ORACLES["locality_leakage_summary"]).fetchone()] * 2 and got[0][2] > 3


def test_chunks_of_documents_with_those_beside(spark, tmp_path):
    """Neighbours from a document's own array are those of the window, which the trace itself needs."""
    texts = [(3, "ab" * 200, "s"), (1, "x", "t"), (2, "", "s"), (7, "y\n" * 64 + "é", "s"), (9, None, "s")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = C.with_beside(T.doc_trace(spark, str(tmp_path), stream="").select("stream", "block", "seq", I._number(F.col("fp")).alias("fp")))
    got = T.doc_numbers(spark, str(tmp_path))
    rows = lambda d: sorted(map(tuple, d.collect()), key=lambda x: x[2])
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() == 7 + 1 + 3


def test_snapshots_write_one_table_of_fingerprints(spark, monkeypatch):
    """Frequencies and neighbours come from one aggregate; pairs of all chunks are not written."""
    names = []
    monkeypatch.setattr(I, "kept", lambda d, name: names.append(name) or kept(d, name))
    t = trace(spark, {"u": [(fp(i % 40), 1) for i in range(90)], "x": [(fp(99), 1)]})
    half, whole = I.snapshots(t, 4, [F.col("block") < 20, F.lit(True)])
    assert names == ["beside", "across", "ends", "lists"]
    for s, part in ((half, t.where("block < 20")), (whole, t)):
        assert sorted(map(tuple, s.freq.collect())) == sorted(map(tuple, C.frequencies(part).collect()))


def _random_links(r, n, lone):
    own = [(i, r.randrange(n)) for i in range(n) if r.random() < lone]
    rest = sorted({*range(n)} - {i for i, _ in own})
    entries = [(i, r.randrange(n), k) for i in rest if r.random() < 0.8 for k in range(r.randrange(1, 4))]
    links = I._Links(n)
    column = lambda rows, k: np.array([x[k] for x in rows], np.int32)
    links.fill((column(own, 0), column(own, 1)), *(column(entries, k) for k in range(3)))
    return links


@pytest.mark.parametrize("lone", [0.0, 0.6, 1.0])
def test_wide_levels_equal_narrow_ones(lone):
    """Levels expanded side by side give the pairs, order and marks of pair by pair, below and at a queue limit."""
    r = random.Random(lone)
    longest = 0
    for n in (20, 200, 900):
        for w in (3, 12, 60, sys.maxsize):
            aux, target = ([_random_links(r, n, lone) for _ in "lr"] for _ in "at")
            start = [(r.randrange(n), c) for c in r.sample(range(n), 10)]
            out = []
            for wide in (1, 10**9):
                seen = bytearray(n)
                for _, c in start:
                    seen[c] = 1
                out.append([*I._walk_numbers(start, seen, aux, target, w, wide), seen])
            assert out[0] == out[1]
            longest = max(longest, len(out[0][0]))
    assert longest > 100


def test_places_of_uneven_and_missing_values():
    for keys in ([5, 6, 7, 1 << 47], [*range(1000), 1 << 47], [9]):
        keys = np.array(keys)
        assert I._places(keys, keys[::-1], 7).tolist() == list(range(len(keys)))[::-1]
        assert (I._places(keys, np.array([-1, 8, 1 << 50])) <= len(keys)).all()


@pytest.mark.parametrize(("w", "leakage"), [(4, 0.0), (12, 0.0), (12, 0.5)])
def test_levels_keep_the_queue_limit(spark, w, leakage):
    r = random.Random(w)
    own = [(fp(r.randrange(60)), 1) for _ in range(300)]
    aux, target = trace(spark, {"u": own[:250]}), trace(spark, {"u": own})
    key = lambda d: [(x.level, x.m_fp, x.c_fp) for x in d.orderBy("pos").collect()]
    run = lambda **more: key(I.locality_inference(aux, target, u=3, v=4, leakage=leakage, **more)[0])
    one = run(w=w)
    assert one == run(w=w, local_rows=0) and one != run(w=10**6)


def test_bottom_alignment_and_queue_limit():
    aux = {(0, "m"): ["a1", "a2", "a3"]}
    target = {(0, "c"): ["b1", "b2"]}
    got = I.walk([("m", "c")], {"c"}, aux, target, 100)
    assert got == [(0, "m", "c"), (1, "a2", "b2"), (1, "a1", "b1")]
    assert I.walk([("m", "c")], {"c"}, aux, target, 2) == [(0, "m", "c"), (1, "a2", "b2")]
    assert I.walk([("m", "c")], {"c"}, aux, target, 1) == [(0, "m", "c")]


def test_numbers_of_fingerprints_take_little_memory():
    """Beside what goes in, making and looking up keys holds 20 bytes for each at most."""
    r = np.random.default_rng(3)
    pieces = [r.integers(0, 1 << 48, n) for n in (400_000, 300_000)]
    pieces.append(pieces[0][:1000])
    tracemalloc.start()
    keys = I._distinct(pieces)
    places = I._places(keys, pieces[1], 10_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(keys) and (keys[places] == pieces[1]).all()
    assert keys.tolist() == sorted(set(np.concatenate(pieces).tolist())) and not len(I._distinct([keys[:0]]))


def test_walk_of_a_large_trace_fits_one_task():
    """About 90,000,000 neighbours, those of a GB of documents, are below the limit; a fingerprint with its lone neighbours on both
    sides takes 20 bytes, 30 while they are made. Rows that come before the last key wait."""
    r = np.random.default_rng(5)
    n = 400_000
    keys = r.permutation(np.unique(r.integers(0, 1 << 48, n)))
    n = len(keys)
    before, behind = np.roll(keys, 1), np.roll(keys, -1)
    tracemalloc.start()
    space = I._Space(n)
    space.add_keys(keys[: n // 2])
    space.add(np.full(10, 3, np.uint8), *(x[:10] for x in (keys, before, behind)))
    space.add_keys(keys[n // 2 :])
    for at in range(10, n, 10_000):
        space.add(np.full(len(keys[at : at + 10_000]), 3, np.uint8), *(x[at : at + 10_000] for x in (keys, before, behind)))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 20 * n and peak < 30 * n and I.LOCAL_ROWS > 2 * 10**8
    order = space.keys.find(keys)
    assert (np.sort(keys) == space.keys.values(np.arange(n))).all() and (np.sort(keys)[order] == keys).all()
    for of, x in zip(space.of, (before, behind)):
        assert (space.keys.values(of[order]) == x).all()
    assert (space.own == 3).all()


def test_summary_writes_no_pairs(spark, monkeypatch):
    """The walk in one task counts for a summary, and gives what the summary beside pairs has."""
    made = []
    monkeypatch.setattr(I, "kept", lambda d, name: made.append((name, d.columns)) or kept(d, name))
    t = trace(spark, {"u": [(fp(i % 40), 1) for i in range(90)]})
    half, whole = I.snapshots(t, 4, [F.col("block") < 20, F.lit(True)])
    got = I.locality_summary(half, whole, u=3, v=4).first()
    assert ("walk", ["inferred", "hits"]) in made and got == I.locality_inference(half, whole, u=3, v=4)[1].first()


@pytest.mark.parametrize("leakage", [0.0, 0.5])
def test_summary_compares_numbers(spark, leakage):
    """Pairs are written as numbers; a summary makes no digits of them."""
    t = trace(spark, {"u": [(fp(i % 40), 1) for i in range(90)]})
    pairs, summary = I.locality_inference(t.where("seq < 60"), t, leakage=leakage)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "lpad" in plan(pairs) and "lpad" not in plan(summary)
    assert summary.first().inferred == pairs.count()


def test_full_leak(spark):
    t = trace(spark, {"u": [(fp(i % 7), 1) for i in range(30)]})
    s = I.locality_inference(t.where("seq < 5"), t, leakage=1.0)[1].first()
    assert (s.leaked, s.leaked_in_aux, s.correct, s.rate) == (7, 5, 7, 100.0)


def test_store_against_model(spark):
    r = random.Random(5)
    streams = {s: [(fp(r.randrange(40)), r.randrange(10, 30)) for _ in range(200)] for s in ("d1", "d2")}
    got = {x.snapshot: (x.index_access, x.update_access, x.loading_access) for x in S.simulate_store(trace(spark, streams), 5, 5000, 0.001, 120).collect()}
    lru, where, boxes, size, want = [], {}, [[]], 0, {}
    for s, own in streams.items():
        n = [0, 0, 0]
        for f, k in own:
            if f in lru:
                lru.remove(f)
                lru.append(f)
            elif f not in where:
                if size + k > 120:
                    boxes.append([])
                    size = 0
                boxes[-1].append(f)
                size += k
                where[f] = len(boxes) - 1
                n[1] += 1
            else:
                n[0] += 1
                for x in boxes[where[f]]:
                    n[2] += 1
                    lru = [y for y in lru if y != x][-(4 if x not in lru else 5) :] + [x]
        if boxes[-1]:
            boxes.append([])
            size = 0
        lru.reverse()
        want[s] = tuple(n)
    assert got == want
    assert {x.snapshot: x.update_access for x in S.update_accesses(trace(spark, streams)).collect()} == {k: v[1] for k, v in want.items()}


def test_hash_vectors():
    assert H.murmur3_x64_128(b"", 0).hex() == "0" * 32
    assert H.murmur3_x64_128(b"hello", 0).hex() == "029bbd41b3a7d8cb191dae486a901e5b"
    assert H.murmur2_32(b"", 0) == 0
    assert H.crc32c_value(b"123456789") == 0xE3069283
    assert H.compression_ratio(b"a" * 10_000) == 255


def test_rabin_follows_the_rolling_rule():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(6000))
    p = K.VariableParams(window=16, bits=6, pattern=0x3F, smallest=40, largest=300)

    def model(at: int) -> int:
        left = len(data) - at
        for end in range(max(p.smallest, p.window), min(left + 1, p.largest)):
            f = 0
            for b in data[at + end - p.window : at + end]:
                f = (f * K.RABIN_PRIME + b) % K.RABIN_MODULUS
            if f & p.mask == p.pattern:
                return end
        return p.largest if left >= p.largest else left

    at, want = 0, []
    while at < len(data):
        n = model(at)
        want.append((at, n))
        at += n
    assert K.rabin_chunks(data, p) == want
    for f in K.CHUNKERS.values():
        assert b"".join(data[o : o + n] for o, n in f(data, p)) == data
    assert K.fixed_chunks(b"x" * 10, 4, False) == [(0, 4), (4, 4)]
    assert K.VariableParams.parse("win_size=16:match_bits=6:pattern=3f:min_csize=40:max_csize=300:tails=on") == p


def test_hashfile_round_trip(spark, tmp_path):
    files = [({"path": "/a/b.txt", "file_size": 9000, "mtime": 86400, "perm": 0o644}, [(4096, "0102030405ff", 12), (4904, "aabbccddeeff", 10)]), ({"path": "/a/l", "target_path": "/t"}, [])]
    path = tmp_path / "one.hash"
    path.write_bytes(X.build("/a", files, sysid="host", start=1, end=2))
    head = X.read_header(path.read_bytes())
    assert (head["version"], head["files"], head["chunks"], head["bytes"], head["sysid"]) == (7, 2, 2, 9000, "host")
    chunks = X.read_hashfile(spark, str(path)).orderBy("file_no", "chunk_no").collect()
    assert [(c.path, c.size, c.fp, c.cratio) for c in chunks] == [("/a/b.txt", 4096, "0102030405ff", 12), ("/a/b.txt", 4904, "aabbccddeeff", 10)]
    entries = X.read_hashfile(spark, str(path), "files").orderBy("file_no").collect()
    assert [(e.path, e.target_path, e.chunks) for e in entries] == [("/a/b.txt", None, 2), ("/a/l", "/t", 0)]
    spark.dataSource.register(X.HashFileSource)
    assert spark.read.format("hashfile").load(str(path)).count() == 2
    fixed = tmp_path / "fixed.hash"
    fixed.write_bytes(X.build("/a", [({"path": "p", "file_size": 9000}, [(0, "00" * 6, 10)] * 3)], fixed_size=4096))
    assert [c.size for c in X.read_hashfile(spark, str(fixed)).orderBy("chunk_no").collect()] == [4096, 4096, 808]
    with pytest.raises(ValueError):
        X.read_header(b"\0" * 9000)


def test_text_trace_round_trip(spark, tmp_path):
    t = trace(spark, {"u": [(fp(i, "ab"), 100 + i) for i in range(5)]})
    T.write_text_trace(t, str(tmp_path / "t"))
    lines = spark.read.text(str(tmp_path / "t" / "stream=u"), wholetext=True).select(F.lit("u").alias("stream"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
    got = [(r.fp, r.size, r.cratio) for r in T.parse_text_lines(lines).orderBy("seq").collect()]
    assert got == [(fp(i, "ab"), 100 + i, 10) for i in range(5)]


def test_paths_and_formats(spark):
    d = spark.createDataFrame([("/a/b.tar.gz",), ("x/long.extension",), ("no",), (None,)], "p string")
    got = d.select(H.file_type(F.col("p")).alias("t"), H.anonymize_path("k")(F.col("p")).alias("a")).collect()
    assert [r.t for r in got][:3] == [".gz", "", ""]
    assert got[0].a.startswith("/") and got[0].a.endswith(".gz") and got[3].a is None
    row = spark.createDataFrame([("00ff3f",)], "f string").select(H.hex_bits(F.col("f")).alias("b"), H.bits_hex(H.hex_bits(F.col("f"))).alias("h"), H.parse_colon_hash(F.lit("AA:0b")).alias("c"), H.parse_colon_hash(F.lit("zz")).alias("d")).first()
    assert row.b == "000000001111111100111111" and row.h == "00ff3f" and row.c == "aa0b" and row.d is None


def test_key_value_table(spark, tmp_path):
    kv = KeyValueTable(spark, str(tmp_path / "kv"))
    d = lambda rows: spark.createDataFrame(rows, "key string, value long")
    kv.write(d([("a", 1), ("b", 2), ("c", 3)]), 1)
    kv.write(d([("b", 20)]), 2, deletes=d([("c", 0)]))
    assert {tuple(r) for r in kv.scan().collect()} == {("a", 1), ("b", 20)}
    assert {tuple(r) for r in kv.scan(at_version=1).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert [tuple(r) for r in kv.scan("b", "z").collect()] == [("b", 20)]
    assert kv.get(d([("c", 0), ("a", 0)])).count() == 1
    assert [tuple(r) for r in kv.iterate("a", 5).collect()] == [(1, "a", 1), (2, "b", 20)]
    assert [tuple(r) for r in kv.iterate("c", 1, back=True).collect()] == [(1, "b", 20)]
    found = kv.properties()
    assert (found["versions"], found["rows"], found["keys"]) == (2, 5, 2) and found["files"] >= 2
    assert 0 < kv.approximate_size("a", "b") < kv.approximate_size() == found["bytes"]
    assert kv.compact(str(tmp_path / "kv2")).scan().count() == 2 and kv.approximate_size() > 0


def test_streaming_segments_equal_batch(spark, tmp_path):
    from tracewright.streaming.traces import running_segments

    r = random.Random(9)
    own = [(fp(r.randrange(99), "3f" if r.random() < 0.2 else "00"), r.randrange(1, 80)) for _ in range(60)]
    t = trace(spark, {"u": own})
    for k in range(2):
        t.where(F.col("seq") >= 30 if k else F.col("seq") < 30).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = running_segments(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), 100, 300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = [x.seg_id for x in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == [x.seg_id for x in segment(t, 100, 300).orderBy("seq").collect()]


@pytest.mark.parametrize(("lru", "capacity"), [(3, 40), (50, 300), (400, 5)])
def test_store_with_an_overfull_filter_against_one_chunk_at_a_time(spark, lru, capacity):
    """Wrong hits of the filter, chunks larger than a container, loads larger than the cache; and no state unless asked for."""
    r = random.Random(lru)
    streams = {s: [(f"{r.randrange(2500) * 0x9E3779B1 % 2**48:012x}", r.randrange(60)) for _ in range(3000)] for s in ("d1", "d2", "d3")}
    bloom, cache, where, boxes, size, want = S.Bloom(1000, 0.05), {}, {}, [[]], 0, set()
    for s, own in streams.items():
        n = [0, 0, 0]
        for f, k in own:
            if f in cache:
                cache[f] = cache.pop(f)
                continue
            key = bytes.fromhex(f)
            n[0] += bloom.has(key)
            if f not in where:
                bloom.add(key)
                if size + k > capacity:
                    boxes.append([])
                    size = 0
                boxes[-1].append(f)
                size, where[f], n[1] = size + k, len(boxes) - 1, n[1] + 1
                continue
            for x in boxes[where[f]]:
                n[2] += 1
                cache.pop(x, None)
                cache[x] = None
                if len(cache) > lru:
                    del cache[next(iter(cache))]
        if boxes[-1]:
            boxes.append([])
            size = 0
        cache = dict.fromkeys(reversed(cache))
        want.add((s, *n))
    counts, state = S.run_store(trace(spark, streams), None, lru, 1000, 0.05, capacity, saved=False)
    assert {tuple(x) for x in counts.collect()} == want and state.isEmpty()
    got, state = set(), None
    for s, own in streams.items():
        counts, state = S.run_store(trace(spark, {s: own}), state, lru, 1000, 0.05, capacity)
        got |= {tuple(x) for x in counts.collect()}
    assert got == want
    kept = state.where("part = 'container'").orderBy("place").collect()
    assert [(x.no, x.fp) for x in kept] == [(i, f) for i, box in enumerate(boxes) for f in box]


def test_store_resumes_where_it_was_saved(spark):
    r = random.Random(8)
    streams = {f"d{k}": [(fp(r.randrange(60)), r.randrange(10, 30)) for _ in range(150)] for k in range(4)}
    sizes = {"lru_entries": 7, "bloom_entries": 5000, "error": 0.001, "container_bytes": 120}
    whole = {tuple(x) for x in S.simulate_store(trace(spark, streams), *sizes.values()).collect()}
    got, state = set(), None
    for names in (["d0"], ["d1", "d2"], [], ["d3"]):
        t = trace(spark, {k: streams[k] for k in names}) if names else spark.createDataFrame([], KIND)
        counts, state = S.run_store(t, state, **sizes)
        got |= {tuple(x) for x in counts.collect()}
    assert got == whole and {x.part for x in state.select("part").distinct().collect()} == {"lru", "container", "open", "bloom"}


def test_bloom_joins_the_filters_of_tasks(spark):
    keys = [fp(i) for i in range(500)]
    bloom = S.build_bloom(spark.createDataFrame([(k,) for k in keys], "fp string").repartition(3), 2000, 0.01)
    one = S.Bloom(2000, 0.01)
    for k in keys:
        one.add(bytes.fromhex(k))
    assert (bloom.data == one.data).all() and all(bloom.has(bytes.fromhex(k)) for k in keys)
    assert sum(bloom.has(bytes.fromhex(fp(10_000 + i))) for i in range(1000)) < 20
    assert 0 < bloom.describe()["set_share"] < 0.5 and bloom.describe()["hashes"] == 7


def test_filters_keep_their_error_beyond_one_filter(spark):
    """20,000 members in filters for 1,000 each: one filter alone would hold every other key too."""
    rows = spark.createDataFrame([(fp(i), i % 2 == 0) for i in range(40_000)], "fp string, member boolean")
    n = Counter(tuple(x) for x in S.found_by_filters(rows, 1000, 0.01).select("member", "found").collect())
    assert n[True, True] == 20_000 and not n[True, False] and 0 < n[False, True] <= 400


def test_filter_tells_keys_apart_that_share_a_short_hash():
    """Of 45,000 keys these two share Murmur2 under every seed: a filter with the first must not hold the second."""
    pair = [bytes.fromhex(x) for x in SHARED]
    assert len({H.murmur2_32(k, H.BLOOM_SEED) for k in pair}) == len({H.murmur2_32(k, 7) for k in pair}) == 1
    bloom = S.Bloom(1_000_000, 1e-6)
    bloom.add(pair[0])
    assert bloom.has(pair[0]) and not bloom.has(pair[1])
    for keys in (pair, [b"abcdefgh", b"12345678"], [b"a", b"longer than eight"]):
        want = [H.murmur3_x64_128(k) for k in keys]
        assert [x.tobytes() + y.tobytes() for x, y in zip(*H.murmur3_halves(keys))] == want


def test_hashes_of_batches_equal_those_of_rows():
    r = random.Random(3)
    data = pd.Series([None, b"", *(r.randbytes(r.randrange(0, 70)) for _ in range(90)), r.randbytes(5000)])
    rows = [b"" if x is None else x for x in data]
    assert H.murmur2_batch(data, 77) == [H.murmur2_32(x, 77) for x in rows]
    assert H.murmur3_batch(data) == [H.murmur3_x64_128(x) for x in rows]
    assert H.crc32c_batch(data) == [H.crc32c_value(x) for x in rows]
    # published values
    assert H.crc32c_value(b"123456789") == 0xE3069283 and H.crc32c_value(bytes(32)) == 0x8A9136AA
    assert H.murmur3_x64_128(b"", 0) == bytes(16)
    assert H.murmur2_32(b"", 0) == 0 and H.murmur2_32(b"", 1) == 0x5BD15E36
    assert H.pwrmod(1048583, 47, 1 << 30) == pow(1048583, 47) % (1 << 30)


@pytest.mark.parametrize("method", ["random", "simple"])
def test_chunks_keep_their_bounds(method):
    p = K.VariableParams(bits=5, pattern=0x0A, smallest=40, largest=200)
    data = random.Random(2).randbytes(30_000)
    cuts = K.random_chunks(data, p, "a") if method == "random" else K.simple_chunks(data, p)
    assert [a for a, _ in cuts] == [0, *(a + n for a, n in cuts[:-1])] and sum(n for _, n in cuts) == len(data)
    assert all(40 <= n <= 200 for _, n in cuts[:-1])
    if method == "random":
        assert cuts != K.random_chunks(data, p, "b") and cuts == K.random_chunks(data, p, "a")
        assert 60 < sum(n for _, n in cuts) / len(cuts) < 85  # 40 and about 32 more
        return
    at = 0
    while at < len(data):  # byte by byte
        n = next((n for n in range(40, 200) if at + n <= len(data) and data[at + n - 1] & 31 == 0x0A), 200)
        assert (at, min(n, len(data) - at)) == cuts.pop(0)
        at += n


@pytest.mark.parametrize("method", ["fixed", "rabin", "simple"])
@pytest.mark.parametrize("tails", [True, False])
def test_blocks_give_the_chunks_of_whole_files(spark, tmp_path, method, tails):
    p = K.VariableParams(bits=5, pattern=0x0A, smallest=60, largest=300, window=48, tails=tails)
    r = random.Random(6)
    for n in (0, 1, 59, 60, 299, 300, 301, 9000):
        data = r.randbytes(n)
        want = [(a, data[a : a + k]) for a, k in K.CHUNKERS[method](data, p)]
        for block in (1, 7, 100, 1000, 20_000):
            assert list(K.stream_chunks((data[a : a + block] for a in range(0, n, block)), method, p)) == want
    (tmp_path / "x").write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / "x"),)], "path string")
    whole = K.chunk_files(paths.withColumn("content", F.lit(bytearray(data))), method, p)
    key = lambda d: sorted(tuple(x) for x in d.collect())
    assert key(K.chunk_paths(paths, method, p, block=1000)) == key(whole)


def test_directory_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_bytes(b"x" * 5000)
    (tmp_path / "y.txt").write_bytes(b"y" * 10)
    (tmp_path / "a" / "link").symlink_to(tmp_path / "y.txt")
    os.mkfifo(tmp_path / "a" / "pipe")
    got = {(r.path.removeprefix(str(tmp_path)), r.kind, r.target) for r in K.scan_entries(spark, str(tmp_path), same_device=True).collect()}
    assert got == {("/a/b/x.txt", "file", None), ("/y.txt", "file", None), ("/a/link", "link", str(tmp_path / "y.txt"))}
    (tmp_path / "a" / "pipe").unlink()
    chunks = K.scan_directory(spark, str(tmp_path), method="fixed", params=K.VariableParams(smallest=4096))
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in chunks.collect()) == [("x.txt", 904), ("x.txt", 4096), ("y.txt", 10)]
    totals = R.scan_totals(K.scan_entries(spark, str(tmp_path)), chunks).first()
    assert tuple(totals) == (2, 1, 5010, 3)


@pytest.mark.parametrize("version", range(1, 8))
def test_hash_files_of_every_version(spark, tmp_path, version):
    files = spark.createDataFrame([("s", 0, "/a", 90, 7), ("s", 1, "/b", 5, 8), ("t", 0, "/c", 1, 9)], "snapshot string, file_no long, path string, file_size long, uid long")
    chunks = spark.createDataFrame([("s", 0, 0, 60, fp(1), 12), ("s", 0, 1, 30, fp(2), 11), ("t", 0, 0, 1, fp(3), 10)], "snapshot string, file_no long, chunk_no long, size long, fp string, cratio short")
    rabin = {"algorithm": "rabin", "window": 48, "prime": 3, "modulus": 8, "bits": 13, "pattern": 5, "smallest": 1, "largest": 9}
    out = X.write_hashfiles(files, chunks, f"file://{tmp_path}/h", version, params=rabin, root="/r", hashing="md5-48bit").collect()
    assert sorted(x.snapshot for x in out) == ["s", "t"]
    got = {(r.snapshot, r.path, r.chunk_no, r.size, r.fp, r.cratio) for r in X.read_hashfile(spark, f"{tmp_path}/h/*.hash").collect()}
    want = {("s.hash", "/a", 0, 60, fp(1), 12), ("s.hash", "/a", 1, 30, fp(2), 11), ("t.hash", "/c", 0, 1, fp(3), 10)}
    assert got == {(s, p, k, n if version > 2 else 0, f, c if version > 5 else 0) for s, p, k, n, f, c in want}
    entries = {(r.snapshot, r.path, r.file_size, r.chunks, r.uid) for r in X.read_hashfile(spark, f"{tmp_path}/h/*.hash", "files").collect()}
    assert entries == {("s.hash", "/a", 90, 2, 7 if version > 3 else None), ("s.hash", "/b", 5, 0, 8 if version > 3 else None), ("t.hash", "/c", 1, 1, 9 if version > 3 else None)}
    head = X.read_header((tmp_path / "h" / "s.hash").read_bytes())
    assert {k: head[k] for k in rabin} == rabin and (head["files"], head["chunks"], head["root"]) == (2, 2, "/r")
    spark.dataSource.register(X.HashFileSource)
    assert spark.read.format("hashfile").option("part", "files").load(f"{tmp_path}/h/*.hash").count() == 3


def test_paths_come_back_by_known_ones(spark):
    d = spark.createDataFrame([("/a/b.txt",), ("/c",)], "path string")
    files, chunks = H.anonymize_tables(d.withColumn("target_path", F.lit("/t.gz")), d.withColumn("fp", F.lit(fp(1))), "k")
    assert not {r.path for r in files.collect()} & {"/a/b.txt", "/c"} and all(r.target_path.endswith(".gz") for r in files.collect())
    assert {len(r.fp) for r in chunks.collect()} == {12}
    back = {r.original for r in H.reveal_paths(files, d, "k").collect()}
    assert back == {"/a/b.txt", "/c"} and {r.original for r in H.reveal_paths(files, d, "other").collect()} == {None}


def test_last_inferred_first(spark):
    t = trace(spark, {"u": [(fp(i % 5), 1) for i in range(20)]})
    pairs = I.locality_inference(t, t, u=1, v=2)[0]
    assert [r.pos for r in I.last_first(pairs).collect()] == sorted((r.pos for r in pairs.collect()), reverse=True)


def test_text_traces_keep_their_order(spark, tmp_path):
    t = trace(spark, {s: [(fp(i, "ab"), 100 + i) for i in range(40)] for s in ("u", "v w")})
    T.write_text_trace(t, str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many splits a file
    try:
        rows = T.read_text_trace(spark, str(tmp_path / "t")).orderBy("stream", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.stream, r.size) for r in rows] == [(s, 100 + i) for s in ("u", "v w") for i in range(40)]


def test_registered_queries_have_no_clash():
    from tracewright.plans import registered as catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 35
