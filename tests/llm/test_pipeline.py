"""The pipeline's stages against brute force over what each of them gets."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from tests.llm.test_operators import brute_repeats, odd_texts, table
from tracewright.llm import packing, simhash


def test_stages(spark, tmp_path):
    rows = [(i, t, "en" if k % 2 else "de") for k, (i, t, _) in enumerate(odd_texts(7))]
    bench = tmp_path / "benchmark.parquet"
    passage = rows[4][1]
    spark.createDataFrame([(1, " ".join(passage.split()[:20]))], "item_id long, text string").write.parquet(str(bench))
    docs = table(spark, rows)
    at = 0
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == P.COLUMNS
        out.write.parquet(str(tmp_path / f"s{at}"))
        before, docs = docs.select(*P.COLUMNS).collect(), spark.read.parquet(str(tmp_path / f"s{at}"))
        after = docs.collect()
        at += 1
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {500, 501, 502}
            assert all(any(map(str.isalpha, r.text or "")) for r in after)
        if name == "near_duplicates":
            fps = [simhash.fingerprint(r.text) for r in before]
            group = list(range(len(fps)))
            for _ in fps:
                for a in range(len(fps)):
                    for b in range(a):
                        if (fps[a] ^ fps[b]).bit_count() <= 3:
                            group[a] = group[b] = min(group[a], group[b])
            low = lambda r: (r.doc_id is None, r.doc_id or 0)
            stays = [min((r for r, k in zip(before, group) if k == g), key=low) for g in sorted(set(group))]
            assert Counter(map(low, stays)) == Counter(map(low, after))
            assert not Counter(after) - Counter(before)
        if name == "repeated_passages":
            want = {w[0]: w for w in brute_repeats([(r.doc_id, r.text, None) for r in before])}
            assert {r.doc_id for r in after} == {i for i, w in want.items() if w[2] < w[1] or not w[2]}
            for r in after:
                text = next(b.text for b in before if b.doc_id == r.doc_id) if not want[r.doc_id][2] else r.text
                assert hashlib.sha256(b" ".join(text.encode().split())).hexdigest() == want[r.doc_id][3]
        if name == "contaminated":
            window = [w.lower() for w in passage.split()[:20]]
            windows = {tuple(window[k : k + 13]) for k in range(8)}

            def share(text):
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
                hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
                return len(hit) > 0 and 20 * len(hit) >= len(w)

            assert 4 in {r.doc_id for r in before} - {r.doc_id for r in after}
            assert Counter(after) == Counter(r for r in before if not share(r.text))
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tok = packing.WordTokenizer(packing.vocabulary_path()).tokenizer
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in packed) == Counter((r.doc_id, len(ids(r.text)) // 4, zlib.crc32(ids(r.text))) for r in after)


def test_run_equals_stages(spark, tmp_path):
    table(spark, odd_texts(8)).drop("fp").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(odd_texts(8)[2][1].split()[:16]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    pieces = lambda rows: Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert len(got) > 5 and pieces(got) == pieces(docs.collect())
    assert all(r.offset + r.length <= 4096 for r in got)


def unlike(seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_rows_that_share_an_id_have_verdicts_of_their_own(spark, tmp_path):
    passage = unlike(1)
    cut = unlike(2) + " " + passage
    rows = [(-5, passage)] + [(i, t) for i in (None, 7) for t in (cut + f" {i}", unlike(3 if i else 4), unlike(5 if i else 6))]
    docs = table(spark, [(i, t, "en") for i, t in rows])
    got = P.repeated_passages(spark, docs, str(tmp_path)).collect()
    # a null id counts as the least: its passages stay, and those of the ids -5 (all of it) and 7 go
    want = [*rows[1:4], (7, "7"), *rows[5:]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
    assert all(r.n_chars == (None if (r.doc_id, r.text) in rows else 1) for r in got)

    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(str(x) for x in rows if passage not in x[1])


def test_one_row_of_each_near_duplicate_group_stays(spark, tmp_path):
    a, b, c, d, e = (unlike(k) for k in range(11, 16))
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, c), (None, c), (None, c.upper()), (None, d), (9, d), (None, e), (3, e), (3, e.upper())]
    got = P.near_duplicates(spark, table(spark, [(i, t, "en") for i, t in rows]), str(tmp_path)).collect()
    kept = [(r.doc_id, r.text.lower()) for r in got]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (2, b), (None, c), (9, d), (3, e)]))
