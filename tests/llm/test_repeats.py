import hashlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import repeats


def brute(texts, length, keep_first=False):
    """Merged spans of each text; texts in their order."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    met, out = set(), []
    for r in raw:
        spans = []
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            if (w in met) if keep_first else seen[w] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
            met.add(w)
        out.append(spans)
    return out


def test_factors_are_those_of_the_definition():
    """Longest previous factors over all windows of some bytes, capped, against a search of every earlier window."""
    rng = np.random.default_rng(4)
    for alphabet, length in ((1, 20), (2, 20), (3, 200), (4, 37), (250, 9)):
        data = rng.integers(0, alphabet, 700).astype(np.uint8)
        if length == 200:
            data[400:650] = data[100:350]
        at, standing = np.arange(len(data) - length + 1), rng.permutation(len(data) - length + 1)
        order, lcp = repeats.suffix_order(data, at, standing, length)
        windows = [data[i : i + length].tobytes() for i in at]
        assert [windows[i] for i in order] == sorted(windows)
        got = np.empty(len(at), np.int64)
        got[order] = repeats.previous_factors(lcp, standing[order])
        common = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        for i in rng.choice(len(at), 25, replace=False).tolist():
            assert got[i] == max((common(windows[i], windows[j]) for j in np.flatnonzero(standing < standing[i]).tolist()), default=0)


def test_the_array_decides(spark, monkeypatch):
    """Without factors, different segments have no repeats: nothing beside the array says so."""
    shared = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(i, f"{i} {i * 7919} left {shared} right {i * 104729}") for i in range(1, 6)], "doc_id long, text string")
    for hot in (1, 20_000):
        assert repeats.repeated_spans(df.selectExpr("doc_id as doc", "doc_id as doc_order", "text"), 150, hot_segments=hot).count() == 5
    run = repeats.matched(150, False)
    import pyarrow as pa

    text = (shared[:170]).encode()
    group = pa.table({"doc": [1, 2], "doc_order": [1, 2], "lo": pa.array([0, 0], pa.int32()), "n": pa.array([2, 3], pa.int32()), "segment": [text[:151], text[:152]]})
    assert run(group).num_rows == 2
    monkeypatch.setattr(repeats, "previous_factors", lambda lcp, standing: np.zeros(len(lcp), np.int64))
    assert run(group).num_rows == 0


@pytest.mark.parametrize("hot", [2, 20_000])
@pytest.mark.parametrize("length", [20, 200])
def test_odd_rows(odd, clashing, length, hot):
    rows = odd.collect()
    want = Counter((str(r.doc_id), repr(s)) for r, s in zip(rows, brute([r.text for r in rows], length), strict=True))
    marked = repeats.mark_repeats(clashing, length, hot_segments=hot)
    assert sorted(marked.columns) == sorted(clashing.columns)
    assert Counter((str(r.doc_id), repr([[s.lo, s.hi] for s in r.repeat_spans])) for r in marked.collect()) == want


def test_first_copies_stay(spark):
    shared = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(120))
    rows = [(3, f"left {shared} right"), (1, f"{shared} one"), (2, f"two {shared[:150]}"), (5, "tail " + shared[100:300] + shared[100:300]), (7, "no"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 20_000):
        got = {r.doc_id: [[s.lo, s.hi] for s in r.repeat_spans] for r in repeats.mark_repeats(df, 60, True, hot).collect()}
        rows = sorted(rows)
        assert got == dict(zip([r[0] for r in rows], brute([r[1] for r in rows], 60, True), strict=True))


def test_removal_and_digest(spark, sf, nothing):
    assert repeats.mark_repeats(nothing).count() == 0
    block = "é" * 150
    df = spark.createDataFrame([(1, "a" + block + "b"), (2, "c" + block), (3, None)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in repeats.remove_repeats(repeats.mark_repeats(df)).collect()}
    assert left == {1: "ab", 2: "c", 3: None}


def test_query_against_brute_force(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want = {}
    for r, spans in zip(docs, brute([r.text for r in docs], 200), strict=True):
        raw = (r.text or "").encode()
        kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
        want[r.doc_id] = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op7_repeats(spark, sf).collect()} == want
