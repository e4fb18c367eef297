import random

import numpy as np
import pyarrow as pa

from ferrule.llm import minhash
from ferrule.llm.common import utf8
from ferrule.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(id, set size, component) of each row, as texts: rows are nodes, the smallest id names a component."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    ids = {}
    for x, (i, _) in enumerate(rows):
        ids.setdefault(find(x), []).append(i)
    least = {root: min((i for i in some if i is not None), default=None) for root, some in ids.items()}
    return sorted((str(i), len(sets[x]), str(least[find(x)])) for x, (i, _) in enumerate(rows)), len([s for root, s in ids.items() if sets[root]])


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def test_odd_rows(odd, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, groups = brute(rows)
    assert result(minhash.near_duplicates(clashing)) == want
    assert minhash.near_duplicates(nothing).count() == 0
    stay = minhash.deduplicate(clashing)
    assert stay.columns == clashing.columns
    kept = stay.collect()
    assert sum(bool(shingles(r.text)) for r in kept) == groups
    assert sum(not shingles(r.text) for r in kept) == sum(not shingles(t) for _, t in rows)
    named = {c for i, n, c in want if n}
    assert {str(r.doc_id) for r in kept if shingles(r.text)} == named
    assert minhash.deduplicate(nothing).count() == 0


def test_rows_without_id_link(spark):
    """A null id links two documents, names nothing, and repeats of it are copies like any other."""
    text = [f"w{i}" for i in range(57)]
    bridge, far = ["x0", *text[1:]], ["x0", *text[1:-3], "y1", "y2", "y3", "y4"]
    rows = [(2, " ".join(text)), (None, " ".join(bridge)), (9, " ".join(far)), (None, "q r s t u v w x"), (None, "q r s t u v w x"), (None, "q r s t u v w x y"), (5, "all by itself in this small place"), (5, "same id but something else altogether here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, groups = brute(rows)
    assert result(minhash.near_duplicates(df)) == want
    assert minhash.deduplicate(df).count() == groups == 4


def test_families_in_blocks(spark):
    """Chains of edits with similarities around the threshold, of small and large sets, and buckets larger than a block."""
    rng = random.Random(3)
    rows, i = [], 0
    for size in (150, 150, 70, 64, 30, 12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(15):
            rows.append((i, "common boiler plate line here " + " ".join(text)))
            i += 1
            if rng.random() < 0.8:
                text[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = list(text)
                for _ in range(4):
                    base[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
                rows.append((i, " ".join(base)))
                i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows)
    for block in (minhash.BLOCK, 400):
        assert result(minhash.near_duplicates(df, block=block)) == want


def test_no_short_pair_is_lost(spark):
    """100,000 pairs of 3 shingles inside 4, at the threshold exactly."""
    from pyspark.sql import functions as F

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.xxhash64("id", k).cast("string")), " ")
    pairs = spark.range(100_000).select("id", words.alias("text"))
    rows = pairs.select((F.col("id") * 2).alias("doc_id"), "text").union(pairs.select((F.col("id") * 2 + 1).alias("doc_id"), F.concat("text", F.lit(" x"))))
    found = minhash.near_duplicates(rows)
    assert found.filter("component_id <> doc_id - doc_id % 2").count() == 0 and found.groupBy("n_shingles").count().count() == 2


def test_minima_and_maxima_estimate_the_similarity():
    rng = np.random.default_rng(0)
    common, mine, other = (" ".join(f"w{x}" for x in rng.integers(0, 10**9, k)) for k in (600, 100, 100))
    sets, offsets = minhash.shingle_sets(*utf8(pa.array([f"{common} {mine}", f"{common} {other}"])))
    a, b = (set(sets[offsets[k] : offsets[k + 1]].tolist()) for k in (0, 1))
    values = np.stack(list(minhash.signatures(sets, offsets)))
    assert len(values) == 2 * minhash.BANDS * minhash.PERMUTATIONS_A_BAND
    assert abs((values[:, 0] == values[:, 1]).mean() - len(a & b) / len(a | b)) < 0.1


def test_sets_of_all_sizes():
    """Small and large sets and empty texts in one batch have the bands and lists they have alone."""
    texts = ["", "a", None, " ".join(f"x{i}" for i in range(64)), " ".join(f"x{i}" for i in range(65)), "b c", " ".join(f"y{i}" for i in range(300))]

    def signed(some):
        none = [0] * len(some)
        batch = pa.RecordBatch.from_arrays([pa.array(none), pa.array(none), pa.array(none), pa.array(some, pa.string())], ["doc_id", "h1", "h2", "text"])
        return [(b, s) for out in minhash._signatures(iter([batch])) for b, s in zip(out.column("bands").to_pylist(), out.column("small").to_pylist(), strict=True)]

    together = signed(texts)
    assert [len(b) for b, _ in together] == [0, 0, 0, 0, 72, 0, 72] and [len(s) for _, s in together] == [0, 1, 0, 60, 61, 1, 0]
    assert together == [signed([t])[0] for t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300)] + [(500, x) for x in range(400, 450)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[300] == 150 and all(got[x] == 400 for x in range(401, 450))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
