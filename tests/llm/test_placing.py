"""Mixing, sharding, nearest neighbours and the pipeline."""

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ferrule.llm import ann, decontam, minhash, mixing, sharding
from tests.oracle import assert_same, connect


def water(words, weights, most=3):
    """Targets by repeated resharing."""
    total, stopped = sum(words.values()), set()
    while True:
        left = total - sum(most * words[s] for s in stopped)
        free = [s for s in words if s not in stopped]
        target = {s: most * words[s] if s in stopped else left * weights[s] / sum(weights[x] for x in free) for s in words}
        over = [s for s in free if target[s] > most * words[s] + 1e-9]
        if not over:
            return target
        stopped |= set(over)


def taken_by(rows, key):
    out = collections.Counter()
    for r in rows:
        out[key(r)] += r.mix_copies * r.mix_size
    return out


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 900 + ["b"] * 30 + ["c"] * 300 + [None] * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    words = collections.Counter()
    for _, t, s in rows:
        words[s] += len(t.split())
    target = water(words, {"a": 1, "b": 2, "c": 3, None: 1})
    assert all(abs(r.mix_target - target[r.source]) < 1e-6 and r.mix_source_size == words[r.source] and 0 <= r.mix_copies <= 3 for r in got)
    taken = taken_by(got, lambda r: r.source)
    assert all(abs(taken[s] - target[s]) <= 2 for s in words)
    again = {r.doc_id: r.mix_copies for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.mix_copies for r in got}
    assert mixing.take(df).count() == sum(r.mix_copies for r in got)


def test_long_documents_do_not_end_a_source(spark):
    rows = [(i, "w " * 300, "a") for i in range(30)] + [(99, "u " * 20_000, "a"), (100, "v " * 40_000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), cycle=(1, 9)).collect()
    taken = taken_by(got, lambda r: r.source)
    target = next(r.mix_target for r in got if r.source == "a")
    assert target == 6900.0 and taken["a"] == 6900


def test_null_and_repeated_ids_reach_their_targets(spark, sf, tmp_path):
    """Rows that share an id are told apart by their texts, repeated rows are numbered; the SQL says the same."""
    rows = [(None, "w " * (1 + i % 7), "a") for i in range(50)] + [(7, "x y z", "b")] * 4 + [(None, "same text here", "e")] * 60 + [(i, "t " * (1 + i % 5), None) for i in range(200, 300)]
    rows += [(None, None, "d"), (None, "", "d"), (1, "long " * 900, "f"), (2, "short " * 5, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert_same(mixing.op9_mix_sources(spark, f"file://{tmp_path}"), connect(str(tmp_path)), mixing.OP9_SQL)
    got = mixing.mix(df, cycle=(1,)).collect()
    taken = taken_by(got, lambda r: r.source)
    target = {r.source: r.mix_target for r in got}
    assert all(abs(taken[s] - target[s]) <= 7 for s in "abe")
    assert len({r.mix_copies for r in got if r.source == "e"}) == 2  # some of the repeated rows, not all or none


def test_mix_odd_rows(spark, odd, clashing, nothing):
    mixed = mixing.mix(clashing)
    assert set(mixed.columns) == set(clashing.columns) | set(mixing.NEW)
    assert mixed.count() == odd.count() and mixed.filter("mix_copies is null or mix_target is null").count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.take(nothing).count() == 0
    empty = mixing.mix(odd.filter("text is null or trim(text) = ''"))
    assert {r.mix_copies for r in empty.collect()} == {1}
    mine = clashing.withColumns({"mix_size": F.lit("own"), "mix_copies": F.lit("own"), "row": F.lit("own")})
    taken = mixing.take(mine)
    assert taken.columns == mine.columns and {(r.mix_size, r.mix_copies, r.row) for r in taken.collect()} == {("own", "own", "own")}


def test_newton_solves_the_dual(spark):
    rows = [("a", 1, 3.0), ("b", 10**9, 1.0), ("c", 7, 7.0), ("d", 1000, 1e-6), ("e", 0, 0.0), (None, 5, 14.9)]
    for r in mixing.solve(spark.createDataFrame(rows, "source string, words long, target double")).collect():
        assert abs(r.words * np.exp(r.tilt) - r.target) <= 1e-8 * max(r.target, 1e-9) and (r.words or r.tilt == 0)


def test_overlapping_constraints(spark):
    """Sources and languages at once: iterative proportional fitting has the same solution; its copies come near both targets."""
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 9)), str(rng.choice(["s1", "s2", "s3"])), str(rng.choice(["en", "de", "fr"], p=[0.6, 0.3, 0.1]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix_groups(df, "lang", {"en": 2.0, "de": 2.0, "fr": 1.0}).collect()
    cells = collections.Counter()
    for _, t, s, g in rows:
        cells[s, g] += len(t.split())
    words = collections.Counter()
    for (s, _), n in cells.items():
        words[s] += n
    target = water(words, {"s1": 1, "s2": 2, "s3": 3})
    total = sum(target.values())
    groups = {"en": total * 0.4, "de": total * 0.4, "fr": total * 0.2}
    fit = dict(cells)
    for _ in range(500):
        for axis, want in ((0, target), (1, groups)):
            sums = collections.Counter()
            for key, n in fit.items():
                sums[key[axis]] += n
            fit = {key: n * want[key[axis]] / sums[key[axis]] for key, n in fit.items()}
    assert max(fit[c] / cells[c] for c in cells) < 3
    by_cell = {(r.source, r.lang): r.mix_target for r in got}
    assert all(abs(by_cell[c] - fit[c]) < 1e-3 * fit[c] for c in cells)
    for axis, want in ((0, target), (1, groups)):
        taken = taken_by(got, lambda r, axis=axis: (r.source, r.lang)[axis])
        assert all(abs(taken[x] - want[x]) <= 30 for x in want)
    with np.testing.assert_raises(ArithmeticError):
        mixing.mix_groups(df.filter("lang = 'en' and source = 's1' or lang = 'de' and source = 's2'"), "lang", {"en": 100.0, "de": 1.0})


def test_shards(spark, odd, clashing, nothing):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    key = F.col("doc_id").cast("string")
    placed = df.select("doc_id", *[sharding.place(key, sharding.tree(n)).alias(f"s{n}") for n in (16, 17, 18, 19)]).collect()
    sizes = collections.Counter(r.s16 for r in placed)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.15 * min(sizes.values())
    for r in placed:
        assert r.s17 in (r.s16, 16) and r.s18 in (r.s17, 17) and r.s19 in (r.s18, 18)
    assert abs(sum(r.s17 == 16 for r in placed) - 20_000 / 17) < 150
    heavier = [x._replace(weight=2.0) if x.shard == 3 else x for x in sharding.tree(16)]
    moved = df.select(sharding.place(key, sharding.tree(16)).alias("a"), sharding.place(key, heavier).alias("b")).filter("a <> b").collect()
    assert all(r.b < 8 for r in moved)  # into the heavier region only
    out = sharding.assign(clashing)
    assert set(out.columns) == set(clashing.columns) and out.schema["shard"].dataType.simpleString() == "int"
    assert sharding.assign(nothing).count() == 0
    rows = sharding.number(sharding.assign(odd).select("doc_id", "n_chars", "shard"), ["doc_id", "n_chars"]).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32).tolist()
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1100, [1.0, None] * 4), (1004, [float("inf")] * 8), (1005, [1.0] * 3), (None, x[3]), (1006, x[0]), (1007, x[0]), (1007, x[0])]
    df = spark.createDataFrame([*enumerate(x), *odd], "vec_id long, embedding array<float>").withColumn("norm", F.lit("own"))
    index, books = ann.build_index(df, sample=200)
    got = ann.nearest(index, books, index.filter("vec_id % 100 = 0"), k=10, rows=30, most=2).collect()
    part = [(i, np.array(v, np.float64)) for i, v in [*enumerate(x), *odd] if i is not None and (i < 1000 or i in (1006, 1007))]
    for q in (0, 100, 200, 300):
        want = sorted((float(np.sqrt(((v - part[q][1]) ** 2).sum())), i) for i, v in part if i != q)[:10]
        have = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in have] == [i for _, i in want] and np.allclose([r.score for r in have], [d for d, _ in want])
    assert {r.query_id for r in got} == {0, 100, 200, 300}
    index, books = ann.build_index(df.limit(0))
    assert ann.nearest(index, books, index).count() == 0


def test_most_blocks_are_never_visited(spark):
    """Clusters far apart: a query meets the blocks of its own cells only, and misses nothing."""
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(40, 8)) * 50, 100, axis=0) + rng.normal(size=(4000, 8))).astype(np.float32)
    index, books = ann.build_index(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>"), sample=1000)
    cells = ann.cells_of(index, 100)
    visited = index.filter("vec_id % 100 = 0").select("vec_id", "embedding", F.lit(6.0).alias("limit")).mapInArrow(ann.visits(books, tuple(cells), False), "block long, query_id long, embedding array<float>, limit double")
    assert visited.count() < 40 * 10 and (cells.block + cells.blocks).max() >= 40
    exact = x.astype(np.float64)
    for r in ann.nearest(index, books, index.filter("vec_id % 1000 = 0"), rows=100).filter("rank = 10").collect():
        d = np.sqrt(((exact - exact[r.query_id]) ** 2).sum(1))
        assert abs(np.sort(d)[10] - r.score) < 1e-9


def test_recall_against_brute_force(spark, sf):
    got = collections.defaultdict(set)
    for r in ann.op6_nearest(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    hits = 0
    for q in got:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.argsort(d)[:10]].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_quantisation_error_shrinks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    books = ann.fit(x, codebooks=4, words=16)
    error = lambda codes: ((x - ann.decode(codes, books)) ** 2).sum()
    assert error(ann.encode(x, books, 4)) <= error(ann.encode(x, books, 1)) < 0.7 * (x**2).sum()


def test_pipeline(spark, sf, tmp_path_factory):
    """Every stage against its definition, on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stages')}/{i}"
        stage(spark, steps[-1], sf).write.parquet(path)
        steps.append(spark.read.parquet(path))
        assert steps[-1].columns == docs.columns + ["shard"] * (name == "sharding")
    raw, good, single, clean, mixed, sharded = [s.collect() for s in steps]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert {labels[r.doc_id] for r in good if r.doc_id in labels} == {1}
    assert sum(labels[r.doc_id] == 1 for r in good if r.doc_id in labels) == sum(v == 1 for v in labels.values())
    assert len(good) < len(raw)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(steps[1]).collect()}
    assert sorted(r.doc_id for r in single) == sorted(set(found.values())) and len(single) < len(good)
    items = [decontam.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(b[i : i + 10]) for b in items for i in range(max(1, len(b) - 9))}

    def hit(text):
        w = decontam.normalised(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if not hit(r.text)) and len(clean) < len(single)
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in clean} and max(copies.values()) <= 3
    assert sorted(r.doc_id for r in sharded) == sorted(r.doc_id for r in mixed)
    assert len({(r.doc_id, r.shard) for r in sharded}) == len(copies)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "shard").collect())) == sorted(map(str, steps[-1].select("doc_id", "shard").collect()))


def test_pipeline_odd_rows(spark, odd, nothing, tmp_path_factory):
    from tests.llm.conftest import COLUMNS

    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    odd.write.parquet(f"{folder}/some/documents.parquet")
    nothing.write.parquet(f"{folder}/none/documents.parquet")
    for name in ("some", "none"):
        spark.createDataFrame([(1, 1, 0), (16, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame([(1, "mit license"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{folder}/{name}")
        assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")] + ["shard"]
        rows = out.collect()
        assert (len(rows) > 0) == (name == "some") and not [r for r in rows if r.doc_id in (2, 14, 16)]
