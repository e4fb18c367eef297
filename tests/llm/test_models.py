"""LM scores, language, quality and licences."""

import collections
import math
import pathlib
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import langid, licenses, lmscore, quality
from ferrule.llm.common import BASE, mix64, shared_dir


def ppm(counts, text, order, end, log=math.log10):
    """Code length by the definition: escapes with exclusion, a dictionary for each context."""
    data, out = bytes(order) + text + end, 0.0
    for i in range(order, len(data)):
        excluded, x = set(), data[i]
        for k in range(order, -1, -1):
            here = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in excluded}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if x in here:
                out += log(here[x] / total)
                break
            out += log(len(here) / total)
            excluded |= set(here)
        else:
            out -= log(max(1, 256 - len(excluded)))
    return out


def learn(texts, order, end):
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        data = bytes(order) + t + end
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    return counts


@pytest.mark.parametrize("order", [2, 5, 7])
def test_lm_scores(spark, odd, nothing, order):
    docs = odd.selectExpr("*", "doc_id % 3 <> 0 as train")
    rows = docs.collect()
    got = lmscore.score_documents(docs, order=order, part_bytes=20_000).collect()
    counts = learn([(r.text or "").encode() for r in rows if r.train], order, b"\xff")
    tokens = collections.Counter(w for r in rows if r.train for w in [*(r.text or "").encode().lower().split(), b"\n"])
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for r in rows:
        words = [*(r.text or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words)
        want.append((str(r.doc_id), len(words), sum(tokens[w] > 0 for w in words), n, round(base, 4), round(ppm(counts, (r.text or "").encode(), order, b"\xff"), 4)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == sorted(want)
    assert lmscore.score_documents(nothing.selectExpr("*", "true as train")).count() == 0


def test_lm_query(spark, sf, tmp_path):
    """The query's split, counts and base score on all rows, and its score on the shorter texts, by the definition."""
    some = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 400 or text is null").limit(150)  # a small fixture of whole texts
    some.write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"file://{tmp_path}/documents.parquet").collect()}
    held_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows.items() if not held_out(i)]
    counts = learn(train, lmscore.ORDER, b"\xff")
    of = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", fold(t.decode())), b"\n"]
    tokens = collections.Counter(w for t in train for w in of(t))
    n, v = sum(tokens.values()), len(tokens)
    got = lmscore.op3_lm_score(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in got} == rows.keys()
    for r in got:
        words = of(rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id), len(words), sum(tokens[w] > 0 for w in words), n)
        assert abs(r.base_score - sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words)) < 1e-6
        assert abs(r.score - ppm(counts, rows[r.doc_id], lmscore.ORDER, b"\xff")) < 1e-6


def test_lm_columns_of_any_name(clashing):
    got = lmscore.score_documents(clashing.withColumn("train", clashing.doc_id > 3).withColumn("cell", clashing.text))
    assert got.count() == clashing.count() and got.columns[:2] == ["doc_id", "train"]


def test_lm_without_training(spark):
    got = lmscore.score_documents(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string").selectExpr("*", "cast(null as boolean) as train")).collect()
    assert {r.doc_id: round(r.score, 6) for r in got} == {1: round(-3 * math.log10(256), 6), 2: round(-math.log10(256), 6)}
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_lm_keeps_one_step_on_disk(spark, odd, tmp_path):
    """When texts are to be scored, the answers' table alone is left, and no shuffle of an earlier step; the session's setting is back."""
    odd.selectExpr("*", "doc_id % 3 <> 0 as train").write.parquet(f"file://{tmp_path}/docs")
    docs, key = spark.read.parquet(f"file://{tmp_path}/docs"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        found = [pathlib.Path(files.apply(i).getPath()) for i in range(files.length())]
        return {p: p.stat().st_size for p in found if p.name.startswith("shuffle_") and p.exists()}

    tables = lambda: {p.name for p in pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("lm-*")}
    earlier, others, before = tables(), shuffles(), spark.conf.get(key)
    got = lmscore.score_documents(docs, part_bytes=20_000)
    left = tables() - earlier
    assert {name.rsplit("-", 1)[0] for name in left} == {"lm-answers"} and spark.conf.get(key) == before
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for _ in range(100):  # files are deleted beside the session
        if (more := sum(n for p, n in shuffles().items() if p not in others)) < texts / 20:
            break
        time.sleep(0.1)
    assert more < texts / 20  # two sums are collected
    assert sorted(map(str, got.collect())) == sorted(map(str, got.collect())) and tables() - earlier == left


def letters(text):
    return any(unicodedata.category(c).startswith("L") for c in text)


def test_language_costs_are_exact():
    texts = [b"the cat sat", b"on the mat\xc3\xa9", b"", b"the catch, then the thatch"]
    counts = learn(texts, langid.ORDER, b"")
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    grams, n = np.unique(langid.contexts(raw, at), return_counts=True)
    model = langid.Model([("xx", g, k) for g, k in zip(grams.tolist(), n.tolist(), strict=True)])
    for probe in (b"the hat", b"zzz \xff", b"a", b"mat\xc3\xa9 on", b"thatched cattle then sat"):
        log = langid.code_lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]), model.trees)
        assert abs(log[0, 0] - ppm(counts, probe, langid.ORDER, b"", math.log)) < 1e-9


def test_language_odd_rows(spark, clashing, nothing):
    got = langid.identify(clashing, clashing).collect()
    assert len(got) == clashing.count()
    for r in got:
        und = r.text is None or not letters(r.text)
        assert (r.lang_pred == "und") == und and 0 <= r.lang_score <= 1 and (r.lang_pred in ("en", "de", "fr") or und)
    assert {r.lang_pred for r in langid.identify(clashing, nothing).collect()} == {"und"}
    assert langid.identify(nothing, clashing).count() == 0
    small = langid.identify(clashing, clashing, model_rows=5)
    assert small.filter("lang_pred <> 'und'").count() > 0


def test_language_blocks_change_nothing(spark):
    """Languages that only whole trees tell apart, in blocks of any size."""
    cycles = {"w": b"abcabd", "x": b"abdabc" * 2 + b"cab", "y": b"bcabda", "z": b"cabcabdd"}
    train = [(lang, (c * 30).decode()) for lang, c in cycles.items()] + [("v", "zzz"), ("\u00e9", "caf\u00e9 ol\u00e9")]
    docs = [(i, (c * k).decode()) for i, (c, k) in enumerate((c, k) for c in cycles.values() for k in (1, 2, 5))] + [(100, None), (101, ""), (102, "123"), (103, "\u00e9\u4e2d"), (104, "q"), (105, "\u00b2 \u00bd \u2460 \u2167"), (106, "\u00aa")]
    learned = {lang: learn([t.encode()], langid.ORDER, b"") for lang, t in train}
    want = {}
    for i, text in docs:
        if text and letters(text):
            log = {lang: ppm(c, text.encode(), langid.ORDER, b"", math.log) for lang, c in learned.items()}
            best = max(sorted(log), key=lambda x: log[x])
            want[i] = (best, 1 / sum(math.exp(v - log[best]) for v in log.values()))
        else:
            want[i] = ("und", 0.0)
    docs, train = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(train, "lang string, text string")
    for model_rows in (1, 20, 10**6):
        got = langid.identify(docs, train, model_rows=model_rows)
        assert got.columns == ["doc_id", "text", "lang_pred", "lang_score"]
        got = {r.doc_id: (r.lang_pred, r.lang_score) for r in got.collect()}
        assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
        assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_language_query(spark, sf):
    """Held-out accuracy, and every prediction for the shorter texts against the definition."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in langid.op4_language(spark, sf).collect()}
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert got.keys() == rows.keys() and all(r.held_out == held_out(i) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert sum(rows[r.doc_id].lang == r.lang_pred for r in held) / len(held) > 0.98
    texts = collections.defaultdict(list)
    for i, r in rows.items():
        if not held_out(i) and r.lang is not None and r.text:
            texts[r.lang].append(fold(r.text))
    learned = {lang: learn(some, langid.ORDER, b"") for lang, some in texts.items()}
    short = [i for i, r in rows.items() if r.text and letters(r.text) and len(r.text) < 200]
    assert len(short) > 20
    for i in short:
        log = {lang: ppm(c, fold(rows[i].text), langid.ORDER, b"", math.log) for lang, c in learned.items()}
        best = max(sorted(log), key=lambda x: log[x])
        assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(math.exp(v - log[best]) for v in log.values())) < 1e-9


def fold(text):
    return text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def test_quality_odd_rows(spark, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (16, 0, 0), (16, None, 1), (15, 0, 0), (18, 1, 0), (18, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.select(clashing, labels)
    assert set(kept.columns) == set(clashing.columns)
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 2, 18} <= ids and 16 not in ids
    assert quality.select(clashing, labels.limit(0)).count() == clashing.count()
    assert quality.select(clashing, labels.filter("quality = 1")).count() == clashing.count()
    assert quality.select(nothing, labels).count() == 0


def test_quality_accuracy_beyond_the_fitted_sample(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored, least = quality.resample(docs, labels, labelled=150)
    kept = {r.doc_id: r.quality_key >= least for r in scored.collect()}
    right = [kept[r.doc_id] == (r.quality == 1) for r in labels.collect()]
    assert sum(right) / len(right) > 0.99


def test_quality_query(spark, sf):
    """The query keeps as many documents as score above the cut, those with the largest keys."""
    rows = quality.op10_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = (sorted(r.score for r in rows if labels.get(r.doc_id) == q) for q in (1, 0))
    cut = (good[math.ceil(len(good) * 0.01) - 1] + bad[math.ceil(len(bad) * 0.99) - 1]) / 2
    k = sum(r.score >= cut for r in rows)
    largest = sorted((r.sample_key for r in rows), reverse=True)[k - 1]
    assert all(r.kept == (r.sample_key >= largest) for r in rows) and 0 < k < len(rows)


def test_quality_with_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "the cat sat on the mat"), ("b", "### $$$ %%% ### $$$"), (None, "the cat")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int")
    assert {r.doc_id for r in quality.select(docs, labels).collect()} >= {"a"}


def test_quality_against_brute_force(spark):
    """Each text by itself, whatever stands before it in a batch; texts of a few bytes among long ones."""
    rows = [(i, t) for i, t in enumerate(["a", "ab", "Zebra! Zebra!", "", None, "b", "?? ?? 17", "the cat sat on the mat " * 20, "THE 9", "ab", "\u00e9", "x", "q u", "a"] * 3)]
    labels = [(0, 1), (2, 1), (7, 1), (14, 1), (6, 0), (8, 0), (20, 0), (22, 0)]
    good = {i for i, q in labels if q}

    def grams(text):
        data = (text or "").encode()
        padded, out = b"\0\0" + data, [[], []]
        for i in range(len(data)):
            out[1].append(int(mix64(np.array([int.from_bytes(padded[i : i + 3])], np.uint64) + np.uint64(BASE))[0]) % quality.BUCKETS)
        before = None
        for w in data.split():
            capitals, signs = (sum(x in r for x in w) for r in (range(65, 91), [x for x in range(128) if not chr(x).isalpha()]))
            shape = (((min(len(w), 15) * 4 + min(capitals, 3)) * 4 + min(signs, 3)) * 128 + (w[-1] if w[-1] < 65 else 0)) * 2 + (before is not None and w.lower() == before[0])
            key = (shape * BASE + (before[1] if before else 0)) % (1 << 64)
            out[0].append(int(mix64(np.array([key], np.uint64))[0]) % quality.BUCKETS)
            before = (w.lower(), shape)
        return out

    all_grams = {i: grams(t) for i, t in rows}
    want, whole = dict.fromkeys(all_grams, 0.0), dict.fromkeys(all_grams, 0.0)
    for kind in range(2):
        raw, target = collections.Counter(), collections.Counter()
        for i, g in all_grams.items():
            raw.update(g[kind])
            if i in good:
                target.update(g[kind])
        share = lambda c, b: (c[b] + quality.SMOOTHING) / (sum(c.values()) + quality.SMOOTHING * quality.BUCKETS)
        for i, g in all_grams.items():
            ratio = sum(math.log(share(target, b) / share(raw, b)) for b in g[kind])
            whole[i] += ratio
            want[i] += ratio / max(1, len(g[kind]))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    least = set()
    for dealt in (docs.coalesce(1), docs.repartition(5, "doc_id"), docs.orderBy(docs.doc_id.desc()).coalesce(1)):
        keys, at = quality.resample(dealt, labels)
        got = {r.doc_id: (r.quality_score, r.quality_ratio) for r in keys.collect()}
        assert got.keys() == want.keys() and all(abs(got[i][0] - want[i]) < 1e-9 and abs(got[i][1] - whole[i]) < 1e-7 for i in want)
        least.add(round(at, 9))
    assert len(least) == 1


def test_kth_largest(spark):
    values = [1.5, -2.0, 7.25, 7.25, 7.25, 0.0, 1e-300, -1e300, 3.0, 3.0000000000000004]
    df = spark.createDataFrame([(v,) for v in values], "quality_key double")
    for k in range(1, len(values)):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, len(values)) == -np.inf and quality.kth_largest(df, 0) == np.inf


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def phrases(text):
    w = WORD.findall((text or "").encode().lower())
    found = []
    for label, phrase in licenses.BASE_PHRASES.items():
        p = phrase.encode().split()
        found += [(label, i) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def test_licenses_against_brute_force(spark, odd, clashing, nothing):
    extra = [(100, "mit license MIT-License cc, by the apache license; gnu General public license apache"), (101, "Licensed under the Apache License, Version 2.0."), (102, "license mit cc gnu general public"), (103, "cc by cc by nc 4.0 cc by")]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan_licenses(df).collect()
    want = sorted((str(i), *phrases(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.lic_words, sorted((p.label, p.at) for p in r.lic_places)) for r in got) == want
    named = {r.doc_id: {m.label: m.share for m in r.lic_matches} for r in got}
    assert named[101]["apache-2.0"] == 1.0 and named[102] == {} and named[103]["cc-by-nc-4.0"] >= 0.5
    assert licenses.scan_licenses(clashing).count() == odd.count() and licenses.scan_licenses(nothing).count() == 0


def test_rarest_words_lead_to_templates():
    """Candidates come from the two rarest words of a key phrase, where their places agree; nothing beside the index finds any."""
    counts = dict.fromkeys(licenses.vocabulary(), 5) | {"mozilla": 0, "unencumbered": 1, "redistribute": 2}
    index = licenses.Index(licenses.build(100, counts))
    text = b"x this source code form is subject to the terms of the mozilla public license v 2 0 y mozilla license public v 2 0"
    hashes, _, _, offsets = licenses.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), licenses.word_table("alnum"))
    k = next(i for i, t in enumerate(index.templates) if t.label == "mpl-2.0")
    assert 1 in index.candidates(hashes)[k].tolist()
    assert [(t.label, at, share) for t, _, at, share in licenses.matches(hashes, offsets, index) if not t.base] == [("mpl-2.0", 12, 1.0)]
    index.postings = [[] for _ in index.postings]
    assert list(licenses.matches(hashes, offsets, index)) == []


def test_licenses_query(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op8_licenses(spark, sf).collect():
        n, found = phrases(rows[r.doc_id])
        at = [i for _, i in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
