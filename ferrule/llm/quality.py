"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one of the target (documents labelled
good), one of the raw corpus (all documents). A document's importance weight is
the ratio of its probabilities under both, over all its n-grams, and documents are
sampled without replacement by Gumbel top-k.

The n-grams are pairs of neighbouring word shapes (length, capitals, signs, last
sign, whether the word repeats the one before) and byte trigrams; each kind
falls into buckets of its own and is a model of its own.

The log of a ratio grows with the length of a text, and with it the errors of the
estimates: taken as it is, it sorts texts by length first and sound long ones go
with the junk. So the weights are tempered: the log ratio of each model is divided
by its number of n-grams, and their sum by the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import BASE, chunks, materialize, mix64, packed, small_batches, table, word_table, words

BUCKETS = 1 << 16
#: Added to each bucket's count in both models.
SMOOTHING = 0.1
#: Of the sampling, for log ratios per n-gram; smaller values come nearer to a plain cut.
TEMPERATURE = 0.1
#: Most labelled documents that the target model and the cut learn from.
LABELLED = 20_000
#: Buckets of a round of the search for the k-th key.
FAN = 4096


def shape_pairs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word's shape with that of the word before, and offsets by text."""
    hashes, start, end, offsets = words(raw, at, word_table("blank"))
    capital = (raw >= 65) & (raw <= 90)
    sign = ~(((raw >= 97) & (raw <= 122)) | capital | (raw >= 128))
    of = lambda flag: np.minimum(np.diff(np.concatenate([[0], np.cumsum(flag)])[np.stack([start, end])], axis=0)[0], 3)
    last = raw[end - 1].astype(np.int64)
    first = np.zeros(len(hashes), bool)
    first[offsets[:-1][offsets[:-1] < len(hashes)]] = True
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])[: len(hashes)] & ~first
    shape = ((((np.minimum(end - start, 15) * 4 + of(capital)) * 4 + of(sign)) * 128 + np.where(last < 65, last, 0)) * 2 + again).astype(np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), shape[:-1]])[: len(shape)]
    before[first] = 0
    return (mix64(shape * np.uint64(BASE) + before) % np.uint64(BUCKETS)).astype(np.int64), offsets


def byte_trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte with the two before it, 0 before a text's start, and offsets by text."""
    x = raw.astype(np.uint64)
    before = np.zeros((2, len(x)), np.uint64)
    before[0, 1:], before[1, 2:] = x[:-1], x[:-2]
    before[:, at[:-1][np.diff(at) > 0]] = 0
    before[1, at[:-1][np.diff(at) > 1] + 1] = 0
    gram = before[1] << np.uint64(16) | before[0] << np.uint64(8) | x
    return (mix64(gram + np.uint64(BASE)) % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS, at


KINDS = (shape_pairs, byte_trigrams)


def importance(raw: np.ndarray, at: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the ratio of a text's probabilities, the sum over all its n-grams of both kinds; and the sum of each kind's mean. 0 without any."""
    whole, tempered = np.zeros((2, len(at) - 1))
    for kind in KINDS:
        bucket, offsets = kind(raw, at)
        n = np.diff(offsets)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), ratio[bucket], minlength=len(n))
        whole += sums
        tempered += sums / np.maximum(n, 1)
    return whole, tempered


def log_ratio(docs: DataFrame, good: list) -> np.ndarray:
    """log(target / raw) of each bucket, from counts over all documents."""
    wanted = docs.sparkSession.sparkContext.broadcast(set(good))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(KINDS) * BUCKETS), np.int64)
        for batch in batches:
            own = np.array([i in wanted.value for i in batch.column("doc_id").to_pylist()], bool)
            for lo, hi, raw, at in chunks(batch.column("text")):
                for kind in KINDS:
                    bucket, offsets = kind(raw, at)
                    sums[0] += np.bincount(bucket, minlength=sums.shape[1])
                    sums[1] += np.bincount(bucket[np.repeat(own[lo:hi], np.diff(offsets))], minlength=sums.shape[1])
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["i", "raw", "target"])

    counts = np.full((2, len(KINDS) * BUCKETS), SMOOTHING)
    found = docs.select("doc_id", "text").mapInArrow(count, "i long, raw long, target long").groupBy("i").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    with small_batches(docs.sparkSession):
        for r in found.collect():  # a row for each bucket
            counts[:, r.i] += (r.raw, r.target)
    parts = counts.reshape(2, len(KINDS), BUCKETS)
    parts /= parts.sum(2, keepdims=True)
    return np.log(parts[1] / parts[0]).ravel() if good else np.zeros(len(KINDS) * BUCKETS)


def _scored(docs: DataFrame, ratio: np.ndarray, seed: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with quality_ratio, quality_score and quality_key, the same on every run."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.stack(importance(raw, at, shared.value)) for _, _, raw, at in chunks(batch.column("text"))]
            new = np.concatenate(got, axis=1) if got else np.empty((2, 0))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *map(pa.array, new)], names=[*keep, "quality_ratio", "quality_score"])

    out = docs.mapInArrow(score, docs.limit(0).select(*keep, F.lit(0.0).alias("quality_ratio"), F.lit(0.0).alias("quality_score")).schema)
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return out.withColumn("quality_key", F.col("quality_score") - F.lit(TEMPERATURE) * F.log(-F.log(u)))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column quality_key, exactly, by rounds of histograms of bounded size."""
    lo, hi, n = keys.agg(F.min("quality_key"), F.max("quality_key"), F.count("quality_key")).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    while lo < hi:
        width = (hi - lo) / FAN
        bucket = F.least(F.floor((F.col("quality_key") - F.lit(lo)) / F.lit(width)), F.lit(FAN - 1)) if width > 0 else F.when(F.col("quality_key") == lo, 0).otherwise(1)
        found = keys.filter(F.col("quality_key").between(lo, hi)).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("quality_key").alias("lo"), F.max("quality_key").alias("hi"))
        for r in sorted(found.collect(), key=lambda r: -r.b):
            if k <= r.n:
                lo, hi, all_of_it = r.lo, r.hi, k == r.n
                break
            k -= r.n
        if all_of_it:
            break
    return lo


def resample(docs: DataFrame, labels: DataFrame, seed: int = 1, labelled: int = LABELLED, keep: list[str] | None = None) -> tuple[DataFrame, float]:
    """(scored, least): a written table of ``docs`` with the columns below (replaced if present), and the least key that is kept.

    quality_ratio: log of the likelihood ratio; quality_score: the same per n-gram
    of each kind; quality_key: this with Gumbel noise.

    The target model learns from up to ``labelled`` documents with a label,
    those with the smallest hashes of doc_id; both models' other counts, the
    scores and the sampling cover all documents. k is the number of documents
    whose score lies above the cut, half way between the lowest hundredth of
    labelled good documents and the highest hundredth of bad ones. ``keep``: the
    columns of ``docs`` that the table carries (doc_id among them), all by default.

    A null or empty text scores 0. Labels without id or value are left out, a
    document with several is good only if all say so. Without good or without
    bad labels everything is kept. Ties at the threshold are all kept, rows with
    a null id share one draw, repeated rows are sampled alike, an empty table
    gives no rows, other columns pass through. doc_id may be of any type that
    labels has too.
    """
    docs = docs.drop("quality_ratio", "quality_score", "quality_key")
    sample = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    good = [r.doc_id for r in rows if r.quality > 0]
    bad = [r.doc_id for r in rows if r.quality <= 0]
    scored = materialize(_scored(docs, log_ratio(docs, good), seed, keep or docs.columns), "quality-scored")
    if not (good and bad):
        return scored, -np.inf
    kind = labels.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.createDataFrame([(r.doc_id, r.quality > 0) for r in rows], f"_labelled {kind}, _good boolean")
    known = scored.select("doc_id", "quality_score").join(F.broadcast(known), F.col("doc_id") == F.col("_labelled"))
    edges = {r._good: (r.low, r.high) for r in known.groupBy("_good").agg(F.percentile_approx("quality_score", 0.01, 10000).alias("low"), F.percentile_approx("quality_score", 0.99, 10000).alias("high")).collect()}
    if not (True in edges and False in edges):
        return scored, -np.inf
    cut = (edges[True][0] + edges[False][1]) / 2
    keys = scored.select("quality_key")
    return scored, kth_largest(keys, scored.filter(F.col("quality_score") >= cut).count())


def select(docs: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """The documents that the sample keeps, with their own columns, whatever their names; nulls, ties and empty tables as ``resample`` has them."""
    scored, least = resample(docs.select("doc_id", "text", packed(docs)), labels, seed, keep=["doc_id", "row"])
    return scored.filter(F.col("quality_key") >= F.lit(float(least))).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, least = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_ratio").alias("log_ratio"), F.col("quality_key").alias("sample_key"), (F.col("quality_key") >= F.lit(float(least))).alias("kept"))
