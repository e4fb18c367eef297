"""Language identification by prediction by partial matching.

Each language has a byte-context tree of order 4: counts of a byte after its four,
three, ... and no bytes before it. A byte that a context has not seen costs an escape
(method C: as likely as the number of different bytes seen there), then counts
in the next shorter context with the bytes of the longer one excluded; last come the
256 byte values less those seen anywhere. A tree is as deep as its text: contexts
that training has not met cost nothing. Trees are frozen after training, so the
cost of a byte depends on five bytes only and is worked out once for each
different five in a batch, from sorted tables of the contexts and grams that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import chunks, crc_of_id, discard, materialize, table

#: Bytes of context; a gram is these and the byte itself, as a number.
ORDER = 4
#: Most (language, gram) counts in one block of languages, and most languages; further ones go in further passes. A language with more counts is a block of its own.
MODEL_ROWS = 3_000_000
BLOCK_LANGUAGES = 100
#: Distinct counts that a worker gathers before it hands them on.
GATHER = 2_000_000
#: A language's number stands above the gram in 64 bits.
SHIFT = 8 * (ORDER + 1)


def folded() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def mask(n: int) -> int:
    """Selects the last ``n`` bytes of a gram."""
    return (1 << 8 * n) - 1


def contexts(raw: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram of each byte; 0 stands before a text's start."""
    x = folded()[raw].astype(np.int64)
    age, out = np.arange(len(x)) - np.repeat(at[:-1], np.diff(at)), x.copy()
    for k in range(1, order + 1):
        before = np.zeros(len(x), np.int64)
        before[k:] = x[:-k] if len(x) > k else 0
        before[age < k] = 0
        out |= before << 8 * k
    return out


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over the rows of ``docs`` (lang, text), summed on the workers first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        keys, sums, held = [], [], 0

        def out():
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, np.concatenate(sums)).astype(np.int64)
            return key, total

        def rows(key, total):
            names = np.array(list(langs), object)
            return pa.RecordBatch.from_arrays([pa.array(names[key >> SHIFT], pa.string()), pa.array(key & mask(ORDER + 1)), pa.array(total)], ["lang", "gram", "n"])

        for batch in batches:
            own = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, raw, at in chunks(batch.column("text")):
                key, n = np.unique(np.repeat(own[lo:hi], np.diff(at)) << SHIFT | contexts(raw, at), return_counts=True)
                keys.append(key)
                sums.append(n)
                held += len(key)
                if held > GATHER:
                    key, n = out()
                    keys, sums, held = [key], [n], len(key)
                    if held > GATHER // 2:
                        yield rows(key, n)
                        keys, sums, held = [], [], 0
        if keys:
            yield rows(*out())

    return docs.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Level(NamedTuple):
    """One order of a tree: its grams with the log of their counts, and its contexts with what follows from them.

    ``size`` and ``escape``: log of the denominator (counts and escapes) and of the
    share of the escape, where this is the longest known context. ``below_size``,
    ``below_escape``: those one order down, the bytes seen here excluded there.
    """

    grams: np.ndarray
    log_n: np.ndarray
    contexts: np.ndarray
    size: np.ndarray
    escape: np.ndarray
    below_size: np.ndarray
    below_escape: np.ndarray


def logs(x: np.ndarray) -> np.ndarray:
    """log, 0 for 0 (an escape where nothing is left to see costs nothing)."""
    return np.log(np.where(x > 0, x, 1))


def tree(grams: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[Level]:
    """Levels of order 0 to ``order`` from the counts of the longest grams."""
    out, (grams, by) = [], np.unique(grams, return_inverse=True)
    n = np.bincount(by, n)
    for k in range(order, -1, -1):
        context, of = np.unique(grams >> 8, return_inverse=True)
        total, kinds = np.bincount(of, n), np.bincount(of).astype(np.float64)
        below_size = below_escape = np.zeros(len(context))
        if k:
            lower, to = np.unique(grams & mask(k), return_inverse=True)
            lower_n = np.bincount(to, n)
            lower_context, lower_of = np.unique(lower >> 8, return_inverse=True)
            down = np.searchsorted(lower_context, context & mask(k - 1))
            new = np.bincount(lower_of)[down] - kinds
            below = np.bincount(lower_of, lower_n)[down] - np.bincount(of, lower_n[to]) + new
            below_size, below_escape = logs(below), logs(new) - logs(below)
        out.insert(0, Level(grams, np.log(n), context, np.log(total + kinds), np.log(kinds) - np.log(total + kinds), below_size, below_escape))
        if k:
            grams, n = lower, lower_n
    return out


def spot(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` is in the sorted ``keys``, -1 if nowhere."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def costs(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log probability of the last byte of each gram in one language."""
    out, left, longer = np.zeros(len(grams)), np.arange(len(grams)), np.full(len(grams), -1)
    for k in range(len(levels) - 1, -1, -1):
        level, gram = levels[k], grams[left] & mask(k + 1)
        found, context = spot(level.grams, gram), spot(level.contexts, gram >> 8)
        above = levels[min(k + 1, len(levels) - 1)]
        size = np.where(longer >= 0, above.below_size[longer], level.size[context])
        escape = np.where(longer >= 0, above.below_escape[longer], np.where(context >= 0, level.escape[context], 0))
        hit = found >= 0
        out[left] += np.where(hit, level.log_n[found] - size, escape)
        left, longer = left[~hit], context[~hit]
    out[left] -= np.log(max(1, 256 - len(levels[0].grams)))
    return out


class Model:
    """Trees of a block of languages, in plain arrays."""

    def __init__(self, rows: list[tuple[str, int, int]] | pa.Table):
        if not isinstance(rows, pa.Table):
            rows = pa.Table.from_pylist([{"lang": x, "gram": g, "n": n} for x, g, n in rows], pa.schema({"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}))
        names, grams, n = rows.column("lang"), rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
        self.langs = sorted(names.unique().to_pylist(), key=lambda x: x.encode())
        lang = pc.index_in(names, pa.array(self.langs, names.type)).to_numpy()
        by = np.argsort(lang, kind="stable")
        ends = np.cumsum(np.bincount(lang, minlength=len(self.langs)))[:-1] if self.langs else []
        self.trees = [tuple(map(tuple, tree(grams[i], n[i]))) for i in np.split(by, ends)] if self.langs else []


def code_lengths(raw: np.ndarray, at: np.ndarray, trees: list) -> np.ndarray:
    """(texts, languages): natural log of each text's probability."""
    out = np.zeros((len(at) - 1, len(trees)))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        grams, place = np.unique(contexts(raw, at), return_inverse=True)
        for i, levels in enumerate(trees):
            out[full, i] = np.add.reduceat(costs(grams, [Level(*x) for x in levels])[place], at[:-1][full])
    return out


def blocks_of(sizes: list[tuple[str, int]], model_rows: int) -> list[list[str]]:
    """Languages in order, in blocks of about ``model_rows`` counts; a single empty block if there are none."""
    out: list[list[str]] = [[]]
    held = 0
    for lang, n in sorted(sizes, key=lambda x: x[0].encode()):
        if out[-1] and (held + n > model_rows or len(out[-1]) == BLOCK_LANGUAGES):
            out.append([])
            held = 0
        out[-1].append(lang)
        held += n
    return out


def identify(docs: DataFrame, training: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """The columns of ``docs`` and ``lang_pred``, ``lang_score`` (replaced if present).

    Learns from the rows of ``training`` (text, lang) with a language, all of
    them, by distributed counts. The language under which a text has the
    shortest code is predicted (of equals the first by code point); the score is
    its posterior under equal priors. Null texts and texts without a letter (of
    Unicode's categories L*), and all texts if nothing was learned, are ``und`` with score 0. Null languages
    teach nothing; repeated rows count repeatedly; empty tables give no rows.

    Languages go in blocks of at most ``model_rows`` counts (or one language),
    each a pass over the documents that carries on the best language and the sum
    for its posterior. Every language keeps its whole tree, so predictions do
    not depend on the blocks.
    """
    spark = docs.sparkSession
    out = docs.drop("lang_pred", "lang_score")
    grams = materialize(counts(training.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")), "lang-counts")
    blocks = blocks_of([tuple(r) for r in grams.groupBy("lang").count().collect()], model_rows)
    for k, block in enumerate(blocks):
        part = grams.filter(F.col("lang").between(block[0], block[-1])) if len(blocks) > 1 else grams
        model = Model(part.toArrow())
        trees = spark.sparkContext.broadcast(model.trees)
        first, last = k == 0, k == len(blocks) - 1
        score = F.lit(0.0) if last else F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))
        schema = out.limit(0).withColumns({"lang_pred": F.lit("").cast("string"), "lang_score": score}).schema
        earlier, out = out, out.mapInArrow(scorer(model.langs, trees, first, last), schema)
        if not last:
            out = materialize(out, "lang-pass")
            trees.unpersist()
            if not first and (files := earlier.inputFiles()):
                discard(spark, files[0].rpartition("/")[0])
    return out


def scorer(langs: list[str], trees, first: bool, last: bool):
    """The pass over documents for one broadcast block of languages."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = True
        for batch in batches:
            column, logs, letter = batch.column("text"), [np.empty((0, len(langs)))], [np.empty(0, bool)]
            for lo, hi, raw, at in chunks(column):
                if langs:
                    logs.append(code_lengths(raw, at, trees.value))
                if last:
                    has = np.zeros(hi - lo, bool)
                    full = np.flatnonzero(np.diff(at))
                    if len(full):
                        has[full] = np.logical_or.reduceat(letters[raw], at[:-1][full])
                    for i in np.flatnonzero(~has & (np.diff(at) > 0)).tolist():
                        has[i] = any(map(str.isalpha, column[lo + i].as_py()))
                    letter.append(has)
            if langs:
                log, has = np.concatenate(logs), np.concatenate(letter)
                top, pred = log.max(1), np.array(langs, object)[log.argmax(1)]
                total = np.exp(log - top[:, None]).sum(1)
            else:
                has = np.zeros(len(column), bool)
                top, pred, total = np.zeros(len(column)), np.full(len(column), "und", object), np.ones(len(column))
            if not first:
                old_top, old_total = (batch.column("lang_score").field(x).to_numpy() for x in ("top", "sum"))
                pred = np.where(top > old_top, pred, np.array(batch.column("lang_pred").to_pylist(), object))
                most = np.maximum(top, old_top)
                total = old_total * np.exp(old_top - most) + total * np.exp(top - most)
                top = most
            if last:
                new = [pa.array(np.where(has, pred, "und"), pa.string()), pa.array(np.where(has, 1 / total, 0.0))]
            else:
                new = [pa.array(pred, pa.string()), pa.StructArray.from_arrays([pa.array(top), pa.array(total)], ["top", "sum"])]
            kept = [c for c in batch.schema.names if c not in ("lang_pred", "lang_score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, "lang_pred", "lang_score"])

    return predict


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (crc_of_id() % 5) == 0
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out).select("text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
