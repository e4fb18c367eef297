"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, hits verified word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import chunks, materialize, packed, running, spans, table, word_table, words

#: Most windows in one broadcast (about 100 bytes each); further ones go in further passes.
BLOCK_WINDOWS = 200_000
NEW = ["bench_words", "bench_hits", "bench_items"]
KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of letters, digits and non-ASCII characters."""
    return (text or "").encode().translate(KEEP).split()


def windows_of(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (window, item) of the benchmark: n words, or the whole of a shorter item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words_of = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    cut = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " ").cast("binary"))
    return cut.select(F.explode(windows).alias("window"), "item").distinct()


def indexed(rows: list[tuple[bytes, str | None]]) -> tuple[dict[bytes, set], dict[int, np.ndarray]]:
    """A block of windows as workers use it, in plain types: words to items for the check, sorted hashes by length for the scan."""
    items: dict[bytes, set] = {}
    for window, item in rows:
        items.setdefault(bytes(window), set()).update([item] if item is not None else [])
    lengths: dict[int, list[bytes]] = {}
    for window in items:
        lengths.setdefault(window.count(b" ") + 1, []).append(window)
    by_length, fold = {}, word_table("alnum")
    for length, found in sorted(lengths.items()):
        raw = np.frombuffer(b"\x00".join(found), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in found])])
        at[-1] -= 1
        hashes, _, _, offsets = words(raw, at, fold)
        by_length[length] = np.unique(spans(running(hashes), offsets[:-1], offsets[:-1] + length))
    return items, by_length


def scan(raw: np.ndarray, at: np.ndarray, block: tuple) -> tuple[np.ndarray, list[tuple[int, int, int, set]]]:
    """Word offsets of each text, and (text, first word, end word, items) of each verified window."""
    items_of, by_length = block
    hashes, start, end, offsets = words(raw, at, word_table("alnum"))
    prefix, hits, text = running(hashes), [], raw.tobytes()
    for length, wanted in by_length.items():
        if len(hashes) < length:
            continue
        first = np.arange(len(hashes) - length + 1)
        got = spans(prefix, first, first + length)
        sieve = np.zeros(1 << 20, bool)
        sieve[wanted >> np.uint64(44)] = True
        first = first[sieve[got >> np.uint64(44)]]
        first = first[np.isin(got[first], wanted)]
        doc = np.searchsorted(offsets, first, "right") - 1
        whole = first + length <= offsets[doc + 1]
        for i, d in zip(first[whole].tolist(), doc[whole].tolist(), strict=True):
            window = b" ".join(text[start[i] : end[i + length - 1]].translate(KEEP).split())
            if (items := items_of.get(window)) is not None:
                base = int(offsets[d])
                hits.append((d, i - base, i - base + length, items))
    return offsets, hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Mark what documents share with a benchmark.

    Returns the columns of ``docs`` and ``bench_words`` (words in the text),
    ``bench_hits`` (array of [first, end) word ranges, merged) and ``bench_items``
    (ids of the items that occur, as sorted strings).

    The windows are counted first. Up to ``block_windows`` they are one
    broadcast; beyond it, they are dealt by hash into blocks of about that size,
    so no broadcast grows. Each block is a pass that reads the texts; all but the
    last give hits only, which are put together by hashes of the text and join the last
    pass.

    Null and empty texts have no words and no hits, items without words give no
    window, items without id mark words but are not listed, and an empty
    benchmark marks nothing. Repeated rows are marked one by one; other columns
    pass through, and columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*NEW)
    found = materialize(windows_of(benchmark, n), "bench-windows")
    passes = max(1, -(-found.count() // block_windows))
    ranges = T.ArrayType(T.ArrayType(T.IntegerType()))
    new = {"bench_words": F.lit(0).cast("long"), "bench_hits": F.array().cast(ranges), "bench_items": F.array().cast("array<string>")}

    def block(k: int):
        part = found if passes == 1 else found.filter(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k)
        return spark.sparkContext.broadcast(indexed([(r.window, r.item) for r in part.collect()]))

    last = docs.mapInArrow(marker(block(passes - 1), docs.columns), docs.limit(0).withColumns(new).schema)
    if passes == 1:
        return last
    keyed = lambda rows: rows.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"), *rows.columns)
    texts, hits = keyed(docs.select("text")), None
    for k in range(passes - 1):
        shared = block(k)
        own = texts.mapInArrow(marker(shared, ["h1", "h2"]), texts.select("h1", "h2").limit(0).withColumns(new).schema).filter(F.size("bench_hits") > 0)
        own = materialize(own.select("h1", "h2", "bench_hits", "bench_items").distinct(), "bench-pass")
        hits = own if hits is None else hits.union(own)
        shared.unpersist()
    # A row for each text and pass.
    hits = hits.groupBy("h1", "h2").agg(F.flatten(F.collect_list("bench_hits")).alias("_bench_h"), F.flatten(F.collect_list("bench_items")).alias("_bench_i"))
    packed_last = last.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"), packed(docs), *NEW)
    both = packed_last.join(materialize(hits, "bench-hits"), ["h1", "h2"], "left")
    nothing = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    every = F.array_sort(F.concat("bench_hits", nothing("_bench_h", ranges)))
    start = F.array().cast(ranges)
    touching = lambda done, r: (F.size(done) > 0) & (F.element_at(done, -1)[1] >= r[0])
    joined = lambda done, r: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], r[1]))))
    one = F.aggregate(every, start, lambda done, r: F.when(touching(done, r), joined(done, r)).otherwise(F.concat(done, F.array(r))))
    items = F.array_sort(F.array_distinct(F.concat("bench_items", nothing("_bench_i", "array<string>"))))
    return both.select("row.*", "bench_words", one.alias("bench_hits"), items.alias("bench_items"))


def marker(block, keep: list[str]):
    """The pass over documents for one broadcast block of windows: the columns ``keep`` and the new ones."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits_of, items_of = [], [], []
            for lo, hi, raw, at in chunks(batch.column("text")):
                offsets, hits = scan(raw, at, block.value)
                counts += np.diff(offsets).tolist()
                ranges: list[list] = [[] for _ in range(hi - lo)]
                items: list[set] = [set() for _ in range(hi - lo)]
                for d, first, end, which in hits:
                    ranges[d].append([first, end])
                    items[d] |= which
                hits_of += map(merged, ranges)
                items_of += map(sorted, items)
            new = [pa.array(counts, pa.int64()), pa.array(hits_of, pa.list_(pa.list_(pa.int32()))), pa.array(items_of, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *new], names=[*keep, *NEW])

    return mark


def merged(ranges: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching [first, end) ranges as one."""
    out: list[list[int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def remove_documents(marked: DataFrame) -> DataFrame:
    """The documents without a hit, with their own columns; null and empty texts have none and stay."""
    return marked.filter(F.size("bench_hits") == 0).drop(*NEW)


def remove_spans(marked: DataFrame) -> DataFrame:
    """All documents with their own columns, the hit words cut out of their texts with what stands between them; texts without a hit, null ones too, stay as they are."""
    schema = T.StructType([f for f in marked.schema if f.name not in NEW])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = word_table("alnum")
        for batch in batches:
            texts, hits = batch.column("text").to_pylist(), batch.column("bench_hits").to_pylist()
            for i, ranges in enumerate(hits):
                if ranges:
                    raw = texts[i].encode()
                    _, start, end, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), fold)
                    kept, at = [], 0
                    for first, last in ranges:
                        kept.append(raw[at : start[first]])
                        at = end[last - 1]
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            names = schema.names
            kind = batch.schema.field("text").type
            yield pa.RecordBatch.from_arrays([pa.array(texts, kind) if c == "text" else batch.column(c) for c in names], names=names)

    return marked.mapInArrow(cut, schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("bench_hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return marked.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS size, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bench WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT doc_id, i, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM cut, sizes WHERE len(w) >= size)
), hits AS (
  SELECT p.doc_id, p.i, p.size, b.item_id FROM places p JOIN wins b ON p.size = b.size AND p.win = b.win
), marked AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM hits GROUP BY doc_id
)
SELECT c.doc_id, CAST(len(c.w) AS BIGINT) AS n_words, CAST(coalesce(m.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.listed, '')) AS items_sha256,
       coalesce(m.n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN marked m USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
