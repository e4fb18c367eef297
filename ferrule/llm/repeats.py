"""Suffix-array dedup: bytes covered by long strings that occur elsewhere, by longest-previous-factor arrays.

One suffix array over a corpus does not fit a machine, and need not: only matches
of ``LENGTH`` bytes count. Every window of that length has an anchor, the
``GRAM`` bytes inside it with the smallest hash (leftmost of equals). Equal windows
have equal anchors at equal places, so windows can be dealt out by anchor:

1. each text gives its anchors, with the run of windows that each serves and a
   hash of the segment that those windows cover; anchors that occur once are done;
2. copies of a whole segment (equal in anchor and segment hash, 128 bits) are one
   string with several places, so that a text of which there are a thousand
   copies is ranked once; the other copies repeat the first one;
3. different segments of an anchor meet in a task, which puts their windows into
   suffix order by prefix doubling, takes the longest common prefixes of
   neighbours from the same ranks, and from the previous and next smaller
   positions in that order computes the longest-previous-factor array (and, with
   positions reversed, that of later matches). A window repeats where its factor
   reaches LENGTH;
4. the runs of such windows go back to their texts.

An anchor with more different segments than a task should hold is dealt out by
the hash of whole windows instead, the copies of a very frequent window over many
tasks, each with the first copy among them; what repeats is decided by the same
arrays on the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import byte_codes, chunks, materialize, packed, running, spans, table

LENGTH, GRAM = 200, 64
#: Segments in a task that ranks windows, about; an anchor with more different ones is dealt out further.
GROUP_SEGMENTS, HOT_SEGMENTS = 20_000, 20_000


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int):
    """(text, anchor hash, segment hash, first window, windows) of each anchor of some texts."""
    if len(raw) < length:
        return (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2, *[np.empty(0, np.int64)] * 2)
    prefix = running(byte_codes()[raw])
    start = np.arange(len(raw) - gram + 1)
    hashes = spans(prefix, start, start + gram)

    def least(low, place, by, n):
        right = low[by : by + n] < low[:n]  # of equals the left one
        return np.where(right, low[by : by + n], low[:n]), np.where(right, place[by : by + n], place[:n])

    low, place, width, size = hashes, start.astype(np.int32), length - gram + 1, 1
    while size * 2 <= width:
        low, place = least(low, place, size, len(low) - size)
        size *= 2
    if size < width:
        low, place = least(low, place, width - size, len(raw) - length + 1)
    place = place.astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(place)]
    window = np.flatnonzero(np.arange(len(place)) + length <= at[1:][text])
    if not len(window):
        return anchors(raw[:0], at[:1], length, gram)
    place, text = place[window], text[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    lo, count = window[first], np.diff(np.append(first, len(window)))
    return text[first], hashes[place[first]], spans(prefix, lo, lo + count - 1 + length), lo - at[:-1][text[first]], count


def ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of every position by its next ``size`` bytes) for 8, 16, ... bytes, at most ``length``; by prefix doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    out = [(8, np.unique(key, return_inverse=True)[1].astype(np.uint32))]
    while (size := out[-1][0]) * 2 <= length:
        rank = out[-1][1].astype(np.uint64)
        after = np.concatenate([rank[size:], np.zeros(min(size, n), np.uint64)])
        out.append((size * 2, np.unique(rank << np.uint64(32) | after, return_inverse=True)[1].astype(np.uint32)))
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, standing: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows at ``at`` by their ``length`` bytes, of equals by ``standing``, and the longest common prefix of each with the one before it."""
    levels = ranks(data, length)
    size, top = levels[-1]
    order = np.lexsort((standing, top[at + length - size], top[at]))
    p, q = at[order][:-1], at[order][1:]
    lcp, more = np.zeros(len(p), np.int64), np.ones(len(p), bool)
    for size, rank in reversed(levels):
        fits = np.flatnonzero(lcp + size <= length)
        lcp[fits] += np.where(rank[p[fits] + lcp[fits]] == rank[q[fits] + lcp[fits]], size, 0)
    for _ in range(7):
        more &= lcp < length
        spot = np.flatnonzero(more)
        more[spot] = data[p[spot] + lcp[spot]] == data[q[spot] + lcp[spot]]
        lcp[more] += 1
    return order, np.concatenate([[0], lcp])[: len(at)]


def previous_factors(lcp: np.ndarray, standing: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array over windows in suffix order: how long a prefix of each also begins at one that stands earlier.

    The longest match is with one of two windows: the previous and the next in
    suffix order that stand earlier (smaller positions). Both are found by
    pointer jumping, with the least common prefix on the way.
    """

    def nearest(lcp, standing):
        at, least = np.arange(len(standing)) - 1, lcp.copy()
        while len(far := np.flatnonzero((at >= 0) & (standing[at] > standing))):
            least[far] = np.minimum(least[far], least[at[far]])
            at[far] = at[at[far]]
        return np.where(at >= 0, least, 0)

    turned = np.concatenate([[0], lcp[:0:-1]])[: len(lcp)]
    return np.maximum(nearest(lcp, standing), nearest(turned, standing[::-1])[::-1])


def matched(length: int, keep_first: bool):
    """Spans of the windows of a group of segments that occur elsewhere (``keep_first``: earlier)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        doc, lo, n, doc_order = (group.column(c).to_numpy() for c in ("doc", "lo", "n", "doc_order"))
        order = np.lexsort((lo, doc, doc_order))
        standing = np.empty(len(order), np.int64)
        standing[order] = np.arange(len(order))
        data = np.frombuffer(b"".join(group.column("segment").to_pylist()), np.uint8)
        at = np.concatenate([[0], np.cumsum(n.astype(np.int64) - 1 + length)])
        segment = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        start = at[segment] + inner
        # A window whose hash is alone equals no other; the rest is put into suffix order.
        hashes = spans(running(byte_codes()[data]), start, start + length)
        by = np.argsort(hashes, kind="stable")
        same = hashes[by][1:] == hashes[by][:-1]
        likely = np.zeros(len(by), bool)
        likely[by[1:]] |= same
        likely[by[:-1]] |= same
        some = np.flatnonzero(likely)
        found = np.zeros(len(segment), bool)
        if len(some):
            kept = np.unique(segment[some])
            use = np.zeros(len(n), bool)
            use[kept] = True
            sizes = (n.astype(np.int64) - 1 + length)[kept]
            moved = np.zeros(len(n), np.int64)
            moved[kept] = np.cumsum(sizes) - sizes
            stands = standing[segment[some]] * (1 << 31) + inner[some]
            suffixes, lcp = suffix_order(data[np.repeat(use, n.astype(np.int64) - 1 + length)], moved[segment[some]] + inner[some], stands, length)
            hit = previous_factors(lcp, stands[suffixes]) >= length
            if not keep_first:
                hit |= previous_factors(lcp, -stands[suffixes]) >= length
            found[some[suffixes]] = hit
        hit = np.flatnonzero(found)
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (hit[1:] != hit[:-1] + 1) | (segment[hit[1:]] != segment[hit[:-1]])
        first = hit[np.flatnonzero(fresh)]
        last = hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)] if len(hit) else first
        of = segment[first]
        return pa.table({"doc": pa.array(doc[of]), "doc_order": pa.array(doc_order[of]), "lo": pa.array((lo[of] + inner[first]).astype(np.int32)), "hi": pa.array((lo[of] + inner[last] + length).astype(np.int32))})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc, doc_order, spans): the byte ranges, as array of (lo, hi), that repeat; only rows that have some.

    ``docs`` has doc and doc_order (longs, together a key of id and text) and text; ``length`` is 8 at least.
    """
    gram = min(GRAM, length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, raw, at in chunks(batch.column("text")):
                text, h, seg, lo, n = anchors(raw, at, length, gram)
                of = pa.array(text + first)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(of), batch.column("doc_order").take(of), pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "doc_order", "h", "seg", "lo", "n"])

    key = ["doc", "doc_order"]
    found = materialize(docs.mapInArrow(find, "doc long, doc_order long, h long, seg long, lo int, n int"), "rep-anchors")
    # Written first: a join of two plain tables can split the rows of a hot anchor among tasks.
    again = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "rep-again")
    live = materialize(found.join(again, "h"), "rep-live")
    place = F.struct("doc_order", "doc", "lo")
    segs = live.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first"))
    segs = materialize(segs, "rep-segments")
    covered = live.join(segs.filter("c > 1").select("h", "seg", "first"), ["h", "seg"])
    if keep_first:
        covered = covered.filter(place != F.col("first"))
    covered = covered.select(*key, "lo", (F.col("lo") + F.col("n") - 1 + length).alias("hi"))
    counts = segs.groupBy("h").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    open_rows = live.join(segs.select("h", "seg", "first"), ["h", "seg"]).filter(place == F.col("first")).join(counts, "h")
    asked = open_rows.select(*key, F.struct("h", "lo", "n", (F.col("different") > hot_segments).alias("hot")).alias("a")).groupBy(*key).agg(F.collect_list("a").alias("asked"))
    names = ["doc", "doc_order", "h", "lo", "n", "segment", "windows"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("doc", "doc_order", "text", "asked")}
                raw, hashes, out = row["text"].encode(), None, []
                for a in row["asked"]:
                    windows = None
                    if a["hot"]:
                        hashes = running(byte_codes()[np.frombuffer(raw, np.uint8)]) if hashes is None else hashes
                        at = np.arange(a["lo"], a["lo"] + a["n"])
                        windows = spans(hashes, at, at + length).view(np.int64)
                    out.append((row["doc"], row["doc_order"], a["h"], a["lo"], a["n"], raw[a["lo"] : a["lo"] + a["n"] - 1 + length], windows))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    kinds = "doc long, doc_order long, h long, lo int, n int, segment binary, windows array<long>"
    pieces = materialize(docs.join(asked, key).mapInArrow(cut, kinds), "rep-pieces")
    groups = max(1, -(-pieces.count() // GROUP_SEGMENTS))
    rows = "doc long, doc_order long, lo int, hi int"
    cold = pieces.filter("windows IS NULL").withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)))
    ranked = cold.groupBy("g").applyInArrow(matched(length, keep_first), rows)
    every = covered.union(ranked)
    hot = pieces.filter("windows IS NOT NULL")
    if not hot.isEmpty():
        every = every.union(_of_hot(hot, length, hot_segments).applyInArrow(matched(length, keep_first), rows))
    return every.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _of_hot(hot: DataFrame, length: int, most: int):
    """Windows of hot anchors that may occur again, one a row, in groups of about ``most``; all copies of a window meet the first of them."""
    place = F.struct("doc_order", "doc", "lo")
    each = hot.select("doc", "doc_order", "h", "lo", "segment", F.posexplode("windows").alias("i", "window"))
    each = materialize(each.select("doc", "doc_order", "h", (F.col("lo") + F.col("i")).alias("lo"), "window", F.expr(f"substring(segment, i + 1, {length})").alias("segment")), "rep-windows")
    twice = materialize(each.groupBy("h", "window").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).filter("c > 1"), "rep-twice")
    bins = max(1, -(-(twice.agg(F.sum("c")).first()[0] or 0) // most))
    salts = F.ceil(F.col("c") / F.lit(most)).cast("int")
    own = F.array(F.pmod(F.xxhash64("doc", "doc_order", "lo"), salts).cast("int"))
    salt = F.explode(F.when(place == F.col("first"), F.sequence(F.lit(0), salts - 1)).otherwise(own))
    bin_ = F.when(salts > 1, F.xxhash64("h", "window")).otherwise(F.pmod(F.xxhash64("h", "window"), F.lit(bins)))
    dealt = each.join(twice, ["h", "window"]).select("doc", "doc_order", "lo", F.lit(1).alias("n"), "segment", bin_.alias("bin"), salt.alias("salt"))
    return dealt.groupBy("bin", "salt")


def mark_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """The columns of ``docs`` and ``repeat_spans``: merged byte ranges [lo, hi) of the text that repeat.

    A byte is in one if a string of ``length`` bytes that covers it also starts
    anywhere else, in this or another text, overlaps included; with
    ``keep_first`` only if it starts earlier (by doc_id, nulls first, then by
    place), so the first copy stays.

    Null, empty and shorter texts have none; repeated rows are copies of each
    other (with ``keep_first``, rows with the same id and text are alike: they
    share one place, and none of them is earlier); a column of that name is
    replaced, others keep their names, whatever they are; an empty table gives no
    rows. Ids that are no whole numbers stand in the order of their hashes.
    """
    docs = docs.drop("repeat_spans")
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    order = F.coalesce(F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(packed(docs), F.xxhash64("doc_id", "text").alias("doc"), order.alias("doc_order"), "text")
    long = rows.select("doc", "doc_order", "text").filter(F.octet_length("text") >= length)
    found = materialize(repeated_spans(long, length, keep_first, hot_segments), "rep-spans")
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<lo:int,hi:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= s["lo"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), F.greatest(F.element_at(done, -1)["hi"], s["hi"]).alias("hi"))))).otherwise(F.concat(done, F.array(s))),
    )
    found = found.select("doc", "doc_order", merged.alias("repeat_spans"))
    joined = rows.select("row", "doc", "doc_order").join(found, ["doc", "doc_order"], "left")
    return joined.select("row.*", F.coalesce("repeat_spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("repeat_spans"))


def removed(text: bytes, ranges: list[dict]) -> bytes:
    kept, at = [], 0
    for r in ranges:
        kept.append(text[at : r["lo"]])
        at = r["hi"]
    return b"".join([*kept, text[at:]])


def remove_repeats(marked: DataFrame) -> DataFrame:
    """The documents without their repeated bytes; a character cut in half goes whole. Null texts stay null, all other columns stay."""

    @F.pandas_udf("string")
    def cut(text, ranges):
        import pandas as pd

        return pd.Series([t if t is None or not len(r) else removed(t.encode(), r).decode(errors="ignore") for t, r in zip(text, ranges, strict=True)])

    return marked.withColumn("text", cut("text", "repeat_spans")).drop("repeat_spans")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("repeat_spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                rows.append((len(raw), sum(r["hi"] - r["lo"] for r in ranges), len(ranges), hashlib.sha256(removed(raw, ranges)).hexdigest()))
            new = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP7_SQL = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS MATERIALIZED (
  SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM docs)
), repeated AS (
  SELECT rid, i FROM windows SEMI JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)
), runs AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run
  FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM repeated)
), spans AS (
  SELECT rid, min(i) AS lo, max(i) + 200 AS hi FROM runs GROUP BY rid, run
), pieces AS (
  SELECT s.rid, lo, hi, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY s.rid ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY s.rid ORDER BY lo), 0))) AS piece
  FROM spans s JOIN docs d ON s.rid = d.rid
), sums AS (
  SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(piece, '' ORDER BY lo) AS kept FROM pieces GROUP BY rid
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN sums s ON s.rid = d.rid
"""
