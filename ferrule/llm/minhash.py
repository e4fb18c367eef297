"""Near-duplicates by min-max hashing: both the minimum and the maximum under each permutation enter the signature.

Minimum and maximum of one permutation agree between two sets with the Jaccard
similarity each, nearly independently, so half the hash evaluations give a
signature of the same length and no more variance. Six values make a band.
In a union of u shingles, 0.75 u of them common, both agree with probability
q = 0.75 (0.75 u - 1) / (u - 1), which nears 0.75**2 for large u. With 72 bands a
pair at the threshold of 0.75 shares none with probability (1 - q**3)**72, below
1e-6 from u = 56 on.

For smaller sets minimum and maximum depend on each other too much, so they are
dealt exactly instead: of two sets with a similarity of 0.75 or more, each holds
at least 0.75 of its own shingles in common with the other, so among the
n - ceil(0.75 n) + 1 first shingles of each, in one order for all, there is a
common one. The order is by frequency, rarest first.

Whatever shares a band or such a shingle is confirmed or refuted on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import BASE, chunks, materialize, mix64, packed, running, spans, table, word_table, words
from ferrule.llm.components import components

SHINGLE = 5
BANDS, PERMUTATIONS_A_BAND = 72, 3
PERCENT = 75
#: Pairs with a set of up to SMALL shingles are found by their rarest ones, so sets of up to SMALL / 0.75 offer these; larger sets than SMALL have bands.
SMALL = 60
#: Shingles of a bucket that one task holds against as many others; larger buckets are dealt out by pairs of blocks.
BLOCK = 400_000


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets."""
    hashes, _, _, offsets = words(raw, at, word_table("blank"))
    prefix, counts = running(hashes), np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1)))
    first = np.arange(len(doc)) - np.searchsorted(doc, doc) + offsets[doc]
    got = spans(prefix, first, first + np.minimum(SHINGLE, counts[doc]))
    order = np.lexsort((got, doc))
    got = got[order]
    fresh = np.ones(len(got), bool)
    fresh[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
    got, doc = got[fresh], doc[fresh]
    return got, np.searchsorted(doc, np.arange(len(counts) + 1))


def signatures(sets: np.ndarray, offsets: np.ndarray):
    """The minima and the maxima of each permutation; every text has a shingle."""
    starts = offsets[:-1]
    factors = mix64(np.arange(1, 2 * BANDS * PERMUTATIONS_A_BAND + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    for i in range(0, len(factors), 2):
        value = sets * factors[i] + factors[i + 1]
        yield np.minimum.reduceat(value, starts)
        yield np.maximum.reduceat(value, starts)


def band_keys(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A (texts, bands) array of band hashes."""
    out = np.empty((len(offsets) - 1, BANDS), np.uint64)
    for i, values in enumerate(signatures(sets, offsets)):
        band = i // (2 * PERMUTATIONS_A_BAND)
        if i % (2 * PERMUTATIONS_A_BAND) == 0:
            out[:, band] = band + 1
        out[:, band] = mix64(out[:, band] * np.uint64(BASE) + values)
    return out


def subset(sets: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sets, by a mask."""
    sizes = np.diff(offsets)
    return sets[np.repeat(which, sizes)], np.concatenate([[0], np.cumsum(sizes[which])])


def lists_of(which: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> pa.Array:
    """A list for each text, empty where it is not among ``which``."""
    ends = np.zeros(len(which) + 1, np.int32)
    ends[1:][which] = counts
    return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(flat.view(np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2, n, k1, k2, bands, small): the size of each text's set, two hashes of it, its bands if it is large, its shingles if it is small."""
    for batch in batches:
        for lo, hi, raw, at in chunks(batch.column("text")):
            sets, offsets = shingle_sets(raw, at)
            sizes = np.diff(offsets)
            keys = np.zeros((2, hi - lo), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                for k in range(2):
                    keys[k, full] = np.add.reduceat(mix64(sets ^ np.uint64(BASE >> k)), offsets[:-1][full])
            large, small = sizes > SMALL, (sizes > 0) & (sizes * PERCENT <= SMALL * 100)
            bands = band_keys(*subset(sets, offsets, large)).ravel() if large.any() else np.empty(0, np.uint64)
            columns = [pa.array(sizes.astype(np.int64)), *(pa.array(k.view(np.int64)) for k in keys), lists_of(large, np.full(large.sum(), BANDS), bands), lists_of(small, sizes[small], subset(sets, offsets, small)[0])]
            own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*own, *columns], ["doc_id", "h1", "h2", "n", "k1", "k2", "bands", "small"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, at in chunks(batch.column("text")):
            sets, offsets = shingle_sets(raw, at)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), lists], ["node", "shingles"])


def compare(group: pa.Table) -> pa.Table:
    """Links that join the components of a bucket, or of two blocks of it: outsiders against all members.

    Each outsider is held against the full sets of all members of other
    components whose size allows the threshold; one that is connected by then is
    skipped.
    """
    group = group.combine_chunks()
    nodes, c, outside = (group.column(x).to_numpy(zero_copy_only=False) for x in ("node", "c", "outside"))
    lists = group.column("shingles").combine_chunks()
    n = lists.value_lengths().to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    flat = lists.flatten().to_numpy().view(np.uint64)  # sorted as such
    comp = np.unique(c, return_inverse=True)[1]
    members, links = ~outside, []
    for i in np.flatnonzero(outside).tolist():
        with_i = np.flatnonzero(members & (comp != comp[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * PERCENT))
        if not len(with_i):
            continue
        own = flat[at[i] : at[i + 1]]
        sizes = n[with_i]
        starts = np.cumsum(sizes) - sizes
        theirs = flat[np.repeat(at[with_i] - starts, sizes) + np.arange(sizes.sum())]
        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        both = np.add.reduceat((own[place] == theirs).astype(np.int64), starts)
        for j in with_i[both * 100 >= (n[i] + sizes - both) * PERCENT].tolist():
            if comp[i] != comp[j]:
                links.append((nodes[i], nodes[j]))
                comp[comp == comp[j]] = comp[i]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return joined.filter(both * 100 >= (F.size("of_a") + F.size("of_b") - both) * PERCENT).select("a", "b")


def _rare(single: DataFrame) -> DataFrame:
    """(bucket, node, n) of the first shingles of small sets, rarest first; only shingles that several sets hold."""
    held = materialize(single.filter(F.size("small") > 0).select("node", "n", F.explode("small").alias("s")), "mh-small")
    often = materialize(held.groupBy("s").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "mh-often")
    # A shingle of one set counts for its place in the order only: it comes first.
    shared = held.join(often, "s").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("found"))
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.size("found"))
    return shared.filter(first > 0).select(F.explode(F.slice("found", 1, first.cast("int"))).alias("f"), "node", "n").select(F.xxhash64(F.col("f.s"), F.lit("rare")).alias("bucket"), "node", "n")


def _deal(labelled: DataFrame, block: int) -> DataFrame:
    """(bucket, x, y, node, c, outside): members of buckets that hold several components, dealt to the tasks that compare them.

    Those of a bucket's largest component need no comparison among themselves:
    outsiders come in blocks x and face all members in blocks y. Each row is
    dealt once for each block on the other side, so a bucket with few outsiders
    takes hardly more than a row for each member.
    """
    sizes = labelled.groupBy("bucket", "c").agg(F.sum("n").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda x: F.ceil(x / F.lit(block)).cast("int")
    mixed = sizes.select("bucket", F.col("top.c").alias("largest"), blocks(F.col("all") - F.col("top.n")).alias("xs"), blocks(F.col("all")).alias("ys"))
    rows = labelled.join(mixed, "bucket").withColumn("own", F.xxhash64("node"))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    spot = lambda of: F.pmod("own", F.col(of)).cast("int")
    facing = rows.select("bucket", every("xs").alias("x"), spot("ys").alias("y"), "node", "c", F.lit(False).alias("outside"))
    outside = rows.filter("c <> largest").select("bucket", spot("xs").alias("x"), every("ys").alias("y"), "node", "c", F.lit(True).alias("outside"))
    return facing.union(outside)


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with h1 and h2, which only rows of equal id and text share."""
    return docs.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.xxhash64(F.lit(2), "text", "doc_id")})


def pick(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``docs`` (h1, h2, ...) for each of ``wanted`` (h1, h2, many, ...): repeats, where there are some, are narrowed down in every task first."""
    found = docs.join(wanted, ["h1", "h2"])
    one = found.filter(F.col("many").isNull()).drop("many")
    rest = found.filter("many").drop("many")
    return one.union(rest.groupBy("h1", "h2").agg(F.first(F.struct(*rest.columns)).alias("r")).select("r.*"))


def _classes(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """A written table (doc_id, h1, h2, n, component, class) of each row of ``docs`` (doc_id, text, h1, h2), and (h1, h2, many) of repeated ones.

    The class names a component even where no document in it has an id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(_signatures, f"doc_id {kind}, h1 long, h2 long, n long, k1 long, k2 long, bands array<long>, small array<long>")
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "mh-signed")
    repeated = materialize(signed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h1", "h2", F.lit(True).alias("many")), "mh-repeated")
    # Rows with equal sets are one node, named by one of them.
    nodes = materialize(signed.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "mh-nodes")
    single = signed.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    rows = single.select(F.explode("bands").alias("bucket"), "node", "n").union(_rare(single)).repartition("bucket")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).filter("leader < _last").drop("_last")
    live = materialize(rows.join(shared, "bucket"), "mh-live")
    wanted = single.select("h1", "h2", "node").join(live.select("node").distinct(), "node", "left_semi").join(repeated, ["h1", "h2"], "left")
    texts = pick(docs.select("h1", "h2", "text"), wanted)
    sets = materialize(texts.select("node", "text").mapInArrow(_sets, "node long, shingles array<long>"), "mh-sets")

    votes = live.filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("votes"))
    first = votes.groupBy("node").agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("a")).select("a", F.col("node").alias("b"))
    labels = components(materialize(_confirm(first, sets), "mh-edges"))
    labelled = live.select("bucket", "node", "n").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("label", "node")).drop("label")
    facing = _deal(materialize(labelled, "mh-labelled"), block).join(sets, "node").groupBy("bucket", "x", "y")
    more = facing.applyInArrow(compare, "a long, b long").union(labels.select(F.col("label").alias("a"), F.col("id").alias("b")))
    labels = components(materialize(more, "mh-edges"))
    # The smallest document of each component, then every row with that of its own.
    linked = nodes.join(labels.withColumnRenamed("id", "node"), "node")
    named = linked.join(linked.groupBy("label").agg(F.min("least").alias("component")), "label").select("node", "label", "component")
    named = nodes.join(named, "node", "left").select("k1", "k2", "n", F.coalesce("label", "node").alias("class"), F.coalesce("component", "least").alias("component"))
    out = signed.drop("bands", "small").join(materialize(named, "mh-named"), ["k1", "k2", "n"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return materialize(out.select("doc_id", "h1", "h2", "n", own.alias("component"), F.coalesce("class", "row").alias("class")), "mh-classes"), repeated


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Rows with equal sets are one node of the graph, so copies cost nothing
    further. Nodes that share a band (or, if small, one of their rarest shingles)
    are linked in two steps. First every node is held against the leader (smallest
    node) that it meets most often. Then buckets that still hold several
    components are looked through: members outside a bucket's largest component
    are held against all its members, on full sets, until they are connected or
    refuted. Large buckets are dealt out in pairs of blocks. So a bucket of near
    copies takes a row for each member and gives fewer links, never all pairs,
    and yet every pair of a bucket is either linked, connected otherwise or
    refuted.

    Every row is a document. Null and empty texts have no shingles, are linked
    with nothing and kept. A null id never names a component: such a row links
    like any other, takes its component's smallest id and is kept only if the
    component has none. Other columns play no part; an empty table gives no rows.
    """
    found, _ = _classes(hashed(docs.select("doc_id", "text")), block)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest id, with its own columns, whatever their names.

    Rows with a null id come last; of rows that repeat an id and a text one
    stays. Documents without words are no copies of anything and all stay. An
    empty table gives no rows.
    """
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(packed(docs), "doc_id", "text")
    own = hashed(rows.filter(~wordless))
    found, repeated = _classes(own.select("doc_id", "text", "h1", "h2"), BLOCK)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")).alias("x")
    kept = materialize(found.groupBy("class").agg(first).select("x.h1", "x.h2").join(repeated, ["h1", "h2"], "left"), "mh-kept")
    return pick(own.select("h1", "h2", "row"), kept).select("row").union(rows.filter(wordless).select("row")).select("row.*")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM cut WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_met FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_met >= 75 * (p.n + q.n - n_met)
), reach AS (
  SELECT doc_id, doc_id AS spot FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.spot
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(spot) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
