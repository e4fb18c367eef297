"""LM scoring by prediction by partial matching over bytes, with a trie as large as the corpus makes it.

The trie holds counts of each byte (and of the end of a text, written FF, which
UTF-8 never uses) after its ``ORDER`` and fewer preceding bytes. A byte costs
the escapes (method C) from the longest known context down to the first that has
seen it, with symbol exclusion: bytes seen in a longer context don't count in a
shorter one. Under frozen counts this cost depends on the ORDER + 1 bytes (a
gram) alone, so the trie is handled as a table of grams:

1. texts are dealt into parts of some MB; each part gives its distinct grams and
   words with their training counts, packed by hash bucket of the key;
2. each bucket is summed over all parts; grams are dealt by the three bytes before
   the last, below which all longer contexts lie in one task, many such cells to a
   task, and each gram's cost is worked out; counts of three bytes are summed first
   and joined to the cells that need them; those of two are a 256 x 256 table;
3. costs go back, by bucket, to the parts that asked for them, and each part
   scores its texts.

What the steps write is counted on disk: the shuffles of a job go when it ends, and
all tables but the answers before texts are scored.

The number of parts and of buckets follows the size of the corpus, so tasks stay
the same size; at 100 TB a pack holds few keys and this is a plain shuffle.

Nothing of the model is broadcast or collected but that fixed table.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import BASE, chunks, crc_of_id, discard, materialize, mix64, shuffles_deleted, table, word_table, words

#: Bytes of context; grams of ORDER + 1 bytes are handled as 64-bit numbers.
ORDER = 5
PART_BYTES = 24_000_000
CHUNK = 1_000_000
#: Counts that a part holds before it sums them up.
GATHER = 1_500_000
#: Bytes of text to a hash bucket of keys.
BUCKET_BYTES = 12_000_000
#: Cells that grams with the same two bytes before the last are dealt to, by the byte before those.
SPREAD = 16
END = 255
#: Stands for the end of a text among the words.
END_WORD = np.uint64(BASE)
GRAM, WORD = 0, 1


def grams(raw: np.ndarray, at: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte and end of each text, and the offsets of the texts' grams; 0 stands before a text's start."""
    lengths = np.diff(at)
    n = len(raw) + len(lengths)
    ends = at[1:] + np.arange(len(lengths))
    x = np.empty(n, np.uint64)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    x[is_end] = END
    x[~is_end] = raw
    starts = ends - lengths
    age = np.arange(n) - np.repeat(starts, lengths + 1)
    out = x.copy()
    for k in range(1, order + 1):
        before = np.zeros(n, np.uint64)
        before[k:] = x[:-k] if n > k else 0
        before[age < k] = 0
        out |= before << np.uint64(8 * k)
    return out, np.append(starts, n)


def _part_words(raw, at):
    hashes, _, _, offsets = words(raw, at, word_table("blank"))
    return hashes, offsets


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs among those of training texts (by sorting values, not indexes)."""
    distinct = np.unique(keys)
    seen, n = np.unique(keys[train], return_counts=True)
    counts = np.zeros(len(distinct), np.int64)
    counts[np.searchsorted(distinct, seen)] = n
    return distinct, counts


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(which, np.concatenate(sums)).astype(np.int64)


def _tally(column: pa.Array, train: np.ndarray, order: int):
    """Distinct grams and words of a part with their counts in training texts."""
    keys, sums = ([], []), ([], [])
    ends = np.zeros(2, np.int64)
    for lo, hi, raw, at in chunks(column, CHUNK):
        for kind, (key, offsets) in enumerate((grams(raw, at, order), _part_words(raw, at))):
            distinct, n = _counted(key, np.repeat(train[lo:hi], np.diff(offsets)))
            keys[kind].append(distinct)
            sums[kind].append(n)
            if sum(map(len, keys[kind][1:])) > GATHER:
                distinct, n = _summed(keys[kind], sums[kind])
                keys[kind][:], sums[kind][:] = [distinct], [n]
        ends += (hi - lo, int(train[lo:hi].sum()))
    if ends[0]:
        keys[WORD].append(np.array([END_WORD]))
        sums[WORD].append(np.array([ends[1]]))
    for kind in (GRAM, WORD):
        if keys[kind]:
            yield kind, *_summed(keys[kind], sums[kind])


class Lookup:
    """Values of known 64-bit keys: sorted by a hash, found from its upper bits in a step or a few."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = keys * np.uint64(BASE)
        by = np.argsort(hashes)
        self.hashes, self.values = hashes[by], values[by]
        bits = max(8, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of ``keys``, all of which are known."""
        hashes = keys * np.uint64(BASE)
        at = self.first[hashes >> self.shift]
        left = np.flatnonzero(self.hashes[at] != hashes)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] != hashes[left]]
        return self.values[at]


def pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def unpack(packs, sizes, kind) -> np.ndarray:
    """The arrays of some packs, end to end."""
    width = np.dtype(kind).itemsize
    return np.concatenate([np.frombuffer(pa.decompress(p, n * width, "zstd", asbytes=True), kind) for p, n in zip(packs, sizes, strict=True)])


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packs, sizes) -> np.ndarray:
    return np.concatenate([np.cumsum(unpack([p], [n], np.uint64), dtype=np.uint64) for p, n in zip(packs, sizes, strict=True)])


def gather(order: int, buckets: int):
    """What a part asks for: packs (part, kind, bucket, size, keys, counts)."""

    def run(part: pa.Table) -> pa.Table:
        number = part.column("part")[0].as_py()
        column = part.column("text").combine_chunks()
        train = part.column("train").to_numpy()
        rows = []
        for kind, keys, n in _tally(column, train, order):
            bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                at = by[edges[b] : edges[b + 1]]
                rows.append((number, kind, b, len(at), pack_keys(keys[at]), pack(n[at])))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "kind", "bucket", "size", "keys", "counts"])

    return run


def total(packs: pa.Table) -> pa.Table:
    """Counts of a bucket's keys over all parts."""
    sizes = packs.column("size").to_pylist()
    keys, which = np.unique(unpack_keys(packs.column("keys").to_pylist(), sizes), return_inverse=True)
    n = np.bincount(which, unpack(packs.column("counts").to_pylist(), sizes, np.int64)).astype(np.int64)
    constant = lambda name, t: pa.array([packs.column(name)[0].as_py()] * len(keys), t)
    return pa.table({"kind": constant("kind", pa.int8()), "bucket": constant("bucket", pa.int32()), "key": pa.array(keys.view(np.int64)), "n": pa.array(n)})


def answer(packs: pa.Table, values: pa.Table) -> pa.Table:
    """The packs of a bucket with values for counts."""
    value = Lookup(values.column("key").to_numpy().view(np.uint64), values.column("value").to_numpy())
    got = [pack(value(unpack_keys([k], [n]))) for k, n in zip(packs.column("keys").to_pylist(), packs.column("size").to_pylist(), strict=True)]
    return packs.select(["part", "kind", "size", "keys"]).append_column("values", pa.array(got, pa.binary()))


def _sums_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return which, np.bincount(which, n, minlength=len(distinct))


def gram_costs(gram: np.ndarray, n: np.ndarray, three: np.ndarray, three_n: np.ndarray, short: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the last byte of each gram.

    The grams are all those with certain three bytes before the last, with counts
    ``n`` (0: wanted, not in training); ``three`` with ``three_n``: sorted numbers
    of three bytes and their counts, all that share two bytes before the last with
    a gram; ``short``: counts of (byte, byte).
    """
    sym, lp = (gram & np.uint64(255)).astype(np.int64), np.zeros(len(gram))
    todo = np.ones(len(gram), bool)
    excluded, kinds_excluded = np.zeros(len(gram)), np.zeros(len(gram))

    def step(count, total, kinds):
        nonlocal todo
        total, kinds = total - excluded, kinds - kinds_excluded
        hit, miss = todo & (count > 0), todo & (count == 0) & (total + kinds > 0)
        lp[hit] += np.log10(count[hit] / (total + kinds)[hit])
        lp[miss] += np.log10(kinds[miss] / (total + kinds)[miss])
        todo &= ~hit

    last_three = (gram & np.uint64(0xFFFFFF)).astype(np.int64)
    place = np.minimum(np.searchsorted(three, last_three), max(len(three) - 1, 0))
    count_three = np.where(three[place] == last_three, three_n[place], 0.0) if len(three) else np.zeros(len(gram))
    levels = []
    for k in range(order, 2, -1):
        key = gram & np.uint64((1 << 8 * (k + 1)) - 1)
        which, sums = _sums_by(key, n)
        levels.append((which, sums, key >> np.uint64(8)))
    for i, (which, sums, context) in enumerate(levels):
        one = np.zeros(len(sums), np.int64)
        one[which] = np.arange(len(gram))  # a gram for each (context, byte)
        contexts, of = np.unique(context, return_inverse=True)
        seen = sums > 0
        total = np.bincount(of[one], sums, minlength=len(contexts))
        kinds = np.bincount(of[one], seen, minlength=len(contexts))
        step(sums[which], total[of], kinds[of])
        shorter = levels[i + 1][1][levels[i + 1][0]][one] if i + 1 < len(levels) else count_three[one]
        excluded = np.bincount(of[one], np.where(seen, shorter, 0), minlength=len(contexts))[of]
        kinds_excluded = kinds[of]
    # Two bytes of context, from the summed table; then one and none.
    pairs, of = np.unique(three >> 8, return_inverse=True)
    known = np.minimum(np.searchsorted(pairs, last_three >> 8), max(len(pairs) - 1, 0))
    value = lambda x: np.where(pairs[known] == last_three >> 8, x[known], 0.0) if len(pairs) else np.zeros(len(gram))
    step(count_three, value(np.bincount(of, three_n)), value(np.bincount(of)))
    excluded, kinds_excluded = value(np.bincount(of, short[three >> 8 & 255, three & 255])), value(np.bincount(of))
    last = last_three >> 8 & 255
    first, after = short.sum(0), short > 0
    step(short[last, sym], short.sum(1)[last], after.sum(1)[last])
    excluded, kinds_excluded = (after * first).sum(1)[last], after.sum(1)[last]
    step(first[sym], np.full(len(gram), float(first.sum())), np.full(len(gram), float((first > 0).sum())))
    lp[todo] -= math.log10(max(1, 256 - int((first > 0).sum())))
    return lp


def price(short: np.ndarray, order: int):
    def run(group: pa.Table, counts: pa.Table) -> pa.Table:
        key, three = group.column("key").to_numpy(), counts.column("three").to_numpy()
        by = np.argsort(three)
        cost = gram_costs(key.view(np.uint64), group.column("n").to_numpy().astype(np.float64), three[by], counts.column("three_n").to_numpy()[by].astype(np.float64), short, order)
        return pa.table({"kind": pa.array(np.full(len(key), GRAM, np.int8)), "bucket": group.column("bucket"), "key": pa.array(key), "value": pa.array(cost)})

    return run


def score_part(order: int):
    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        kind, tables = values.column("kind").to_numpy(), []
        for which in (GRAM, WORD):
            own = values.filter(pa.array(kind == which))
            sizes = own.column("size").to_pylist()
            tables.append(Lookup(unpack_keys(own.column("keys").to_pylist(), sizes), unpack(own.column("values").to_pylist(), sizes, np.float64)))
        cost, count = tables
        end_count = count(np.array([END_WORD]))[0]
        scores, tokens, known, base = [], [], [], []
        for lo, hi, raw, at in chunks(docs.column("text").combine_chunks(), CHUNK):
            got, offsets = grams(raw, at, order)
            scores.append(np.add.reduceat(cost(got), offsets[:-1]))
            hashes, offsets = _part_words(raw, at)
            c = count(hashes)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (c > 0, np.log10(c + 1))]
            counts = np.diff(offsets)
            tokens.append(counts + 1)
            known.append(np.diff(sums[0][offsets]) + (end_count > 0))
            base.append(np.diff(sums[1][offsets]) + np.log10(end_count + 1))
        join = lambda x, t: pa.array(np.concatenate(x).astype(t))
        return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), "n_tokens": join(tokens, np.int64), "n_known": join(known, np.int64), "sum_log": join(base, np.float64), "score": join(scores, np.float64)})

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, and the shuffle files that led up to the table go with the job."""
    with shuffles_deleted(df.sparkSession):
        return materialize(df, name)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for done in tables:
        for path in {unquote(f).rsplit("/", 1)[0] for f in done.inputFiles()}:
            discard(done.sparkSession, path)


def score_documents(docs: DataFrame, order: int = ORDER, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, train: learn from this text).

    Columns doc_id, train, n_tokens (words and one end), n_known (tokens that
    occur in training), train_tokens, base_score (add-one unigram log10
    probability of the tokens), score (the trie's log10 probability of the
    bytes and the end). ``order`` is 2 to 7.

    A null text is empty: one end token. A null ``train`` is false. Repeated rows
    are counted and scored one by one. With nothing to learn from, all bytes
    cost log10(256). Null ids pass through; an empty table gives no rows; other
    columns play no part.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // part_bytes), 2 * spark.sparkContext.defaultParallelism)
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = max(-(-size // BUCKET_BYTES), 2 * spark.sparkContext.defaultParallelism)
    asked = written(dealt.groupBy("part").applyInArrow(gather(order, buckets), "part int, kind byte, bucket int, size int, keys binary, counts binary"), "lm-asked")
    sums = written(asked.groupBy("kind", "bucket").applyInArrow(total, "kind byte, bucket int, key long, n long"), "lm-sums")
    seen = sums.filter("n > 0")
    found = seen.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    three = seen.filter(F.col("kind") == GRAM).groupBy(F.expr("key & 16777215").alias("three")).agg(F.sum("n").alias("three_n"))
    three = written(three, "lm-three")
    short = np.zeros((256, 256))
    for r in three.groupBy(F.expr("three & 65535").alias("two")).agg(F.sum("three_n").alias("n")).collect():  # at most 65,536 rows
        short[r.two >> 8, r.two & 255] = r.n
    # A pair of bytes lies in SPREAD cells at most, by the byte before it; each cell gets the pair's counts.
    pair, before = F.expr("shiftright(key, 8) & 65535"), F.expr("shiftright(key, 24) & 255")
    cell = F.pmod(F.xxhash64(pair, before % SPREAD), F.lit(buckets))
    trie = sums.filter(F.col("kind") == GRAM).select("bucket", "key", "n", cell.alias("cell"), pair.alias("pair"))
    counts = trie.select("cell", "pair").distinct().join(three.withColumn("pair", F.expr("shiftright(three, 8)")), "pair").select(F.col("cell").alias("of_cell"), "three", "three_n")
    costs = trie.drop("pair").groupBy("cell").cogroup(counts.groupBy("of_cell")).applyInArrow(price(short, order), "kind byte, bucket int, key long, value double")
    values = costs.union(sums.filter(F.col("kind") == WORD).select("kind", "bucket", "key", F.col("n").cast("double")))
    answers = written(asked.groupBy("kind", "bucket").cogroup(values.groupBy("kind", "bucket")).applyInArrow(answer, "part int, kind byte, size int, keys binary, values binary"), "lm-answers")
    release(asked, sums, three)
    schema = f"doc_id {kind}, train boolean, n_tokens long, n_known long, sum_log double, score double"
    scored = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score_part(order), schema)
    scale = F.lit(float(found.tokens + found.distinct + 1))
    return scored.withColumn("train_tokens", F.lit(found.tokens).cast("long")).withColumn("base_score", F.col("sum_log") - F.col("n_tokens") * F.log10(scale)).drop("sum_log")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (crc_of_id() % 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return score_documents(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
