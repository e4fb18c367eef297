"""Nearest neighbours by additive quantisation.

A vector is written as a sum of full-dimensional codewords, one of each codebook.
Codebooks are fitted to residuals, then refitted together by least squares;
encoding is a beam search. With the norm of the sum stored, a squared distance is
|q|^2 + norm - 2 * (a sum of looked-up products of q and codewords). The stored
length of the quantisation error bounds how far that can be off, so reranking on
the original vectors takes every candidate that could still be among the nearest.

The first two codewords are a vector's cell. A search goes to the two nearest
blocks of cells first; the k-th distance found there and the cells' ranges of
distances from their own points tell which other blocks can hold anything nearer,
by the triangle inequality. So no vector is missed and most are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import materialize, table

CODEBOOKS, WORDS, BEAM = 8, 256, 4
#: Most vectors that the codebooks are fitted on: those with the smallest hashes of vec_id.
SAMPLE = 8192
#: Rows of the index in a block, and queries that a task holds against one.
ROWS, QUERIES = 4096, 4096
#: Candidates with the smallest approximate distances, reranked first.
FIRST = 32


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Beam search: one word of each codebook for each row, as (rows, codebooks)."""
    residual, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.uint8)
    for book in books:
        cost = (residual**2).sum(2)[:, :, None] - 2 * residual @ book.T + (book**2).sum(1)
        flat = cost.reshape(len(x), -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        path, word = best // len(book), best % len(book)
        rows = np.arange(len(x))[:, None]
        residual = residual[rows, path] - book[word]
        codes = np.concatenate([codes[rows, path], word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(len(x)), (residual**2).sum(2).argmin(1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = 6) -> np.ndarray:
    """Codebooks (codebooks, words, dimensions): k-means on residuals in turn, then least squares over all."""
    rng, residual, books = np.random.default_rng(0), x.astype(np.float64), []
    for _ in range(codebooks):
        book = residual[rng.choice(len(x), words, replace=len(x) < words)].copy()
        for _ in range(rounds):
            of = ((book**2).sum(1) - 2 * residual @ book.T).argmin(1)
            n = np.bincount(of, minlength=words)
            by = np.argsort(of, kind="stable")
            sums = np.add.reduceat(residual[by], (np.cumsum(n) - n)[n > 0])
            book[n > 0] = sums / n[n > 0, None]
        residual = residual - book[((book**2).sum(1) - 2 * residual @ book.T).argmin(1)]
        books.append(book)
    books = np.stack(books)
    codes = np.concatenate([encode(x[i : i + 1024].astype(np.float64), books) for i in range(0, len(x), 1024)]).astype(np.int64)
    # Least squares: words that occur together are fitted together (ridge keeps unused words at their places).
    size = codebooks * words
    cells = codes + np.arange(codebooks) * words
    together, sums = np.zeros((size, size)), np.zeros((size, x.shape[1]))
    left = x - decode(codes, books)
    for a in range(codebooks):
        sums += np.stack([np.bincount(cells[:, a], left[:, d], minlength=size) for d in range(x.shape[1])], 1)
        for b in range(codebooks):
            np.add.at(together, (cells[:, a], cells[:, b]), 1)
    return books + conjugate_gradients(together + np.eye(size), sums).reshape(books.shape)


def conjugate_gradients(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Solves a x = b for a positive definite matrix, all columns side by side; codebooks need no more than a few digits."""
    x, rest = np.zeros_like(b), b.copy()
    way, size = rest.copy(), (rest**2).sum(0)
    for _ in range(rounds):
        if size.max(initial=0) <= 1e-20 * max(1.0, (b**2).sum()):
            break
        along = a @ way
        step = size / np.maximum((way * along).sum(0), 1e-300)
        x, rest = x + step * way, rest - step * along
        size, before = (rest**2).sum(0), size
        way = rest + size / np.maximum(before, 1e-300) * way
    return x


def usable(rows: DataFrame) -> DataFrame:
    """Vectors that take part: with an id, not null, of the most common length, all components finite, not all zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(F.forall("embedding", good) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == (sizes[0].d if sizes else 0))


def build_index(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray | None]:
    """The index, a written table of all usable rows, and the codebooks.

    Its columns: vec_id, embedding, codes, norm (of their sum), error (its distance
    from the vector), cell (the first two codes) and reach (the vector's distance
    from the sum of these two). Codebooks are fitted on at most ``sample`` vectors.
    An empty table gives an empty index without codebooks.
    """
    rows = materialize(usable(rows), "ann-vectors")
    new = {"codes": F.lit(b""), "norm": F.lit(0.0), "error": F.lit(0.0), "cell": F.lit(0), "reach": F.lit(0.0)}
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    if not fitted:
        return rows.withColumns(new), None
    books = fit(np.array([r.embedding for r in fitted], np.float64))
    shared, names = rows.sparkSession.sparkContext.broadcast(books), [*rows.columns, *new]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                x = matrix(batch.column("embedding")).astype(np.float64)
                codes = encode(x, books)
                near, first = decode(codes, books), decode(codes[:, :2], books[:2])
                length = lambda v: pa.array(np.sqrt((v**2).sum(1)))
                cell = codes[:, 0].astype(np.int32) * WORDS + codes[:, 1]
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near**2).sum(1)), length(x - near), pa.array(cell), length(x - first)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return materialize(rows.mapInArrow(add, rows.limit(0).withColumns(new).schema), "ann-index"), books


class Cells(NamedTuple):
    """The cells that have vectors, at most WORDS**2: their numbers, ranges of reach, and first block and number of blocks of each."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    block: np.ndarray
    blocks: np.ndarray


def cells_of(index: DataFrame, rows: int) -> Cells:
    """Small cells share a block of about ``rows`` vectors, large ones have several."""
    found = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).collect()
    found.sort(key=lambda r: r.cell)
    block, blocks, at, held = [], [], 0, 0
    for r in found:
        if r.n > rows or held + r.n > rows:
            at, held = at + (held > 0), 0
        own = -(-r.n // rows)
        block.append(at)
        blocks.append(own)
        at, held = (at, held + r.n) if own == 1 else (at + own, 0)
    kinds = (np.int64, np.float64, np.float64, np.int64, np.int64)
    return Cells(*(np.array(x, t) for x, t in zip(([r.cell for r in found], [r.low for r in found], [r.high for r in found], block, blocks), kinds, strict=True)))


def visits(books: np.ndarray, plain: tuple, first: bool):
    """(block, query_id, embedding, limit): the two blocks nearest to each query (``first``), or all that can hold a vector within its limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*plain)
        one, two = cells.cell // WORDS, cells.cell % WORDS
        norm = ((books[0][one] + books[1][two]) ** 2).sum(1)
        for whole in batches:
            for i in range(0, len(whole), 64):
                batch = whole.slice(i, 64)
                q, limit = matrix(batch.column("embedding")).astype(np.float64), batch.column("limit").to_numpy()
                lengths = (q**2).sum(1)
                squared = lengths[:, None] + norm - 2 * ((q @ books[0].T)[:, one] + (q @ books[1].T)[:, two])
                far = np.sqrt(np.maximum(squared, 0))
                which, block = [], []
                for j in range(len(q)):
                    if first:
                        near = cells.block[np.argsort(far[j], kind="stable")[:64]]
                        got = near[np.sort(np.unique(near, return_index=True)[1])][:2]
                    else:
                        slack = 1e-6 * (1 + np.sqrt(lengths[j] + norm))
                        can = np.flatnonzero(np.maximum(far[j] - cells.high, cells.low - far[j]) - slack <= limit[j])
                        inner = np.arange(cells.blocks[can].sum()) - np.repeat(np.cumsum(cells.blocks[can]) - cells.blocks[can], cells.blocks[can])
                        got = np.unique(np.repeat(cells.block[can], cells.blocks[can]) + inner)
                    block.append(got)
                    which.append(np.full(len(got), j))
                rows = batch.take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)), rows.column("vec_id"), rows.column("embedding"), rows.column("limit")], ["block", "query_id", "embedding", "limit"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components summed in order."""
    return np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])


def search(books: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k nearest within its limit that each query has in a block of the index."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        ids, vectors, limits = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(rows) and len(queries):
            vec, x = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding").combine_chunks()).astype(np.float64)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(vec), -1)
            norm, error, reach = (rows.column(c).to_numpy() for c in ("norm", "error", "reach"))
            cell = rows.column("cell").to_numpy()
            present, of = np.unique(cell, return_inverse=True)
            points = books[0][present // WORDS] + books[1][present % WORDS]
            for i, limit, q in zip(queries.column("query_id").to_pylist(), queries.column("limit").to_pylist(), matrix(queries.column("embedding").combine_chunks()).astype(np.float64), strict=True):
                slack = 1e-6 * (1 + np.sqrt((q**2).sum()))
                bound = np.abs(np.sqrt(((points - q) ** 2).sum(1))[of] - reach)
                at = np.flatnonzero((bound <= limit + slack) & (vec != i))
                products = sum((book @ q)[codes[at, m]] for m, book in enumerate(books))
                near = np.sqrt(np.maximum((q**2).sum() + norm[at] - 2 * products, 0))
                if len(at) > FIRST:  # the likeliest ones lower the limit
                    first = at[np.argpartition(near, FIRST)[:FIRST]]
                    limit = min(limit, np.sort(distance(q, x[first]))[min(k, FIRST) - 1])
                at = at[near - error[at] <= limit + slack]
                dist, found = smallest(distance(q, x[at]), vec[at], k)
                ids.append(np.full(len(dist), i))
                vectors.append(found)
                limits.append(dist)
        return pa.table({"query_id": pa.array(np.concatenate(ids)), "vec_id": pa.array(np.concatenate(vectors)), "score": pa.array(np.concatenate(limits))})

    return run


def smallest(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids, dist))[:k]
    return dist[by], ids[by]


def nearest(index: DataFrame, books: np.ndarray | None, queries: DataFrame, k: int = 10, rows: int = ROWS, most: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of the index to each row of ``queries`` (vec_id, embedding).

    Queries are dealt to the blocks that they have to visit and meet them in
    tasks of about ``rows`` vectors and ``most`` queries; neither is collected. A
    row with the query's id is no candidate. Ties go to the smaller id. Repeated
    rows of the index are candidates each, repeated queries are answered once,
    an empty index or no query gives no rows.
    """
    spark = index.sparkSession
    schema = "query_id long, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    cells = cells_of(index, rows)
    known = spark.createDataFrame([(int(c), int(b), int(n)) for c, b, n in zip(cells.cell, cells.block, cells.blocks, strict=True)], "cell int, first int, blocks int")
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("long")
    # At most WORDS**2 cells.
    dealt = index.select("vec_id", "embedding", "codes", "norm", "error", "cell", "reach").join(F.broadcast(known), "cell").withColumn("block", block).drop("first", "blocks")
    queries = queries.select("vec_id", "embedding").dropDuplicates(["vec_id"])
    plain = tuple(cells)

    def looked(asked: DataFrame, first: bool) -> DataFrame:
        kind = dict(queries.dtypes)["embedding"]
        there = materialize(asked.mapInArrow(visits(books, plain, first), f"block long, query_id long, embedding {kind}, limit double"), "ann-visits")
        salts = there.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("salts"))
        asked_rows = there.join(salts, "block").withColumn("salt_", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")).withColumnRenamed("block", "block_").drop("salts")
        index_rows = dealt.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return index_rows.groupBy("block", "salt").cogroup(asked_rows.groupBy("block_", "salt_")).applyInArrow(search(books, k), schema)

    spot = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = looked(queries.withColumn("limit", F.lit(float("inf"))), True).withColumn("rank", spot).filter(F.col("rank") == k)
    limits = materialize(best.select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit")), "ann-limits")
    again = queries.join(limits, "vec_id", "left").select("vec_id", "embedding", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    return looked(again, False).withColumn("rank", spot).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, books = build_index(table(spark, sf_dir, "embeddings"))
    return nearest(index, books, index.filter("vec_id % 100 = 0").select("vec_id", "embedding"))


OP6_SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
