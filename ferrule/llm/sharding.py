"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn in turn.

At each level every child draws -ln(u) / weight, with u a hash of the document's
key and the child's name, and the smallest draw wins; a child wins in proportion
to its weight. A changed weight moves documents only into or out of the subtrees
whose weights change.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import ranked, table


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, built_with: int = 16) -> list[Leaf]:
    """The tree of a cluster: two racks of four shards to a region up to ``built_with`` shards.

    Each shard added later opens a region of its own. So all weights outside that
    region stay as they are, and a further shard takes rows only into itself.
    """
    first = [Leaf(f"r{s // 8}", f"r{s // 8}k{s % 8 // 4}", s) for s in range(min(shards, built_with))]
    return first + [Leaf(f"x{s}", f"x{s}k0", s) for s in range(built_with, shards)]


def drawn(key: Column, names: dict[str, float]) -> Column:
    """Index of the child with the smallest weighted draw."""
    if len(names) == 1:
        return F.lit(0)

    def score(i: int, name: str, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)).alias("s"), F.lit(i).alias("i"))

    return F.array_min(F.array(*[score(i, n, w) for i, (n, w) in enumerate(names.items())]))["i"]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key (text), an int; leaves without weight take nothing."""
    leaves = [leaf for leaf in leaves if leaf.weight > 0]

    def descend(some: list[Leaf], level: int) -> Column:
        groups: dict[str, list[Leaf]] = {}
        for leaf in some:
            groups.setdefault(str(leaf[level]) if level < 2 else f"s{leaf.shard}", []).append(leaf)
        below = [F.lit(g[0].shard) if level == 2 else descend(g, level + 1) for g in groups.values()]
        if len(below) == 1:
            return below[0]
        which = drawn(key, {n: float(sum(leaf.weight for leaf in g)) for n, g in groups.items()})
        rest = reduce(lambda chosen, i: chosen.when(which == i, below[i]), range(1, len(below) - 1), F.when(which == 0, below[0]))
        return rest.otherwise(below[-1])

    return descend(leaves, 0).cast("int")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with ``shard`` (replaced if present), decided by doc_id and the number of shards; a narrow step without shuffle.

    A null id counts as the empty text, so all null ids share a shard, as do
    repeated ids. Texts play no part.
    """
    return docs.withColumn("shard", place(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), tree(shards)))


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """``slot``: the place of each row in its shard by ``order``, gapless from 0; a shard takes many tasks, an empty table gives no rows."""
    return ranked(rows.drop("slot"), ["shard", *[F.col(c).asc_nulls_first() for c in order]], "slot", by=["shard"])


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = assign(docs, 16).select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), "shard", place(key, tree(17)).alias("grown_shard")
    )
    return number(rows, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_place(leaves: list[Leaf]) -> str:
    """SQL for ``place`` over docs(rid, key): rows (rid, shard)."""
    regions: dict[str, float] = {}
    racks: dict[tuple, float] = {}
    for leaf in leaves:
        regions[leaf.region] = regions.get(leaf.region, 0) + leaf.weight
        racks[leaf.region, leaf.rack] = racks.get((leaf.region, leaf.rack), 0) + leaf.weight
    score = "-ln((CAST(CAST('0x' || substr(md5(key || '|' || name), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / weight"
    rows = lambda xs: ", ".join("(" + ", ".join(repr(y) for y in x) + ")" for x in xs)
    return f"""(
      WITH a AS (SELECT rid, key, arg_min(name, {score}) AS region FROM docs, (VALUES {rows(regions.items())}) n(name, weight) GROUP BY rid, key),
           b AS (SELECT rid, key, arg_min(name, {score}) AS rack FROM a JOIN (VALUES {rows((r, k, w) for (r, k), w in racks.items())}) n(region, name, weight) USING (region) GROUP BY rid, key)
      SELECT rid, arg_min(shard, {score}) AS shard FROM b JOIN (VALUES {rows((x.rack, f"s{x.shard}", x.shard, x.weight) for x in leaves)}) n(rack, name, shard, weight) USING (rack) GROUP BY rid)"""


OP5_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(text, '') AS text FROM documents
), crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), points AS (
  SELECT rid, list_transform(regexp_extract_all(text, '(?s).'), lambda x: CAST(unicode(x) AS BIGINT)) AS p FROM docs
), bytes AS (
  SELECT rid, flatten(list_transform(p, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 + (c >> 6), 128 + (c & 63)]
    WHEN c < 65536 THEN [224 + (c >> 12), 128 + ((c >> 6) & 63), 128 + (c & 63)]
    ELSE [240 + (c >> 18), 128 + ((c >> 12) & 63), 128 + ((c >> 6) & 63), 128 + (c & 63)] END)) AS b FROM points
), sums AS (
  SELECT rid, len(b) + 1 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, crc.t[xor(c & 255, x) + 1])), 4294967295) AS crc FROM bytes, crc
), rows AS (
  SELECT d.doc_id, CAST(s.size AS BIGINT) AS size, CAST(s.crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(p.shard AS INTEGER) AS shard, CAST(g.shard AS INTEGER) AS grown_shard
  FROM docs d JOIN sums s USING (rid) JOIN {_sql_place(tree(16))} p USING (rid) JOIN {_sql_place(tree(17))} g USING (rid)
)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id ASC NULLS FIRST, size, text_crc32) - 1 AS slot FROM rows
"""
