"""From raw documents to a sharded training mix.

Each stage works on all that its predecessor kept; run() writes each result to
the shared folder and reads it again. An empty table passes through every stage as
one, and further columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import decontam, minhash, mixing, quality, sharding
from ferrule.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier's sample keeps.

    Null and empty texts score 0, above the cut of labelled junk; repeated rows go
    or stay together; without labels of both kinds everything stays.
    """
    return quality.select(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id (null ids last); wordless texts all stay."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; null and empty texts hold none."""
    return decontam.remove_documents(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for; null sources are one source, sources without words keep their documents once."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, decided by doc_id (null: the empty text); a column ``shard`` is replaced."""
    return sharding.assign(docs, 16)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hash-based sampling and signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
