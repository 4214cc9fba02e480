"""A training corpus from raw documents: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadycast.llm import common, mixing, near_dup, packing, quality, queries, suffixes


def _only(docs: DataFrame, rows: DataFrame, key: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose ``key``, columns by the names they have in ``rows``, is in ``rows``; null is a value."""
    there = docs.withColumns({f"_{c}": value for c, value in key.items()})
    wanted = rows.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct().alias("w")
    same = reduce(and_, (F.col(f"d._{c}").eqNullSafe(F.col(f"w._{c}")) for c in key))
    return there.alias("d").join(wanted, same, "left_semi")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep(docs, quality.learn(docs, queries.labels(spark, sf_dir)))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, 0.8 alike."""
    kept = near_dup.marked(docs, size=5).where("kept")
    key = {"doc_id": F.col("doc_id").cast("long"), "mark": near_dup.mark_of(F.col("text"))}
    return _only(docs, kept, key).dropDuplicates(["_doc_id", "_mark"]).select(*docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that occur earlier."""
    return suffixes.clean(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for nine tenths of the tokens, one epoch, by the weights of the mix."""
    taken = mixing.mix(docs, epochs=1, weights=queries.MIX_WEIGHTS).where("copies > 0")
    # Rows of one id and leaf have one ticket, and are taken together.
    tree = {"domain": mixing.domain_of(F.col("source").cast("string"))}
    tree |= {c: F.coalesce(F.col(c).cast("string"), F.lit(mixing.NONE)) for c in ("lang", "source")}
    return _only(docs, taken, {"doc_id": F.col("doc_id").cast("long")} | tree).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("near-duplicates", unlike),
    ("repeated strings", unrepeated),
    ("mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None  # fitted scores and signatures cannot be written as SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
