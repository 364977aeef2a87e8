"""From raw documents to packed windows: four stages, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and works
on every row that its predecessor kept.  All but the last return the columns of
``documents``: the quality rules drop documents and boilerplate lines, SimHash keeps
one document of each group, the repeat index cuts repeated passages out, and packing
returns a row per piece.

Null and empty texts fail the quality rules, as do all of fewer than fifty words; very long
texts stay whole in every stage; of equal rows one stays; an empty table gives no pieces;
further columns are carried along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import packing, quality, repeats, simhash
from kpiforge.llm.common import written
from kpiforge.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their boilerplate lines."""
    return quality.kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_per_group(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the bytes of repeated 200-byte strings."""
    # the row is one column, so no name of its columns meets one of the operator's
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    cut = repeats.without_repeats(whole, keep=["row"])
    changed = F.col("n_removed") > 0
    return cut.select(*[
        F.col("kept_text").alias(c) if c == "text"
        else F.when(changed, F.length("kept_text").cast(kind)).otherwise(F.col("row")[c]).alias(c) if c == "n_chars"
        else F.col("row")[c].alias(c) for c, kind in docs.dtypes])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed window."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", pack_windows),
]

#: Fingerprints and tokenizers are outside SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
