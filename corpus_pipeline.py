"""Documents to packed training sequences, stage by stage.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of `docs` as they are, whatever else there may be. Rows
that repeat are judged each time, nulls in other columns pass through, and no documents
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import Saved, prepared, table
from quern.llm.decontaminate import without_leaks
from quern.llm.packing import pack
from quern.llm.quality import without_poor
from quern.llm.simhash import without_near_duplicates
from quern.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes as toxic go. Null and wordless texts get
    the chain's prior; without labels of given documents all stay."""
    return without_toxic(docs, table(prepared(spark), sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go. Null texts count as empty, null
    page columns as a value of their own; without labels of given documents all stay."""
    return without_poor(docs, table(prepared(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, of
    equal ids that with the smallest text hash. Null, empty and blank texts are one group."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go. Null and empty texts stay."""
    return without_leaks(docs, table(prepared(spark), sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token ids: each piece with the sequence and the offset it goes to.
    Null and empty texts are the end id alone."""
    packed = pack(docs)
    return packed.pieces.join(packed.places, "piece_id").select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no counterpart of the classifiers, the fingerprints' graph and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on all documents, each result written and read again."""
    docs = table(prepared(spark), sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        after = Saved(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = after.df, after
    return docs
