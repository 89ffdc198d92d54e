"""Corpus pipeline: toxicity, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept; its result is written as Parquet and read again for the next.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table, written
from weftline.llm.jaccard_join import near_duplicates
from weftline.llm.packing import pack_documents
from weftline.llm.quality_rules import quality_cascade
from weftline.llm.toxicity import fit, score_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below their language's threshold; the classifier learns from every label of the documents given."""
    model = fit(docs, table(spark, sf_dir, "labels"), True)
    return score_texts(docs, model).filter("not toxic").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_cascade(docs).filter("kept").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of its smallest id; rows without an id are all kept.

    A row's key is its id and a hash of the rest: of rows under one id only those go whose text is a near duplicate.
    """
    rest = F.xxhash64(*[c for c in COLUMNS if c != "doc_id"])
    kind = f"struct<absent:boolean,doc_id:{docs.schema['doc_id'].dataType.simpleString()},rest:bigint>"
    keyed = docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", rest.alias("rest")).cast(kind))
    found = near_duplicates(keyed.select("key", "text"), "key")
    best = found.filter("key = component_id and not key.absent").select("key").distinct()
    kept = keyed.join(best, "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    out = pack_documents(docs)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_duplicate", near_duplicate), ("packing", packing)]

#: A trained classifier and a packing plan have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
