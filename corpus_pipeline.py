"""A training-data pipeline of five of the corpus operators.

Stages take (spark, docs, sf_dir); each one's rows are written as Parquet and reread as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import quoted, settle, table
from vigilake.llm.op1_substring_dedup import remove_repeats
from vigilake.llm.op2_packing import pack
from vigilake.llm.op5_ngram_join import one_of_each
from vigilake.llm.op6_mixing import mix_documents
from vigilake.llm.op9_toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on docs and labels, rejects go. A null text is judged as empty; rows that repeat stay or go together."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, its smallest doc_id. Rows without doc_id or words stay; of equal rows one."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier go; texts that lose none stay as they are, a null text becomes empty.

    Earlier is a smaller doc_id (null last), then a digest of the text; of rows with equal texts one keeps its words.
    n_chars follows the text, other columns are kept whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, carry=tuple(others)) if others else remove_repeats(docs)
    text = F.col("kept_text")
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"carried.{quoted(c)}") for c in others}
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as the mix of sources takes them, words taken again follow once more. Documents of which nothing is taken go, those without words too.

    A null source is a source of its own; rows that repeat each hold their own words. n_chars follows the text.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives the end id alone. Rows that repeat or lack a doc_id are packed each for itself; pieces of one length are numbered in an
    order that reruns repeat.
    """
    return pack(docs, with_ids=False)


STAGES = [("toxicity", toxicity), ("ngram_join", near_copies), ("substring_dedup", repeated_passages), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the trained classifier, the pseudorandom mix or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
