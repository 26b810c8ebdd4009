"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's documents.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents:

1. language: documents whose language is undetermined go;
2. near_duplicates: one document of each group of near copies (five words, similarity 0.8 or more) stays;
3. decontaminate: documents that hold a benchmark item go;
4. mix: all stay, and the written files hold them in the order of the mix;
5. tokens: the whole texts as token files, in the files' order, and one row per document read back from them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.common import fresh_path, goes_at_exit, table, written
from folioweave.llm.decontaminate import without_leaks
from folioweave.llm.jaccard_join import one_of_each
from folioweave.llm.lang_id import train, with_language
from folioweave.llm.mixing import mixed
from folioweave.llm.token_files import read_token_files, write_token_files


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs, train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    try:  # the order in which the mix was written: by part, then by row
        docs, order = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("part"), F.col("_metadata.row_index").alias("row")), ["part", "row"]
    except AnalysisException:  # documents that aren't files have no such columns: by id
        order = None
    write_token_files(docs, path, order=order)
    goes_at_exit(spark, path)
    return read_token_files(spark, path)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
