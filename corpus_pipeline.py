"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiograph.llm import decontamination, language, near_duplicates, packing, secrets
from radiograph.llm.common import bounded, written
from radiograph.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Logical nodes under which each row of a file gives at most one row.
_ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias", "LogicalRelation")


def _is_scan(plan) -> bool:
    children = plan.children()
    return plan.nodeName() in _ROW_BY_ROW and all(_is_scan(children.apply(i)) for i in range(children.size()))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: a null or repeated doc_id names no row.

    A row of a scan is named by its file's number and its place there, which every scan gives alike, so that the documents
    needn't be written again; rows of any other plan (a union, a join, rows made of others) are written with a running
    number. Spark's driver holds the names of a scan's files in any case.
    """
    if not docs.inputFiles() or not _is_scan(docs._jdf.queryExecution().analyzed()):
        return written(docs.select(*COLUMNS).withColumn("key", F.monotonically_increasing_id()), "keyed")
    files = sorted(r["file"] for r in docs.select(F.col("_metadata.file_path").alias("file")).distinct().collect())  # one row for each file
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    key = F.call_function("shiftleft", F.col("number"), F.lit(40)) + F.col("place")
    return placed.join(bounded(numbers), "file").select(*COLUMNS, key.alias("key"))


def _without(docs: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    """The rows of keyed docs whose key is not among keys."""
    return docs.join(bounded(written(keys, tag)), "key", "left_anti").select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; null and empty texts and those without letters go.

    A null doc_id or lang is no reason to go; repeated rows share their fate; extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    return language.with_language(docs).where("lang_pred <> 'und'").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, null last.

    Rows are told apart by a key of their own, so repeated rows and null ids count like any other copies; null and empty
    texts belong to no group and stay.
    """
    docs = _keyed(docs)
    groups = near_duplicates.near_duplicates(docs.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    groups = written(groups, "groups")
    shared = bounded(written(groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "shared"))
    members = bounded(written(groups.join(shared, "component_id"), "members"))
    members = written(docs.select("key", "doc_id").join(members, "key"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
    return _without(docs, members.select("key").join(bounded(written(first.select("key"), "first")), "key", "left_anti"), "gone")


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no passage with a benchmark item, by a key of each row, so null and repeated ids escape nothing.

    Null and empty texts, and null benchmark items, share nothing.
    """
    docs = _keyed(docs)
    hit = decontamination.contaminated(docs.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("key")).distinct()
    return _without(docs, hit, "hit")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mask; n_chars follows a text that changed.

    Null texts stay null; repeated rows and null ids are masked like any other.
    """
    return secrets.without_secrets(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequence and offset; null and empty texts are one token, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_benchmark_text),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: No stage but decontamination can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_chars", F.col("n_chars").cast("long"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
