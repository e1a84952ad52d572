"""Queries of the language-model problems, over whole tables and whole texts, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encoding, generated, mixing, subjects, syntax


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.pairs(table(spark, d, "parsed_files"), with_code=False).select("file_id", "qualified_name").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return syntax.pairs(table(spark, d, "parsed_files")).dropDuplicates(["file_id", "qualified_name", "line_start"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.answers(table(spark, d, "parsed_files")).where("not valid").select("file_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(table(spark, d, "parsed_files")).where("not valid").dropDuplicates(["file_id"])


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.answers(table(spark, d, "parsed_files")))


def _not_hand_written(spark: SparkSession, d: str) -> DataFrame:
    return generated.not_hand_written(table(spark, d, "parsed_files"), table(spark, d, "scan_config"), table(spark, d, "upstream_files"), table(spark, d, "symbols"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_hand_written(spark, d).select("file_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files by repository and by why they are not hand-written."""
    files = table(spark, d, "parsed_files").select("file_id", "repo_id").distinct()
    return files.join(_not_hand_written(spark, d), "file_id").groupBy("repo_id", "reason").count().withColumnRenamed("count", "files")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def _sized_and_planned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return sized, mixing.plan(sized, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_sized_and_planned(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, planned = _sized_and_planned(spark, d)
    return mixing.shares(mixing.mix(sized, planned), planned)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(*(table(spark, d, t) for t in ("documents", "subject_labels", "subject_areas")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p9_makeup(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the sum of their shares by subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.sum("share"), 3).alias("share_sum"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p4_found, p4_report, p4_rates, p5_found, p5_reasons, p7_ids, p8_mix, p8_shares, p9_found, p9_makeup)}
SQL: dict[str, str] = {}
