"""Queries of the operators on text and source code, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import docpairs, leakage, provenance, reading, tokens, validity
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "nodes"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "nodes"))


def p1_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.source_pairs(table(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.flagged(table(spark, d, "sources"), table(spark, d, "files")).filter("bad").select("path").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.rates(table(spark, d, "sources"), table(spark, d, "files"))


def p5_causes(spark: SparkSession, d: str) -> DataFrame:
    return validity.unparsable(table(spark, d, "sources"), table(spark, d, "files")).groupBy("language", "cause").agg(F.count("*").alias("files"), F.sum("cost").alias("edits"), F.sum(F.col("exact").cast("int")).alias("exact_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.judged(table(spark, d, "sources")).select("path").distinct()


def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    return provenance.judged(table(spark, d, "sources")).groupBy("reason").agg(F.countDistinct("path").alias("files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.round_trip(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("most_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "graded_texts"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    levels = reading.levels(docs, table(spark, d, "graded_texts"))
    return docs.select("doc_id", "source").join(levels, "doc_id").groupBy("source", "band").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pairs, p1_source_pairs, p5_found, p5_rates, p5_causes, p7_found, p7_reasons, p8_ids, p8_round_trip, p9_found, p9_items, p10_found, p10_profile)
}

SQL: dict[str, str] = {}
