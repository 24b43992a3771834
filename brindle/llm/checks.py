"""Invariants of plans and units that SQL can state: nothing overfull, no cap passed, every text cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import mixing, packing, sentences
from brindle.llm.tokens import sized
from brindle.plans.shared import read_table


def p7_overfull(spark: SparkSession, d: str) -> DataFrame:
    """pack_id, documents packed, containers above the capacity, texts split though they would fit."""
    targets = read_table(spark, d, "pack_targets")
    packs = packing.packed(spark, read_table(spark, d, "documents"), targets)
    bins = packs.groupBy("pack_id", "container").agg(F.sum("tokens").alias("n")).join(targets, "pack_id").groupBy("pack_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"))
    texts = packs.groupBy("pack_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).join(targets, "pack_id")
    of = texts.groupBy("pack_id").agg(F.count("*").alias("n_documents"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_split"))
    return of.join(bins, "pack_id").select("pack_id", "n_documents", "n_overfull", "n_split")


def p7_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """pack_id and how many items share a container with a copy of their text."""
    docs, targets = read_table(spark, d, "documents"), read_table(spark, d, "pack_targets")
    return packing.fill_report(packing.packed(spark, docs, targets), targets, docs).select("pack_id", "same_text")


def p8_caps(spark: SparkSession, d: str) -> DataFrame:
    """mix_id, its sources, and how many were used more often than allowed."""
    report = mixing.share_report(*mixing.mixed(spark, read_table(spark, d, "documents"), read_table(spark, d, "mix_targets")))
    return report.groupBy("mix_id").agg(F.count("*").alias("n_sources"), F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("n_over"))


def p8_reached(spark: SparkSession, d: str) -> DataFrame:
    """mix_id, its sources, and those that are used up or miss their share by less than a thousandth and one document (none is split)."""
    docs = read_table(spark, d, "documents")
    report = mixing.share_report(*mixing.mixed(spark, docs, read_table(spark, d, "mix_targets")))
    largest = sized(docs).groupBy("source").agg(F.max("tokens").alias("largest"))
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    spent = F.col("tokens") == F.col("tokens_available") * F.col("max_repeats")
    near = F.col("tokens") + F.coalesce("largest", F.lit(0)) >= (F.col("target_share") - 0.001) * whole
    return report.join(largest, "source", "left").select("mix_id", (spent | near).alias("ok")).groupBy("mix_id").agg(F.count("*").alias("n_sources"), F.count_if("ok").alias("n_reached"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents with units, and those whose units leave out a letter or digit."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", "text")
    units = sentences.sentence_units(docs)
    cut = units.join(docs, "doc_id").select("doc_id", "source", F.length(F.regexp_replace(F.expr("substring(text, cast(start_char as int) + 1, cast(end_char - start_char as int))"), r"[^\p{L}\p{N}]", "")).alias("n"))
    whole = docs.select("doc_id", F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).alias("all"))
    return cut.groupBy("doc_id", "source").agg(F.sum("n").alias("n")).join(whole, "doc_id").groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("n") != F.col("all")).alias("n_torn"))


QUERIES = {f.__name__: f for f in (p7_overfull, p7_conflicts, p8_caps, p8_reached, p9_documents)}
ORACLES = {
    "p7_overfull": "SELECT pack_id, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0 AS n_overfull, 0 AS n_split FROM pack_targets",
    "p7_conflicts": "SELECT pack_id, 0 AS same_text FROM pack_targets",
    "p8_caps": "SELECT mix_id, count(*) AS n_sources, 0 AS n_over FROM mix_targets GROUP BY 1",
    "p8_reached": "SELECT mix_id, count(*) AS n_sources, count(*) AS n_reached FROM mix_targets GROUP BY 1",
    "p9_documents": "SELECT source, count(*) AS n_documents, 0 AS n_torn FROM documents WHERE regexp_matches(text, '\\S') GROUP BY 1",
}
