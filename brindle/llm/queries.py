"""Queries of the problems of language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import checks, distinct, mixing, packing, sentences
from brindle.plans.shared import read_table

_KEYS = ["day", "source", "index_name"]
_SETS = [["day"], ["source"], ["index_name"], ["day", "source"], ["day", "index_name"], ["source", "index_name"], _KEYS, []]


def _host_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "ingest_events").select(F.to_date("received_at").alias("day"), "source", F.coalesce("index_name", F.lit("main")).alias("index_name"), "host")
    return distinct.cells(rows, _KEYS, F.col("host"))


def p3_hosts(spark: SparkSession, d: str) -> DataFrame:
    return distinct.estimates(_host_cells(spark, d), _KEYS, _SETS)


def p3_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The stored partial results: one sketch for each day, source and index."""
    return distinct.sketches(_host_cells(spark, d), _KEYS)


def p3_from_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hosts per day, put together from stored sketches."""
    return distinct.estimates(distinct.merged_cells(p3_sketches(spark, d), ["day"]), ["day"], [["day"]])


def p3_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """For each of the eight groupings the number of its groups, and how many estimates lie within five standard errors (at least 2) of the exact count."""
    rows = read_table(spark, d, "ingest_events").select(F.to_date("received_at").alias("day"), "source", F.coalesce("index_name", F.lit("main")).alias("index_name"), F.lower(F.trim("host")).alias("host")).filter("host <> ''")
    number = {tuple(s): sum(1 << (2 - _KEYS.index(k)) for k in s) for s in _SETS}
    exact = None
    for keys, n in number.items():
        part = rows.groupBy(*keys).agg(F.countDistinct("host").alias("n")).select(*(F.col(k) if k in keys else F.lit(None).cast("date" if k == "day" else "string").alias(k) for k in _KEYS), F.lit(n).alias("grouping"), "n")
        exact = part if exact is None else exact.unionByName(part)
    estimated = p3_hosts(spark, d).select(*(F.col(k).alias(f"e_{k}") for k in _KEYS), F.col("grouping").alias("e_grouping"), "estimate")
    on = exact["grouping"] == estimated["e_grouping"]
    for k in _KEYS:
        on = on & exact[k].eqNullSafe(estimated[f"e_{k}"])
    near = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(5 * distinct.ERROR * F.col("n"), F.lit(2))
    return exact.join(estimated, on, "left").groupBy("grouping").agg(F.count("*").alias("n_groups"), F.count_if(near).alias("n_within"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(spark, read_table(spark, d, "documents"), read_table(spark, d, "pack_targets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, and how many items share one with their source or with a copy of their text."""
    return packing.fill_report(p7_containers(spark, d), read_table(spark, d, "pack_targets"), read_table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(spark, read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*mixing.mixed(spark, read_table(spark, d, "documents"), read_table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_hosts, p3_sketches, p3_from_sketches, p3_within_bound, p7_containers, p7_fill, p8_mix, p8_shares, p9_found)} | checks.QUERIES
_DAY, _INDEX = "CAST(received_at AT TIME ZONE 'UTC' AS DATE)", "coalesce(index_name, 'main')"
_NAMED = {"day": _DAY, "source": "source", "index_name": _INDEX}
ORACLES = checks.ORACLES | {
    "p3_within_bound": " UNION ALL ".join(
        f"SELECT {sum(1 << (2 - _KEYS.index(k)) for k in s)} AS grouping, count(*) AS n_groups, count(*) AS n_within FROM (SELECT 1 FROM ingest_events WHERE trim(host) <> ''" + (f" GROUP BY {', '.join(_NAMED[k] for k in s)})" if s else " LIMIT 1)") for s in _SETS
    ),
}
