"""Readers of log files, each giving _raw and, where the format states them, _time and fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import runs

SAMPLE_LINES = 100
TIME_KEYS = ("_time", "timestamp", "@timestamp", "time", "ts")


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """_raw, _source and a row order (file, position) of each line that isn't empty."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    df = reader.text(path).select(F.regexp_replace("value", r"\r$", "").alias("_raw"), F.col("_metadata.file_path").alias("_source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return df.filter("_raw <> ''")


def detect_format(df: DataFrame) -> str:
    """The format of most of the first lines (a bounded sample): json, combined, syslog, logfmt, csv, tsv or text."""
    votes: dict[str, int] = {}
    for (line,) in df.select("_raw").limit(SAMPLE_LINES).collect():
        kind = (
            "docker" if re.match(r'\s*\{"log":', line) and '"stream":' in line else
            "json" if re.match(r"\s*\{.*\}\s*$", line) else
            "cef" if "CEF:" in line else "leef" if line.lstrip().startswith("LEEF:") else
            "w3c" if line.startswith("#Fields:") else
            "combined" if re.match(r'\S+ \S+ \S+ \[[^\]]+\] "', line) else
            "syslog" if re.match(r"<\d{1,3}>|[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d ", line) else
            "kv" if re.match(r"\w+[:=]\S+[,;]\s?\w+[:=]", line) else
            "logfmt" if len(re.findall(r'(?:^|\s)[\w.]+=(?:"|\S)', line)) >= 2 else
            "tsv" if line.count("\t") >= 2 else "csv" if line.count(",") >= 2 else "text"
        )
        votes[kind] = votes.get(kind, 0) + 1
    return max(sorted(votes), key=votes.get) if votes else "text"


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of JSON lines beside _raw; _time from the usual keys. Lines that aren't JSON keep only _raw."""
    lines = read_lines(spark, path)
    schema = spark.read.json(path).schema
    names = [f.name for f in schema.fields if f.name != "_corrupt_record"]
    out = lines.withColumn("__j", F.from_json("_raw", schema)).select("*", *(F.col(f"__j.`{n}`").alias(n) for n in names if n not in lines.columns)).drop("__j")
    keys = [k for k in TIME_KEYS if k in out.columns]
    return out.withColumn("_time", F.coalesce(*(F.col(f"`{k}`").cast("string").try_cast("timestamp") for k in keys))) if keys else out


def _placed(lines: DataFrame) -> DataFrame:
    """lines of read_lines with their block and their place in the order of files and lines."""
    at = lines.withColumn("__at", F.struct("_source", F.coalesce("_block", F.lit(0).cast("bigint")).alias("b"), "_line"))
    return at.withColumn(runs.BLOCK, F.struct("_source", F.col("__at.b").alias("b")))


def read_entries(spark: SparkSession, path: str, start: str, separator: str | None = None) -> DataFrame:
    """_raw, _source, _line of entries of several lines: a line that start (a regex) finds begins one, the others go on the one before; lines before a file's first one are an entry too."""
    lines = _placed(read_lines(spark, path, separator))
    r = runs.Running("__at", True)
    r.out = {"__n": r.sum(F.when(F.col("_raw").rlike(start), 1).otherwise(0))}
    counted = r.applied(lines)
    rows = F.array_sort(F.collect_list(F.struct("__at", "_raw")))
    return counted.groupBy("_source", "__n").agg(rows.alias("l")).select(F.array_join(F.transform("l", lambda x: x["_raw"]), "\n").alias("_raw"), "_source", F.col("l")[0]["__at"]["_line"].alias("_line"))


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Action and document lines in turn: documents with the index of the action line before them."""
    lines = _placed(read_lines(spark, path))
    action = F.regexp_extract("_raw", r'^\s*\{\s*"(?:index|create)"\s*:', 0) != ""
    r = runs.Running("__at", False)
    index = F.coalesce(F.get_json_object("_raw", "$.index._index"), F.get_json_object("_raw", "$.create._index"), F.lit("main"))
    r.out = {"index": r.last(F.when(action, index), F.col("__at"))}
    return r.applied(lines).filter(~action & F.col("index").isNotNull()).select("_raw", "index")


def read_collector(spark: SparkSession, path: str) -> DataFrame:
    """Collector events, one JSON object a line: event, time (seconds), host, source, sourcetype, index, fields."""
    j = lambda k: F.get_json_object("value", f"$.{k}")
    return spark.read.text(path).select(
        j("event").alias("_raw"), F.timestamp_micros((j("time").try_cast("double") * 1e6).cast("bigint")).alias("_time"), j("host").alias("host"), j("source").alias("_source"), j("sourcetype").alias("_sourcetype"), F.coalesce(j("index"), F.lit("main")).alias("index"), j("fields").alias("fields"),
    ).filter("_raw is not null")
