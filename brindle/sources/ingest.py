"""Stages that rows pass on their way in: fields from their text, one UTC time, an index by rules.

Each takes and gives a DataFrame of rows with _raw and composes with the others; nothing is
read twice. Defined results: a text without such fields gives nulls; a field that is there
already keeps its value; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import formats as fm
from brindle.operators import instants


def with_json(df: DataFrame, paths: dict[str, str], text: str = "_raw") -> DataFrame:
    """Chosen fields of JSON texts only: name to path, such as {"user": "$.ctx.user"}."""
    return _added(df, {n: F.get_json_object(F.col(text), p) for n, p in paths.items()})


def with_pairs(df: DataFrame, into: str = "fields", separator: str | None = None, assign: str = "=", text: str = "_raw") -> DataFrame:
    """key=value pairs as one map column, so that keys need not be known."""
    return _added(df, {into: fm.pairs(F.col(text), separator, assign)})


def with_format(df: DataFrame, name: str, text: str = "_raw") -> DataFrame:
    """The fields of a fixed format (syslog, combined, ...)."""
    taken = df.withColumn("__m", fm.taken_apart(F.col(text), fm.FIXED[name][0]))
    _, found = fm.fixed(name, F.col("__m"))
    return _added(taken, found).drop("__m")


def with_time(df: DataFrame, stamp: Column, zone: Column | None = None, received_at: Column | None = None, order: Column | None = None) -> DataFrame:
    """_time from a timestamp text of any known layout, in the zone given where it states none."""
    none = F.lit(None).cast("string")
    timed = instants.with_instant(df, stamp, zone if zone is not None else none, order if order is not None else none, received_at if received_at is not None else F.current_timestamp(), "__utc")
    time = F.timestamp_micros("__utc")
    return timed.withColumn("_time", F.coalesce("_time", time) if "_time" in df.columns else time).drop("__utc")


def routed(df: DataFrame, rules: list[tuple[Column, str]], default: str = "main") -> DataFrame:
    """index by the first rule that holds."""
    out = F.lit(default)
    for test, index in reversed(rules):
        out = F.when(test, F.lit(index)).otherwise(out)
    return df.withColumn("index", out)


def _added(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(f"`{n}`"), c.cast(df.schema[n].dataType)) if n in df.columns else c for n, c in found.items()})
