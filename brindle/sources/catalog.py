"""Named sources: DataFrames in one shape, found by name, glob and exclusion."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.syntax import QueryError, closest

META = ("_time", "_raw", "_source", "_sourcetype", "host", "index")


def normalised(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, others as double, dates and zoneless times as timestamps."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("timestamp")
        elif isinstance(f.dataType, T.BinaryType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.IntegerType)):
            c = c.cast("array<double>" if isinstance(f.dataType.elementType, T.FloatType) else "array<bigint>")
        cols.append(c.alias(f.name))
    return df.select(*cols)


@dataclass
class Source:
    df: DataFrame
    order: tuple[str, ...] = ()
    json: bool = False
    given: DataFrame | None = None  # as registered


@dataclass
class Catalog:
    spark: SparkSession
    sources: dict[str, Source] = field(default_factory=dict)
    pending: dict[str, tuple] = field(default_factory=dict)

    def add_lazily(self, name: str, load: Callable[[], DataFrame], **options) -> None:
        """Register a source that is opened when a query first names it."""
        self.pending[name] = (load, options)

    def names(self) -> list[str]:
        return sorted({*self.sources, *self.pending})

    def open(self, name: str) -> Source:
        if name in self.pending:
            load, options = self.pending.pop(name)
            self.add(name, load(), **options)
        return self.sources[name]

    def add(self, name: str, df: DataFrame, time: str | None = None, raw: str | None = None, order: tuple[str, ...] = (), json: bool = False, source: str | None = None) -> None:
        """Register a DataFrame. time and raw name the columns that become _time and _raw; order the columns that settle
        the rows' order after _time; with json unknown names are looked up in _raw."""
        given = df
        df = normalised(df)
        for new, old in (("_time", time), ("_raw", raw), ("_source", source)):
            if old and new not in df.columns:
                df = df.withColumn(new, F.col(f"`{old}`"))
        if "_time" in df.columns and not isinstance(df.schema["_time"].dataType, T.TimestampType):
            df = df.withColumn("_time", F.col("_time").try_cast("timestamp"))
        self.sources[name] = Source(df, tuple(order), json, given)

    def resolve(self, names: list[str]) -> Source:
        """A list of names, globs and !exclusions as one source; several are united by name."""
        gone = [n[1:] for n in names if n.startswith("!")]
        picked: list[str] = []
        for n in names:
            if n.startswith("!"):
                continue
            if re.search(r"[*?\[{]", n):
                hits = [k for k in self.names() if any(fnmatch.fnmatchcase(k, p) for p in braces(n))]
            elif n in self.sources or n in self.pending:
                hits = [n]
            else:
                raise QueryError(f"there is no source {n}", hint=closest(n, self.names()))
            picked += [h for h in hits if h not in picked and not any(fnmatch.fnmatchcase(h, p) for g in gone for p in braces(g))]
        if not picked:
            raise QueryError(f"no source matches {', '.join(names)}")
        if len(picked) == 1:
            return self.open(picked[0])
        parts = [self.open(p) for p in picked]
        frames = [s.df if "_source" in s.df.columns else s.df.withColumn("_source", F.lit(p)) for p, s in zip(picked, parts)]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        order = tuple(dict.fromkeys(c for s in parts for c in s.order))
        return Source(out, order, any(s.json for s in parts))


def braces(pattern: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", pattern)
    return [p for a in m[1].split(",") for p in braces(pattern[: m.start()] + a + pattern[m.end() :])] if m else [pattern]
