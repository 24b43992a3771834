"""Materialized views: results kept as tables, kept up to date batch by batch, and used in place of their query.

A view of an aggregation stores mergeable state, one row for each group and batch; reading
merges it, so a new batch is only appended. Counts, sums, minima and maxima merge as they
are, an average as sum and count, an estimated distinct count as a HyperLogLog sketch and
percentiles of an approximate engine as KLL sketches. Views whose aggregates don't merge
are refreshed as a whole.

The registry lies in the store as one small file a view, so that a new session knows the
views of an earlier one. A batch has a name and is a folder of its own: written again, as
after a retry, it takes its own place.

A view stands in for a query only if both cover the same absolute time bounds and its
sources are those it was made from; ranges relative to now never match.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.aggregates import percentile_of
from brindle.plans.shared import list_path, read_text, remove_path, work_path, write_text
from brindle.plans.syntax import Agg, QueryError, Stage, parse

_LG, _K = 12, 400


@dataclass
class View:
    name: str
    path: str
    text: str
    columns: list[str]  # as stored
    retention: int | None = None
    partition_by: list[str] | None = None
    state: list[list] | None = None  # of a mergeable aggregation: [alias, aggregate, share of a percentile, state columns]
    keys: list[str] = field(default_factory=list)
    shown: list[str] = field(default_factory=list)
    bounds: list[str | None] | None = None  # None: relative to the time of the query
    stamp: str | None = None  # of the sources it was made from; None once it holds more than those
    data: str = "data"
    created: str = ""

    @property
    def stages(self) -> list[Stage]:
        return parse(self.text).stages


def _signature(stages: list[Stage]) -> str:
    return " | ".join(" ".join(s.text.split()) for s in stages)


#: How each state merges (fixed values).
MERGE: dict[str, list[Callable]] = {
    "count": [F.sum], "sum": [F.sum], "min": [F.min], "max": [F.max], "avg": [F.sum, F.sum], "sumsq": [F.sum], "range": [F.min, F.max],
    "estdc": [F.hll_union_agg], "percentile": [F.kll_merge_agg_double],
}


def kind_of(a: Agg, scope) -> tuple[str, float | None] | None:
    """(kind of state, share of a percentile) of an aggregate; None if it doesn't merge."""
    share = percentile_of(a, scope)
    if share is not None:
        return ("percentile", share) if scope.approximate else None
    if a.name == "dc" and scope.approximate:
        return "estdc", None
    return (a.name, None) if a.name in MERGE else None


def state_columns(kind: str, final: Column, number: Column | None, value: Column | None) -> list[Column]:
    """The state of one aggregate over the rows of a batch."""
    if kind == "avg":
        return [F.sum(number), F.count(number)]
    if kind == "range":
        return [F.min(number), F.max(number)]
    if kind == "estdc":
        return [F.hll_sketch_agg(value, F.lit(_LG))]
    if kind == "percentile":
        return [F.kll_sketch_agg_double(number, F.lit(_K))]
    return [final]


def finished(kind: str, share: float | None, parts: list[Column]) -> Column:
    if kind == "avg":
        return parts[0] / F.nullif(parts[1], F.lit(0))
    if kind == "range":
        return parts[1] - parts[0]
    if kind == "estdc":
        return F.coalesce(F.hll_sketch_estimate(parts[0]), F.lit(0).cast("bigint"))
    if kind == "percentile":
        return F.when(F.kll_sketch_get_n_double(parts[0]) > 0, F.kll_sketch_get_quantile_double(parts[0], F.lit(share)))
    return parts[0]


class Views:
    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark, self.store = spark, store.rstrip("/") if store else None
        self.known: dict[str, View] = {}
        if self.store:
            for file in list_path(spark, f"{self.store}/registry"):
                v = View(**json.loads(read_text(spark, file)))
                self.known[v.name] = v

    def has(self, name: str) -> bool:
        return name in self.known

    def list(self) -> list[dict]:
        return [{"name": v.name, "query": v.text, "retention": v.retention, "partition_by": v.partition_by, "mergeable": v.state is not None, "created": v.created} for v in self.known.values()]

    def _file(self, name: str) -> str:
        return f"{self.store}/registry/{quote(name, safe='')}.json"

    def _keep(self, v: View) -> None:
        self.known[v.name] = v
        write_text(self.spark, self._file(v.name), json.dumps(asdict(v)))

    def create(self, name: str, stages: list[Stage], df: DataFrame, shown: list[str], state=None, keys=(), partition_by=None, retention: int | None = None, bounds=None, stamp: str | None = None) -> View:
        """df: what a batch stores, that is keys and state columns of a mergeable aggregation, else the result."""
        if not self.store:
            self.store = work_path(self.spark, "views")
        path = f"{self.store}/{quote(name, safe='')}"
        v = View(name, path, _signature(stages), df.columns, int(retention) if retention else None, list(partition_by) if partition_by else None, state, list(keys), list(shown), bounds, stamp, created=dt.datetime.now(dt.UTC).isoformat())
        self._replace(v, df)
        return v

    def _write(self, v: View, df: DataFrame, folder: str, batch: str) -> None:
        # column names such as count() aren't valid everywhere: kept under numbers, their names in the registry
        named = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
        w = named.write.mode("overwrite")
        if v.partition_by:
            w = w.partitionBy(*(f"c{v.columns.index(c)}" for c in v.partition_by))
        w.parquet(f"{v.path}/{folder}/batch={quote(batch, safe='')}")

    def _replace(self, v: View, df: DataFrame) -> None:
        """All data of a view anew: written beside the old, then the registry points to it."""
        import uuid

        old, folder = v.data, f"data-{uuid.uuid4().hex}"
        self._write(v, df, folder, "base")
        v.data = folder
        self._keep(v)
        remove_path(self.spark, f"{v.path}/{old}")

    def _stored(self, v: View) -> DataFrame:
        df = self.spark.read.option("basePath", f"{v.path}/{v.data}").parquet(f"{v.path}/{v.data}")
        df = df.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(v.columns)))
        return df if not v.retention or "_time" not in v.columns else df.filter(self._fresh(v))

    def _fresh(self, v: View) -> Column:
        return F.col("_time").isNull() | (F.col("_time") >= F.lit(dt.datetime.now(dt.UTC) - dt.timedelta(microseconds=int(v.retention))))

    def _merged(self, v: View, keys: list[str], wanted: list[list], names: list[str]) -> DataFrame:
        """Groups of keys with the aggregates of wanted (entries of v.state) under names."""
        df = self._stored(v)
        parts = {c: how(F.col(f"`{c}`")) for _, kind, _, columns in wanted for c, how in zip(columns, MERGE[kind])}
        grouped = df.groupBy(*(F.col(f"`{k}`") for k in keys)) if keys else df.groupBy()
        merged = grouped.agg(*(c.alias(n) for n, c in parts.items()))
        return merged.select(*(F.col(f"`{k}`") for k in keys), *(finished(kind, share, [F.col(f"`{c}`") for c in columns]).alias(n) for n, (_, kind, share, columns) in zip(names, wanted)))

    def read(self, name: str) -> DataFrame:
        v = self._get(name)
        if v.state is None:
            return self._stored(v)
        return self._merged(v, v.keys, v.state, [a for a, *_ in v.state]).select(*(F.col(f"`{c}`") for c in v.shown))

    def append(self, name: str, df: DataFrame, batch: str) -> None:
        """A batch of the columns that the view stores. The same batch again replaces itself."""
        v = self._get(name)
        if v.state is None and any(s.name in ("stats", "every", "count", "rate") for s in v.stages):
            raise QueryError(f"view {name} holds aggregates that don't merge: refresh it")
        self._write(v, df.select(*(F.col(f"`{c}`") for c in v.columns)), v.data, batch)
        if v.stamp is not None:
            v.stamp = None
            self._keep(v)

    def refresh(self, name: str, df: DataFrame, stamp: str | None = None) -> None:
        v = self._get(name)
        v.stamp = stamp
        self._replace(v, df)

    def alter(self, name: str, retention: int | None = None, partition_by: list[str] | None = None) -> None:
        """Change what is kept (microseconds) or how it lies."""
        v = self._get(name)
        df = self._stored(v)
        v.retention, v.partition_by = int(retention) if retention else v.retention, partition_by or v.partition_by
        self._replace(v, df)

    def expire(self, name: str) -> None:
        """Delete the rows that are older than the view's retention."""
        v = self._get(name)
        if v.retention:
            self._replace(v, self._stored(v))

    def delete(self, name: str) -> None:
        remove_path(self.spark, self._get(name).path)
        remove_path(self.spark, self._file(name))
        del self.known[name]

    def _get(self, name: str) -> View:
        if name not in self.known:
            raise QueryError(f"there is no view {name}")
        return self.known[name]

    def rewrite(self, stages: list[Stage], bounds: list[str | None] | None, stamp: Callable[[], str | None]) -> tuple[DataFrame, tuple[str, ...], int] | None:
        """A view that answers the first stages of a query: the same ones exactly, or an aggregation by fewer of its keys."""
        for v in self.known.values():
            if v.state is None or v.retention or bounds is None or v.bounds != bounds or v.stamp is None:
                continue
            own = v.stages
            n = len(own)
            if len(stages) < n or _signature(stages[: n - 1]) != _signature(own[: n - 1]) or stages[n - 1].name != "stats":
                continue
            have, want = own[-1].args, stages[n - 1].args
            keys = [name for _, name in want["by"]]
            if any((e, k) not in have["by"] for e, k in want["by"]):
                continue
            kept = {(a.name, repr(a.args), repr(a.where)): s for a, s in zip(have["aggs"], v.state)}
            found = [kept.get((a.name, repr(a.args), repr(a.where))) for a in want["aggs"]]
            if any(s is None for s in found) or v.stamp != stamp():
                continue
            shown = ["_time" if k.startswith("bin(_time") else k for k in keys]
            return self._merged(v, shown, found, [a.alias for a in want["aggs"]]), tuple(shown), n
        return None
