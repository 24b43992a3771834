"""Running computations over all rows in order, without one task that sees them all.

Rows are put into blocks that follow each other in the order: a minute of time each where
the order begins with _time, else ranges of the order, written once so that every use sees
the same blocks. Inside a block a window gives the running value, one row a block says
what came before it, and both are put together. Frames of n rows are cut out of blocks of
equal size, made from row numbers, with the n rows before each copied into it. Groups may
be run over in the same way, each by itself: then a block is one of its group, and a group
that holds a third of all rows is no task of its own. That costs a further aggregate, so
it is done where is_hot finds such a group in an input that is large.

Defined results: those of one window over all rows; rows of equal order follow each other
in any order; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.shared import work_path

#: Microseconds of a time block, and rows of a block of equal size.
SPAN, BLOCK_ROWS = 60_000_000, 100_000
BLOCK = "__block"
#: Size of an input from which its groups are looked at, and rows from which a group is hot.
HOT_BYTES, HOT_ROWS = 8 << 30, 10_000_000
_FIRST = Window.unboundedPreceding


def ranged(df: DataFrame, *by: Column) -> DataFrame:
    """df written once in ranges of an order, with the number of each row's range."""
    at = work_path(df.sparkSession, "ranges")
    df.repartitionByRange(*by).withColumn(BLOCK, F.spark_partition_id().cast("bigint")).write.parquet(at)
    return df.sparkSession.read.parquet(at)


def is_hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether a group of keys is too large for one task. Small inputs aren't looked at."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < HOT_BYTES:
        return False
    return not df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_ROWS).isEmpty()


def blocked(df: DataFrame, order: str, keys: list[str] = ()) -> DataFrame:
    """df with the block of each row; order is a column that compares rows. With keys each group has blocks of its own."""
    t = df.schema[order].dataType
    if isinstance(t, T.StructType) and t.names[:1] == ["_time"] and isinstance(t.fields[0].dataType, (T.TimestampType, T.TimestampNTZType)):
        time = F.unix_micros(F.col(order).getField("_time").cast("timestamp"))
        out = df.withColumn(BLOCK, F.coalesce(F.floor(time / SPAN), F.lit(-(2**62))))
    else:
        out = ranged(df, F.col(order))
    # equal structs have equal fields, nulls too
    return out.withColumn(BLOCK, F.struct(*(F.col(k) for k in keys), F.col(BLOCK).alias("__b"))) if keys else out


def inside(order: str | Column, low: int = _FIRST, high: int = 0):
    return Window.partitionBy(BLOCK).orderBy(order).rowsBetween(low, high)


def carried(df: DataFrame, state: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """df with columns name: what an aggregate of the blocks before a row's block (of its group) comes to. One row for each block is gathered."""
    t = df.schema[BLOCK].dataType
    groups = [F.col(BLOCK).getField(n) for n in t.names if n != "__b"] if isinstance(t, T.StructType) and "__b" in t.names else []
    before = Window.partitionBy(*groups).orderBy(BLOCK).rowsBetween(_FIRST, -1)
    blocks = df.groupBy(BLOCK).agg(*(c.alias(n) for n, (c, _) in state.items()))
    return df.join(blocks.select(BLOCK, *(how(F.col(n)).over(before).alias(n) for n, (_, how) in state.items())), BLOCK)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df, which has blocks, with the number of each row in the whole order (of its group), from 1."""
    df = carried(df, {"__before": (F.count("*"), F.sum)})
    return df.withColumn(name, F.row_number().over(Window.partitionBy(BLOCK).orderBy(order)) + F.coalesce("__before", F.lit(0).cast("bigint"))).drop("__before")


def framed(df: DataFrame, order: str, columns: dict[str, Column], before: int, after: int, keys: list[str] = ()) -> DataFrame:
    """df with window columns over piece(keys) that look at most before rows back and after rows ahead."""
    size = max(BLOCK_ROWS, before, after)
    df = numbered(blocked(df, order, keys), order, "__n").drop(BLOCK)
    home, at = F.floor((F.col("__n") - 1) / size), (F.col("__n") - 1) % size
    near = F.array_compact(F.array(home, F.when(at >= size - before, home + 1) if before else F.lit(None).cast("bigint"), F.when((at < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint")))
    copies = df.withColumn("__home", home).withColumn("__piece", F.explode(near))
    return copies.withColumns(columns).filter("__piece = __home").drop("__piece", "__home", "__n")


def piece(keys: list[str] = ()):
    """Order and pieces of framed windows."""
    return Window.partitionBy(*keys, "__piece").orderBy("__n")


class Running:
    """Cumulative aggregates as a local column, the state a block hands on, and both put together."""

    def __init__(self, order: str, current: bool):
        self.window = inside(order, _FIRST, 0 if current else -1)
        self.local: dict[str, Column] = {}
        self.state: dict[str, tuple[Column, Callable]] = {}
        self.out: dict[str, Column] = {}

    def _part(self, aggregate: Callable[[Column], Column], how: Callable, value: Column) -> tuple[Column, Column]:
        """(running value inside the block, value of the blocks before)."""
        n = len(self.state)
        self.local[f"__l{n}"] = aggregate(value).over(self.window)
        self.state[f"__c{n}"] = (aggregate(value), how)
        return F.col(f"__l{n}"), F.col(f"__c{n}")

    def count(self, value: Column) -> Column:
        a, b = self._part(F.count, F.sum, value)
        return F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint"))

    def sum(self, value: Column) -> Column:
        a, b = self._part(F.sum, F.sum, value)
        return F.coalesce(a + b, a, b)

    def extreme(self, value: Column, least: bool) -> Column:
        one = F.min if least else F.max
        a, b = self._part(one, one, value)
        return (F.least if least else F.greatest)(a, b)

    def first(self, value: Column, order: Column) -> Column:
        return self._edge(value, order, True)

    def last(self, value: Column, order: Column) -> Column:
        return self._edge(value, order, False)

    def _edge(self, value: Column, order: Column, first: bool) -> Column:
        n = len(self.state)
        one, pick = (F.first, F.min_by) if first else (F.last, F.max_by)
        self.local[f"__l{n}"] = one(value, ignorenulls=True).over(self.window)
        self.state[f"__c{n}"] = (pick(value, F.when(value.isNotNull(), order)), lambda c: one(c, ignorenulls=True))
        a, b = F.col(f"__l{n}"), F.col(f"__c{n}")
        return F.coalesce(b, a) if first else F.coalesce(a, b)

    def spread(self, value: Column, middle: Column, sample: bool) -> Column:
        """Variance; middle is any constant near the values, taken off so that squares don't swallow differences."""
        d = value - middle
        n, s, ss = self.count(d), self.sum(d), self.sum(d * d)
        least = 1 if sample else 0
        return F.when(n > least, F.greatest(ss - s * s / n, F.lit(0.0)) / (n - least))

    def applied(self, df: DataFrame) -> DataFrame:
        done = carried(df, self.state).withColumns(self.local)
        return done.withColumns(self.out).drop(*self.local, *self.state)


def quantiles(values: DataFrame, shares: list[float]) -> tuple[int, list[float | None]]:
    """(number of values, exact interpolated quantiles) of a column x of doubles without nulls.

    A sketch tells between which values a rank lies, and only what lies between them is
    looked at again, until so few values are left that they can be sorted on the driver.
    """
    n = values.count()
    if not n:
        return 0, [None] * len(shares)
    spots = [(n - 1) * s for s in shares]
    known = {k: _ranked(values, n, k) for k in sorted({k for h in spots for k in (int(h), min(int(h) + 1, n - 1))})}
    return n, [known[int(h)] + (known[min(int(h) + 1, n - 1)] - known[int(h)]) * (h - int(h)) if h > int(h) else known[int(h)] for h in spots]


#: Values that are sorted on the driver, and the sketch's share of wrong ranks.
FEW, SKETCH = 50_000, 10_000


def _ranked(values: DataFrame, n: int, k: int) -> float:
    """The value of rank k, from 0."""
    x, below, left, rest = F.col("x"), 0, n, values
    while left > FEW:
        near = [min(1.0, max(0.0, (k - below + d * left / SKETCH) / left)) for d in (-2, 2)]
        low, high = rest.agg(F.percentile_approx("x", near, SKETCH).alias("p")).first()["p"]
        under, upto_low, under_high, upto = rest.agg(*(F.count_if(c) for c in (x < low, x <= low, x < high, x <= high))).first()
        r = k - below
        if upto_low > r >= under:
            return low
        if upto > r >= under_high:
            return high
        # neither end lies between, so that each step leaves fewer
        if r < under:
            rest, left = rest.filter(x < low), under
        elif r < under_high:
            rest, below, left = rest.filter((x > low) & (x < high)), below + upto_low, under_high - upto_low
        else:
            rest, below, left = rest.filter(x > high), below + upto, left - upto
    return sorted(r["x"] for r in rest.collect())[k - below]
