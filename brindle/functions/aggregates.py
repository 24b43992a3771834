"""Aggregates and window functions of stats, eventstats and streamstats as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.scalar import text
from brindle.plans.binding import Scope, Typed, bind, kind, null, predicate
from brindle.plans.syntax import Agg, QueryError, closest

WINDOW_ONLY = ("lag", "lead", "row_number", "running_sum", "moving_avg")
_PERCENTILES = {f"{p}{n}": n / 100 for p in ("p", "perc") for n in (25, 50, 75, 90, 95, 99)}
_SIMPLE = {"avg": F.avg, "stdev": F.stddev_samp, "var": F.var_samp, "stdevp": F.stddev_pop, "varp": F.var_pop}
_RATES = {"per_minute": 60, "per_hour": 3600, "per_day": 86400}
NAMES = (
    "count sum avg min max dc estdc perc stdev var mode first last earliest latest values list rate per_second range sumsq "
    "earliest_time latest_time estdc_error".split() + list(_PERCENTILES) + list(_SIMPLE) + list(_RATES)
)


#: Accuracy of approximate percentiles: ranks are right to 1 / PERCENTILE_ACCURACY of the rows.
PERCENTILE_ACCURACY = 10_000


def percentile_of(agg: Agg, scope: Scope) -> float | None:
    """The share that a percentile aggregate asks for; None if it is another aggregate."""
    if agg.name in _PERCENTILES and agg.args:
        return _PERCENTILES[agg.name]
    if agg.name == "perc" and len(agg.args) > 1:
        p = bind(agg.args[1], scope).value
        return p / 100 if isinstance(p, (int, float)) and 0 <= p <= 100 else None
    return None


def numbers(agg: Agg, scope: Scope) -> Column:
    x = bind(agg.args[0], scope)
    c = x.col.try_cast("double") if x.kind == "string" else x.col.cast("double") if x.kind in ("int", "float", "bool") else F.try_variant_get(x.col, "$", "double") if x.kind == "any" else F.lit(None).cast("double")
    return F.when(predicate(agg.where, scope), c) if agg.where is not None else c


def percentiles_of(aggs: list[Agg], scope: Scope) -> Column:
    """Percentiles of one value and condition as one array, in order of aggs."""
    shares = F.array(*(F.lit(percentile_of(a, scope)) for a in aggs))
    x = numbers(aggs[0], scope)
    return F.percentile_approx(x, shares, PERCENTILE_ACCURACY) if scope.approximate else F.percentile(x, shares)


def build(agg: Agg, scope: Scope, order: Column, span_seconds: float | None = None) -> Column:
    """An aggregate as a column. order: the rows' order, as one comparable value."""
    name = agg.name
    if name not in NAMES:
        raise QueryError(f"{name} isn't an aggregate", hint="use streamstats" if name in WINDOW_ONLY else closest(name, NAMES))
    where = predicate(agg.where, scope) if agg.where is not None else None
    x = bind(agg.args[0], scope) if agg.args else None
    if x is not None and x.kind == "null" and name != "count":
        x = Typed(F.lit(None).cast("double"), T.DoubleType())
    if x is None and name not in ("count", "rate"):
        raise QueryError(f"{name} needs an argument")

    def kept(c: Column) -> Column:
        return F.when(where, c) if where is not None else c

    def number() -> Column:
        if x.kind == "string":
            return kept(x.col.try_cast("double"))
        return kept(x.col.cast("double") if x.kind in ("int", "float", "bool") else F.try_variant_get(x.col, "$", "double") if x.kind == "any" else F.lit(None).cast("double"))

    if name == "count":
        return F.count(kept(x.col)) if x is not None else F.count(kept(F.lit(1)))
    if name == "rate":
        return F.count(kept(F.lit(1))) / F.lit(float(span_seconds or 1.0))
    if name in ("min", "max"):
        c = kept(text(x) if x.kind in ("any", "object") else x.col)
        return F.min(c) if name == "min" else F.max(c)
    if name == "sum":
        return F.sum(number())
    if name in _SIMPLE:
        return _SIMPLE[name](number())
    if name == "per_second":
        return F.sum(number()) / F.lit(float(span_seconds or 1.0))
    if name in _RATES:
        return F.sum(number()) / F.lit(float(span_seconds or 1.0)) * _RATES[name]
    if name == "sumsq":
        return F.sum(number() * number())
    if name == "range":
        return F.max(number()) - F.min(number())
    if name == "dc" and scope.approximate:
        return F.approx_count_distinct(kept(text(x)), 0.01)
    if name == "dc":
        return F.count_distinct(kept(text(x) if x.kind in ("any", "object") else x.col))
    if name == "estdc":
        return F.approx_count_distinct(kept(text(x)), 0.01)
    if name == "estdc_error":
        return F.lit(0.01)
    if name in _PERCENTILES or name == "perc":
        share = percentile_of(agg, scope)
        if share is None:
            raise QueryError("perc takes a number from 0 to 100")
        return F.percentile_approx(number(), share, PERCENTILE_ACCURACY) if scope.approximate else F.percentile(number(), F.lit(share))
    if name == "mode":
        return F.mode(kept(text(x)), deterministic=True)
    if name in ("first", "last", "earliest", "latest"):
        by = order if name in ("first", "last") else F.struct(F.col("_time"), order) if "_time" in scope.names else order
        usable = x.col.isNotNull() if where is None else x.col.isNotNull() & where
        if name in ("earliest", "latest") and "_time" in scope.names:
            usable = usable & F.col("_time").isNotNull()
        # a null ordering value is passed over, so rows that don't count have none
        value = F.when(usable, by)
        return (F.min_by if name in ("first", "earliest") else F.max_by)(x.col, value)
    if name in ("earliest_time", "latest_time"):
        return (F.min if name == "earliest_time" else F.max)(kept(F.when(x.col.isNotNull(), F.col("_time"))))
    item = F.struct(order.alias("o"), x.col.alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(x.col.isNotNull() if where is None else x.col.isNotNull() & where, item))), lambda s: s.x)
    return F.array_distinct(ordered) if name == "values" else ordered


def window_column(agg: Agg, scope: Scope, order: Column, plain_window, framed_window) -> Column:
    """An aggregate over running rows, or one of the functions that only windows have."""
    if agg.name not in WINDOW_ONLY:
        return windowed_aggregate(agg, scope, order, framed_window)
    where = predicate(agg.where, scope) if agg.where is not None else None
    x = bind(agg.args[0], scope) if agg.args else null()
    n = bind(agg.args[1], scope).value if len(agg.args) > 1 else 1
    c = F.when(where, x.col) if where is not None else x.col
    if agg.name == "row_number":
        return F.row_number().over(plain_window)
    if agg.name in ("lag", "lead"):
        return (F.lag if agg.name == "lag" else F.lead)(c, n).over(plain_window)
    from pyspark.sql import Window

    number = c.cast("double") if kind(x.type) in ("int", "float", "bool") else c.try_cast("double")
    if agg.name == "running_sum":
        return F.sum(number).over(plain_window.rowsBetween(Window.unboundedPreceding, 0))
    return F.avg(number).over(plain_window.rowsBetween(-(n - 1), 0))


def windowed_aggregate(agg: Agg, scope: Scope, order: Column, window) -> Column:
    """Aggregates of several Spark functions need each of them over the window."""
    where = predicate(agg.where, scope) if agg.where is not None else None
    x = bind(agg.args[0], scope) if agg.args else None
    keep = (lambda c: F.when(where, c)) if where is not None else (lambda c: c)
    if agg.name in ("first", "last", "earliest", "latest"):
        c = keep(x.col)
        return (F.first if agg.name in ("first", "earliest") else F.last)(c, ignorenulls=True).over(window)
    if agg.name == "dc":
        return F.size(F.collect_set(keep(text(x))).over(window)).cast("bigint")
    if agg.name in ("values", "list"):
        items = F.collect_list(keep(x.col)).over(window)
        return F.array_distinct(items) if agg.name == "values" else items
    if agg.name == "range":
        c = keep(x.col.cast("double"))
        return F.max(c).over(window) - F.min(c).over(window)
    if agg.name == "mode":
        counts = F.collect_list(keep(text(x))).over(window)
        return F.try_element_at(F.array_sort(F.transform(F.array_distinct(counts), lambda v: F.struct((-F.size(F.filter(counts, lambda u: u == v))).alias("n"), v.alias("v")))), F.lit(1)).getField("v")
    return build(agg, scope, order).over(window)
