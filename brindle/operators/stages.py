"""The stages of the language, each a function from a Frame and its arguments to a Frame.

A Frame's rows have an order, kept in the hidden column __ord: one comparable value, made
from the source's ordering columns and replaced by sort. Stages that depend on order use
it; Spark itself orders nothing until then. Columns that begin with two underscores are
hidden and dropped from results.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import formats as fm
from brindle.functions.aggregates import build, numbers, percentile_of, percentiles_of, window_column
from brindle.functions.scalar import FUNCTIONS, bin_micros, text
from brindle.operators import runs
from brindle.plans.binding import Scope, Typed, bind, kind, predicate
from brindle.plans.syntax import Agg, QueryError

ORD = "__ord"
#: The #Fields: line that holds for a row, while w3c is parsed.
W3C = "__w3c"


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    now: dt.datetime
    json_from: str | None = None
    sorted_by: tuple[Column, ...] | None = None  # direct sort columns, valid until the columns change
    ordered: bool = False  # whether results must come out in order
    keys: tuple[str, ...] = ()  # group keys of the last aggregation
    approximate: bool = False  # percentiles and distinct counts by sketches of bounded size

    def scope(self) -> Scope:
        return Scope(self.df.schema, self.now, self.json_from, approximate=self.approximate)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def ord(self) -> Column:
        if ORD in self.df.columns:
            return F.col(ORD)
        return F.struct(*(F.col(f"`{c}`") for c in sorted(self.columns) if orderable(self.df.schema[c].dataType)))

    def to(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **({"sorted_by": None} | changes))

    def result(self) -> DataFrame:
        df = self.df
        if self.ordered:
            df = df.orderBy(*(self.sorted_by or (self.ord(),)))
        return df.select(*(F.col(f"`{c}`") for c in self.columns))


def orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(orderable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return orderable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


def q(name: str) -> Column:
    return F.col(f"`{name}`")


# projection and filters
def where(f: Frame, expr) -> Frame:
    return replace(f, df=f.df.filter(predicate(expr, f.scope())))


def extend(f: Frame, assign) -> Frame:
    for name, e in assign:
        t = bind(e, f.scope())
        f = f.to(f.df.withColumn(name, t.col if t.kind != "null" else F.lit(None).cast("string")))
    return f


def _match(patterns: list[str], names: list[str]) -> list[str]:
    out: list[str] = []
    for p in patterns:
        hits = [n for n in names if fnmatch.fnmatchcase(n, p)] if re.search(r"[*?\[]", p) else [p]
        out += [h for h in hits if h not in out]
    return out


def keep(f: Frame, fields: list[str], but: list[str] = ()) -> Frame:
    gone = set(_match(list(but), f.columns))
    chosen = [c for c in _match(fields, f.columns) if c not in gone]
    hidden = [q(c) for c in f.df.columns if c.startswith("__")]
    return f.to(f.df.select(*((q(c) if c in f.columns else F.lit(None).cast("string").alias(c)) for c in chosen), *hidden))


def drop(f: Frame, fields: list[str]) -> Frame:
    gone = set(_match(fields, f.columns))
    return f.to(f.df.select(*(q(c) for c in f.df.columns if c not in gone)))


def rename(f: Frame, pairs: list[tuple[str, str]]) -> Frame:
    for old, new in pairs:
        if old not in f.columns:
            f = f.to(f.df.withColumn(new, F.lit(None).cast("string")))
            continue
        f = f.to(f.df.select(*(q(c).alias(new) if c == old else q(c) for c in f.df.columns if c == old or c != new)))
    return f


# aggregation
def _keys(f: Frame, by) -> list[tuple[str, Column, int | None]]:
    """(name, column, span if it is a time bucket) of group keys; bin(_time, d) is called _time."""
    out = []
    for e, name in by:
        t = bind(e, f.scope())
        span = None
        if e[0] == "call" and e[1].lower() == "bin" and e[2][1][0] == "lit":
            span = int(e[2][1][1])
            name = "_time" if e[2][0] == ("name", "_time", False) and "(" in name else name
        out.append((name, t.col if t.kind != "null" else F.lit(None).cast("string"), span))
    return out


def stats(f: Frame, aggs: list[Agg], by=()) -> Frame:
    keys = _keys(f, by)
    span = next((s / 1e6 for _, _, s in keys if s), None)
    grouped = f.df.groupBy(*(c.alias(n) for n, c, _ in keys)) if keys else f.df.groupBy()
    # percentiles of one value share one aggregate: its values are held once
    shared: dict[str, list[Agg]] = {}
    for a in aggs:
        if percentile_of(a, f.scope()) is not None:
            shared.setdefault(repr((a.args[0], a.where)), []).append(a)
    arrays = {f"__pct{i}": members for i, members in enumerate(m for m in shared.values() if len(m) > 1)}
    at = {id(a): (name, j) for name, members in arrays.items() for j, a in enumerate(members)}
    cols = [build(a, f.scope(), f.ord(), span).alias(a.alias) for a in aggs if id(a) not in at]
    cols += [percentiles_of(members, f.scope()).alias(name) for name, members in arrays.items()]
    df = grouped.agg(*cols)
    if arrays:
        df = df.select(*(q(n) for n, _, _ in keys), *(F.col(at[id(a)][0])[at[id(a)][1]].alias(a.alias) if id(a) in at else q(a.alias) for a in aggs))
    return Frame(df, f.now, keys=tuple(n for n, _, _ in keys), approximate=f.approximate)


def partial(f: Frame, aggs: list[Agg], by=()) -> tuple[Frame, list[list]] | None:
    """(keys and mergeable state of a stats stage, what each state is); None if an aggregate doesn't merge."""
    from brindle.plans.views import kind_of, state_columns

    kinds = [kind_of(a, f.scope()) for a in aggs]
    if not aggs or any(k is None for k in kinds):
        return None
    cols, state = [], []
    for i, (a, (kind_, share)) in enumerate(zip(aggs, kinds)):
        test = predicate(a.where, f.scope()) if a.where is not None else None
        number = numbers(a, f.scope()) if a.args else None
        value = text(bind(a.args[0], f.scope())) if a.args else None
        made = state_columns(kind_, build(a, f.scope(), f.ord()), number, F.when(test, value) if test is not None else value)
        names = [f"{a.alias}#{i}.{j}" for j in range(len(made))]
        cols += [c.alias(n) for c, n in zip(made, names)]
        state.append([a.alias, kind_, share, names])
    keys = _keys(f, by)
    df = (f.df.groupBy(*(c.alias(n) for n, c, _ in keys)) if keys else f.df.groupBy()).agg(*cols)
    return Frame(df, f.now, keys=tuple(n for n, _, _ in keys), approximate=f.approximate), state


def _attach(f: Frame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of totals at every row of its group; no window, so that a group may be of any size."""
    if not keys:
        return f.df.join(F.broadcast(totals))  # one row
    right = totals.select(*(q(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(q(c) for c in totals.columns if c not in keys))
    on = None
    for i, k in enumerate(keys):
        test = q(k).eqNullSafe(q(f"__k{i}"))
        on = test if on is None else on & test
    return f.df.join(right, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def eventstats(f: Frame, aggs: list[Agg], by=()) -> Frame:
    made = [(n, c) for n, c, _ in _keys(f, by)]
    g = f
    names = []
    for i, (n, c) in enumerate(made):
        if n not in f.columns:
            n = f"__g{i}"
            g = replace(g, df=g.df.withColumn(n, c))
        names.append(n)
    aliases = [a.alias for a in aggs]
    cols = [build(a, g.scope(), g.ord()).alias(a.alias) for a in aggs]
    totals = (g.df.groupBy(*(q(n) for n in names)) if names else g.df.groupBy()).agg(*cols)
    base = replace(g, df=g.df.select(*(q(c) for c in g.df.columns if c not in aliases or c in names)))
    out = _attach(base, totals, names)
    return f.to(out.drop(*(n for n in names if n.startswith("__g"))))


#: Aggregates whose running value follows from that of the blocks before; the others hold all values they have seen.
CUMULATIVE = "count sum rate avg min max stdev var stdevp varp sumsq range first last earliest latest running_sum row_number per_second per_minute per_hour per_day".split()


def with_keys(f: Frame, by) -> tuple[DataFrame, list[str]]:
    """The frame's rows with the group keys as hidden columns, and their names."""
    keys = {f"__k{i}": c for i, (_, c, _) in enumerate(_keys(f, by))}
    return (f.df.withColumns(keys) if keys else f.df), list(keys)


def streamstats(f: Frame, aggs: list[Agg], by=(), window: int = 0, current: bool = True) -> Frame:
    """Running aggregates of each group. Without groups, or with one that is hot, they run over blocks of rows (brindle.operators.runs), but for those that hold all values seen so far."""
    scope = f.scope()
    bounded = bool(window and window > 0)
    low = Window.unboundedPreceding if not bounded else -(window - 1) if current else -window
    df, keys = with_keys(f, by)
    if keys and not runs.is_hot(df, keys):
        w = Window.partitionBy(*keys).orderBy(f.ord())
        return f.to(df.withColumns({a.alias: window_column(a, scope, f.ord(), w, w.rowsBetween(low, 0 if current else -1)) for a in aggs}).drop(*keys))
    names = {id(a): f"__o{i}" for i, a in enumerate(aggs)}
    reach = [a for a in aggs if a.name in ("lag", "lead", "moving_avg") or bounded and a.name not in ("row_number", "running_sum")]
    running = [a for a in aggs if a not in reach and a.name in CUMULATIVE]
    df = df.withColumn(ORD, f.ord())
    if running:
        df = _running(df, running, names, scope, current, keys)
    if reach:
        rows = lambda a: int(bind(a.args[1], scope).value) if len(a.args) > 1 and a.name in ("lag", "lead", "moving_avg") else 1 if a.name in ("lag", "lead") else window or 0
        w = runs.piece(keys)
        made = {names[id(a)]: window_column(a, scope, F.col(ORD), w, w.rowsBetween(low, 0 if current else -1)) for a in reach}
        df = runs.framed(df, ORD, made, max((rows(a) for a in reach if a.name != "lead"), default=0), max((rows(a) for a in reach if a.name == "lead"), default=0), keys)
    w = Window.partitionBy(*keys).orderBy(F.col(ORD))
    df = df.withColumns({a.alias: q(names[id(a)]) if a in reach or a in running else window_column(a, scope, F.col(ORD), w, w.rowsBetween(low, 0 if current else -1)) for a in aggs})
    return f.to(df.drop(*names.values(), *keys))


def _running(df: DataFrame, aggs: list[Agg], names: dict, scope: Scope, current: bool, keys: list[str]) -> DataFrame:
    df = runs.blocked(df, ORD, keys)
    r = {c: runs.Running(ORD, c) for c in (True, False)}
    middles = {}
    for a in aggs:
        x = bind(a.args[0], scope) if a.args else None
        test = predicate(a.where, scope) if a.where is not None else None
        kept = (lambda c, t=test: F.when(t, c)) if test is not None else (lambda c: c)
        own = r[True if a.name in ("running_sum", "row_number") else current]
        rate = {"per_minute": 60, "per_hour": 3600, "per_day": 86400}.get(a.name, 1)
        if a.name in ("count", "rate"):
            out = own.count(kept(x.col if x is not None and a.name == "count" else F.lit(1)))
            out = out if a.name == "count" else out / F.lit(1.0)
        elif a.name == "row_number":
            out = own.count(F.lit(1))
        elif a.name in ("min", "max"):
            out = own.extreme(kept(text(x) if x.kind in ("any", "object") else x.col), a.name == "min")
        elif a.name in ("first", "earliest"):
            out = own.first(kept(x.col), F.col(ORD))
        elif a.name in ("last", "latest"):
            out = own.last(kept(x.col), F.col(ORD))
        else:
            v = numbers(a, scope)
            if a.name == "range":
                out = own.extreme(v, False) - own.extreme(v, True)
            elif a.name == "avg":
                out = own.sum(v) / F.nullif(own.count(v), F.lit(0))
            elif a.name == "sumsq":
                out = own.sum(v * v)
            elif a.name in ("sum", "running_sum") or a.name.startswith("per_"):
                out = own.sum(v) * F.lit(float(rate)) if rate != 1 else own.sum(v)
            else:
                middle = f"__mid{len(middles)}"
                middles[middle] = F.avg(v)
                spread = own.spread(v, F.col(middle), a.name in ("stdev", "var"))
                out = F.sqrt(spread) if a.name.startswith("stdev") else spread
        own.out[names[id(a)]] = out
    if middles:
        df = df.join(F.broadcast(df.agg(*(c.alias(n) for n, c in middles.items()))))  # one row
    for one in r.values():
        df = one.applied(df) if one.out else df
    return df.drop(runs.BLOCK, *middles)


def sort(f: Frame, keys: list[tuple[str, bool]]) -> Frame:
    """Nulls last for ascending keys, first for descending ones; ties by all other columns in order of their names."""
    direct, parts = [], []
    for name, down in keys:
        if name not in f.columns:
            continue
        c, t = q(name), f.df.schema[name].dataType
        if not orderable(t):
            c, t = F.to_json(c), T.StringType()
        direct.append(c.desc_nulls_first() if down else c.asc_nulls_last())
        parts += _comparable(c, t, down)
    rest = [c for c in sorted(f.columns) if c not in [k for k, _ in keys] and orderable(f.df.schema[c].dataType)]
    direct += [q(c).asc_nulls_last() for c in rest]
    for c in rest:
        parts += _comparable(q(c), f.df.schema[c].dataType, False)
    return replace(f, df=f.df.withColumn(ORD, F.struct(*(p.alias(f"s{i}") for i, p in enumerate(parts)))), sorted_by=tuple(direct), ordered=True)


def _comparable(c: Column, t: T.DataType, down: bool) -> list[Column]:
    """Columns whose ascending order is the order asked for."""
    if not down:
        return [c.isNull(), c]
    k = kind(t)
    if k in ("int", "float"):
        return [c.isNotNull(), -c.cast("double") if k == "float" else -c]
    if k == "bool":
        return [c.isNotNull(), ~c]
    if k == "timestamp":
        return [c.isNotNull(), -F.unix_micros(c.cast("timestamp"))]
    # hex digits exchanged end to end: the order of strings backwards
    turned = F.concat(F.translate(F.hex(c.cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return [c.isNotNull(), turned]


def head(f: Frame, n: int) -> Frame:
    return replace(f, df=f.df.orderBy(*(f.sorted_by or (f.ord(),))).limit(n), ordered=True)


def tail(f: Frame, n: int) -> Frame:
    marked = f.df.withColumn(ORD, f.ord())
    return replace(f, df=marked.orderBy(F.col(ORD).desc()).limit(n), ordered=True)


def dedup(f: Frame, fields: list[str], n: int = 1) -> Frame:
    missing = [c for c in fields if c not in f.columns]
    df = f.df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else f.df
    marked = df.withColumn(ORD, f.ord())
    if n == 1:
        # a partial aggregate: a hot key is reduced before the shuffle
        rest = [c for c in marked.columns if c not in fields]
        one = marked.groupBy(*(q(c) for c in fields)).agg(F.min_by(F.struct(*(q(c) for c in rest)), F.col(ORD)).alias("__row"))
        out = one.select(*(q(c) if c in fields else F.col("__row").getField(c).alias(c) for c in marked.columns))
    else:
        w = Window.partitionBy(*(q(c) for c in fields)).orderBy(ORD)
        out = marked.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
    return f.to(out.drop(*missing))


# several inputs
def join(left: Frame, right: Frame, on: list[str], how: str = "inner") -> Frame:
    """Keys of different kinds don't join; of names on both sides the left one stays."""
    for k in on:
        for side, name in ((left, "left"), (right, "right")):
            if k not in side.columns:
                raise QueryError(f"join: {name} side has no {k}")
        a, b = (kind(s.df.schema[k].dataType) for s in (left, right))
        if a != b and {a, b} != {"int", "float"}:
            raise QueryError(f"join: {k} is {a} on one side and {b} on the other")
    names = [c for c in right.columns if c in on or c not in left.df.columns]
    r = right.df.select(*(q(c) for c in names))
    out = left.df.join(r, on, {"outer": "full"}.get(how, how))
    order = [c for c in left.df.columns] + [c for c in names if c not in on]
    return left.to(out.select(*(q(c) for c in order)))


def union(f: Frame, others: list[Frame]) -> Frame:
    """By name; a column of different kinds on the two sides becomes a string."""
    frames = [f, *others]
    kinds: dict[str, set[str]] = {}
    for g in frames:
        for c in g.columns:
            kinds.setdefault(c, set()).add(kind(g.df.schema[c].dataType))
    mixed = {c for c, ks in kinds.items() if len(ks - {"null"}) > 1 and ks - {"null"} != {"int", "float"}}
    out = None
    for i, g in enumerate(frames):
        cols = [(text(Typed(q(c), g.df.schema[c].dataType)).alias(c) if c in mixed else q(c)) for c in g.columns]
        # rows of one input stay together, in that input's order where that compares
        part = g.df.select(*cols, F.lit(i).alias("__part"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    ordering = F.struct("__part", *(q(c) for c in (["_time"] if "_time" in kinds else []) + sorted(c for c in kinds if c != "_time" and orderable(out.schema[c].dataType))))
    return f.to(out.withColumn(ORD, ordering).drop("__part"), ordered=False)


def explode(f: Frame, field: str, as_: str | None = None) -> Frame:
    """Rows without elements go; elements that are objects also give field.key columns."""
    name = as_ or field
    if field not in f.columns:
        return f.to(f.df.withColumn(name, F.lit(None).cast("string")).limit(0))
    t = f.df.schema[field].dataType
    if kind(t) == "any":
        arr = F.try_variant_get(q(field), "$", "array<variant>")
    elif kind(t) == "string":
        arr = F.from_json(q(field), "array<string>")
    elif kind(t) == "array":
        arr = q(field)
    else:
        return f.to(f.df.limit(0))
    df = f.df.withColumn("__e", F.explode(arr))
    et = df.schema["__e"].dataType
    df = df.withColumn(name, F.col("__e"))
    if isinstance(et, T.StructType):
        df = df.withColumns({f"{name}.{k}": F.col("__e").getField(k) for k in et.names})
    return f.to(df.drop("__e"))


def describe(f: Frame) -> Frame:
    """field, type, coverage, distinct_est, top_values: one row for each column."""
    total = f.df.agg(F.count("*").alias("__n"))
    named = [(c, f.df.schema[c].dataType) for c in f.columns]
    long = f.df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.lit(kind(t)).alias("type"), text(Typed(q(c), t)).alias("v")) for c, t in named))).alias("s")).select("s.*")
    counted = long.groupBy("field", "type", "v").agg(F.count("*").alias("n"))
    sums = counted.groupBy("field", "type").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("present"), F.count("v").alias("distinct_est"))
    # the most frequent of each of many lots first, so that no task ranks all values of a field
    best = [F.desc("n"), F.col("v")]
    lots = counted.filter("v is not null").withColumn("lot", F.pmod(F.xxhash64("v"), F.lit(256)))
    few = lots.withColumn("rank", F.row_number().over(Window.partitionBy("field", "lot").orderBy(*best))).filter("rank <= 5")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(*best))).filter("rank <= 5")
    tops = ranked.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("rank", "v", "n"))).alias("t"))
    rows = sums.join(tops, "field", "left").withColumn("t", F.coalesce("t", F.array().cast("array<struct<rank:int,v:string,n:bigint>>")))
    out = rows.join(F.broadcast(total)).select(
        "field", "type", F.coalesce(F.try_divide(F.coalesce("present", F.lit(0)).cast("double"), F.col("__n").cast("double")), F.lit(0.0)).alias("coverage"), "distinct_est", F.transform("t", lambda x: F.struct(x.v.alias("value"), x.n.alias("count"))).alias("top_values")
    )
    return Frame(out, f.now)


# shortcuts
def name_(n: str):
    return ("name", n, False)


def count(f: Frame, by=()) -> Frame:
    return stats(f, [Agg("count", [], None, "count")], by)


def top(f: Frame, field: str, n: int = 10, by=(), rare: bool = False) -> Frame:
    counted = stats(f, [Agg("count", [], None, "count")], [(name_(field), field), *by])
    total = counted.df.agg(F.sum("count").alias("__total"))
    pct = counted.df.join(F.broadcast(total)).withColumn("percent", F.round(F.col("count") * 100.0 / F.col("__total"), 2)).drop("__total")
    return head(sort(Frame(pct, f.now), [("count", not rare), (field, False)]), n)


def every(f: Frame, span: int, aggs: list[Agg], by=()) -> Frame:
    bucket = (("call", "bin", [name_("_time"), ("lit", span, "duration")], None), "_time")
    return stats(f, aggs, [bucket, *by])


def rate(f: Frame, per: int, by=()) -> Frame:
    return every(f, per, [Agg("count", [], None, "rate")], by)


def latency(f: Frame, field: str, every_: int | None = None, by=()) -> Frame:
    aggs = [Agg(p, [name_(field)], None, p) for p in ("p50", "p95", "p99")] + [Agg("count", [], None, "count")]
    return every(f, every_, aggs, by) if every_ else stats(f, aggs, by)


def percentiles(f: Frame, field: str, by=()) -> Frame:
    return stats(f, [Agg(p, [name_(field)], None, f"{p}_{field}") for p in ("p50", "p75", "p90", "p95", "p99")], by)


def proportion(f: Frame, expr, as_: str, every_: int | None = None, by=()) -> Frame:
    aggs = [Agg("count", [], expr, f"{as_}_num"), Agg("count", [], None, f"{as_}_den")]
    out = every(f, every_, aggs, by) if every_ else stats(f, aggs, by)
    return out.to(out.df.withColumn(as_, F.try_divide(q(f"{as_}_num").cast("double"), q(f"{as_}_den").cast("double"))))


def facets(f: Frame, fields: list[str], limit: int = 10) -> Frame:
    """All facets in one pass: each row gives one (facet, value) for each field."""
    scope = f.scope()
    pairs = F.array(*(F.struct(F.lit(n).alias("_facet"), text(bind(name_(n), scope)).cast("string").alias("_value")) for n in fields))
    counted = f.df.select(F.explode(pairs).alias("s")).select("s.*").groupBy("_facet", "_value").agg(F.count("*").alias("count"))
    w = Window.partitionBy("_facet").orderBy(F.desc("count"), F.col("_value").asc_nulls_last())
    return Frame(counted.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn"), f.now)


def impact(f: Frame, aggs: list[Agg], by) -> Frame:
    agg = aggs[0] if aggs else Agg("count", [], None, "n")
    name = agg.alias
    if aggs and "(" in name:
        name = "n" if agg.name == "count" else f"{agg.name}_{agg.args[0][1]}" if agg.args and agg.args[0][0] == "name" else agg.name
    out = stats(f, [Agg(agg.name, agg.args, agg.where, name)], by)
    total = out.df.agg(F.sum(q(name)).alias(f"total_{name}"))
    df = out.df.join(F.broadcast(total)).withColumn(f"pct_{name}", F.try_divide(q(name).cast("double") * 100, q(f"total_{name}").cast("double")))
    return sort(Frame(df, f.now), [(name, True)])


def baseline(f: Frame, field: str, window: int, by=()) -> Frame:
    x = [name_(field)]
    out = streamstats(f, [Agg("avg", x, None, "baseline_avg"), Agg("stdev", x, None, "baseline_stdev")], by, window, False)
    delta = q(field).cast("double") - q("baseline_avg")
    return out.to(out.df.withColumn("delta", delta).withColumn("z", F.when(q("baseline_stdev") > 0, q("delta") / q("baseline_stdev"))))


def changes(f: Frame, field: str, by=()) -> Frame:
    """Rows whose value differs from the previous non-null one of its group, in time order."""
    df, keys = with_keys(f, by)
    if not keys or runs.is_hot(df, keys):
        df = runs.blocked(df.withColumn(ORD, f.ord()).withColumn("__c", F.struct(*(["_time"] if "_time" in f.columns else []), ORD)), "__c", keys)
        r = runs.Running("__c", False)
        r.out = {f"previous_{field}": r.last(q(field), F.col("__c"))}
        out = r.applied(df).drop(runs.BLOCK, "__c", *keys)
        return f.to(out.filter(q(field).isNotNull() & q(f"previous_{field}").isNotNull() & (q(field) != q(f"previous_{field}"))))
    order = F.struct("_time", f.ord()) if "_time" in f.columns else f.ord()
    w = Window.partitionBy(*(c for _, c, _ in _keys(f, by))).orderBy(order)
    prev = F.last(q(field), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = f.df.withColumn(f"previous_{field}", prev)
    return f.to(out.filter(q(field).isNotNull() & q(f"previous_{field}").isNotNull() & (q(field) != q(f"previous_{field}"))))


def exemplars(f: Frame, n: int = 3, by=()) -> Frame:
    df = f.df.withColumn(ORD, f.ord())
    newest = [q("_time").desc_nulls_last(), F.col(ORD).desc()] if "_time" in f.columns else [F.col(ORD).desc()]
    if not by:
        return f.to(df.orderBy(*newest).limit(n))
    w = Window.partitionBy(*(c for _, c, _ in _keys(f, by))).orderBy(*newest)
    return f.to(df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn"))


# parse
def parse(f: Frame, formats_: list[tuple[str, dict]], from_: str = "_raw", into=(), prefix: str = "", on_error: str = "propagate") -> Frame:
    """Fields from text. Never overwrites a value that isn't null; the first format that reads a row gives its fields."""
    if from_ not in f.columns:
        raise QueryError(f"parse: there is no {from_}")
    wanted = {n: t for n, t in into}
    src = text(Typed(q(from_), f.df.schema[from_].dataType))
    if any(name == "w3c" and not given.get("fields") for name, given in formats_):
        f = _with_w3c_header(f, src)
    # each regex runs once for a row: what it takes apart is a column of its own
    regexes = {f"__m{i}": r for i, (name, given) in enumerate(formats_) if (r := _regex(name, given)) is not None}
    f = f.to(f.df.withColumns({c: fm.taken_apart(src, r) for c, r in regexes.items()}), sorted_by=f.sorted_by) if regexes else f
    tried = [(name, *_fields(f, name, given, src, wanted, q(f"__m{i}"))) for i, (name, given) in enumerate(formats_)]
    names: dict[str, list[tuple[Column, Column]]] = {}
    for _, ok, fields in tried:
        for n, c in fields.items():
            if not wanted or n in wanted:
                names.setdefault(n, []).append((ok, c))
    for n in wanted:
        names.setdefault(n, [])
    earlier: list[Column] = []
    use: dict[int, Column] = {}
    for i, (_, ok, _) in enumerate(tried):
        free = F.coalesce(ok, F.lit(False))
        for e in earlier:
            free = free & ~e
        use[i] = free
        earlier.append(F.coalesce(ok, F.lit(False)))
    good = F.lit(False)
    for e in earlier:
        good = good | e
    df, cols = f.df, {}
    for n in names:
        parts = [F.when(use[i], fields[n]) for i, (_, _, fields) in enumerate(tried) if n in fields]
        types = [f.df.select(fields[n].alias("x")).schema[0].dataType for _, _, fields in tried if n in fields]
        c = F.coalesce(*((p.cast("string") if len({str(t) for t in types}) > 1 else p) for p in parts)) if parts else F.lit(None).cast("string")
        t = types[0] if types and len({str(t) for t in types}) == 1 else T.StringType()
        if wanted.get(n):
            conv = FUNCTIONS.get(wanted[n])
            if conv is None or wanted[n] not in ("int", "float", "bool", "string", "timestamp", "duration"):
                raise QueryError(f"into: {wanted[n]} isn't a type")
            c = conv.build(None, Typed(c, t)).col
        out = prefix + n
        cols[out] = F.coalesce(q(out), c.cast(f.df.schema[out].dataType)) if out in f.columns else c
    df = df.withColumns(cols)
    failed = src.isNotNull() & ~good
    if on_error == "drop":
        df = f.df.filter(~F.coalesce(failed, F.lit(True))).withColumns(cols)
    elif on_error == "strict":
        any_col = next(iter(cols))
        df = df.withColumn(any_col, F.when(failed, F.raise_error(F.concat(F.lit("parse: can't read "), src)).cast(df.schema[any_col].dataType)).otherwise(q(any_col)))
    elif on_error == "propagate":
        label = "first_of" if len(tried) > 1 else tried[0][0]
        detail = F.struct(F.lit(label).alias("format"), F.array(*(F.lit(n) for n, _, _ in tried)).alias("tried"), F.substring(src, 1, 200).alias("input"))
        kept = F.col("_error") if "_error" in f.columns else F.lit(None).cast("string")
        df = df.withColumn("_error", F.coalesce(kept, F.when(failed, F.lit(f"parse:{label}: no match"))))
        if "_error_detail" not in f.columns:
            df = df.withColumn("_error_detail", F.when(failed, detail))
    return f.to(df.drop(W3C, *regexes))


def _regex(name: str, given: dict) -> str | None:
    if name == "regex":
        return given["text"].replace("(?P<", "(?<")
    if name == "pattern":
        return fm.pattern_regex(given["text"])
    return fm.FIXED[fm.known(name)][0] if name in fm.FIXED else None


def _w3c_header(src: Column) -> Column:
    return F.nullif(F.regexp_extract(src, r"^\s*#Fields:\s*(.*?)\s*$", 1), F.lit(""))


def _with_w3c_header(f: Frame, src: Column) -> Frame:
    """Each row with the last #Fields: line at or before it in its source, in row order."""
    if ORD in f.df.columns and "_source" in f.columns:
        by = Window.partitionBy(q("_source")).orderBy(F.col(ORD)).rowsBetween(Window.unboundedPreceding, 0)
        return f.to(f.df.withColumn(W3C, F.last(_w3c_header(src), ignorenulls=True).over(by)), sorted_by=f.sorted_by)
    if ORD in f.df.columns:
        r = runs.Running(ORD, True)
        r.out = {W3C: r.last(_w3c_header(src), F.col(ORD))}
        return f.to(r.applied(runs.blocked(f.df, ORD)).drop(runs.BLOCK), sorted_by=f.sorted_by)
    headers = f.df.select(_w3c_header(src).alias("h")).filter("h is not null").distinct().limit(2).collect()
    if len(headers) > 1:
        raise QueryError("w3c: several #Fields: lines need a source with an order")
    return f.to(f.df.withColumn(W3C, F.lit(headers[0]["h"] if headers else None).cast("string")), sorted_by=f.sorted_by)


def _fields(f: Frame, name: str, given: dict, src: Column, wanted: dict, groups: Column) -> tuple[Column, dict[str, Column]]:
    fm.known(name)
    if name in ("regex", "pattern"):
        ok, out = fm.by_regex(groups, _regex(name, given))
        return F.when(src.isNotNull(), ok), out
    if name in ("json", "docker"):
        value = F.try_parse_json(src)
        ok = F.when(src.isNotNull(), F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)))
        spark_type = {"int": "bigint", "float": "double", "bool": "boolean", None: "string"}
        found = [([n], spark_type.get(t, "string")) for n, t in wanted.items()] if wanted else fm.infer_json(f.df, src)
        out = {}
        for path, t in found:
            at = "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in (path if not wanted else path[0].split(".")))
            out[".".join(path)] = F.try_variant_get(value, at, t)
        if name == "docker" and "log" in out:
            out["log"] = F.regexp_replace(out["log"], r"\n$", "")
        return ok, out
    if name in ("logfmt", "kv"):
        m = fm.pairs(src, given.get("sep"), given.get("assign", "="))
        found = {n: "string" for n in wanted} if wanted else fm.infer_map(f.df, m)
        return F.when(src.isNotNull(), m.isNotNull()), {k: F.try_element_at(m, F.lit(k)).try_cast(t) for k, t in found.items()}
    if name == "w3c":
        line = F.regexp_replace(src, r"^\s+|\s+$", "")
        parts, data = F.split(line, r"\s+"), (line != "") & ~line.startswith("#")
        value = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("-"))
        if given.get("fields"):
            return F.when(src.isNotNull(), data), {n.replace("-", "_"): F.when(data, value(i)) for i, n in enumerate(given["fields"].split())}
        headers = [r["h"] for r in f.df.select(_w3c_header(src).alias("h")).filter("h is not null").distinct().orderBy("h").collect()]
        if not headers:
            raise QueryError("w3c needs a #Fields: line or w3c(fields=...)")
        at: dict[str, Column] = {}
        for h in headers:
            for i, n in enumerate(h.replace("-", "_").split()):
                at[n] = (at[n] if n in at else F).when(F.col(W3C) == h, value(i))
        ok = data & F.col(W3C).isNotNull()
        return F.when(src.isNotNull(), ok), {n: F.when(ok, c) for n, c in at.items()}
    ok, out = fm.fixed(name, groups)
    if name in ("cef", "leef"):
        ext = out.pop("extension")
        m = fm.leef_pairs(ext, out.pop("delimiter")) if name == "leef" else fm.pairs(ext, None, "=")
        if name == "cef":  # values hold spaces: a value ends before the next key=
            keys = F.regexp_extract_all(ext, F.lit(r"(?:^|\s)([\w.]+)=((?:[^=\\]|\\.)*)(?=\s[\w.]+=|$)"), F.lit(1))
            values = F.regexp_extract_all(ext, F.lit(r"(?:^|\s)([\w.]+)=((?:[^=\\]|\\.)*)(?=\s[\w.]+=|$)"), F.lit(2))
            m = F.when(F.size(keys) > 0, F.map_from_entries(F.transform(F.arrays_zip(F.array_distinct(keys).alias("k")), lambda e: F.struct(e.k, F.element_at(values, F.array_position(keys, e.k).cast("int"))))))
        found = {n: "string" for n in wanted if n not in out} if wanted else fm.infer_map(f.df, m)
        out |= {k: F.try_element_at(m, F.lit(k)).try_cast(t) for k, t in found.items() if k not in out}
    return F.when(src.isNotNull(), ok), out


def time_bucket(c: Column, span: int) -> Column:
    return F.timestamp_micros(bin_micros(F.unix_micros(c), span))


STAGE_FUNCTIONS: dict[str, Any] = {
    "where": lambda f, a: where(f, a["expr"]), "extend": lambda f, a: extend(f, a["assign"]), "keep": lambda f, a: keep(f, a["fields"], a["but"]), "drop": lambda f, a: drop(f, a["fields"]), "rename": lambda f, a: rename(f, a["pairs"]),
    "stats": lambda f, a: stats(f, a["aggs"], a["by"]), "eventstats": lambda f, a: eventstats(f, a["aggs"], a["by"]), "streamstats": lambda f, a: streamstats(f, a["aggs"], a["by"], a.get("window", 0), a.get("current", True)),
    "sort": lambda f, a: sort(f, a["keys"]), "head": lambda f, a: head(f, a["n"]), "tail": lambda f, a: tail(f, a["n"]), "dedup": lambda f, a: dedup(f, a["fields"], a["n"]),
    "explode": lambda f, a: explode(f, a["field"], a["as"]), "describe": lambda f, a: describe(f), "count": lambda f, a: count(f, a["by"]), "top": lambda f, a: top(f, a["field"], a["n"], a["by"]), "rare": lambda f, a: top(f, a["field"], a["n"], a["by"], True),
    "every": lambda f, a: every(f, a["span"], a["aggs"], a["by"]), "rate": lambda f, a: rate(f, a["per"], a["by"]), "latency": lambda f, a: latency(f, a["field"], a["every"], a["by"]), "percentiles": lambda f, a: percentiles(f, a["field"], a["by"]),
    "proportion": lambda f, a: proportion(f, a["expr"], a["as"], a["every"], a["by"]), "facets": lambda f, a: facets(f, a["fields"], a.get("limit", 10)), "impact": lambda f, a: impact(f, a["aggs"], a["by"]),
    "baseline": lambda f, a: baseline(f, a["field"], a["window"], a["by"]), "changes": lambda f, a: changes(f, a["field"], a["by"]), "exemplars": lambda f, a: exemplars(f, a["n"], a["by"]),
    "parse": lambda f, a: parse(f, a["formats"], a["from"], a["into"], a["prefix"], a["on_error"]),
}
