"""The analysing stages: sessions, transactions, outliers, traces, templates and the like."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.aggregates import PERCENTILE_ACCURACY
from brindle.functions.scalar import text
from brindle.operators import runs
from brindle.operators.stages import ORD, Frame, _keys, q, time_bucket, with_keys
from brindle.plans.binding import Typed, bind, predicate
from brindle.plans.syntax import QueryError

HALF_HOUR = 1_800_000_000


def _number(f: Frame, field: str) -> Column:
    if field not in f.columns:
        return F.lit(None).cast("double")
    return q(field).try_cast("double")


def outliers(f: Frame, field: str, method: str = "iqr", threshold: float | None = None) -> Frame:
    """_outlier and _score; rows without a number, and sets too small to judge (iqr: 4, mad: 3, zscore: 2 values), are never outliers."""
    x = _number(f, field)
    t = float(threshold) if threshold is not None else {"iqr": 1.5, "zscore": 3.0, "mad": 3.5}.get(method)
    if t is None:
        raise QueryError(f"outliers has no method {method}", hint="iqr, zscore or mad")
    values = f.df.select(x.alias("x")).filter("x is not null")
    zero = F.lit(0.0)
    one_row = lambda n, **v: f.df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("__n"), *(F.lit(c).cast("double").alias(k) for k, c in v.items()))
    if method == "iqr":
        if f.approximate:
            one = values.agg(F.count("*").alias("__n"), F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.75)), PERCENTILE_ACCURACY).alias("__p")).select("__n", F.col("__p")[0].alias("__m"), F.col("__p")[1].alias("__s"))
        else:
            n, (low, high) = runs.quantiles(values, [0.25, 0.75])
            one = one_row(n, __m=low, __s=high)
        q1, q3 = F.col("__m"), F.col("__s")
        width = q3 - q1
        away = F.greatest(q1 - x, x - q3, zero)
        score = F.when(width > 0, away / width).otherwise(F.when(away > 0, F.lit(float("inf"))).otherwise(zero))
        flag, least, score = (x < q1 - t * width) | (x > q3 + t * width), 4, score
    elif method == "zscore":
        one = values.agg(F.count("*").alias("__n"), F.avg("x").alias("__m"), F.stddev_samp("x").alias("__s"))
        score = F.when(F.col("__s") > 0, F.abs(x - F.col("__m")) / F.col("__s")).otherwise(zero)
        flag, least = score > t, 2
    else:
        if f.approximate:
            middle = values.agg(F.count("*").alias("__n"), F.percentile_approx("x", F.lit(0.5), PERCENTILE_ACCURACY).alias("__m"))
            spread = values.join(F.broadcast(middle)).agg(F.percentile_approx(F.abs(F.col("x") - F.col("__m")), F.lit(0.5), PERCENTILE_ACCURACY).alias("__d"))
            one = middle.join(F.broadcast(spread))
        else:
            n, (middle,) = runs.quantiles(values, [0.5])
            _, (spread,) = runs.quantiles(values.select(F.abs(F.col("x") - F.lit(middle).cast("double")).alias("x")), [0.5])
            one = one_row(n, __m=middle, __d=spread)
        score = F.when(F.col("__d") > 0, F.abs(x - F.col("__m")) * 0.6745 / F.col("__d")).otherwise(zero)
        flag, least = score > t, 3
    fine = x.isNotNull() & (F.col("__n") >= least)
    df = f.df.join(F.broadcast(one))
    df = df.withColumn("_score", F.when(fine, score).otherwise(zero)).withColumn("_outlier", F.coalesce(fine & flag, F.lit(False)))
    return f.to(df.drop(*(c for c in ("__n", "__m", "__s", "__d"))))


def sessionize(f: Frame, maxpause: int = HALF_HOUR, by=()) -> Frame:
    """_session_id (1, 2, ... by keys and start), _session_start, _session_end; a gap longer than maxpause begins a session."""
    is_new = lambda before: (before.isNull() | q("_time").isNull() | (F.unix_micros("_time") - F.unix_micros(before) > int(maxpause))).cast("int")
    ends = [F.min("_time").alias("_session_start"), F.max("_time").alias("_session_end")]
    df, names = with_keys(f, by)
    if not names or runs.is_hot(df, names):
        df = runs.blocked(df.withColumn("__at", F.struct(q("_time"), f.ord().alias("o"))), "__at", names)
        df = runs.carried(df, {"__t": (F.max("_time"), F.max)})
        df = df.withColumn("__new", is_new(F.coalesce(F.lag("_time").over(Window.partitionBy(runs.BLOCK).orderBy("__at")), "__t")))
        df = runs.carried(df, {"__c": (F.sum("__new"), F.sum)}).withColumn("__s", F.sum("__new").over(runs.inside("__at")) + F.coalesce("__c", F.lit(0).cast("bigint")))
        df = df.drop("__t", "__c", "__at", runs.BLOCK)
        if not names:
            one = df.groupBy(F.col("__s").alias("_session_id")).agg(*ends)
            return f.to(df.join(one, q("_session_id") == q("__s")).drop("__s", "__new"))
    else:
        w = Window.partitionBy(*names).orderBy(q("_time"), f.ord())
        df = df.withColumn("__new", is_new(F.lag("_time").over(w)))
        df = df.withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each session, numbered in ranges of keys and start
    one = df.groupBy(*names, "__s").agg(*ends).withColumn("__at", F.struct(*names, "_session_start", "__s"))
    one = runs.numbered(runs.ranged(one, F.col("__at")), "__at", "_session_id").withColumn("_session_id", F.col("_session_id").cast("bigint"))
    right = one.select(*(q(n).alias(f"{n}r") for n in [*names, "__s"]), "_session_id", "_session_start", "_session_end")
    on = q("__s") == q("__sr")
    for n in names:
        on = on & q(n).eqNullSafe(q(f"{n}r"))
    out = df.join(right, on).drop(*names, *(f"{n}r" for n in names), "__s", "__sr", "__new")
    return f.to(out)


def transaction(f: Frame, fields: list[str], maxspan: int | None = None, startswith=None, endswith=None) -> Frame:
    """One row for each group of events: eventcount, duration (seconds), _raw joined, the rest of its first event."""
    scope = f.scope()
    starts = F.coalesce(predicate(startswith, scope), F.lit(False)) if startswith is not None else F.lit(False)
    ends = F.coalesce(predicate(endswith, scope), F.lit(False)) if endswith is not None else F.lit(False)

    def new(before: Column, ended: Column) -> Column:
        out = before.isNull() | starts | F.coalesce(ended, F.lit(False))
        if maxspan is not None:
            out = out | F.coalesce(F.unix_micros("_time") - F.unix_micros(before) > int(maxspan), F.lit(False))
        return out.cast("int")

    df = f.df.withColumn(ORD, f.ord()).withColumn("__ends", ends).withColumn("__at", F.struct(q("_time"), ORD))
    if runs.is_hot(df, fields):
        df = runs.blocked(df, "__at", fields)
        df = runs.carried(df, {"__t": (F.max("_time"), F.max), "__e": (F.max_by("__ends", "__at"), lambda c: F.last(c, ignorenulls=True))})
        w = Window.partitionBy(runs.BLOCK).orderBy("__at")
        first = F.row_number().over(w) == 1
        df = df.withColumn("__new", new(F.when(first, q("__t")).otherwise(F.lag("_time").over(w)), F.when(first, q("__e")).otherwise(F.lag("__ends").over(w))))
        df = runs.carried(df, {"__c": (F.sum("__new"), F.sum)}).withColumn("__t", F.sum("__new").over(runs.inside("__at")) + F.coalesce("__c", F.lit(0).cast("bigint"))).drop(runs.BLOCK, "__c", "__e")
    else:
        w = Window.partitionBy(*(q(c) for c in fields)).orderBy("__at")
        df = df.withColumn("__new", new(F.lag("_time").over(w), F.lag("__ends").over(w))).withColumn("__t", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("_time", ORD)
    rest = [c for c in f.columns if c not in (*fields, "_time", "_raw", "eventcount", "duration")]
    aggs = [
        F.min("_time").alias("_time"), F.count("*").alias("eventcount"),
        (F.coalesce(F.unix_micros(F.max("_time")) - F.unix_micros(F.min("_time")), F.lit(0)) / 1e6).alias("duration"),
    ]
    if "_raw" in f.columns:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), q("_raw").alias("r")))), lambda s: s.r), "\n").alias("_raw"))
    if rest:
        aggs.append(F.min_by(F.struct(*(q(c) for c in rest)), order).alias("__first"))
    out = df.groupBy(*(q(c) for c in fields), "__t").agg(*aggs)
    return Frame(out.select(*(q(c) for c in fields), *(c for c in out.columns if c not in (*fields, "__t", "__first")), *(F.col("__first").getField(c).alias(c) for c in rest)), f.now)


def topology(f: Frame, source_field: str = "source", dest_field: str = "dest", weight_field: str | None = None, max_nodes: int | None = None) -> Frame:
    """Edges with their counts; degrees count events. With max_nodes only edges between the nodes of most events stay."""
    scope = f.scope()
    s, d = (text(bind(("name", n, False), scope)).cast("string") for n in (source_field, dest_field))
    df = f.df.select(s.alias("_source"), d.alias("_destination"), (_number(f, weight_field) if weight_field else F.lit(None).cast("double")).alias("w")).filter("_source is not null and _destination is not null")
    edges = df.groupBy("_source", "_destination").agg(F.count("*").alias("_edge_count"), F.sum("w").alias("_edge_weight"))
    out_ = edges.groupBy("_source").agg(F.sum("_edge_count").alias("_source_out_degree"))
    in_ = edges.groupBy("_destination").agg(F.sum("_edge_count").alias("_dest_in_degree"))
    if max_nodes:
        nodes = edges.select(F.explode(F.array("_source", "_destination")).alias("n"), "_edge_count").groupBy("n").agg(F.sum("_edge_count").alias("c")).orderBy(F.desc("c"), "n").limit(max_nodes).select("n")
        edges = edges.join(nodes.withColumnRenamed("n", "_source"), "_source", "left_semi").join(nodes.withColumnRenamed("n", "_destination"), "_destination", "left_semi")
    out = edges.join(out_, "_source").join(in_, "_destination").select("_source", "_destination", "_edge_count", "_source_out_degree", "_dest_in_degree", *(["_edge_weight"] if weight_field else []))
    from brindle.operators.stages import sort

    return sort(Frame(out, f.now), [("_edge_count", True), ("_source", False), ("_destination", False)])


def correlate(f: Frame, a: str, b: str, method: str = "pearson") -> Frame:
    """One row; null for fewer than two pairs, 0 where a side has no variance. Ranks of spearman ignore ties."""
    pairs = f.df.select(_number(f, a).alias("a"), _number(f, b).alias("b"), f.ord().alias("o")).filter("a is not null and b is not null")
    if method == "spearman":
        for side in ("a", "b"):
            placed = pairs.withColumn("__at", F.struct(side, "o"))
            pairs = runs.numbered(runs.ranged(placed, F.col("__at")), "__at", f"__{side}").drop("__at", runs.BLOCK)
        pairs = pairs.select(F.col("__a").cast("double").alias("a"), F.col("__b").cast("double").alias("b"))
    elif method != "pearson":
        raise QueryError(f"correlate has no method {method}", hint="pearson or spearman")
    one = pairs.agg(F.count("*").alias("_n"), F.corr("a", "b").alias("c"))
    value = F.when(F.col("_n") < 2, None).otherwise(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)))
    return Frame(one.select(value.alias("_correlation"), F.lit(method).alias("_method"), "_n", F.lit(a).alias("_field1"), F.lit(b).alias("_field2")), f.now)


def rollup(f: Frame, spans: list[tuple[str, int]], by=()) -> Frame:
    """Counts per bucket at several resolutions, from one pass: the finest that divides the others is counted first."""
    keys = _keys(f, by)
    names = [n for n, _, _ in keys]
    finest = min(s for _, s in spans)
    base = finest if all(s % finest == 0 for _, s in spans) else None
    if base:
        small = f.df.groupBy(time_bucket(q("_time"), base).alias("__b"), *(c.alias(n) for n, c, _ in keys)).agg(F.count("*").alias("__c"))
    else:
        small = f.df.select(q("_time").alias("__b"), *(c.alias(n) for n, c, _ in keys), F.lit(1).cast("bigint").alias("__c"))
    each = F.explode(F.array(*(F.struct(F.lit(label).alias("_resolution"), time_bucket(F.col("__b"), s).alias("_bucket")) for label, s in spans)))
    wide = small.filter("__b is not null").select(each.alias("s"), *names, "__c").select("s.*", *names, "__c")
    return Frame(wide.groupBy("_resolution", "_bucket", *names).agg(F.sum("__c").alias("count")), f.now)


def xyseries(f: Frame, x: str, y: str, v: str) -> Frame:
    """One row for each x, one column for each y in order of first appearance; the last value wins. A schema holds as many columns as there are values of y."""
    shown = F.coalesce(text(Typed(q(y), f.df.schema[y].dataType)), F.lit("null"))
    names = [r["y"] for r in f.df.groupBy(shown.alias("y")).agg(F.min(f.ord()).alias("o")).orderBy("o", "y").select("y").collect()]
    key = F.coalesce(text(Typed(q(y), f.df.schema[y].dataType)), F.lit("null"))
    order = f.ord()
    cols = [F.max_by(q(v), F.when(key == n, order)).alias(n) for n in names]
    return Frame(f.df.groupBy(q(x)).agg(*cols), f.now)


def trace(f: Frame, trace_id: str = "trace_id", span_id: str = "span_id", parent_id: str | None = None) -> Frame:
    """Spans of each trace depth first: _span_depth and _span_tree. Roots have no parent or an unknown one; a cycle ends where it began."""
    parent = parent_id or next((c for c in ("parent_id", "parent_span_id") if c in f.columns), None)
    for c in (trace_id, span_id):
        if c not in f.columns:
            raise QueryError(f"trace: there is no {c}")
    cols = {"trace_id": q(trace_id).cast("string"), "span_id": q(span_id).cast("string"), "parent": (q(parent) if parent else F.lit("")).cast("string")}
    for c, t in (("service", "string"), ("operation", "string"), ("duration_ms", "double")):
        cols[c] = (q(c) if c in f.columns else F.lit(None)).cast(t)
    cols["t"] = F.unix_micros("_time") if "_time" in f.columns else F.lit(0).cast("bigint")

    names = ("trace_id", "span_id", "parent", "service", "operation", "duration_ms")

    def walk(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: (r["t"] is not None, r["t"] or 0, r["span_id"] or ""))
        known = {r["span_id"] for r in rows}
        children: dict[str, list[int]] = {}
        roots = []
        for i, r in enumerate(rows):
            p = r["parent"]
            if not p or p not in known or p == r["span_id"]:
                roots.append(i)
            else:
                children.setdefault(p, []).append(i)
        found, seen = [], set()
        # spans of a cycle without a root come last, each beginning where it is met
        for start in [*roots, *range(len(rows))]:
            stack = [(start, 0, "", True)]
            while stack:
                i, depth, lead, last = stack.pop()
                if i in seen:
                    continue
                seen.add(i)
                found.append((i, depth, (lead + ("└─ " if last else "├─ ") if depth else "") + str(rows[i]["operation"] or rows[i]["span_id"])))
                kids = [k for k in children.get(rows[i]["span_id"], []) if k not in seen]
                below = lead + ("   " if last else "│  ") if depth else ""
                stack += [(k, depth + 1, below, n == 0) for n, k in enumerate(reversed(kids))]
        kinds = [pa.float64() if n == "duration_ms" else pa.string() for n in names]
        cols = [pa.array([rows[i][n] for i, _, _ in found], k) for n, k in zip(names, kinds)]
        cols += [pa.array([d for _, d, _ in found], pa.int64()), pa.array([t for _, _, t in found], pa.string()), pa.array(range(len(found)), pa.int64())]
        return pa.Table.from_arrays(cols, names=["trace_id", "span_id", "parent_id", "service", "operation", "duration_ms", "_span_depth", "_span_tree", "_span_order"])

    schema = "trace_id string, span_id string, parent_id string, service string, operation string, duration_ms double, _span_depth bigint, _span_tree string, _span_order bigint"
    df = f.df.select(*(c.alias(n) for n, c in cols.items())).filter("trace_id is not null").groupBy("trace_id").applyInArrow(walk, schema)
    return Frame(df, f.now)


#: What is masked in a message before templates are formed, in this order.
_MASKS = (
    r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", r"\b0[xX][0-9a-fA-F]+\b", r"(?i)\b(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{8,}\b", r"(?<![\w.])-?\d+(?:\.\d+)?(?=(?:ms|us|ns|s|%|[kKMG]?B)?(?![\w.]\w))",
)


#: First words that lead to a leaf of the tree.
LEAF_WORDS = 2


def patterns(f: Frame, field: str = "_raw", max_templates: int = 50, similarity: float = 0.4) -> Frame:
    """pattern, count, percent, example: masked texts grouped exactly, then merged where enough of their words agree."""
    s = text(Typed(q(field), f.df.schema[field].dataType)) if field in f.columns else F.lit(None).cast("string")
    masked = s
    for m in _MASKS:
        masked = F.regexp_replace(masked, m, "<*>")
    df = f.df.select(F.trim(masked).alias("m"), s.alias("s")).filter("m is not null")
    exact = df.groupBy("m").agg(F.count("*").alias("n"), F.min("s").alias("example"))
    # the leaf of a tree of depth four: number of words, then the first words, those with digits as one
    words = F.split("m", r"\s+")
    first = F.transform(F.slice(words, 1, LEAF_WORDS), lambda t: F.when(t.rlike(r"\d|<\*>"), F.lit("<*>")).otherwise(t))
    keyed = exact.withColumn("w", F.size(words)).withColumn("k", F.array_join(first, " "))
    need, leaf = float(similarity), "w int, k string, m string, n bigint, example string"

    def merge(pdf):
        import pandas as pd

        w, k = pdf["w"].iat[0], pdf["k"].iat[0]
        pdf = pdf.sort_values(["n", "m"], ascending=[False, True])
        made: list[list] = []
        for m, n, e in zip(pdf["m"], pdf["n"], pdf["example"]):
            words = re.split(r"\s+", m)
            best, at = 0.0, -1
            for i, (t, _, _) in enumerate(made):
                same = sum(a == b for a, b in zip(t, words)) / len(words)
                if same > best:
                    best, at = same, i
            if at >= 0 and best >= need:
                made[at][0] = [a if a == b else "<*>" for a, b in zip(made[at][0], words)]
                made[at][1] += n
            else:
                made.append([words, n, e])
        return pd.DataFrame([(w, k, " ".join(t), n, e) for t, n, e in made], columns=["w", "k", "m", "n", "example"])

    # first in lots of each leaf, then what those left of it
    lots = keyed.groupBy("w", "k", F.pmod(F.xxhash64("m"), F.lit(64))).applyInPandas(merge, leaf)
    merged = lots.groupBy("w", "k", "m").agg(F.sum("n").alias("n"), F.min("example").alias("example")).groupBy("w", "k").applyInPandas(merge, leaf).select(F.col("m").alias("pattern"), F.col("n").alias("count"), "example")
    merged = merged.groupBy("pattern").agg(F.sum("count").alias("count"), F.min("example").alias("example"))
    total = exact.agg(F.sum("n").alias("__n"))
    out = merged.join(F.broadcast(total)).select("pattern", "count", F.round(F.col("count") * 100.0 / F.col("__n"), 2).alias("percent"), "example")
    from brindle.operators.stages import head, sort

    return head(sort(Frame(out, f.now), [("count", True), ("pattern", False)]), max_templates)


def compare(current: Frame, before: Frame, shift: int) -> Frame:
    """The result beside that of the same query a span earlier: previous_c and change_c for each number c that isn't a key."""
    keys = [k for k in current.keys if k in current.columns]
    numbers = [c for c, t in current.df.dtypes if c not in keys and t in ("bigint", "double", "int", "float")]
    right = before.df
    if "_time" in keys:
        right = right.withColumn("_time", F.timestamp_micros(F.unix_micros("_time") + int(shift)))
    right = right.select(*(q(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(q(c).alias(f"previous_{c}") for c in numbers))
    if keys:
        on = None
        for i, k in enumerate(keys):
            test = q(k).eqNullSafe(q(f"__k{i}"))
            on = test if on is None else on & test
        df = current.df.join(right, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))
    else:
        df = current.df.join(F.broadcast(right))  # both sides are one row
    return current.to(df.withColumns({f"change_{c}": q(c) - q(f"previous_{c}") for c in numbers}))


def field_summary(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    return df.groupBy(q(field)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), q(field)).limit(n)


ANALYSIS = {
    "outliers": lambda f, a: outliers(f, a["field"], a.get("method", "iqr"), a.get("threshold")),
    "sessionize": lambda f, a: sessionize(f, a.get("maxpause", HALF_HOUR), a["by"]),
    "transaction": lambda f, a: transaction(f, a["fields"], a.get("maxspan"), a.get("startswith"), a.get("endswith")),
    "topology": lambda f, a: topology(f, a.get("source_field", "source"), a.get("dest_field", "dest"), a.get("weight_field"), a.get("max_nodes")),
    "correlate": lambda f, a: correlate(f, a["a"], a["b"], a.get("method", "pearson")),
    "rollup": lambda f, a: rollup(f, a["spans"], a["by"]),
    "xyseries": lambda f, a: xyseries(f, a["x"], a["y"], a["v"]),
    "trace": lambda f, a: trace(f, a.get("trace_id", "trace_id"), a.get("span_id", "span_id"), a.get("parent_id")),
    "patterns": lambda f, a: patterns(f, a.get("field", "_raw"), a.get("max_templates", 50), a.get("similarity", 0.4)),
}
