"""Live queries on Structured Streaming: tailing, windowed statistics and deduplication within a watermark."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.aggregates import build
from brindle.operators.stages import STAGE_FUNCTIONS, Frame
from brindle.plans.binding import predicate
from brindle.plans.syntax import QueryError, Stage, parse

#: Stages that treat each row by itself and so may run on a stream as they are.
ROWWISE = {"where", "extend", "keep", "drop", "rename", "parse", "explode"}
WINDOWED = {"every", "rate", "latency", "proportion"}


def _micros(span: int) -> str:
    return f"{int(span)} microseconds"


def live_query(stream: DataFrame, text: str, watermark: str = "10 minutes", now: dt.datetime | None = None) -> DataFrame:
    """A streaming DataFrame for a query over a stream that has _time.

    Row-wise stages run as they are; one windowed aggregation (every, rate, or stats by
    bin(_time, d)) emits a window once the watermark has passed it; dedup keeps the first
    row of a key seen within the watermark. Stages that need all rows are refused.
    """
    f = Frame(stream, now or dt.datetime.now(dt.UTC))
    stages = parse(text).stages
    if stages[0].name == "from":
        if stages[0].args["search"] is not None:
            f = f.to(f.df.filter(predicate(stages[0].args["search"], f.scope())))
        stages = stages[1:]
    done = False
    for s in stages:
        if s.name in ROWWISE:
            if s.name == "parse" and not s.args["into"] and s.args["formats"][0][0] in ("json", "logfmt", "kv", "w3c", "docker"):
                raise QueryError("on a stream parse needs into (...)")
            f = STAGE_FUNCTIONS[s.name](f, s.args)
        elif s.name == "dedup" and s.args["n"] == 1:
            f = f.to(f.df.withWatermark("_time", watermark).dropDuplicatesWithinWatermark(s.args["fields"]))
        elif not done and (s.name in WINDOWED or s.name in ("stats", "count")):
            f, done = _windowed(f, s, watermark), True
        else:
            raise QueryError(f"{s.name} needs all rows and can't run on a stream")
    return f.df.select(*(F.col(f"`{c}`") for c in f.columns))


def _windowed(f: Frame, s: Stage, watermark: str) -> Frame:
    from brindle.plans.syntax import Agg

    a = s.args
    span = {"every": "span", "rate": "per", "latency": "every", "proportion": "every"}.get(s.name)
    span = a.get(span) if span else None
    by = list(a["by"])
    if span is None:
        bins = [(e, n) for e, n in by if e[0] == "call" and e[1].lower() == "bin" and e[2][0][:2] == ("name", "_time")]
        if not bins:
            raise QueryError(f"{s.name} without a time window needs all rows", hint="add bin(_time, 5m) to by")
        span = bins[0][0][2][1][1]
        by = [b for b in by if b not in bins]
    count = lambda alias, where=None: Agg("count", [], where, alias)
    if s.name == "rate":
        aggs = [count("rate")]
    elif s.name == "count":
        aggs = [count("count")]
    elif s.name == "proportion":
        aggs = [count(f"{a['as']}_num", a["expr"]), count(f"{a['as']}_den")]
    elif s.name == "latency":
        aggs = [Agg(p, [("name", a["field"], False)], None, p) for p in ("p50", "p95", "p99")] + [count("count")]
    else:
        aggs = a["aggs"]
    from brindle.operators.stages import _keys

    keys = [c.alias(n) for n, c, _ in _keys(f, by)]
    order: Column = F.col("_time")
    cols = [build(g, f.scope(), order, int(span) / 1e6).alias(g.alias) for g in aggs]
    out = f.df.withWatermark("_time", watermark).groupBy(F.window("_time", _micros(span)).alias("__w"), *keys).agg(*cols)
    out = out.select(F.col("__w.start").alias("_time"), *(F.col(f"`{c}`") for c in out.columns if c != "__w"))
    if s.name == "proportion":
        out = out.withColumn(a["as"], F.try_divide(F.col(f"{a['as']}_num").cast("double"), F.col(f"{a['as']}_den").cast("double")))
    return Frame(out, f.now)


def session_counts(stream: DataFrame, pause: str, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Sessions of a stream: keys, start, last event and count, once the watermark has passed their end."""
    grouped = stream.withWatermark("_time", watermark).groupBy(F.session_window("_time", pause).alias("w"), *keys)
    return grouped.agg(F.max("_time").alias("session_end"), F.count("*").alias("eventcount")).select(*keys, F.col("w.start").alias("session_start"), "session_end", "eventcount")


#: Running aggregates of a stream: how a value changes what is held.
RUNNING = {"count": lambda held, v: (held or 0) + 1, "sum": lambda held, v: (held or 0.0) + v, "min": lambda held, v: v if held is None else min(held, v), "max": lambda held, v: v if held is None else max(held, v), "last": lambda held, v: v}


def running(stream: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], idle: str | None = None) -> DataFrame:
    """A stream whose rows carry running aggregates of their key: name to (count, sum, min, max, last or avg; column of numbers).

    Within a micro-batch rows count in the order of _time, and batches in the order they
    come, so a late row counts when it comes. What is held of a key is one number for each
    aggregate; with idle ("1 hour") it is given up when nothing came for so long.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = list(aggs)
    parts = {n: ["sum", "count"] if how == "avg" else [how] for n, (how, _) in aggs.items()}
    unknown = [how for how, _ in aggs.values() if how not in RUNNING and how != "avg"]
    if unknown:
        raise QueryError(f"{unknown[0]} can't run on a stream", hint=", ".join([*RUNNING, "avg"]))
    fields = [f"s{i}_{j}" for i, n in enumerate(names) for j in range(len(parts[n]))]

    def step(_, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else [None] * len(fields)
        rows = pd.concat(list(batches)).sort_values("_time", kind="stable")
        out: dict[str, list] = {n: [] for n in names}
        for at in range(len(rows)):
            k = 0
            for n in names:
                how, column = aggs[n]
                v = rows[column].iat[at]
                for part in parts[n]:
                    if not pd.isna(v):
                        held[k] = float(RUNNING[part](held[k], float(v) if part != "count" else 1))
                    k += 1
                total = held[k - 2] / held[k - 1] if how == "avg" and held[k - 1] else held[k - 1] if how != "avg" else None
                out[n].append(total if total is not None or how != "count" else 0.0)
        state.update(tuple(held))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1_000))
        yield rows.assign(**out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + "".join(f", `{n}` double" for n in names)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, ", ".join(f"{f} double" for f in fields), "append", timeout)


def tail(batch: DataFrame, stream: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the last n rows that are there, the stream's rows that are later than all of those)."""
    last = batch.orderBy(F.col("_time").desc_nulls_last()).limit(n)
    seen = batch.agg(F.max("_time").alias("t")).first()["t"]
    return last.orderBy("_time"), stream.filter(F.col("_time") > F.lit(seen)) if seen is not None else stream


def keep_view(stream: DataFrame, engine, name: str, checkpoint: str):
    """A stream that appends each micro-batch's partial results to a materialized view; a batch that is tried again replaces itself."""

    def add(rows: DataFrame, number: int) -> None:
        engine.append_to_view(name, rows, f"stream {number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
