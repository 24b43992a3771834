"""The one entry point: text in, DataFrame out.

    engine = Engine(spark)
    engine.catalog.add("events", spark.read.parquet(path), time="ts", order=("event_id",))
    engine.query('from events | where value > 3 | stats count() as n by user_id | sort -n | head 5')
    engine.table("events").where("value > 3").stats("count() as n by user_id").result()
"""

from __future__ import annotations

import datetime as dt
import re
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.analysis import ANALYSIS, compare
from brindle.operators.stages import ORD, STAGE_FUNCTIONS, Frame, join, orderable, partial, union
from brindle.plans.binding import predicate
from brindle.plans.saved import Saved
from brindle.plans.shared import work_path
from brindle.plans.syntax import STAGES, UNITS, Query, QueryError, Stage, parse, parse_expr, parse_stage
from brindle.plans.views import Views
from brindle.sources import sinks
from brindle.sources.catalog import Catalog

_SNAP = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week"}


def instant(text: str, now: dt.datetime) -> dt.datetime:
    """A bound of a time range: -1h, -1h@h, @d, now, a date and time, or epoch seconds."""
    text = text.strip()
    if text in ("", "now"):
        return now
    m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?(?:ns|us|ms|s|m|h|d|w))?(?:@(s|m|h|d|w))?", text)
    if m and (m[1] or m[2]):
        out = now
        if m[1]:
            n, unit = re.match(r"([+-]?[\d.]+)(\w+)", m[1]).groups()
            sign = 1 if m[1][0] in "+-" else -1  # 15m means 15 minutes ago
            out = out + dt.timedelta(microseconds=sign * float(n) * UNITS[unit])
        return snapped(out, m[2]) if m[2] else out
    if re.fullmatch(r"\d{9,11}(?:\.\d+)?", text):
        return dt.datetime.fromtimestamp(float(text), dt.UTC)
    try:
        out = dt.datetime.fromisoformat(text.strip('"').replace("Z", "+00:00"))
    except ValueError:
        raise QueryError(f"{text!r} isn't a time", hint="-1h, @d, 2026-01-31T12:00:00Z or epoch seconds") from None
    return out if out.tzinfo else out.replace(tzinfo=dt.UTC)


def snapped(t: dt.datetime, unit: str) -> dt.datetime:
    if unit == "w":
        t = t - dt.timedelta(days=t.weekday())
        unit = "d"
    cut = {"s": {}, "m": {"second": 0}, "h": {"minute": 0, "second": 0}, "d": {"hour": 0, "minute": 0, "second": 0}}[unit]
    return t.replace(microsecond=0, **cut)


def bounds(text: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """[-1h], [-7d..-1d], [@d], [-1h][@h] and a pair of instants."""
    if "][" in text:
        a, b = text.split("][", 1)
        return instant(a + b if b.startswith("@") else a, now), now
    low, _, high = text.partition("..") if ".." in text else text.partition(",")
    return instant(low, now), instant(high, now)


class Engine:
    def __init__(self, spark: SparkSession, now: dt.datetime | None = None, default: str = "main", store: str | None = None, approximate: bool = False):
        """approximate: percentiles and distinct counts by sketches of bounded size, for groups with too many values to hold."""
        self.spark, self.now, self.default, self.approximate = spark, now, default, approximate
        self.catalog = Catalog(spark)
        self.fragments, self.saved = Saved(spark, store, "fragments"), Saved(spark, store, "saved")
        self.views = Views(spark, store)
        self.warnings: list[str] = []
        #: The last queries of this engine: text, start and seconds until bound.
        self.history: deque[tuple[str, dt.datetime, float]] = deque(maxlen=1_000)

    # queries
    def query(self, text: str, since: str | None = None, until: str | None = None) -> DataFrame:
        return self.frame(text, since, until).result()

    def frame(self, text: str, since: str | None = None, until: str | None = None, dry: bool = False) -> Frame:
        """dry: stages that write (tee, materialize) write nothing."""
        tree = parse(text)
        now = self.now or dt.datetime.now(dt.UTC)
        self.warnings = []
        moving = any(t and instant(t, now) != instant(t, now + dt.timedelta(days=1)) for t in (since, until))
        begun = dt.datetime.now(dt.UTC)
        found = Run(self, now, instant(since, now) if since else None, instant(until, now) if until else None, dry=dry, moving=moving).query(tree)
        self.history.append((text, begun, (dt.datetime.now(dt.UTC) - begun).total_seconds()))
        return found

    def explain(self, text: str) -> str:
        """The stages as understood, and Spark's plan for them; nothing is written."""
        tree = parse(text)
        lines = [f"let ${n}: " + " | ".join(s.text for s in ss) for n, ss in tree.lets.items()]
        plan = self.frame(text, dry=True).result()._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join([*lines, *(f"{i}. {s.text}" for i, s in enumerate(tree.stages, 1)), plan])

    def analyze(self, text: str) -> str:
        """Runs a query, without bringing its rows here, and tells what each node of the plan did."""
        execution = self.frame(text, dry=True).result()._jdf.queryExecution()
        execution.toRdd().count()
        lines: list[str] = []

        def walk(node, depth: int) -> None:
            kind = node.getClass().getSimpleName()
            inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
            if inner is not None:
                return walk(inner, depth)
            found = []
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if m._2().value() > 0:
                    found.append(f"{m._1()}={m._2().value()}")
            lines.append("  " * depth + node.nodeName() + (f" ({', '.join(sorted(found))})" if found else ""))
            children = node.children().iterator()
            while children.hasNext():
                walk(children.next(), depth + 1)

        walk(execution.executedPlan(), 0)
        return "\n".join(lines)

    def table(self, name: str) -> Pipe:
        return Pipe(self, f"from {name}")

    def run_saved(self, name: str) -> DataFrame:
        return self.query(self.saved[name])

    # thin verbs
    def count(self, text: str) -> int:
        return self.query(text).count()

    def sample(self, source: str, n: int = 10) -> DataFrame:
        return self.query(f"from {source} | head {n}")

    def fields(self, source: str) -> DataFrame:
        return self.query(f"from {source} | describe")

    def top(self, source: str, field: str, n: int = 10) -> DataFrame:
        return self.query(f"from {source} | top {n} {field}")

    def diff(self, text: str, span: str) -> DataFrame:
        return self.query(f"{text} | compare previous {span}")

    def histogram(self, source: str, span: str, by: str | None = None) -> DataFrame:
        return self.query(f"from {source} | every {span} {f'by {by} ' if by else ''}stats count() as count | sort _time")

    def tail(self, source: str, n: int = 10) -> DataFrame:
        return self.query(f"from {source} | tail {n}")

    def watch(self, text: str, times: int, seconds: float = 5.0):
        """The result of a query, run again and again."""
        import time

        for i in range(times):
            if i:
                time.sleep(seconds)
            yield self.query(text)

    def columns(self) -> DataFrame:
        """source, field and type of every registered source."""
        rows = [(n, f, t) for n in self.catalog.names() for f, t in self.catalog.open(n).df.dtypes]
        return self.spark.createDataFrame(rows, "source string, field string, type string")

    def parts(self) -> DataFrame:
        """source, path, size_bytes, modified and event_count of every file behind a registered source."""
        out = self.spark.createDataFrame([], "source string, path string, size_bytes bigint, modified timestamp, event_count bigint")
        for name in self.catalog.names():
            df = self.catalog.open(name).given
            if df is not None and df.inputFiles():
                m = "_metadata.file_"
                files = df.groupBy(F.col(f"{m}path").alias("path"), F.col(f"{m}size").alias("size_bytes"), F.col(f"{m}modification_time").alias("modified")).agg(F.count("*").alias("event_count"))
                out = out.unionByName(files.select(F.lit(name).alias("source"), "path", "size_bytes", "modified", "event_count"))
        return out

    def queries(self) -> DataFrame:
        """text, _time and bind_seconds of this engine's last queries."""
        return self.spark.createDataFrame(list(self.history), "text string, _time timestamp, bind_seconds double")

    def refresh_view(self, name: str) -> None:
        """Run a view's own query again over all rows."""
        v = self.views._get(name)
        since, until = ((dt.datetime.fromisoformat(b) if b else None for b in v.bounds) if v.bounds and v.stages[0].args["range"] is None else (None, None))
        run = Run(self, self.now or dt.datetime.now(dt.UTC), since, until)
        self.views.refresh(name, run.stored(v.stages), run.stamp(v.stages[0]))

    def append_to_view(self, name: str, rows: DataFrame, batch: str) -> None:
        """Rows of a view's source as one more batch of it; a batch given again replaces itself."""
        v = self.views._get(name)
        run = Run(self, self.now or dt.datetime.now(dt.UTC))
        self.views.append(name, run.stored(v.stages, Frame(rows, run.now, approximate=self.approximate)), batch)

    def backfill(self, name: str, since: str, until: str) -> None:
        """A view's query over a time range of its source, as a batch of that range; in slices, again and in any order."""
        now = self.now or dt.datetime.now(dt.UTC)
        low, high = instant(since, now), instant(until, now)
        run = Run(self, now, low, high - dt.timedelta(microseconds=1))
        first, *rest = self.views._get(name).stages
        whole = Stage(first.name, {**first.args, "range": None}, first.text)  # the slice counts, not the view's own range
        self.views.append(name, run.stored([whole, *rest]), f"backfill {low.isoformat()} {high.isoformat()}")

    def sources(self) -> DataFrame:
        return self.spark.createDataFrame([(n, ", ".join(self.catalog.open(n).df.columns)) for n in self.catalog.names()], "source string, fields string")


#: Tables that an engine keeps about itself.
SYSTEM = {"system.columns": Engine.columns, "system.parts": Engine.parts, "system.queries": Engine.queries, "system.views": lambda e: e.spark.createDataFrame([(v["name"], v["query"], v["mergeable"], v["created"]) for v in e.views.list()], "name string, query string, mergeable boolean, created string")}


class Pipe:
    """The same stages as methods; each takes its arguments as the language spells them."""

    def __init__(self, engine: Engine, text: str):
        self.engine, self.text = engine, text

    def __getattr__(self, name: str):
        if name not in STAGES or name == "from":
            raise AttributeError(name)

        def add(arguments: str = "") -> Pipe:
            stage = f"{name} {arguments}".strip()
            parse_stage(stage)  # fails here rather than at the end
            return Pipe(self.engine, f"{self.text} | {stage}")

        return add

    def result(self) -> DataFrame:
        return self.engine.query(self.text)


class Run:
    """One query being bound, stage by stage: what a stage makes decides what the next may name."""

    def __init__(self, engine: Engine, now: dt.datetime, since=None, until=None, shift: dt.timedelta = dt.timedelta(0), dry: bool = False, moving: bool = False):
        """dry: nothing is written; moving: since and until depend on the time of the query."""
        self.e, self.now, self.since, self.until, self.shift, self.dry, self.moving = engine, now, since, until, shift, dry, moving
        self.lets: dict[str, list[Stage]] = {}
        self.made: dict[str, Frame] = {}

    def query(self, tree: Query) -> Frame:
        self.lets = tree.lets
        return self.pipeline(tree.stages)

    def let(self, name: str) -> Frame:
        name = name.lstrip("$")
        if name not in self.lets:
            raise QueryError(f"${name} isn't defined")
        if name not in self.made:
            stages, self.lets = self.lets[name], {k: v for k, v in self.lets.items() if k != name}
            self.made[name] = self.pipeline(stages)
            self.lets[name] = stages
        return self.made[name]

    def sub(self, spec) -> Frame:
        return self.let(spec) if isinstance(spec, str) else self.pipeline(spec)

    def pipeline(self, stages: list[Stage]) -> Frame:
        stages = self.spliced(stages)
        if stages[0].name != "from":
            stages = [Stage("from", {"sources": [self.e.default], "range": None, "search": None}, "from " + self.e.default), *stages]
        found = self.e.views.rewrite(stages, self.absolute(stages), lambda: self.stamp(stages[0])) if not self.shift and self.e.views.known else None
        if found is not None:
            f, rest = Frame(found[0], self.now, keys=found[1]), found[2]
        else:
            f, rest = self.scan(stages[0]), 1
        for i in range(rest, len(stages)):
            self.before = before if i > rest else None
            before, f = f, self.stage(f, stages, i)
        return f

    def absolute(self, stages: list[Stage]) -> list[str | None] | None:
        """The time bounds of a pipeline; None if they depend on the time of the query, or if it reads more than named sources."""
        if stages[0].args["sources"][0].startswith("$") or any(s.name in ("join", "union", "compare") for s in stages):
            return None
        text = stages[0].args["range"]
        if text is None:
            return None if self.moving else [t.isoformat() if t else None for t in (self.since, self.until)]
        found = bounds(text, self.now)
        return [t.isoformat() for t in found] if found == bounds(text, self.now + dt.timedelta(days=1, hours=1)) else None

    def stamp(self, first: Stage) -> str | None:
        """What tells one state of the sources of a query from another: their files and sizes, else their plan."""
        import hashlib

        if first.args["sources"][0] in SYSTEM:
            return None
        df = self.e.catalog.resolve(first.args["sources"]).df
        files = sorted(df.inputFiles())
        size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return hashlib.sha256("\n".join([*files, size] if files else [str(df.semanticHash())]).encode()).hexdigest()

    def stored(self, stages: list[Stage], rows: Frame | None = None) -> DataFrame:
        """What a view of these stages stores for the source's rows, or for the rows given."""
        f = rows if rows is not None else self.scan(stages[0])
        for i in range(1, len(stages) - 1):
            f = self.stage(f, stages, i)
        last = stages[-1]
        if last.name == "stats" and (made := partial(f, last.args["aggs"], last.args["by"])) is not None:
            return made[0].result()
        return self.stage(f, stages, len(stages) - 1).result() if len(stages) > 1 else f.result()

    def spliced(self, stages: list[Stage]) -> list[Stage]:
        out: list[Stage] = []
        for s in stages:
            if s.name == "use":
                name = s.args["fragment"]
                if name not in self.e.fragments:
                    raise QueryError(f"there is no fragment {name}")
                out += parse(self.e.fragments[name]).stages
            else:
                out.append(s)
        return out

    def scan(self, s: Stage) -> Frame:
        names = s.args["sources"]
        if names[0].startswith("$"):
            f = self.let(names[0])
        elif len(names) == 1 and names[0] in SYSTEM and names[0] not in self.e.catalog.names():
            f = Frame(SYSTEM[names[0]](self.e), self.now)
        elif len(names) == 1 and self.e.views.has(names[0]) and names[0] not in self.e.catalog.names():
            f = Frame(self.e.views.read(names[0]), self.now)
        else:
            src = self.e.catalog.resolve(names)
            df = src.df
            order = [c for c in ("_time", *src.order) if c in df.columns and orderable(df.schema[c].dataType)]
            if order:
                df = df.withColumn(ORD, F.struct(*(F.col(f"`{c}`") for c in order)))
            f = Frame(df, self.now, "_raw" if src.json else None, approximate=self.e.approximate)
        low, high = (bounds(s.args["range"], self.now) if s.args["range"] else (self.since, self.until))
        if (low or high) and "_time" in f.columns:
            # events without a time are kept
            t, test = F.col("_time"), F.lit(True)
            if low:
                test = test & (t >= F.lit(low - self.shift))
            if high:
                test = test & (t <= F.lit(high - self.shift))
            f = f.to(f.df.filter(t.isNull() | test))
        if s.args["search"] is not None:
            f = f.to(f.df.filter(predicate(s.args["search"], f.scope())))
        return f

    def stage(self, f: Frame, stages: list[Stage], i: int) -> Frame:
        s = stages[i]
        if s.name in STAGE_FUNCTIONS:
            return STAGE_FUNCTIONS[s.name](f, s.args)
        if s.name in ANALYSIS:
            return ANALYSIS[s.name](f, s.args)
        if s.name == "join":
            return join(f, self.sub(s.args["right"]), s.args["on"], s.args["type"])
        if s.name == "union":
            return union(f, [self.sub(o) for o in s.args["others"]])
        if s.name == "compare":
            if stages[0].args.get("range") is None and not (self.since or self.until):
                raise QueryError("compare needs a time range", hint="from name[-1h]")
            shift = dt.timedelta(microseconds=int(s.args["shift"]))
            before = Run(self.e, self.now, self.since, self.until, self.shift + shift, dry=True)
            before.lets = self.lets
            return compare(f, before.pipeline(stages[:i]), int(s.args["shift"]))
        if s.name == "tee":
            if self.dry:
                return f
            # computed once: the rows written are those that go on
            at = work_path(self.e.spark, "tee")
            f.df.write.parquet(at)
            f = f.to(self.e.spark.read.parquet(at), sorted_by=f.sorted_by)
            sinks.write(f.result(), s.args["path"])
            return f
        if s.name == "materialize":
            if i != len(stages) - 1:
                raise QueryError("materialize must come last")
            if not self.dry:
                self.materialize(f, stages[:i], s.args)
            return f
        raise QueryError(f"{s.name} isn't a stage here")

    def materialize(self, f: Frame, stages: list[Stage], a: dict) -> None:
        last = stages[-1]
        options = {"partition_by": a.get("partition_by"), "retention": a.get("retention"), "bounds": self.absolute(stages), "stamp": None if stages[0].args["sources"][0].startswith("$") else self.stamp(stages[0])}
        made = partial(self.before, last.args["aggs"], last.args["by"]) if last.name == "stats" and self.before is not None else None
        if made is None:
            df = f.result()
            self.e.views.create(a["name"], stages, df, df.columns, **options)
        else:
            self.e.views.create(a["name"], stages, made[0].result(), f.columns, made[1], made[0].keys, **options)


def check(text: str) -> None:
    """Raises QueryError if text isn't a query."""
    parse(text)


__all__ = ["Engine", "Frame", "Pipe", "QueryError", "check", "parse", "parse_expr"]
