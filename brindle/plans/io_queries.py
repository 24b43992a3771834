"""Queries of what surrounds the stages: readers and sinks, streams, views over time, verbs and texts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.plans.queries import NOW, engine
from brindle.plans.shared import read_table, work_path
from brindle.sources import ingest, readers, sinks


def _events(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).query("from events | keep event_id, user_id, event_type, value")


def sink_formats(spark: SparkSession, d: str) -> DataFrame:
    """The same rows written in each format and read back."""
    df, out = _events(spark, d), None
    for how in ("json", "csv", "tsv", "parquet", "orc"):
        at = work_path(spark, "sink")
        sinks.write(df, at, how)
        schema = "event_id bigint, user_id bigint, event_type string, value double"
        back = spark.read.schema(schema).json(at) if how == "json" else spark.read.schema(schema).option("header", True).option("sep", "\t" if how == "tsv" else ",").csv(at) if how in ("csv", "tsv") else spark.read.format(how).load(at)
        one = back.agg(F.count("*").alias("n"), F.sum("user_id").alias("u"), F.countDistinct("event_type").alias("t"), F.round(F.sum("value"), 2).alias("v")).withColumn("format", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out.select("format", "n", "u", "t", "v")


def reader_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with a time key: fields, _raw and _time."""
    at = work_path(spark, "lines")
    read_table(spark, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")).write.json(at)
    found = readers.read_json_lines(spark, at)
    return found.groupBy("event_type", F.date_format("_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("event_id").alias("s"), F.count_if(F.col("_raw").startswith("{")).alias("raw"))


def reader_collector(spark: SparkSession, d: str) -> DataFrame:
    """Collector objects, one a line, with time in seconds. Sums of times are exact: bigint, or a decimal if one lies beyond it, where the SQL's cast fails."""
    at = work_path(spark, "collector")
    rows = read_table(spark, d, "events").select(F.col("event_type").alias("event"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("decimal(20,6)").alias("time"), F.concat(F.lit("h"), "user_id").alias("host"), F.when(F.col("event_id") % 2 == 0, F.lit("web")).alias("index"))
    rows.write.json(at)
    # some 5,400 times of today in microseconds pass the range of bigint
    sums = readers.read_collector(spark, at).groupBy(F.col("_raw").alias("event_type"), "index").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.sum(F.unix_micros("_time").cast("decimal(28,0)")).alias("t"))
    done = work_path(spark, "sums")
    sums.write.parquet(done)
    found = spark.read.schema(sums.schema).parquet(done)
    beyond = found.filter(F.col("t").isNotNull() & F.col("t").try_cast("bigint").isNull())
    return found.withColumn("t", F.col("t").cast("bigint")) if beyond.isEmpty() else found


def reader_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Action and document lines in turn, in several files."""
    at = work_path(spark, "bulk")
    lines = read_table(spark, d, "events").select(F.concat(F.lit('{"index": {"_index": "'), "event_type", F.lit('"}}\n{"v": '), "event_id", F.lit("}")).alias("value"))
    lines.repartition(4).write.text(at)
    return readers.read_bulk(spark, at).groupBy("index").agg(F.count("*").alias("n"), F.sum(F.get_json_object("_raw", "$.v").cast("bigint")).alias("s"))


def reader_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of several lines: as many further lines as the identifier modulo 4 says."""
    at = work_path(spark, "entries")
    more = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda i: F.when(i == 0, F.concat(F.lit("at "), F.col("event_id").cast("string"))).otherwise(F.lit("  more"))), "\n")
    read_table(spark, d, "events").select(more.alias("value")).repartition(3).write.text(at)
    entries = readers.read_entries(spark, at, "^at ")
    return entries.select(F.size(F.split("_raw", "\n")).alias("lines"), F.regexp_extract("_raw", r"^at (\d+)", 1).cast("bigint").alias("id")).groupBy("lines").agg(F.count("*").alias("n"), F.sum("id").alias("s"))


def ingest_stages(spark: SparkSession, d: str) -> DataFrame:
    """Syslog lines on their way in: fields of the format, pairs, and an index by rules."""
    lines = read_table(spark, d, "raw_lines").filter(F.col("event").startswith("<")).select(F.col("event").alias("_raw"))
    rows = ingest.with_pairs(ingest.with_format(lines, "syslog"))
    routed = ingest.routed(rows, [(F.col("severity") <= 3, "errors"), (F.col("fields")["took"].isNotNull(), "slow")])
    return routed.groupBy("index", "facility").agg(F.count("*").alias("n"))


def implicit_source(spark: SparkSession, d: str) -> DataFrame:
    """A text without from reads the default source, here a DataFrame in memory."""
    e = Engine(spark, now=NOW)
    e.catalog.add("main", read_table(spark, d, "orders").cache(), time="o_orderdate")
    return e.query("where o_totalprice > 100000.0 | stats count() as n by o_orderstatus")


def verbs(spark: SparkSession, d: str) -> DataFrame:
    """Stages as methods, and the histogram of a source."""
    e = engine(spark, d)
    made = e.table("events").where("value > 10.0").stats("count() as count by event_type").result().withColumnRenamed("event_type", "name")
    return made.unionByName(e.histogram("events", "1d").select(F.date_format("_time", "yyyy-MM-dd").alias("name"), "count"))


def source_columns(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a source as the system table lists them."""
    return engine(spark, d).columns().filter("source = 'nation'").select("field", "type")


def system_parts(spark: SparkSession, d: str) -> DataFrame:
    """The files behind a source, and their rows."""
    return engine(spark, d).query('from system.parts | where source in ("events", "lineitem") | stats sum(event_count) as n, count() as files by source')


def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    """A result as texts for people, line by line."""
    df = engine(spark, d).query("from nation | sort n_nationkey | keep n_nationkey, n_name")
    rows = [(how, i, line) for how in ("csv", "tsv", "line", "ndjson") for i, line in enumerate(sinks.render(df, how).split("\n"))]
    return spark.createDataFrame(rows, "how string, i bigint, line string").filter("not (how in ('csv', 'tsv') and i = 0)").select("how", "line")


def saved_query(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.saved["busy"] = "from events | stats count() as n by user_id | where n > 5"
    return e.run_saved("busy")


def view_batches(spark: SparkSession, d: str) -> DataFrame:
    """A view of the first half of the events, to which the second is appended, the last batch twice, and which is read by fewer keys."""
    whole = read_table(spark, d, "events")
    e = Engine(spark, now=NOW)
    e.catalog.add("events", whole.filter("event_id % 2 = 0"), time="ts", order=("event_id",))
    e.query('from events | stats count() as n, avg(value) as a, max(value) as m by event_type, user_id | materialize "v"')
    rest = whole.filter("event_id % 2 = 1").withColumn("_time", F.col("ts"))
    for batch, part in (("one", 1), ("two", 3), ("two", 3)):
        e.append_to_view("v", rest.filter(f"event_id % 4 = {part}"), batch)
    return e.query("from v | stats sum(n) as n, max(m) as m by event_type")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read_table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("_time", F.col("ts").cast("timestamp"))


def _finished(spark: SparkSession, out: DataFrame, schema: str) -> DataFrame:
    at = work_path(spark, "stream")
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def live_rows(spark: SparkSession, d: str) -> DataFrame:
    """Row-wise stages on a stream."""
    from brindle.streaming.live import live_query

    out = live_query(_stream(spark, d), "from events | where value > 50.0 | extend v = round(value * 2.0, 4) | keep event_id, v")
    return _finished(spark, out, "event_id bigint, v double")


def live_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row for each key within the watermark, which is longer than the data here."""
    from brindle.streaming.live import live_query

    out = live_query(_stream(spark, d), "from events | dedup user_id | keep user_id", watermark="1000 days")
    return _finished(spark, out, "user_id bigint")


def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a stream, once the watermark has passed their end."""
    from brindle.streaming.live import session_counts

    out = session_counts(_stream(spark, d), "30 minutes", ["user_id"], "0 seconds")
    found = _finished(spark, out, "user_id bigint, session_start timestamp, session_end timestamp, eventcount bigint")
    return found.select("user_id", F.unix_micros("session_start").alias("t"), "eventcount")


def live_running(spark: SparkSession, d: str) -> DataFrame:
    """The last running count and sum of each key of a stream."""
    from brindle.streaming.live import running

    out = running(_stream(spark, d).select("_time", "user_id", "value"), ["user_id"], {"n": ("count", "value"), "s": ("sum", "value")})
    return _finished(spark, out, "user_id bigint, n double, s double").groupBy("user_id").agg(F.max("n").cast("bigint").alias("n"), F.round(F.max_by("s", "n"), 3).alias("s"))


QUERIES = {f.__name__: f for f in (sink_formats, reader_json_lines, reader_collector, reader_bulk, reader_entries, ingest_stages, implicit_source, verbs, source_columns, system_parts, shown_texts, saved_query, view_batches, live_rows, live_dedup, live_sessions, live_running)}
_SYSLOG = "CAST(regexp_extract(event, '^<(\\d+)>', 1) AS INT)"
ORACLES: dict[str, str] = {
    "sink_formats": "SELECT f AS format, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS u, count(DISTINCT event_type) AS t, round(sum(value), 2) AS v FROM events, (VALUES ('json'), ('csv'), ('tsv'), ('parquet'), ('orc')) x(f) GROUP BY 1",
    "reader_json_lines": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s, count(*) AS raw FROM events GROUP BY 1, 2",
    "reader_collector": "SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'main' END AS \"index\", count(*) AS n, count(DISTINCT user_id) AS hosts, CAST(sum(epoch_us(ts)) AS BIGINT) AS t FROM events GROUP BY 1, 2",
    "reader_bulk": "SELECT event_type AS \"index\", count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY 1",
    "reader_entries": "SELECT CAST(event_id % 4 + 1 AS INT) AS lines, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY 1",
    "ingest_stages": f"SELECT CASE WHEN {_SYSLOG} % 8 <= 3 THEN 'errors' WHEN event LIKE '% took=%' THEN 'slow' ELSE 'main' END AS \"index\", {_SYSLOG} // 8 AS facility, count(*) AS n FROM raw_lines WHERE event LIKE '<%' GROUP BY 1, 2",
    "implicit_source": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1",
    "verbs": "SELECT event_type AS name, count(*) AS count FROM events WHERE value > 10 GROUP BY 1 UNION ALL SELECT strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 1",
    "source_columns": "SELECT * FROM (VALUES ('n_nationkey', 'bigint'), ('n_name', 'string'), ('n_regionkey', 'bigint')) t(field, type)",
    "system_parts": "SELECT 'events' AS source, CAST(count(*) AS DOUBLE) AS n, 1 AS files FROM events UNION ALL SELECT 'lineitem', CAST(count(*) AS DOUBLE), 1 FROM lineitem",
    "shown_texts": "SELECT 'csv' AS how, n_nationkey || ',' || n_name AS line FROM nation UNION ALL SELECT 'tsv', n_nationkey || chr(9) || n_name FROM nation UNION ALL SELECT 'line', 'n_nationkey=' || n_nationkey || ' n_name=' || n_name FROM nation UNION ALL SELECT 'ndjson', '{\"n_nationkey\": ' || n_nationkey || ', \"n_name\": \"' || n_name || '\"}' FROM nation",
    "saved_query": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 5",
    "view_batches": "SELECT event_type, CAST(count(*) AS DOUBLE) AS n, max(value) AS m FROM events GROUP BY 1",
    "live_rows": "SELECT event_id, round(value * 2, 4) AS v FROM events WHERE value > 50",
    "live_dedup": "SELECT DISTINCT user_id FROM events",
    "live_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, epoch_us(min(ts)) AS t, count(*) AS eventcount FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events)",
    "live_running": "SELECT user_id, count(value) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1",
}
