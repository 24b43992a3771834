"""Queries of the data-engineering problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import compaction, dedup, instants, nesting, templates
from brindle.plans.shared import read_table, small_side


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return templates.found_entries(spark, read_table(spark, d, "raw_lines"))


def _timed(found: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """The stated timestamp as one UTC instant, read in the zone of the source."""
    sources = read_table(spark, d, "log_sources").select("source", F.col("tz").alias("__tz"), F.col("date_order").alias("__order"))
    joined = found.join(small_side(sources), "source", "left")
    out = instants.with_instant(joined, F.col("stamp"), F.col("__tz"), F.col("__order"), F.col("received_at"))
    return out.withColumn("utc", F.timestamp_micros("utc_us")).drop("utc_us", "__tz", "__order")


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    """Whole entries of raw_lines: utc, log_level, component, message."""
    return _timed(templates.entries(spark, read_table(spark, d, "raw_lines")), spark, d)


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    """The entries that ingest_events holds whole: utc, log_level, component, message."""
    rows = read_table(spark, d, "ingest_events").select("row_id", "source", "received_at", "event")
    return _timed(templates.whole_entries(spark, rows), spark, d)


def p1_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates of raw_lines: constant and variable slots, lines of each, whether they begin entries."""
    return templates.template_report(spark, read_table(spark, d, "raw_lines").select("line_id", "event"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_pairs(read_table(spark, d, "ingest_events"))


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first_delivery(spark, f"{d}/ingest_events.parquet")


def p2_kept_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries and kept messages of each source."""
    kept = p2_kept(spark, d).groupBy("source").agg(F.count("*").alias("n_kept"))
    return read_table(spark, d, "ingest_events").groupBy("source").agg(F.count("*").alias("n")).join(kept, "source", "left").select("source", "n", "n_kept")


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the entries of raw_lines begin, how long they are and what their levels are."""
    return p1_found(spark, d).select("line_id", "n_lines", "log_level")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The links of all flat tables."""
    return nesting.FlatTables.write(spark, nesting.triples(read_table(spark, d, "nested_events"))).links()


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables below each other: table, keys and the leaves as a JSON object in document order."""
    rows = nesting.grouped(nesting.triples(read_table(spark, d, "nested_events")))
    return rows.select("table", "row_id", "origin", "record", "parent", "parent_path", "path", F.size("leaves").alias("n_leaves"), F.to_json("leaves").alias("leaves"))


def p4_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of every flat table, with how many values each holds."""
    return nesting.FlatTables.write(spark, nesting.triples(read_table(spark, d, "nested_events"))).columns


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """One flat table opened: the entries of transactions, pivoted, with the keys of their parents."""
    return nesting.FlatTables.write(spark, nesting.triples(read_table(spark, d, "nested_events"))).open("$.txn.entries[]")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    inputs, _, _ = compaction.consolidate(spark, read_table(spark, d, "ingest_events"), read_table(spark, d, "part_files"))
    return inputs.select("part_id")


def p5_layout(spark: SparkSession, d: str) -> DataFrame:
    return compaction.part_layout(spark, read_table(spark, d, "ingest_events"), read_table(spark, d, "part_files"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows in new parts, and rows left where they were."""
    return p5_layout(spark, d).groupBy("rewritten").agg(F.sum("event_count").alias("event_count"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.found_times(read_table(spark, d, "ingest_events"), read_table(spark, d, "log_sources"))


def p6_events(spark: SparkSession, d: str) -> DataFrame:
    return instants.normalise_times(read_table(spark, d, "ingest_events"), read_table(spark, d, "log_sources")).withColumn("event_utc", F.timestamp_micros("utc_us"))


QUERIES = {f.__name__: f for f in (p1_found, p1_entries, p1_events, p1_templates, p1_spans, p2_found, p2_kept, p2_kept_per_source, p4_found, p4_tables, p4_columns, p4_entries, p5_found, p5_layout, p5_totals, p6_found, p6_events)}

_NORM = r"nullif(regexp_replace(regexp_replace(lower(trim({})), '^\s*urn:[a-z0-9][a-z0-9-]*:', ''), '[^\p{{L}}\p{{N}}]+', '', 'g'), '')"
_JSON = "CASE WHEN json_valid({0}) THEN coalesce(json_extract_string({0}, '$.msg_id'), json_extract_string({0}, '$.message_id')) END"
_PAIR = r"""(?:^|[\s|,;\[(])(?:msg_id|message_id)\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s|,;"''\])]+))"""
_IN_EVENT = "CASE WHEN ltrim(event) LIKE '{%' THEN " + _JSON.format("event") + " ELSE " + " || ".join(f"regexp_extract(event, '{_PAIR}', {i})" for i in (1, 2, 3)) + " END"
_IDS = "SELECT row_id, source, coalesce(" + ", ".join(_NORM.format(x) for x in ("msg_id", "(" + _JSON.format("fields_json") + ")", "(" + _IN_EVENT + ")")) + ") AS id FROM ingest_events"
_STARTS = r"""(^(<\d{1,3}>(1 )?)?\[?(\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d|[A-Z][a-z][a-z], \d\d [A-Z][a-z][a-z] \d{4} \d\d:|[A-Z][a-z][a-z] [ \d]\d \d\d:\d\d:\d\d)|^[A-Z]\d{4} \d\d:\d\d:\d\d|^ts=|^\{.*"(ts|timestamp|@timestamp)"\s*:)"""
_RAW_LEVEL = r"""upper(CASE WHEN event LIKE '<%' THEN ['emerg','alert','crit','err','warning','notice','info','debug'][CAST(regexp_extract(event, '^<(\d+)>', 1) AS INT) % 8 + 1]
  WHEN event LIKE '{%' THEN coalesce(json_extract_string(event, '$.level'), json_extract_string(event, '$.lvl'), json_extract_string(event, '$.severity'), '')
  WHEN event LIKE 'ts=%' THEN regexp_extract(event, ' (?:level|lvl)=(\w+)', 1)
  WHEN regexp_matches(event, '^[A-Z]\d{4} ') THEN event[1]
  WHEN regexp_matches(event, '^\S+ \S+ - ') THEN regexp_extract(event, '^\S+ \S+ - .+? - (\w+) - ', 1)
  WHEN regexp_matches(event, '^\S+ \S+ UTC \[') THEN regexp_extract(event, '^\S+ \S+ UTC \[\d+\] .*?([A-Z]+)\d?:  ', 1)
  WHEN regexp_matches(event, '^\[') THEN regexp_extract(event, '^\[[^\]]+\] (\w+) ', 1)
  WHEN regexp_matches(event, '^\S+ \S+ \[\w+\] \d+#') THEN regexp_extract(event, '^\S+ \S+ \[(\w+)\]', 1)
  WHEN regexp_matches(event, '^\S+ \[') THEN regexp_extract(event, '^\S+ \[(\w+)\]', 1)
  ELSE regexp_extract(event, '^\S+ \S+ (\w+) +\[', 1) END)"""
_RAW_COMPONENT = r"""CASE WHEN event LIKE '<%>1 %' THEN nullif(string_split(event, ' ')[4], '-')
  WHEN event LIKE '<%' THEN regexp_extract(event, '\d\d:\d\d:\d\d \S+ ([^\s:\[]+)(?:\[\d+\])?: ', 1)
  WHEN event LIKE '{%' THEN coalesce(json_extract_string(event, '$.component'), json_extract_string(event, '$.logger'), json_extract_string(event, '$.service'))
  WHEN event LIKE 'ts=%' THEN regexp_extract(event, ' (?:component|comp|logger|service)=([\w.-]+)', 1)
  WHEN regexp_matches(event, '^[A-Z]\d{4} ') THEN regexp_extract(event, '^\S+ \S+ +\d+ (\w+)', 1)
  WHEN regexp_matches(event, '^\S+ \S+ - ') THEN regexp_extract(event, '^\S+ \S+ - ([\w. -]+?) - ', 1)
  WHEN regexp_matches(event, '^\S+ \S+ UTC \[') THEN regexp_extract(event, 'UTC \[\d+\] ([\w. -]*?) ?(?:[A-Z]+\d?)?:  ', 1)
  WHEN regexp_matches(event, '^\[') THEN regexp_extract(event, '^\[[^\]]+\] (?:\w+ )?([\w.-]+): ', 1)
  WHEN regexp_matches(event, '^\S+ \S+ (?:\[\w+\] )?\d+#\d+: ') THEN regexp_extract(event, ', module: ([^,\s]+)', 1)
  WHEN regexp_matches(event, '^\S+ \[') THEN regexp_extract(event, '^\S+ (?:\[\w+\] )?\[([^\]]*)\] ', 1)
  ELSE regexp_extract(event, '\[[^\]]*\] (\S+) +- ', 1) END"""
_LEVEL = "CASE WHEN l IN ('TRACE','TRC','T') THEN 'TRACE' WHEN l IN ('DEBUG','DBG','D') THEN 'DEBUG' WHEN l IN ('INFO','INF','NOTICE','LOG','I') THEN 'INFO' WHEN l IN ('WARN','WARNING','WRN','W') THEN 'WARN' WHEN l IN ('ERROR','ERR','E') THEN 'ERROR' WHEN l IN ('FATAL','CRIT','CRITICAL','ALERT','EMERG','PANIC','F') THEN 'FATAL' ELSE '' END"
_PENDING = """WITH RECURSIVE l AS (SELECT part_id, level, event_count, removed_at, inputs FROM part_files QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY listed_at DESC, removed_at IS NOT NULL DESC) = 1),
    e AS (SELECT DISTINCT part_id AS parent, event_count, removed_at IS NULL AS alive, regexp_replace(unnest(regexp_extract_all(inputs, '[A-Za-z0-9_.-]+')), '[.][a-z]+$', '') AS child FROM l WHERE level >= 1),
    c AS (SELECT e.parent FROM e LEFT JOIN l ON l.part_id = e.child GROUP BY e.parent, e.event_count HAVING sum(l.event_count) = e.event_count AND count(*) = count(l.event_count)),
    k AS (SELECT e.* FROM e JOIN c USING (parent)),
    h AS (SELECT child FROM k WHERE alive UNION SELECT k.child FROM h JOIN k ON k.parent = h.child),
    pending AS (SELECT part_id FROM l WHERE level = 0 AND removed_at IS NULL AND part_id NOT IN (SELECT child FROM h)) """
#: Instants that a local time x may be in zone tz: those that read as x there, tried half an hour to two hours around the one that SQL gives.
_INSTANTS = "list_transform(list_filter([-7200000000, -3600000000, -1800000000, 0, 1800000000, 3600000000, 7200000000], lambda w: epoch_us(timezone(tz, make_timestamptz(epoch_us(timezone(tz, make_timestamp(x))) + w))) = x), lambda w: epoch_us(timezone(tz, make_timestamp(x))) + w)"
_ISO = r"\d{4}[-/]\d\d[-/]\d\d[Tt ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?:Z| ?[+-]\d\d:?\d\d| (?:UTC|GMT|CET|CEST|EET|EEST|BST|IST|JST|[ECMP][SD]T|A[EWC][SD]T)\b)?"
_STAMP = _ISO + r"|\d{8}T\d{6}Z|[A-Z][a-z]{2}, \d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|\d{10,19}(?:\.\d+)?"
_TIMES = (r"""WITH s AS (SELECT row_id, epoch_us(received_at) AS rec, year(received_at) AS now, coalesce(tz, 'UTC') AS tz, lower(date_order) AS o, trim(event_time) AS sent, event FROM ingest_events e LEFT JOIN log_sources l USING (source)),
t AS (SELECT row_id, rec, now, tz, o, CASE WHEN sent IS NOT NULL AND lower(sent) NOT IN ('', '-', 'null', 'none', 'n/a', 'unknown') THEN sent
  WHEN ltrim(event) LIKE '{%' AND json_valid(event) THEN coalesce(json_extract_string(event, '$.timestamp'), json_extract_string(event, '$.ts'), json_extract_string(event, '$."@timestamp"'), json_extract_string(event, '$.time'))
  ELSE coalesce(nullif(regexp_extract(event, '^(?:<\d+>(?:1 )?)?\[?(?:ts=)?(@@S)', 1), ''), nullif(regexp_extract(event, '^[IWEFD](\d{4} \d\d:\d\d:\d\d\.\d+)', 1), ''), nullif(regexp_extract(event, '^\S+ \S+ \S+ \[(\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})\]', 1), '')) END AS t FROM s),
p AS (SELECT *, regexp_full_match(t, '\d{9,19}(\.\d+)?') AS bare,
  regexp_extract(t, '(?:^|[T :])(\d\d):?(\d\d):?(\d\d)(?:[.,](\d+))?(?: ?[AP]M)?(?:Z| ?[+-]\d\d:?\d\d| [A-Z]{3,5})?$', ['h', 'm', 's', 'f']) AS k, regexp_extract(t, ' ([AP])M', 1) AS half,
  regexp_extract(t, '([+-]\d\d):?(\d\d)$', ['h', 'm']) AS z, regexp_matches(t, '\dZ$') AS zulu, regexp_extract(t, ' ([A-Z]{3,5})$', 1) AS abbr,
  CASE WHEN regexp_matches(t, '^\d{4}[-/]') THEN [t[1:4] || '-' || t[6:7] || '-' || t[9:10]] WHEN regexp_matches(t, '^\d{8}T') THEN [t[1:4] || '-' || t[5:6] || '-' || t[7:8]]
    WHEN regexp_matches(t, '^\d\d\.\d\d\.\d{4}') THEN [t[7:10] || '-' || t[4:5] || '-' || t[1:2]]
    WHEN regexp_matches(t, '^\d\d/\d\d/\d{4}') THEN (CASE WHEN o = 'dmy' THEN [t[7:10] || '-' || t[4:5] || '-' || t[1:2]] WHEN o = 'mdy' THEN [t[7:10] || '-' || t[1:2] || '-' || t[4:5]] ELSE [t[7:10] || '-' || t[4:5] || '-' || t[1:2], t[7:10] || '-' || t[1:2] || '-' || t[4:5]] END)
    WHEN regexp_matches(t, '^\d\d/[A-Z]') THEN [strftime(strptime(t[1:11], '%d/%b/%Y'), '%Y-%m-%d')] WHEN regexp_matches(t, '^[A-Z][a-z]{2}, ') THEN [strftime(strptime(t[6:16], '%d %b %Y'), '%Y-%m-%d')]
    WHEN regexp_matches(t, '^[A-Z][a-z]{2} ') THEN list_transform([now - 1, now, now + 1], lambda y: strftime(strptime(y || ' ' || t[1:3] || ' ' || trim(t[5:6]), '%Y %b %d'), '%Y-%m-%d'))
    WHEN regexp_matches(t, '^\d{4} ') THEN list_transform([now - 1, now, now + 1], lambda y: y || '-' || t[1:2] || '-' || t[3:4]) END AS days FROM t WHERE t IS NOT NULL),
q AS (SELECT row_id, rec, tz, bare, t, upper(abbr) AS abbr, CASE WHEN zulu THEN 0 WHEN z.h <> '' THEN (CASE WHEN z.h[1] = '-' THEN -1 ELSE 1 END) * (abs(TRY_CAST(z.h AS INT)) * 60 + TRY_CAST(z.m AS INT)) END AS off,
  list_transform(list_filter(list_transform(days, lambda x: try_cast(x AS DATE)), lambda x: x IS NOT NULL), lambda x: epoch_us(CAST(x AS TIMESTAMP)) + ((TRY_CAST(nullif(k.h, '') AS BIGINT) % (CASE WHEN half = '' THEN 24 ELSE 12 END) + (CASE WHEN half = 'P' THEN 12 ELSE 0 END)) * 3600 + TRY_CAST(nullif(k.m, '') AS BIGINT) * 60 + TRY_CAST(nullif(k.s, '') AS BIGINT)) * 1000000 + TRY_CAST(rpad(k.f, 6, '0')[1:6] AS BIGINT)) AS loc FROM p),
c AS (SELECT row_id, rec, bare, t, CASE WHEN off IS NOT NULL THEN list_transform(loc, lambda x: x - off * 60000000::BIGINT) ELSE flatten(list_transform(loc, lambda x: (CASE
    WHEN len(@@I) = 0 THEN [epoch_us(timezone(tz, make_timestamp(x - 86400000000))) + 86400000000]
    WHEN regexp_matches(abbr, '^([A-Z]{1,3}DT|CEST|EEST|BST|IST)$') THEN [list_min(@@I)]
    WHEN abbr <> '' THEN [list_max(@@I)]
    ELSE @@I END))) END AS u FROM q)
SELECT row_id, CASE WHEN bare THEN (CASE length(string_split(t, '.')[1]) WHEN 10 THEN TRY_CAST(string_split(t, '.')[1] AS BIGINT) * 1000000 + TRY_CAST(rpad(coalesce(string_split(t, '.')[2], ''), 6, '0')[1:6] AS BIGINT) WHEN 13 THEN TRY_CAST(t AS BIGINT) * 1000 WHEN 16 THEN TRY_CAST(t AS BIGINT) ELSE TRY_CAST(t AS BIGINT) // 1000 END)
  ELSE coalesce(list_max(list_filter(u, lambda x: x <= rec)), list_min(u)) END AS utc_us FROM c""").replace("@@S", _STAMP).replace("@@I", _INSTANTS)
_OPENED = "CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_matches({0} ->> '$', '^\\s*[\\[{{]') AND json_valid({0} ->> '$') THEN ({0} ->> '$')::JSON ELSE {0} END"
_NODES = (
    "WITH RECURSIVE t AS (SELECT row_id, 'event' AS origin, event AS x FROM nested_events UNION ALL SELECT row_id, 'fields_json', fields_json FROM nested_events), "
    "n AS (SELECT row_id, origin, '$' AS path, '$' AS own, '$' AS parent, false AS el, " + _OPENED.format("(CASE WHEN json_valid(x) THEN x END)::JSON") + " AS j FROM t WHERE json_valid(x) "
    "UNION ALL SELECT row_id, origin, path, CASE WHEN el AND json_type(j) = 'OBJECT' THEN path ELSE own END, own, el, j FROM (SELECT row_id, origin, own, path || s.p AS path, s.el AS el, " + _OPENED.format("s.j") + " AS j FROM (SELECT row_id, origin, path, own, unnest(CASE json_type(j) "
    "WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: {'p': '.' || k, 'el': false, 'j': json_extract(j, '$.\"' || k || '\"')}) "
    "WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda i: {'p': '[' || i || ']', 'el': true, 'j': json_extract(j, '$[' || i || ']')}) END) AS s FROM n))) "
)
_RECORDS = _NODES + "SELECT row_id, origin, parent AS parent_path, path AS child_path FROM n WHERE el AND json_type(j) = 'OBJECT'"
_LEAVES = _NODES + (
    ", f AS (SELECT row_id, origin, own, regexp_replace(regexp_replace(path[length(own) + 1 :], '^[.]', ''), '\\[\\d+\\]', '[]', 'g') AS leaf, CAST(json_type(j) <> 'NULL' AS INT) AS v FROM n "
    "WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY') OR json_type(j) = 'ARRAY' AND json_array_length(j) = 0 OR json_type(j) = 'OBJECT' AND NOT el AND path <> '$' AND len(json_keys(j)) = 0), "
    "a AS (SELECT own, leaf, v FROM f UNION ALL SELECT own, NULL, 0 FROM n WHERE el AND json_type(j) = 'OBJECT' AND NOT EXISTS (SELECT 1 FROM f WHERE f.row_id = n.row_id AND f.origin = n.origin AND f.own = n.own)) "
    "SELECT regexp_replace(own, '\\[\\d+\\]', '[]', 'g') AS \"table\", leaf, CAST(sum(v) AS BIGINT) AS n_values FROM a GROUP BY 1, 2"
)
ORACLES: dict[str, str] = {
    "p1_spans": f"SELECT line_id, n_lines, {_LEVEL} AS log_level FROM (SELECT line_id, coalesce(lead(line_no) OVER (PARTITION BY source ORDER BY line_no), e + 1) - line_no AS n_lines, {_RAW_LEVEL} AS l FROM (SELECT *, max(line_no) OVER (PARTITION BY source) AS e FROM raw_lines) WHERE regexp_matches(event, '{_STARTS}'))",
    "p1_found": f"SELECT line_id, n_lines, {_LEVEL} AS log_level, coalesce(k, '') AS component FROM (SELECT line_id, coalesce(lead(line_no) OVER (PARTITION BY source ORDER BY line_no), e + 1) - line_no AS n_lines, {_RAW_LEVEL} AS l, {_RAW_COMPONENT} AS k FROM (SELECT *, max(line_no) OVER (PARTITION BY source) AS e FROM raw_lines) WHERE regexp_matches(event, '{_STARTS}'))",
    "p2_kept_per_source": "WITH i AS (" + _IDS + ") SELECT source, count(*) AS n, count(*) FILTER (WHERE id IS NULL OR r = 1) AS n_kept FROM (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY row_id) AS r FROM i) GROUP BY 1",
    "p2_found": "WITH i AS (SELECT row_id, source, coalesce(" + ", ".join(_NORM.format(x) for x in ("msg_id", "(" + _JSON.format("fields_json") + ")", "(" + _IN_EVENT + ")")) + ") AS id FROM ingest_events) "
    "SELECT a AS row_id_a, row_id AS row_id_b FROM (SELECT row_id, min(row_id) OVER (PARTITION BY source, id) AS a FROM i WHERE id IS NOT NULL) WHERE a <> row_id",
    "p2_kept": "WITH i AS (" + _IDS + ") SELECT e.* FROM ingest_events e JOIN (SELECT row_id, id, row_number() OVER (PARTITION BY source, id ORDER BY row_id) AS r FROM i) USING (row_id) WHERE id IS NULL OR r = 1",
    "p5_found": _PENDING + "SELECT part_id FROM pending",
    "p4_found": _RECORDS,
    "p4_columns": _LEAVES,
    "p6_found": _TIMES,
    "p6_events": f"SELECT e.*, u.utc_us, make_timestamptz(u.utc_us) AS event_utc FROM ingest_events e LEFT JOIN ({_TIMES}) u USING (row_id)",
    "p5_totals": _PENDING + "SELECT part_id IN (SELECT part_id FROM pending) AS rewritten, count(*) AS event_count FROM ingest_events GROUP BY 1",
}
