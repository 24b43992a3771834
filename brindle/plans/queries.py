"""Queries of the engine's own stages and functions over the given tables, each with its SQL twin."""

from __future__ import annotations

import datetime as dt

import xxhash
from pyspark.sql import DataFrame, SparkSession

from brindle.engine import Engine
from brindle.plans.shared import read_table

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.UTC)


def engine(spark: SparkSession, d: str) -> Engine:
    e = Engine(spark, now=NOW)
    add = lambda name, **o: e.catalog.add_lazily(name, lambda: read_table(spark, d, name), **o)
    add("events", time="ts", raw="props", order=("event_id",))
    add("lineitem", time="l_shipdate", order=("l_orderkey", "l_linenumber"))
    add("orders", time="o_orderdate", order=("o_orderkey",))
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        add(name, order=(key,))
    add("documents", time="created_at", raw="text", order=("doc_id",))
    add("backend_log", time="log_time", raw="message", order=("log_id",))
    add("ingest_events", time="received_at", raw="event", order=("row_id",))
    add("raw_lines", time="received_at", raw="event", order=("line_id",))
    add("nested_events", raw="fields_json", order=("row_id",))
    return e


_TS = "strftime(_time, \"%Y-%m-%d %H:%M:%S\")"
_HOUR = "strftime(to_timestamp(CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"
_DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')"
_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')"

#: name: (pipeline, SQL or None)
TEXTS: dict[str, tuple[str, str | None]] = {
    # filters and projections
    "where_basic": (
        "from lineitem | where l_quantity >= 30.0 and l_returnflag == \"R\" and not l_discount between 0.02 and 0.05 | keep l_orderkey, l_linenumber, l_quantity",
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R' AND NOT (l_discount BETWEEN 0.02 AND 0.05)",
    ),
    "where_in": ("from orders | where o_orderstatus in [\"O\", \"P\"] or o_orderkey in (1, 2, 3) | stats count() as n, sum(o_totalprice) as s | extend s = round(s, 2)", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus IN ('O','P') OR o_orderkey IN (1,2,3)"),
    "where_compare_kinds": ("from events | where event_type == 5 or user_id == \"7\" | stats count() as n", "SELECT count(*) AS n FROM events WHERE false"),
    "extend_chain": (
        "from lineitem | extend net = l_extendedprice * (1 - l_discount), gross = net * (1 + l_tax), unit = l_orderkey / l_linenumber, rest = l_orderkey % 7 | keep l_orderkey, l_linenumber, net, gross, unit, rest",
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_orderkey // l_linenumber AS unit, l_orderkey % 7 AS rest FROM lineitem",
    ),
    "keep_except": ("from customer | keep * except c_name, c_acct*", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "keep_missing": ("from nation | keep n_name, nosuch | where is_missing(other) and nosuch ?? \"none\" == \"none\" | stats count() as n, count(nosuch) as m", "SELECT count(*) AS n, 0 AS m FROM nation"),
    "drop_glob": ("from part | drop p_n*, p_brand, p_type", "SELECT p_partkey, p_size, p_retailprice FROM part"),
    "rename_cols": ("from region | rename r_name as region, r_regionkey as id", "SELECT r_regionkey AS id, r_name AS region FROM region"),
    # aggregates
    "stats_multi": (
        "from lineitem | stats count() as n, sum(l_quantity) as q, avg(l_extendedprice) as a, min(l_discount) as lo, max(l_tax) as hi by l_returnflag, l_linestatus | extend q = round(q, 2), a = round(a, 4)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY ALL",
    ),
    "stats_where": (
        "from lineitem | stats count(where l_quantity > 25.0) as big, sum(l_extendedprice, where l_returnflag == \"A\") as a, count() as n by l_linestatus | extend a = round(a, 2)",
        "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 2) AS a, count(*) AS n FROM lineitem GROUP BY 1",
    ),
    "stats_expression_key": ("from orders | stats count() as n by floor(o_totalprice / 50000.0) as band", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, count(*) AS n FROM orders GROUP BY 1"),
    "stats_empty": ("from orders | where o_orderkey < 0 | stats count() as n, sum(o_totalprice) as s", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0"),
    "stats_spread": (
        "from lineitem | stats stdev(l_quantity) as sd, var(l_quantity) as v, stdevp(l_quantity) as sp, varp(l_quantity) as vp, range(l_quantity) as r, sumsq(l_quantity) as ss by l_returnflag | extend sd = round(sd, 6), v = round(v, 5), sp = round(sp, 6), vp = round(vp, 5), ss = round(ss, 1)",
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 5) AS v, round(stddev_pop(l_quantity), 6) AS sp, round(var_pop(l_quantity), 5) AS vp, max(l_quantity) - min(l_quantity) AS r, round(sum(l_quantity * l_quantity), 1) AS ss FROM lineitem GROUP BY 1",
    ),
    "percentiles": (
        "from lineitem | stats p50(l_extendedprice) as p50, p75(l_extendedprice) as p75, p90(l_extendedprice) as p90, p95(l_extendedprice) as p95, p99(l_extendedprice) as p99, perc(l_extendedprice, 10) as p10 by l_returnflag | extend p50 = round(p50, 3), p75 = round(p75, 3), p90 = round(p90, 3), p95 = round(p95, 3), p99 = round(p99, 3), p10 = round(p10, 3)",
        "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 3) AS p{p}" for p in (50, 75, 90, 95, 99, 10)) + " FROM lineitem GROUP BY 1",
    ),
    "dc": ("from lineitem | stats dc(l_partkey) as parts, dc(l_suppkey) as supps by l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY 1"),
    "mode_tie": (
        "from orders | stats mode(o_orderpriority) as m by o_orderstatus",
        "SELECT o_orderstatus, m FROM (SELECT o_orderstatus, o_orderpriority AS m, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1",
    ),
    "values_sorted": ("from orders | stats values(o_orderpriority) as v by o_orderstatus | extend v = join(array_sort(v), \",\")", "SELECT o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS v FROM orders GROUP BY 1"),
    "list_ordered": ("from events | stats list(event_type) as l by user_id | extend l = join(l, \",\")", "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS l FROM events GROUP BY 1"),
    "first_last": ("from events | stats first(value) as f, last(value) as l, earliest(event_id) as e, latest(event_id) as t by user_id", "SELECT user_id, arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS l, arg_min(event_id, (ts, event_id)) AS e, arg_max(event_id, (ts, event_id)) AS t FROM events GROUP BY 1"),
    "count_null": ("from ingest_events | stats count() as n, count(msg_id) as ids by index_name", "SELECT index_name, count(*) AS n, count(msg_id) AS ids FROM ingest_events GROUP BY 1"),
    # buckets
    "every_1h": (f"from events | every 1h by event_type stats count() as n, sum(value) as s | extend t = {_TS}, s = round(s, 3) | drop _time", f"SELECT event_type, {_HOUR} AS t, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1, 2"),
    "stats_bin": (f"from events | stats count() as n, rate() as r by bin(_time, 1d) | extend t = {_TS}, r = round(r, 9) | drop _time", f"SELECT {_DAY} AS t, count(*) AS n, round(count(*) / 86400.0, 9) AS r FROM events GROUP BY 1"),
    "rate_per_5m": (f"from events | rate per 5m by event_type | extend t = {_TS} | drop _time", "SELECT event_type, strftime(to_timestamp(CAST(floor(epoch(ts) / 300) * 300 AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS t, count(*) AS rate FROM events GROUP BY 1, 2"),
    "per_second": (f"from events | stats per_second(value) as v by bin(_time, 1h) | extend t = {_TS}, v = round(v, 9) | drop _time", f"SELECT {_HOUR} AS t, round(sum(value) / 3600.0, 9) AS v FROM events GROUP BY 1"),
    "rollup": (
        "from events | rollup 1h, 1d by event_type | extend b = strftime(_bucket, \"%Y-%m-%d %H:%M:%S\") | drop _bucket",
        f"SELECT '1h' AS _resolution, {_HOUR} AS b, event_type, count(*) AS count FROM events GROUP BY 2, 3 UNION ALL SELECT '1d', {_DAY}, event_type, count(*) FROM events GROUP BY 2, 3",
    ),
    "time_range": ("from events[2024-01-05T00:00:00Z..2024-01-10T12:00:00Z] | stats count() as n", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00'"),
    "time_range_relative": ("from events[-7d@d] | stats count() as n", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' AND ts <= TIMESTAMP '2024-02-01 00:00:00'"),
    # windows
    "eventstats": ("from events | eventstats avg(value) as a, count() as c, dc(user_id) as u by event_type | keep event_id, a, c, u | extend a = round(a, 6)", "SELECT event_id, round(a, 6) AS a, c, u FROM events JOIN (SELECT event_type, avg(value) AS a, count(*) AS c, count(DISTINCT user_id) AS u FROM events GROUP BY 1) USING (event_type)"),
    "eventstats_global": ("from events | eventstats max(value) as m | where value == m | keep event_id, m", "SELECT event_id, value AS m FROM events WHERE value = (SELECT max(value) FROM events)"),
    "streamstats_w3": ("from events | streamstats window=3 avg(value) as a, max(value) as m by user_id | keep event_id, a, m | extend a = round(a, 6)", "SELECT event_id, round(avg(value) OVER w, 6) AS a, max(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "streamstats_nocur": ("from events | streamstats current=false sum(value) as s, count() as n by user_id | keep event_id, s, n | extend s = round(s, 4)", "SELECT event_id, round(sum(value) OVER w, 4) AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "lag_lead": ("from events | streamstats lag(value) as a, lead(value, 2) as b, row_number() as r by user_id | keep event_id, a, b, r", "SELECT event_id, lag(value) OVER w AS a, lead(value, 2) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "running_sum": ("from events | streamstats running_sum(value) as s, moving_avg(value, 4) as m by event_type | keep event_id, s, m | extend s = round(s, 3), m = round(m, 6)", "SELECT event_id, round(sum(value) OVER w, 3) AS s, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "baseline": ("from events | baseline value window=5 by user_id | keep event_id, baseline_avg, delta, z | extend baseline_avg = round(baseline_avg, 6), delta = round(delta, 6), z = round(z, 6)", "SELECT event_id, round(a, 6) AS baseline_avg, round(value - a, 6) AS delta, round(CASE WHEN s > 0 THEN (value - a) / s END, 6) AS z FROM (SELECT event_id, value, avg(value) OVER w AS a, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"),
    "changes": ("from events | changes event_type by user_id | keep event_id, event_type, previous_event_type", "SELECT event_id, event_type, p AS previous_event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL AND p <> event_type"),
    # order
    "sort_nulls": ("from ingest_events | keep row_id, index_name | sort -index_name, row_id | streamstats row_number() as place", "SELECT row_id, index_name, row_number() OVER (ORDER BY index_name DESC NULLS FIRST, row_id) AS place FROM ingest_events"),
    "topk": ("from lineitem | sort -l_extendedprice, l_orderkey, l_linenumber | head 25 | keep l_orderkey, l_linenumber, l_extendedprice", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"),
    "head": ("from events | head 12 | keep event_id", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 12"),
    "tail": ("from events | tail 12 | keep event_id", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 12"),
    "dedup": ("from events | dedup user_id, event_type | keep event_id", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    "dedup_n": ("from events | dedup 3 user_id | keep event_id", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3"),
    # several inputs
    "join_inner": ("from orders | rename o_custkey as c_custkey | join on c_custkey with [from customer | keep c_custkey, c_mktsegment] | stats count() as n, sum(o_totalprice) as s by c_mktsegment | extend s = round(s, 2)", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "join_left": ("from customer | join type=left on c_custkey with [from orders | rename o_custkey as c_custkey | stats count() as n by c_custkey] | keep c_custkey, n", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)"),
    "join_outer": ("from nation | where n_nationkey < 10 | rename n_nationkey as k | keep k, n_name | join type=outer on k with [from region | rename r_regionkey as k | where k > 2] | keep k, n_name, r_name", "SELECT k, n_name, r_name FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 10) FULL JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey > 2) USING (k)"),
    "join_keys": ("from lineitem | rename l_partkey as p, l_suppkey as s | stats sum(l_quantity) as q by p, s | join on p, s with [from lineitem | where l_returnflag == \"R\" | rename l_partkey as p, l_suppkey as s | stats count() as returned by p, s] | extend q = round(q, 2)", "SELECT p, s, q, returned FROM (SELECT l_partkey AS p, l_suppkey AS s, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) USING (p, s)"),
    "cte": ("let $big = from orders | where o_totalprice > 100000.0 | keep o_orderkey, o_orderstatus; from $big | stats count() as n by o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1"),
    "union_pad": ("from nation | keep n_name | union [from region | keep r_name] | stats count() as n, count(n_name) as a, count(r_name) as b", "SELECT 30 AS n, 25 AS a, 5 AS b"),
    "source_glob": ("from n*,r*,!raw_lines,!nested* | stats count(n_name) as a, count(r_name) as b", "SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM region) AS b"),
    # parsing and arrays
    "parse_json": ("from events | parse json | stats count(k) as n, sum(k) as s, min(k) as lo", "SELECT count(k) AS n, CAST(sum(k) AS DOUBLE) AS s, min(k) AS lo FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"),
    "parse_json_into": ("from events | parse json into (k as float) prefix \"p_\" | stats sum(p_k) as s by event_type", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS s FROM events GROUP BY 1"),
    "parse_regex": ("from documents | parse regex r\"store-(?<store>\\d+)\" | stats count(store) as n by store | where exists(store)", "SELECT store, count(*) AS n FROM (SELECT nullif(regexp_extract(text, 'store-(\\d+)', 1), '') AS store FROM documents) WHERE store IS NOT NULL GROUP BY 1"),
    "parse_logfmt": ("from ingest_events | where starts_with(event, \"ts=\") | parse logfmt into (level as string, component as string, dur as float) | stats count() as n, sum(dur) as d by level, component | extend d = round(d, 3)", "SELECT level, component, count(*) AS n, round(sum(dur), 3) AS d FROM (SELECT regexp_extract(event, ' level=(\\w+)', 1) AS level, regexp_extract(event, ' component=([\\w-]+)', 1) AS component, CAST(regexp_extract(event, ' dur=([\\d.]+)', 1) AS DOUBLE) AS dur FROM ingest_events WHERE event LIKE 'ts=%') GROUP BY 1, 2"),
    "parse_combined": ("from ingest_events | parse combined on_error drop | stats count() as n, sum(bytes) as b by method, status", "SELECT regexp_extract(event, '\"(\\S+) ', 1) AS method, CAST(regexp_extract(event, '\" (\\d{3}) ', 1) AS BIGINT) AS status, count(*) AS n, CAST(sum(CAST(regexp_extract(event, '\" \\d{3} (\\d+) ', 1) AS BIGINT)) AS DOUBLE) AS b FROM ingest_events WHERE regexp_matches(event, '^\\S+ \\S+ \\S+ \\[[^\\]]+\\] \"[^\"]*\" \\d{3} (\\d+|-) \"[^\"]*\" \"[^\"]*\"') GROUP BY 1, 2"),
    "parse_first_of": ("from ingest_events | parse first_of(json, combined) into (status as int) on_error null | stats count() as n by status", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN json_valid(event) AND json_type(CASE WHEN json_valid(event) THEN event END) = 'OBJECT' THEN CAST(json_extract(CASE WHEN json_valid(event) THEN event END, '$.status') AS BIGINT) WHEN regexp_matches(event, '^\\S+ \\S+ \\S+ \\[[^\\]]+\\] \"[^\"]*\" \\d{3} (\\d+|-) \"[^\"]*\" \"[^\"]*\"') THEN CAST(regexp_extract(event, '\" (\\d{3}) ', 1) AS BIGINT) END AS status FROM ingest_events) GROUP BY 1"),
    "explode_split": ("from documents | where lang == \"en\" | extend w = split(lower(text), \" \") | explode w as word | stats count() as n by word", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents WHERE lang = 'en') GROUP BY 1"),
    "explode_floats": (None, "SELECT label, count(*) AS n, round(sum(e), 3) AS s FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY 1"),
    # shortcuts
    "count_by": ("from events | count by event_type", "SELECT event_type, count(*) AS count FROM events GROUP BY 1"),
    "top": ("from events | top 5 user_id", "SELECT user_id, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS percent FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "rare": ("from part | rare 7 p_type", "SELECT p_type, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM part), 2) AS percent FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 7"),
    "facets": ("from orders | facets o_orderstatus, o_orderpriority limit=2", "SELECT _facet, _value, count FROM (SELECT *, row_number() OVER (PARTITION BY _facet ORDER BY count DESC, _value) AS r FROM (SELECT 'o_orderstatus' AS _facet, o_orderstatus AS _value, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)) WHERE r <= 2"),
    "impact": ("from lineitem | impact sum(l_quantity) by l_returnflag | extend sum_l_quantity = round(sum_l_quantity, 2), total_sum_l_quantity = round(total_sum_l_quantity, 2), pct_sum_l_quantity = round(pct_sum_l_quantity, 6)", "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity, round((SELECT sum(l_quantity) FROM lineitem), 2) AS total_sum_l_quantity, round(sum(l_quantity) * 100 / (SELECT sum(l_quantity) FROM lineitem), 6) AS pct_sum_l_quantity FROM lineitem GROUP BY 1"),
    "latency": ("from events | latency value by event_type | extend p50 = round(p50, 4), p95 = round(p95, 4), p99 = round(p99, 4)", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, count(*) AS count FROM events GROUP BY 1"),
    "percentiles_stage": ("from events | percentiles value | extend p50_value = round(p50_value, 4), p75_value = round(p75_value, 4), p90_value = round(p90_value, 4), p95_value = round(p95_value, 4), p99_value = round(p99_value, 4)", "SELECT " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}_value" for p in (50, 75, 90, 95, 99)) + " FROM events"),
    "proportion": ("from events | proportion value > 50.0 as hot by event_type | extend hot = round(hot, 9)", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS hot_num, count(*) AS hot_den, round(count(*) FILTER (WHERE value > 50) / count(*), 9) AS hot FROM events GROUP BY 1"),
    "exemplars": ("from events | exemplars 2 by event_type | keep event_id", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 2"),
    # search
    "search_words": ("from documents store* \"the disk\" not quota lang=e* | stats count() as n", f"SELECT count(*) AS n FROM documents WHERE len(list_filter({_TOKENS}, lambda x: starts_with(x, 'store'))) > 0 AND contains(lower(text), 'the disk') AND NOT list_contains({_TOKENS}, 'quota') AND lang LIKE 'e%'"),
    "has": ("from documents | where has(text, \"lease\") | stats count() as n by doc_type", f"SELECT doc_type, count(*) AS n FROM documents WHERE list_contains({_TOKENS}, 'lease') GROUP BY 1"),
    "contains": ("from documents | where contains(text, \"DISK\") and not contains_cs(text, \"Disk\") | stats count() as n", "SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'disk') AND NOT contains(text, 'Disk')"),
    "glob_matches": ("from part | where glob(p_name, \"*a*\") and matches(p_brand, r\"[0-9]$\") | stats count() as n", "SELECT count(*) AS n FROM part WHERE p_name LIKE '%a%' AND regexp_matches(p_brand, '[0-9]$')"),
    "extract": ("from documents | extend s = extract(text, r\"store-(\\d+)\"), a = extract_all(text, r\"store-(\\d+)\") | stats count(s) as n, sum(len(a)) as m", "SELECT count(*) FILTER (WHERE regexp_matches(text, 'store-(\\d+)')) AS n, CAST(sum(len(regexp_extract_all(text, 'store-(\\d+)', 1))) FILTER (WHERE regexp_matches(text, 'store-(\\d+)')) AS DOUBLE) AS m FROM documents"),
    # functions
    "fn_string": (
        "from part | extend a = upper(p_name), b = len(p_name), c = substr(p_brand, 1, 3), d = replace(p_type, r\"[aeiou]\", \"_\"), e = starts_with(p_name, \"p\"), f = ends_with(p_type, \"L\"), g = trim(\"  x \"), h = printf(\"%05d|%s\", p_size, p_brand), i = join(split(p_type, \" \"), \"-\"), j = substr(p_brand, -2) | keep p_partkey, a, b, c, d, e, f, g, h, i, j",
        "SELECT p_partkey, upper(p_name) AS a, length(p_name) AS b, substr(p_brand, 2, 3) AS c, regexp_replace(p_type, '[aeiou]', '_', 'g') AS d, starts_with(p_name, 'p') AS e, ends_with(p_type, 'L') AS f, 'x' AS g, printf('%05d|%s', p_size, p_brand) AS h, replace(p_type, ' ', '-') AS i, right(p_brand, 2) AS j FROM part",
    ),
    "fn_math": (
        "from part | extend a = abs(-p_size), b = round(p_retailprice, 1), c = floor(p_retailprice), d = ceil(p_retailprice), e = round(sqrt(p_retailprice), 6), f = round(ln(p_retailprice), 6), g = round(log(p_retailprice), 6), h = pow(2, 10), i = clamp(p_size, 5, 20), j = p_size / 0, k = bucket(p_size, [0, 10, 25]), l = round(log(8, 2), 6), m = ln(0 - 1) | keep p_partkey, a, b, c, d, e, f, g, h, i, j, k, l, m",
        "SELECT p_partkey, p_size AS a, round(p_retailprice, 1) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, CAST(ceil(p_retailprice) AS BIGINT) AS d, round(sqrt(p_retailprice), 6) AS e, round(ln(p_retailprice), 6) AS f, round(log10(p_retailprice), 6) AS g, 1024.0::DOUBLE AS h, greatest(5, least(p_size, 20)) AS i, NULL::BIGINT AS j, CASE WHEN p_size >= 25 THEN 25 WHEN p_size >= 10 THEN 10 WHEN p_size >= 0 THEN 0 END AS k, 3.0::DOUBLE AS l, NULL::DOUBLE AS m FROM part",
    ),
    "fn_conditional": (
        "from events | extend a = if(value > 50.0, \"hi\", \"lo\"), b = case(value > 90.0, \"A\", value > 50.0, \"B\", \"C\"), c = coalesce(null, event_type), d = nullif(event_type, \"click\"), e = exists(d), f = typeof(user_id), g = null or value > 0.0, h = null and value > 1e9 | keep event_id, a, b, c, d, e, f, g, h",
        "SELECT event_id, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS a, CASE WHEN value > 90 THEN 'A' WHEN value > 50 THEN 'B' ELSE 'C' END AS b, event_type AS c, nullif(event_type, 'click') AS d, event_type <> 'click' AS e, 'int' AS f, (NULL OR value > 0) AS g, (NULL AND value > 1e9) AS h FROM events",
    ),
    "fn_convert": (
        "from events | extend a = int(\"12\"), b = float(\"x\"), c = bool(\"yes\"), d = string(user_id), e = int(value), f = int(\"7.9\"), g = duration(\"90m\") / 1h, h = int(\"junk\") | keep event_id, a, b, c, d, e, f, g, h",
        "SELECT event_id, 12 AS a, NULL::DOUBLE AS b, true AS c, CAST(user_id AS VARCHAR) AS d, CAST(trunc(value) AS BIGINT) AS e, 7 AS f, 1.5::DOUBLE AS g, NULL::BIGINT AS h FROM events",
    ),
    "fn_time": (
        "from events | extend a = strftime(_time, \"%Y-%m-%d %H:%M\"), b = day_of_week(_time), c = strftime(bin(_time, 15m), \"%H:%M:%S\"), d = time_of_day(_time) / 1s, e = strftime(_time + 36h, \"%d\"), f = (_time - timestamp(\"2024-01-01T00:00:00Z\")) / 1d, g = strftime(strptime(\"05/02/2024\", \"%d/%m/%Y\"), \"%Y-%m-%d\") | keep event_id, a, b, c, d, e, f, g | extend d = round(d, 3), f = round(f, 6)",
        "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS a, dayofweek(ts) AS b, strftime(to_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT)) AT TIME ZONE 'UTC', '%H:%M:%S') AS c, round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000, 3) AS d, strftime(ts + INTERVAL 36 HOUR, '%d') AS e, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000, 6) AS f, '2024-02-05' AS g FROM events",
    ),
    "fn_hash": ("from nation | extend a = md5(n_name), b = sha1(n_name), c = sha256(n_name) | keep n_nationkey, a, b, c", "SELECT n_nationkey, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "fn_xxhash": ("from region | extend h = xxhash64(r_name) | keep r_name, h", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{xxhash.xxh64_intdigest(n):x}')" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + ") t(r_name, h)"),
    "fn_net": (
        "from backend_log | where exists(client_ip) | extend a = cidr_match(\"10.0.0.0/8\", client_ip), b = ipmask(\"255.255.0.0\", client_ip), c = ip_parse(client_ip).version | stats count() as n by a, b, c",
        "SELECT a, b, c, count(*) AS n FROM (SELECT client_ip LIKE '10.%' AS a, regexp_replace(client_ip, '\\.\\d+\\.\\d+$', '.0.0') AS b, 4 AS c FROM backend_log WHERE client_ip IS NOT NULL) GROUP BY ALL",
    ),
    "fn_array": (
        "from nation | extend q = [3, 1, 2, 1], a = q[-1], b = join(map(array_sort(q), x -> string(x * 2)), \",\"), c = len(filter(q, x -> x > 1)), d = any(q, x -> x == 2), e = all(q, x -> x > 0), f = len(array_distinct(q)), g = join(map(slice(q, 1, 3), x -> string(x)), \",\"), h = len(array_concat(q, [9])), i = len(flatten([[1], [2, 3]])), j = q[9] | keep n_nationkey, a, b, c, d, e, f, g, h, i, j",
        "SELECT n_nationkey, 1 AS a, '2,2,4,6' AS b, 2 AS c, true AS d, true AS e, 3 AS f, '1,2' AS g, 5 AS h, 3 AS i, NULL::BIGINT AS j FROM nation",
    ),
    "fn_object": (
        "from nation | extend o = {id: n_nationkey, name: n_name}, a = o.id, b = o[\"name\"], c = join(keys(o), \",\"), d = has_key(o, \"id\"), m = merge(o, {id: 0, z: true}), e = m.id, f = m.z, g = to_json({k: n_nationkey}), h = len(o) | keep a, b, c, d, e, f, g, h",
        "SELECT n_nationkey AS a, n_name AS b, 'id,name' AS c, true AS d, 0 AS e, true AS f, '{\"k\":' || n_nationkey || '}' AS g, 2 AS h FROM nation",
    ),
    "fn_json": ("from events | extend j = from_json(props), k = int(j.k) | stats sum(k) as s by event_type", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS s FROM events GROUP BY 1"),
    "fn_url": ("from region | extend u = url_parse(\"https://a.example:8080/x/17?q=1&r=two#top\"), a = u.scheme, b = u.host, c = u.port, d = u.path, e = u.query.r, f = u.fragment, g = path_normalize(\"/a/123/b/550e8400-e29b-41d4-a716-446655440000\"), h = urldecode(\"a%20b\") | keep r_name, a, b, c, d, e, f, g, h", "SELECT r_name, 'https' AS a, 'a.example' AS b, 8080 AS c, '/x/17' AS d, 'two' AS e, 'top' AS f, '/a/:id/b/:uuid' AS g, 'a b' AS h FROM region"),
    # analysis
    "sessionize": (
        "from events | sessionize maxpause=30m by user_id | stats count() as n, min(event_id) as lo by _session_id, user_id",
        "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), a AS (SELECT user_id, k, min(ts) AS t, count(*) AS n, min(event_id) AS lo FROM s GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY user_id, t) AS _session_id, user_id, n, lo FROM a",
    ),
    "transaction": (
        "from events | transaction user_id maxspan=1h | extend duration = round(duration, 3) | keep user_id, eventcount, duration, event_id, event_type",
        "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, count(*) AS eventcount, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS duration, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM s GROUP BY user_id, k",
    ),
    "transaction_bounds": (
        "from events | transaction user_id endswith=event_type == \"purchase\" | keep user_id, eventcount, event_id",
        "WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM events) SELECT user_id, count(*) AS eventcount, arg_min(event_id, (ts, event_id)) AS event_id FROM s GROUP BY user_id, k",
    ),
    "outliers_iqr": ("from events | outliers field=value | where _outlier | keep event_id, _score | extend _score = round(_score, 6)", "SELECT event_id, round(greatest(q1 - value, value - q3, 0) / (q3 - q1), 6) AS _score FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"),
    "outliers_zscore": ("from events | outliers field=value method=zscore threshold=2.5 | where _outlier | stats count() as n", "SELECT count(*) AS n FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs(value - m) / s > 2.5"),
    "outliers_mad": ("from events | outliers field=value method=mad | where _outlier | stats count() as n", "WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m) SELECT count(*) AS n FROM events, m, d WHERE abs(value - m) * 0.6745 / d > 3.5"),
    "correlate": ("from lineitem | correlate l_quantity l_extendedprice | keep _correlation, _n | extend _correlation = round(_correlation, 9)", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS _correlation, count(*) AS _n FROM lineitem"),
    "correlate_spearman": ("from events | correlate value user_id method=spearman | keep _correlation, _n | extend _correlation = round(_correlation, 9)", "SELECT round(corr(a, b), 9) AS _correlation, count(*) AS _n FROM (SELECT CAST(row_number() OVER (ORDER BY value, ts, event_id) AS DOUBLE) AS a, CAST(row_number() OVER (ORDER BY user_id, ts, event_id) AS DOUBLE) AS b FROM events)"),
    "xyseries": ("from events | stats count() as n by user_id, event_type | xyseries user_id event_type n", "SELECT user_id, " + ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"),
    "topology": (
        "from events | extend a = string(user_id) | topology source_field=a dest_field=event_type weight_field=value | extend _edge_weight = round(_edge_weight, 3)",
        "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS _source, event_type AS _destination, count(*) AS _edge_count, round(sum(value), 3) AS _edge_weight FROM events GROUP BY 1, 2) SELECT *, CAST(sum(_edge_count) OVER (PARTITION BY _source) AS BIGINT) AS _source_out_degree, CAST(sum(_edge_count) OVER (PARTITION BY _destination) AS BIGINT) AS _dest_in_degree FROM e",
    ),
    "compare": ("from events[2024-01-15T00:00:00Z..2024-01-21T23:59:59Z] | stats count() as n by event_type | compare previous 7d", "SELECT event_type, n, p AS previous_n, n - p AS change_n FROM (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-21 23:59:59' GROUP BY 1) LEFT JOIN (SELECT event_type, count(*) AS p FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-14 23:59:59' GROUP BY 1) USING (event_type)"),
    "patterns": ("from backend_log | patterns field=message max_templates=30", None),
    "trace": ("from backend_log | where exists(trace_id) | extend operation = method | trace | stats count() as n, max(_span_depth) as depth by trace_id", "SELECT trace_id, count(*) AS n, 0 AS depth FROM backend_log WHERE trace_id IS NOT NULL GROUP BY 1"),
}


def _runner(text: str):
    return lambda spark, d: engine(spark, d).query(text)


def explode_floats(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.catalog.add("embeddings", read_table(spark, d, "embeddings"), order=("vec_id",))
    return e.query("from embeddings | explode embedding as e | stats count() as n, sum(e) as s by label | extend s = round(s, 3)")


def view_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """An aggregation answered from a view of a finer one."""
    e = engine(spark, d)
    e.query('from events | where value > 1.0 | stats count() as n, sum(value) as s, max(value) as m by event_type, user_id | materialize "by_user"')
    return e.query("from events | where value > 1.0 | stats count() as n, sum(value) as s, max(value) as m by event_type | extend s = round(s, 3)")


def tee_passes(spark: SparkSession, d: str) -> DataFrame:
    from brindle.plans.shared import work_path

    at = work_path(spark, "tee")
    engine(spark, d).query(f'from orders | where o_totalprice > 150000.0 | keep o_orderkey, o_totalprice | tee "{at}" | stats count() as n')
    return spark.read.schema("o_orderkey bigint, o_totalprice double").json(at)


def use_fragment(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.fragments["returned"] = 'where l_returnflag == "R" | stats count() as n by l_linestatus'
    return e.query('from lineitem | use "@returned"')


def live_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, counted in hourly windows as the watermark passes them, then read whole."""
    from brindle.plans.shared import work_path
    from brindle.streaming.live import live_query
    from pyspark.sql import functions as F

    at = work_path(spark, "live")
    schema = read_table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("_time", F.col("ts").cast("timestamp"))
    out = live_query(stream, "from events | every 1h by event_type stats count() as n", watermark="0 seconds")
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("_time timestamp, event_type string, n bigint").parquet(f"{at}/out").select(F.date_format("_time", "yyyy-MM-dd HH:mm:ss").alias("t"), "event_type", "n")


_FUNCTIONS = {f.__name__: f for f in (explode_floats, view_rewrite, tee_passes, use_fragment, live_windows)}
QUERIES = {n: _FUNCTIONS.get(n) or _runner(t) for n, (t, _) in TEXTS.items()} | _FUNCTIONS
ORACLES = {n: s for n, (_, s) in TEXTS.items() if s} | {
    "view_rewrite": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS s, max(value) AS m FROM events WHERE value > 1 GROUP BY 1",
    "live_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS t, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2",
    "tee_passes": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000",
    "use_fragment": "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
}
