"""More queries of the engine's functions and stages over whole tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.format_queries import _runner
from brindle.plans.queries import engine

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')"
_LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_KINDS = dict.fromkeys(_LINEITEM, "float") | dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "int") | dict.fromkeys(("l_returnflag", "l_linestatus"), "string") | {"l_shipdate": "timestamp"}
_ORDER = "ORDER BY ts, event_id"

#: name: (pipeline, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "fn_trigonometry": (
        "from part | extend a = round(sin(p_size), 9), b = round(cos(p_size), 9), c = round(tan(p_size), 6), d = round(asin(p_size / 100.0), 9), e = round(acos(p_size / 100.0), 9), f = round(atan(p_size), 9), g = round(atan2(p_size, 3), 9), h = round(exp(p_size / 10.0), 6) | keep p_partkey, a, b, c, d, e, f, g, h",
        "SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 6) AS c, round(asin(p_size / 100.0::DOUBLE), 9) AS d, round(acos(p_size / 100.0::DOUBLE), 9) AS e, round(atan(p_size), 9) AS f, round(atan2(p_size, 3), 9) AS g, round(exp(p_size / 10.0::DOUBLE), 6) AS h FROM part",
    ),
    "fn_text_more": (
        'from events | extend a = ltrim("  " + event_type + " "), b = rtrim(" " + event_type + "  "), c = is_null(nullif(event_type, "click")), d = event_type.upper(), e = strftime(now(), "%Y-%m-%d"), f = xxhash64(string(event_id)) != "" | keep event_id, a, b, c, d, e, f',
        "SELECT event_id, event_type || ' ' AS a, ' ' || event_type AS b, event_type = 'click' AS c, upper(event_type) AS d, '2024-02-01' AS e, true AS f FROM events",
    ),
    "fn_optional": (
        "from events | extend o = from_json(props), a = int(o?.k), b = o?.none?.deep | stats sum(a) as s, count(b) as n by event_type",
        "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS s, 0 AS n FROM events GROUP BY 1",
    ),
    "has_glob": ('from documents | where has_glob(text, "store*") | stats count() as n by lang', f"SELECT lang, count(*) AS n FROM documents WHERE len(list_filter({_TOKENS}, lambda x: starts_with(x, 'store'))) > 0 GROUP BY 1"),
    "search_in": ('from documents lang in ("en", "de") and (lease or disk) | stats count() as n by lang', f"SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') AND (list_contains({_TOKENS}, 'lease') OR list_contains({_TOKENS}, 'disk')) GROUP BY 1"),
    "search_compared": ("from lineitem l_quantity>=49 l_returnflag!=R | stats count() as n by l_linestatus", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity >= 49 AND l_returnflag <> 'R' GROUP BY 1"),
    "stats_default_names": ("from events | stats count(), max(value), dc(user_id) by event_type", 'SELECT event_type, count(*) AS "count()", max(value) AS "max(value)", count(DISTINCT user_id) AS "dc(user_id)" FROM events GROUP BY 1'),
    "stats_more": (
        'from lineitem | stats p25(l_quantity) as a, perc25(l_quantity) as b, perc99(l_quantity) as c, per_minute(l_quantity) as d, per_hour(l_quantity) as e, per_day(l_quantity) as f, earliest_time(l_quantity) as g, latest_time(l_quantity) as h by l_returnflag | extend g = strftime(g, "%Y-%m-%d"), h = strftime(h, "%Y-%m-%d")',
        "SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.25) AS b, quantile_cont(l_quantity, 0.99) AS c, sum(l_quantity) * 60 AS d, sum(l_quantity) * 3600 AS e, sum(l_quantity) * 86400 AS f, strftime(min(l_shipdate), '%Y-%m-%d') AS g, strftime(max(l_shipdate), '%Y-%m-%d') AS h FROM lineitem GROUP BY 1",
    ),
    "estdc_bound": ("from lineitem | stats estdc(l_partkey) as e, dc(l_partkey) as d, estdc_error(l_partkey) as r by l_returnflag | extend near = abs(e - d) <= d * r * 5.0 + 1.0 | keep l_returnflag, near", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1"),
    "join_null_keys": (
        "from events | extend k = if(event_id % 2 == 0, user_id, null), side = \"l\" | keep event_id, k, side | join type=left on k with [from events | stats count() as n by user_id | extend k = if(user_id % 3 == 0, null, user_id), side = \"r\" | keep k, n, side] | stats count() as rows, count(n) as hits, sum(n) as s by side",
        "SELECT 'l' AS side, count(*) AS rows, count(n) AS hits, CAST(sum(n) AS DOUBLE) AS s FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS k FROM events) l LEFT JOIN (SELECT CASE WHEN user_id % 3 <> 0 THEN user_id END AS k, count(*) AS n FROM events GROUP BY user_id) r ON l.k = r.k",
    ),
    "explode_objects": ("from nation | extend o = [{a: n_nationkey, b: n_name}, {a: 0, b: \"x\"}] | explode o as e | extend a = e.a, b = e.b | keep n_nationkey, a, b", "SELECT n_nationkey, n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT n_nationkey, 0, 'x' FROM nation"),
    "describe_all": ("from lineitem | drop _time | describe | keep field, type, coverage, distinct_est", " UNION ALL ".join(f"SELECT '{c}' AS field, '{_KINDS[c]}' AS type, 1.0::DOUBLE AS coverage, count(DISTINCT {c}) AS distinct_est FROM lineitem" for c in _LINEITEM)),
    "describe_values": ("from events | keep event_type | describe | explode top_values as t | extend v = t.value, n = t.count | keep field, v, n", "SELECT 'event_type' AS field, event_type AS v, count(*) AS n FROM events GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, event_type) <= 5"),
    # running over all rows
    "running_all": (
        "from events | streamstats sum(value) as s, row_number() as i, lag(event_id) as p, lead(event_id, 2) as q, moving_avg(value, 5) as m, min(value) as lo, stdev(value) as d | extend s = round(s, 4), m = round(m, 6), d = round(d, 5) | keep event_id, s, i, p, q, m, lo, d",
        f"SELECT event_id, round(sum(value) OVER ({_ORDER}), 4) AS s, row_number() OVER ({_ORDER}) AS i, lag(event_id) OVER ({_ORDER}) AS p, lead(event_id, 2) OVER ({_ORDER}) AS q, round(avg(value) OVER ({_ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m, min(value) OVER ({_ORDER}) AS lo, round(stddev_samp(value) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING), 5) AS d FROM events",
    ),
    "baseline_all": ("from events | baseline value window=20 | extend a = round(baseline_avg, 6), z = round(z, 4) | keep event_id, a, z", f"SELECT event_id, round(a, 6) AS a, round((value - a) / nullif(d, 0), 4) AS z FROM (SELECT *, avg(value) OVER w AS a, stddev_samp(value) OVER w AS d FROM events WINDOW w AS ({_ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"),
    "changes_all": ("from events | changes event_type | keep event_id, event_type, previous_event_type", f"SELECT * FROM (SELECT event_id, event_type, lag(event_type) OVER ({_ORDER}) AS previous_event_type FROM events) WHERE event_type <> previous_event_type"),
    "sessionize_all": (
        "from events | sessionize maxpause=5m | stats count() as n, min(event_id) as lo by _session_id",
        f"WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({_ORDER}) <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS f FROM events) SELECT k AS _session_id, count(*) AS n, min(event_id) AS lo FROM (SELECT *, CAST(sum(f) OVER ({_ORDER}) AS BIGINT) AS k FROM g) GROUP BY 1",
    ),
    "running_sorted": ("from events | sort -value | streamstats row_number() as i, count(value) as c | keep event_id, i, c", "SELECT event_id, row_number() OVER w AS i, count(value) OVER w AS c FROM events WINDOW w AS (ORDER BY value DESC NULLS FIRST, props, ts, event_id ROWS UNBOUNDED PRECEDING)"),
    # analysis
    "patterns_cover": ("from backend_log | patterns field=message max_templates=1000000 | stats sum(count) as n", "SELECT CAST(count(*) AS DOUBLE) AS n FROM backend_log WHERE message IS NOT NULL"),
    "trace_depths": (
        'from events | extend trace_id = string(event_id % 50), span_id = string(event_id), parent_id = if(event_id % 7 == 0, "", string(event_id - 50 * (1 + event_id % 3))), operation = event_type | trace | stats count() as n, max(_span_depth) as depth by trace_id',
        "WITH RECURSIVE e AS (SELECT event_id AS id, event_id % 50 AS t, CASE WHEN event_id % 7 <> 0 THEN event_id - 50 * (1 + event_id % 3) END AS p FROM events), d AS (SELECT id, t, 0 AS k FROM e WHERE p IS NULL OR p NOT IN (SELECT event_id FROM events) UNION ALL SELECT e.id, e.t, d.k + 1 FROM e JOIN d ON e.p = d.id) SELECT CAST(t AS VARCHAR) AS trace_id, count(*) AS n, max(k) AS depth FROM d GROUP BY 1",
    ),
}


def view_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A query over a shorter time than the view that its text matches."""
    e = engine(spark, d)
    q = "from events | stats count() as n, avg(value) as a by event_type"
    e.query(q + ' | materialize "types"')
    return e.query(q + " | extend a = round(a, 6)", since="2024-01-10T00:00:00Z", until="2024-01-20T00:00:00Z")


def view_averages(spark: SparkSession, d: str) -> DataFrame:
    """An average by fewer keys than the view's, put together from its sums and counts."""
    e = engine(spark, d)
    e.query('from events | stats count() as n, avg(value) as a, range(value) as r by event_type, user_id | materialize "by_both"')
    return e.query("from events | stats avg(value) as a, range(value) as r by event_type | extend a = round(a, 6)")


_FUNCTIONS = {f.__name__: f for f in (view_bounds, view_averages)}
QUERIES = {n: _runner(t) for n, (t, _) in TEXTS.items()} | _FUNCTIONS
ORACLES = {n: s for n, (_, s) in TEXTS.items()} | {
    "view_bounds": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS a FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY 1",
    "view_averages": "SELECT event_type, round(avg(value), 6) AS a, max(value) - min(value) AS r FROM events GROUP BY 1",
}
