"""Queries of the parse stage, one for each format, over lines written from the columns of backend_log, with the SQL that reads those columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (stage that writes the line, parse and what follows, SQL)
LINES: dict[str, tuple[str, str, str]] = {
    "parse_clf": (
        'printf("10.0.0.%d - %s [10/Feb/2026:08:12:03 +0000] \\"%s %s HTTP/1.1\\" %d %d", status, service, method, path, status, duration_ms)',
        "clf from line | stats count() as n, sum(bytes) as b, count(ident) as i by client_ip, user, method, uri, protocol, status",
        "SELECT '10.0.0.' || status AS client_ip, service AS user, method, path AS uri, 'HTTP/1.1' AS protocol, status, count(*) AS n, CAST(sum(duration_ms) AS DOUBLE) AS b, 0 AS i FROM backend_log GROUP BY ALL",
    ),
    "parse_apache_error": (
        'printf("[Fri Feb 14 14:52:01.234567 2026] [%s:%s] [pid %d:tid %d] [client 10.1.2.3:%d] AH02032: %s", service, level, status, duration_ms, log_id, message)',
        "apache_error from line | stats count() as n, sum(pid) as p, sum(tid) as t, sum(client_port) as c by module, severity, error_code, client_ip, message",
        "SELECT service AS module, level AS severity, 'AH02032' AS error_code, '10.1.2.3' AS client_ip, message, count(*) AS n, CAST(sum(status) AS DOUBLE) AS p, CAST(sum(duration_ms) AS DOUBLE) AS t, CAST(sum(log_id) AS DOUBLE) AS c FROM backend_log GROUP BY ALL",
    ),
    "parse_nginx_error": (
        'printf("2026/02/14 14:52:01 [%s] %d#%d: *%d %s, client: 10.0.1.5, server: %s, module: m, request: \\"%s %s HTTP/1.1\\", host: \\"h\\"", lower(level), status, duration_ms, log_id, service, service, method, path)',
        "nginx_error from line | stats count() as n, sum(pid) as p, sum(tid) as t, max(cid) as c by severity, client, server, request, method, uri, host, message",
        "SELECT lower(level) AS severity, '10.0.1.5' AS client, service AS server, method || ' ' || path || ' HTTP/1.1' AS request, method, path AS uri, 'h' AS host, service AS message, count(*) AS n, CAST(sum(status) AS DOUBLE) AS p, CAST(sum(duration_ms) AS DOUBLE) AS t, max(log_id) AS c FROM backend_log GROUP BY ALL",
    ),
    "parse_redis": (
        'printf("%d:%s 14 Feb 2026 14:52:01.234 %s %s", status, case(method == "GET", "M", method == "POST", "S", "C"), case(level == "INFO", "*", level == "ERROR", "#", "."), service)',
        "redis from line | stats count() as n, sum(pid) as p by role, level, message",
        "SELECT CASE method WHEN 'GET' THEN 'master' WHEN 'POST' THEN 'replica' ELSE 'rdb_child' END AS role, CASE level WHEN 'INFO' THEN 'notice' WHEN 'ERROR' THEN 'warning' ELSE 'debug' END AS level, service AS message, count(*) AS n, CAST(sum(status) AS DOUBLE) AS p FROM backend_log GROUP BY ALL",
    ),
    "parse_postgres": (
        'printf("2026-02-14 14:52:01.234 UTC [%d] %s@db LOG:  duration: %d.5 ms  statement: SELECT %d", status, service, duration_ms, status)',
        "postgres from line | stats count() as n, sum(duration_ms) as d by pid, user, database, severity, statement, timestamp",
        "SELECT status AS pid, service AS user, 'db' AS database, 'LOG' AS severity, 'SELECT ' || status AS statement, '2026-02-14 14:52:01.234 UTC' AS timestamp, count(*) AS n, sum(duration_ms + 0.5::DOUBLE) AS d FROM backend_log GROUP BY ALL",
    ),
    "parse_haproxy": (
        'printf("Feb 14 14:52:01 lb1 haproxy[7]: 10.0.0.1:%d [14/Feb/2026:14:52:01.234] web~ %s/srv1 10/0/-1/69/%d %d %d - - ---- 1/1/0/0/0 0/0 \\"%s %s HTTP/1.1\\"", log_id, service, duration_ms, status, duration_ms, method, path)',
        "haproxy from line | stats count() as n, max(client_port) as c, sum(tt) as t, sum(bytes) as b, sum(tc) as k by frontend, backend, server, status, term_state, method, uri, protocol, beconn",
        "SELECT 'web' AS frontend, service AS backend, 'srv1' AS server, status, '----' AS term_state, method, path AS uri, 'HTTP/1.1' AS protocol, 0 AS beconn, count(*) AS n, max(log_id) AS c, CAST(sum(duration_ms) AS DOUBLE) AS t, CAST(sum(duration_ms) AS DOUBLE) AS b, -count(*)::DOUBLE AS k FROM backend_log GROUP BY ALL",
    ),
    "parse_mysql_slow": (
        'printf("# Time: 2026-02-14T14:52:01Z\\n# User@Host: %s[root] @ localhost [127.0.0.1]  Id: %d\\n# Query_time: %d.25  Lock_time: 0.5 Rows_sent: %d  Rows_examined: 9\\nSELECT *\\nFROM %s;", service, log_id, duration_ms, status, service)',
        "mysql_slow from line | stats count() as n, max(connection_id) as c, sum(query_time) as q, sum(lock_time) as l, sum(rows_sent) as r by user, host, client_ip, statement, timestamp, rows_examined",
        "SELECT service AS user, 'localhost' AS host, '127.0.0.1' AS client_ip, 'SELECT *' || chr(10) || 'FROM ' || service AS statement, '2026-02-14T14:52:01Z' AS timestamp, 9 AS rows_examined, count(*) AS n, max(log_id) AS c, sum(duration_ms + 0.25::DOUBLE) AS q, count(*) * 0.5::DOUBLE AS l, CAST(sum(status) AS DOUBLE) AS r FROM backend_log GROUP BY ALL",
    ),
    "parse_cef": (
        'printf("CEF:0|Ven\\\\|dor|%s|1.0|%d|%s|5|src=10.0.0.1 msg=%s act=%s", service, status, level, message, method)',
        "cef from line | stats count() as n by device_vendor, device_product, signature_id, name, severity, src, msg, act",
        "SELECT 'Ven|dor' AS device_vendor, service AS device_product, CAST(status AS VARCHAR) AS signature_id, level AS name, '5' AS severity, '10.0.0.1' AS src, message AS msg, method AS act, count(*) AS n FROM backend_log WHERE message NOT LIKE '%=%' GROUP BY ALL",
    ),
    "parse_leef": (
        'printf("LEEF:2.0|ven|%s|7|%s|^|src=10.0.0.1^usr=%s^n=%d", service, method, path, status)',
        "leef from line | stats count() as n, sum(n) as s by leef_version, device_product, event_id, src, usr",
        "SELECT 2.0::DOUBLE AS leef_version, service AS device_product, method AS event_id, '10.0.0.1' AS src, path AS usr, count(*) AS n, CAST(sum(status) AS DOUBLE) AS s FROM backend_log GROUP BY ALL",
    ),
    "parse_docker": (
        'to_json({log: printf("%s\\n", service), stream: method, attrs: {tag: path}})',
        "docker from line | stats count() as n by log, stream, attrs.tag",
        "SELECT service AS log, method AS stream, path AS \"attrs.tag\", count(*) AS n FROM backend_log GROUP BY ALL",
    ),
    "parse_kv": (
        "printf(\"a:%d,b:'%s x',c:%s\", status, service, method)",
        'kv(sep=",", assign=":") from line | stats count() as n, sum(a) as s by b, c',
        "SELECT service || ' x' AS b, method AS c, count(*) AS n, CAST(sum(status) AS DOUBLE) AS s FROM backend_log GROUP BY ALL",
    ),
    "parse_pattern": (
        'printf("%s - %s [%d] tail", service, method, status)',
        'pattern "<svc> - <verb> [<code>] <_>" into (svc, verb, code as int) from line | stats count() as n, sum(code) as s by svc, verb',
        "SELECT service AS svc, method AS verb, count(*) AS n, CAST(sum(status) AS DOUBLE) AS s FROM backend_log GROUP BY ALL",
    ),
    "parse_w3c": (
        'if(log_id % 500 == 7, "#Fields: date cs-method sc-status", printf("d %s %d", method, status))',
        "w3c from line | stats count() as n by cs_method, sc_status, date",
        "SELECT m AS cs_method, s AS sc_status, d AS date, count(*) AS n FROM (SELECT CASE WHEN ok THEN method END AS m, CASE WHEN ok THEN CAST(status AS VARCHAR) END AS s, CASE WHEN ok THEN 'd' END AS d FROM (SELECT *, log_id % 500 <> 7 AND coalesce(sum(CASE WHEN log_id % 500 = 7 THEN 1 ELSE 0 END) OVER (ORDER BY log_time, log_id), 0) > 0 AS ok FROM backend_log)) GROUP BY ALL",
    ),
}
#: name: (pipeline, SQL), over the tables' own lines
TEXTS: dict[str, tuple[str, str]] = {
    "parse_syslog": (
        'from raw_lines | where starts_with(event, "<") | parse syslog | stats count() as n, sum(facility) as f by severity_name, format, appname, hostname, version',
        "SELECT ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug'][p % 8 + 1] AS severity_name, CASE WHEN new THEN 'rfc5424' ELSE 'rfc3164' END AS format, CASE WHEN new THEN w[4] ELSE regexp_extract(event, '\\d\\d:\\d\\d:\\d\\d \\S+ ([^\\s:\\[]+)', 1) END AS appname, "
        "CASE WHEN new THEN w[3] ELSE regexp_extract(event, '\\d\\d:\\d\\d:\\d\\d (\\S+)', 1) END AS hostname, CASE WHEN new THEN '1' END AS version, count(*) AS n, CAST(sum(p // 8) AS DOUBLE) AS f "
        "FROM (SELECT event, CAST(regexp_extract(event, '^<(\\d+)>', 1) AS INT) AS p, event LIKE '%>1 %' AS new, string_split(event, ' ') AS w FROM raw_lines WHERE event LIKE '<%') GROUP BY ALL",
    ),
    "parse_propagate": (
        'from events | extend line = if(event_id % 3 == 0, "broken", props) | parse json from line into (k as int) | stats count(_error) as bad, count(k) as good, sum(k) as s by event_type',
        "SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0) AS bad, count(k) AS good, CAST(sum(k) AS DOUBLE) AS s FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY 1",
    ),
    "parse_keeps_values": (
        'from events | extend k = if(event_id % 2 == 0, event_id, null) | parse json into (k as int) | stats sum(k) as s, count() as n by event_type',
        "SELECT event_type, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id ELSE CAST(json_extract(props, '$.k') AS BIGINT) END) AS DOUBLE) AS s, count(*) AS n FROM events GROUP BY 1",
    ),
}


def _runner(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        from brindle.plans.queries import engine

        return engine(spark, d).query(text)

    return run


QUERIES = {n: _runner(f"from backend_log | {'where not contains(message, \"=\") | ' if n == 'parse_cef' else ''}extend line = {line} | drop level, user_id, status, method, path, message, client_ip, service, duration_ms | parse {then}") for n, (line, then, _) in LINES.items()} | {n: _runner(t) for n, (t, _) in TEXTS.items()}
ORACLES = {n: s for n, (_, _, s) in LINES.items()} | {n: s for n, (_, s) in TEXTS.items()}
