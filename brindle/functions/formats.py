"""Formats of the parse stage: a text column to named fields, as Spark columns.

A fixed format is one anchored regex with named groups; a field that is a number in every
record has its type here. Dynamic formats find their keys by one distributed pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.syntax import QueryError, closest

#: Distinct keys of a dynamic format up to which each becomes a column.
MAX_KEYS = 2_000

_CLF = r'^(?<client_ip>\S+) (?<ident>\S+) (?<user>\S+) \[(?<timestamp>[^\]]+)\] "(?<request>(?:[^"\\]|\\.)*)" (?<status>\d{3}) (?<bytes>\d+|-)'
_TIME = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?(?: \w+)?"
_HEADER = r"(?:[^|\\]|\\.)*"
#: name: (regex, integer fields, float fields)
FIXED: dict[str, tuple[str, str, str]] = {
    "combined": (_CLF + r' "(?<referer>(?:[^"\\]|\\.)*)" "(?<user_agent>(?:[^"\\]|\\.)*)"', "status bytes", ""),
    "clf": (_CLF, "status bytes", ""),
    "syslog": (
        r"^(?:<(?<priority>\d{1,3})>)?(?:(?<version>\d) )?(?<timestamp>[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+|-) (?<hostname>\S+) "
        r"(?:(?<appname>[^\s:\[]+)(?:\[(?<procid>[^\]]*)\])?: ?|(?<new_appname>\S+) (?<new_procid>\S+) (?<msgid>\S+) (?<structured_data>-|(?:\[[^\]]*\])+) ?)(?<message>.*)$",
        "priority", "",
    ),
    "nginx_error": (
        r'^(?<timestamp>\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(?<severity>\w+)\] (?<pid>\d+)#(?<tid>\d+): (?:\*(?<cid>\d+) )?(?<message>.*?)(?<tail>(?:, [a-z_]+: (?:"[^"]*"|[^,"]*))*)$',
        "pid tid cid", "",
    ),
    "apache_error": (
        r"^\[(?<timestamp>[^\]]+)\] \[(?:(?<module>[^:\]]*):)?(?<severity>\w+)\] (?:\[pid (?<pid>\d+)(?::tid (?<tid>\d+))?\] )?(?:\[client (?<client_ip>[^\]]+?)(?::(?<client_port>\d+))?\] )?(?:(?<error_code>AH\d+): )?(?<message>.*)$",
        "pid tid client_port", "",
    ),
    "redis": (r"^(?<pid>\d+):(?<role_char>[A-Z]) (?<timestamp>\d+ \w{3} (?:\d{4} )?\d\d:\d\d:\d\d(?:\.\d+)?) (?<level_char>[.\-*#]) (?<message>.*)$", "pid", ""),
    "postgres": (
        rf"^(?<timestamp>{_TIME}) \[(?<pid>\d+)\](?: (?<user>[^@\s]+)@(?<database>\S+))? (?<severity>[A-Z]+\d?): +(?<message>(?:duration: (?<duration_ms>[\d.]+) ms)?(?: *(?:statement|execute [^:]*): (?<statement>.*))?.*)$",
        "pid", "duration_ms",
    ),
    "haproxy": (
        r"^(?:.*?haproxy\[\d+\]: )?(?<client_ip>[\d.a-fA-F:]+):(?<client_port>\d+) \[(?<timestamp>[^\]]+)\] (?<frontend>[^\s~]+)~? (?<backend>[^/\s]+)/(?<server>\S+) (?<tq>-?\d+)/(?<tw>-?\d+)/(?<tc>-?\d+)/(?<tr>-?\d+)/\+?(?<tt>-?\d+) (?<status>-?\d+) \+?(?<bytes>\d+) \S+ \S+ (?<term_state>\S+)"
        r'(?: (?<actconn>\d+)/(?<feconn>\d+)/(?<beconn>\d+)/(?<srv_conn>\d+)/\+?(?<retries>\d+) \d+/\d+)?(?: (?:\{[^}]*\} ?)*)?(?: ?"(?<method>\S+) (?<uri>\S+)(?: (?<protocol>[^"]*))?")?',
        "client_port tq tw tc tr tt status bytes actconn feconn beconn srv_conn retries", "",
    ),
    "mysql_slow": (
        r"(?s)^(?:# Time: (?<timestamp>\S+(?: \S+)?)\s+)?# User@Host: (?<user>[^\[\s]+)\[[^\]]*\] @ *(?<host>\S*) *\[(?<client_ip>[^\]]*)\](?: +Id: +(?<connection_id>\d+))?\s+(?:# Schema: (?<schema>\S+).*?\n)?# Query_time: (?<query_time>[\d.]+) +Lock_time: (?<lock_time>[\d.]+) +Rows_sent: (?<rows_sent>\d+) +Rows_examined: (?<rows_examined>\d+)\s+(?:SET timestamp=\d+;\s+)?(?<statement>.*?);*\s*$",
        "connection_id rows_sent rows_examined", "query_time lock_time",
    ),
    "cef": (
        rf"(?s)^(?:.*?)CEF:(?<cef_version>\d+)\|(?<device_vendor>{_HEADER})\|(?<device_product>{_HEADER})\|(?<device_version>{_HEADER})\|(?<signature_id>{_HEADER})\|(?<name>{_HEADER})\|(?<severity>{_HEADER})(?:\|(?<extension>.*))?$",
        "cef_version", "",
    ),
    "leef": (
        r"(?s)^\s*(?i:LEEF):(?<leef_version>[\d.]+)\|(?<device_vendor>[^|]*)\|(?<device_product>[^|]*)\|(?<device_version>[^|]*)\|(?<event_id>[^|]*)(?:\|(?:(?<delimiter>0[xX][0-9a-fA-F]{2}|[^=|])\|)?(?<extension>.*))?$",
        "", "leef_version",
    ),
}
_FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
_SEVERITIES = "emergency alert critical error warning notice info debug".split()
_ROLES = {"M": "master", "S": "replica", "C": "rdb_child", "X": "sentinel"}
_REDIS_LEVELS = {".": "debug", "-": "verbose", "*": "notice", "#": "warning"}
DYNAMIC = ("json", "logfmt", "kv", "docker", "w3c")
NAMES = [*FIXED, *DYNAMIC, "regex", "pattern"]
#: Stands before each group of a text that a regex has taken apart; texts don't hold it.
_MARK = "\x1f"


def group_names(pattern: str) -> list[str]:
    return re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)


def taken_apart(col: Column, pattern: str) -> Column:
    """The named groups of a regex in col as an array, after one run of the regex; null if it doesn't match.

    Where it is used several times it must be a column of its own, so that it is made once.
    """
    java = re.sub(r"\(\?<([A-Za-z]\w*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    whole = ("" if re.match(r"(\(\?s\))?\^", java) else r"^(?s:.*?)") + f"(?:{java})" + ("" if java.endswith("$") else r"(?s:.*)$")
    marked = F.regexp_replace(col, whole, "".join(_MARK + "${" + n.replace("_", "") + "}" for n in group_names(pattern)) or _MARK)
    return F.when(marked.startswith(_MARK), F.split(F.substring(marked, 2, F.length(marked)), _MARK, -1))


def by_regex(groups: Column, pattern: str) -> tuple[Column, dict[str, Column]]:
    """(matched, field columns) of a regex with named groups, from what taken_apart gave; a group that takes no part is null."""
    return groups.isNotNull(), {n: F.nullif(groups[i], F.lit("")) for i, n in enumerate(group_names(pattern))}


def fixed(name: str, groups: Column) -> tuple[Column, dict[str, Column]]:
    """The fields of a fixed format, from what taken_apart gave."""
    pattern, ints, floats = FIXED[name]
    ok, out = by_regex(groups, pattern)
    if name in ("combined", "clf"):
        out = {k: F.nullif(c, F.lit("-")) for k, c in out.items()}
    if name == "cef":
        plain = lambda c: F.regexp_replace(c, r"\\([|\\])", "$1")
        out = {k: c if k in ("extension", "cef_version") else plain(c) for k, c in out.items()}
    out = {k: c.try_cast("bigint") if k in ints.split() else c.try_cast("double") if k in floats.split() else c for k, c in out.items()}
    if name in ("combined", "clf"):
        words = F.split(out["request"], " ")
        out |= {"method": words[0], "uri": F.try_element_at(words, F.lit(2)), "protocol": F.try_element_at(words, F.lit(3))}
    if name == "nginx_error":
        tail = out.pop("tail")
        for k in ("client", "server", "request", "upstream", "host", "referrer"):
            out[k] = F.nullif(F.regexp_replace(F.regexp_extract(tail, rf', {k}: ("[^"]*"|[^,]*)', 1), '^"|"$', ""), F.lit(""))
        words = F.split(out["request"], " ")
        out |= {"method": words[0], "uri": F.try_element_at(words, F.lit(2))}
    if name == "syslog":
        out["appname"], out["procid"] = F.coalesce(out["appname"], out.pop("new_appname")), F.coalesce(out["procid"], out.pop("new_procid"))
        p = out["priority"]
        out |= {"facility": F.floor(p / 8).cast("bigint"), "severity": (p % 8).cast("bigint")}
        out["facility_name"] = F.try_element_at(F.array(*map(F.lit, _FACILITIES)), (out["facility"] + 1).cast("int"))
        out["severity_name"] = F.try_element_at(F.array(*map(F.lit, _SEVERITIES)), (out["severity"] + 1).cast("int"))
        out["format"] = F.when(ok, F.when(out["version"].isNotNull(), "rfc5424").otherwise("rfc3164"))
    if name == "redis":
        out |= {"role": _mapped(out["role_char"], _ROLES), "level": _mapped(out["level_char"], _REDIS_LEVELS)}
    return ok, out


def leef_pairs(extension: Column, delimiter: Column) -> Column:
    """key=value pairs of a LEEF text, between tabs or the character its header names."""
    hexed = F.when(F.length(delimiter) == 4, F.char(F.conv(F.substring(delimiter, 3, 2), 16, 10).cast("int")))
    by = F.coalesce(hexed, delimiter, F.lit("\t"))
    each = F.filter(F.split(F.translate(extension, _MARK, " "), F.concat(F.lit(r"\Q"), by, F.lit(r"\E"))), lambda x: x.contains("="))
    keyed = F.transform(each, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    # of equal keys the last counts
    names = F.transform(keyed, lambda e: e.key)
    last = F.filter(keyed, lambda e, i: i == F.size(keyed) - F.array_position(F.reverse(names), e.key))
    return F.when(F.size(keyed) > 0, F.map_from_entries(last))


def _mapped(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in names.items()))


def pattern_regex(template: str) -> str:
    """A template such as `<ip> - <user> [<_>]` as a regex; <_> skips."""
    parts = re.split(r"<(\w+)>", template)
    out = re.escape(parts[0])
    for i in range(1, len(parts), 2):
        body = ".*?" if parts[i + 1] else ".*"
        out += (f"(?:{body})" if parts[i] == "_" else f"(?<{parts[i]}>{body})") + re.escape(parts[i + 1])
    return "^" + out + "$"


def pairs(col: Column, sep: str | None, assign: str) -> Column:
    """key=value pairs as a map, the last of equal keys; values may be quoted."""
    a, gap = re.escape(assign), r"\s" if sep is None else re.escape(sep)
    p = rf"(?:^|{gap})\s*([\w.@/-]+){a}(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^{gap}\"']*)" if sep else rf"(?:^|[\s|,;(])([\w.@/-]+){a}(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s\"']*)"
    keys, values = F.regexp_extract_all(col, F.lit(p), F.lit(1)), F.regexp_extract_all(col, F.lit(p), F.lit(2))
    bare = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r"^([\"'])(.*)\1$", "$2"), r"\\([\"\\])", "$1"))
    last = F.filter(F.arrays_zip(keys.alias("k"), bare.alias("v"), F.transform(keys, lambda k, i: i).alias("i")), lambda e: e.i == F.size(keys) - F.array_position(F.reverse(keys), e.k))
    return F.when(F.size(keys) > 0, F.map_from_entries(F.transform(last, lambda e: F.struct(e.k, e.v))))


def infer_map(df: DataFrame, col: Column) -> dict[str, str]:
    """Keys of a map column with the narrowest type that holds all of their values, by one pass."""
    each = df.select(F.explode(col).alias("k", "v")).filter("v is not null")
    found = each.groupBy("k").agg(
        F.min(F.lower("v").isin("true", "false")).alias("bool"), F.min(F.col("v").try_cast("bigint").isNotNull() & F.col("v").rlike(r"^-?\d+$")).alias("int"), F.min(F.col("v").try_cast("double").isNotNull() & F.col("v").rlike(r"^[-+.\deE]+$")).alias("float")
    )
    rows = found.orderBy("k").limit(MAX_KEYS + 1).collect()
    if len(rows) > MAX_KEYS:
        raise QueryError(f"more than {MAX_KEYS} keys", hint="name the fields with into (...)")
    return {r["k"]: "boolean" if r["bool"] else "bigint" if r["int"] else "double" if r["float"] else "string" for r in rows}


def infer_json(df: DataFrame, text: Column) -> list[tuple[list[str], str]]:
    """(path, type) of each leaf of the objects in a text column; arrays are leaves. One pass over all rows."""
    name = df.select(F.schema_of_variant_agg(F.try_parse_json(text))).first()[0] or "VOID"
    out: list[tuple[list[str], str]] = []

    def walk(t: str, path: list[str]) -> None:
        if t.startswith("OBJECT<"):
            for k, v in _split_fields(t[7:-1]):
                walk(v, [*path, k])
        elif path:
            kind = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "VOID": "string", "STRING": "string"}.get(t)
            out.append((path, kind or ("double" if t.startswith("DECIMAL") else "variant" if t.startswith(("ARRAY", "VARIANT")) else "string")))

    walk(name, [])
    if len(out) > MAX_KEYS:
        raise QueryError(f"more than {MAX_KEYS} keys", hint="name the fields with into (...)")
    return out


def _split_fields(body: str) -> list[tuple[str, str]]:
    out, depth, start, at, quoted = [], 0, 0, 0, False
    while at <= len(body):
        c = body[at] if at < len(body) else ","
        if c == "`":
            quoted = not quoted
        elif not quoted:
            depth += (c in "<(") - (c in ">)")
            if c == "," and depth == 0:
                part = body[start:at].strip()
                if part:
                    m = re.match(r"(`(?:[^`]|``)*`|[^:]+):\s*(.*)$", part, re.S)
                    out.append((m[1].strip("`").strip(), m[2]))
                start = at + 1
        at += 1
    return out


def known(name: str) -> str:
    if name not in NAMES:
        raise QueryError(f"{name} isn't a format", hint=closest(name, NAMES))
    return name
