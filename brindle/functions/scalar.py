"""The scalar functions. Null in, null out, unless said otherwise; failing conversions give null, their ! forms fail the query."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.binding import DURATION, Scope, Typed, bind, common, compare, from_micros, kind, micros, nothing, null, predicate
from brindle.plans.syntax import QueryError

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


class Spec(NamedTuple):
    least: int
    most: int | None
    build: Callable[..., Typed]
    raw: bool = False
    strict: bool = False
    strict_build: Any = None


FUNCTIONS: dict[str, Spec] = {}


def fn(name: str, least: int, most: int | None = -1, raw: bool = False, strict=None):
    def add(build):
        for n in name.split():
            FUNCTIONS[n] = Spec(least, least if most == -1 else most, build, raw, strict is not None, strict)
        return build

    return add


def text(t: Typed) -> Column:
    if t.kind in ("array", "object"):
        return F.to_json(t.col)
    if t.kind == "any":
        return F.try_variant_get(t.col, "$", "string")
    if t.kind == "timestamp":
        return F.date_format(t.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t.col.cast("string")


def needs(t: Typed, *kinds: str) -> bool:
    return t.kind in kinds


# conversion
def _to_int(_, x):
    if x.kind == "string":
        return Typed(F.coalesce(x.col.try_cast("bigint"), F.when(x.col.try_cast("double").isNotNull(), x.col.try_cast("double").try_cast("bigint"))), L)
    return Typed(x.col.try_cast("bigint") if x.kind in ("int", "float", "bool") else F.try_variant_get(x.col, "$", "bigint") if x.kind == "any" else micros(x) if x.kind == "duration" else nothing(L), L)


def _to_float(_, x):
    return Typed(x.col.try_cast("double") if x.kind in ("int", "float", "string", "bool") else F.try_variant_get(x.col, "$", "double") if x.kind == "any" else nothing(D), D)


def _to_bool(_, x):
    if x.kind == "string":
        s = F.lower(F.trim(x.col))
        return Typed(F.when(s.isin("true", "t", "1", "yes", "y"), True).when(s.isin("false", "f", "0", "no", "n", ""), False), B)
    return Typed(x.col if x.kind == "bool" else x.col != 0 if x.kind in ("int", "float") else nothing(B), B)


def _to_time(_, x, layout=None):
    if x.kind == "timestamp":
        return Typed(x.col.cast(TS), TS)
    if x.kind != "string":
        return Typed(nothing(TS), TS)
    return Typed(F.try_to_timestamp(x.col, F.lit(java_layout(layout.value))) if layout else x.col.try_cast(TS), TS)


_UNIT = {"ns": 0.001, "us": 1, "ms": 1e3, "s": 1e6, "m": 6e7, "h": 3.6e9, "d": 8.64e10, "w": 6.048e11}


def _to_duration(_, x):
    if x.kind == "duration":
        return x
    n = F.regexp_extract(x.col, r"^\s*(-?\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d|w)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(x.col, r"(ns|us|ms|s|m|h|d|w)\s*$", 1)
    scale = F.coalesce(*(F.when(unit == u, F.lit(float(v))) for u, v in _UNIT.items()))
    return Typed(from_micros(F.round(n * scale).cast("bigint")), DURATION) if x.kind == "string" else Typed(nothing(DURATION), DURATION)


def _strictly(lenient, name: str):
    def build(*args):
        out = lenient(None, *args)
        fail = F.raise_error(F.concat(F.lit(f"{name}: can't convert "), F.coalesce(args[0].col.cast("string"), F.lit("null"))))
        return Typed(F.when(args[0].col.isNull() | out.col.isNotNull(), out.col).otherwise(fail.cast(out.type)), out.type)

    return build


for _name, _build, _most in (("int", _to_int, 1), ("float", _to_float, 1), ("bool", _to_bool, 1), ("timestamp", _to_time, 2), ("duration", _to_duration, 1)):
    FUNCTIONS[_name] = Spec(1, _most, _build, False, True, _strictly(_build, _name))


@fn("string", 1)
def _(_, x):
    return Typed(text(x), S)


# conditional
@fn("if", 3, raw=True)
def _(args, scope: Scope):
    c, a, b = predicate(args[0], scope), bind(args[1], scope), bind(args[2], scope)
    t = common([a.type, b.type])
    if t is None:
        t, a, b = S, Typed(text(a), S), Typed(text(b), S)
    return Typed(F.when(c, a.col.cast(t) if kind(t) != "null" else a.col).when(~c, b.col.cast(t) if kind(t) != "null" else b.col), t)


@fn("case", 2, None, raw=True)
def _(args, scope: Scope):
    default = bind(args[-1], scope) if len(args) % 2 else None
    pairs = [(predicate(args[i], scope), bind(args[i + 1], scope)) for i in range(0, len(args) - len(args) % 2, 2)]
    values = [v for _, v in pairs] + ([default] if default else [])
    t = common([v.type for v in values])
    as_ = (lambda v: v.col.cast(t)) if t is not None and kind(t) != "null" else (lambda v: text(v))
    out = None
    for c, v in pairs:
        out = F.when(c, as_(v)) if out is None else out.when(c, as_(v))
    return Typed(out.otherwise(as_(default)) if default else out, t if t is not None and kind(t) != "null" else S)


@fn("coalesce", 1, None)
def _(_, *xs):
    t = common([x.type for x in xs])
    if t is None:
        return Typed(F.coalesce(*(text(x) for x in xs)), S)
    return Typed(F.coalesce(*(x.col.cast(t) for x in xs)), t) if kind(t) != "null" else null()


@fn("nullif", 2)
def _(_, a, b):
    return Typed(F.when(F.coalesce(compare("==", a, b), F.lit(False)), None).otherwise(a.col), a.type)


@fn("exists", 1)
def _(_, x):
    return Typed(F.lit(False) if x.kind == "null" else x.col.isNotNull(), B)


@fn("is_null", 1)
def _(_, x):
    if x.kind == "any":
        return Typed(F.coalesce(F.is_variant_null(x.col), F.lit(False)), B)
    return Typed(F.lit(False) if x.missing else x.col.isNull(), B)


@fn("is_missing", 1)
def _(_, x):
    return Typed(F.lit(True) if x.missing else x.col.isNull() if x.kind == "any" else F.lit(False), B)


@fn("typeof", 1)
def _(_, x):
    if x.missing:
        return Typed(F.lit("missing"), S)
    if x.kind == "any":
        return Typed(F.coalesce(F.lower(F.schema_of_variant(x.col)), F.lit("missing")), S)
    return Typed(F.when(x.col.isNull(), "null").otherwise(x.kind), S)


# strings
@fn("len", 1)
def _(_, x):
    if isinstance(x.type, T.StructType):
        return Typed(F.when(x.col.isNotNull(), F.lit(len(x.type)).cast("bigint")), L)
    return Typed((F.length(x.col) if x.kind == "string" else F.when(x.col.isNotNull(), F.size(x.col)) if x.kind in ("array", "object") else nothing(L)).cast("bigint"), L)


for _name, _f in (("lower", F.lower), ("upper", F.upper)):
    fn(_name, 1)(lambda _, x, f=_f: Typed(f(text(x)), S))
for _name, _f in (("trim", F.btrim), ("ltrim", F.ltrim), ("rtrim", F.rtrim)):
    fn(_name, 1, 2)(lambda _, x, chars=None, f=_f: Typed(f(text(x), chars.col if chars else F.lit(" \t\n\r\x0b\x0c")), S))


def _clamped(i: Column, n: Column) -> Column:
    return F.greatest(F.least(F.when(i < 0, n + i).otherwise(i), n), F.lit(0))


@fn("substr", 2, 3)
def _(_, s, start, length=None):
    x, n = text(s), F.length(text(s)).cast("bigint")
    at = F.when(start.col < 0, F.greatest(n + start.col, F.lit(0))).otherwise(start.col)
    size = F.greatest(length.col, F.lit(0)) if length else n
    return Typed(F.substring(x, (at + 1).cast("int"), F.least(size, n).cast("int")), S)


def java_regex(t: Typed) -> str:
    """A regex literal, with named groups as Java spells them; what would not be portable is refused."""
    if not isinstance(t.value, str):
        raise QueryError("a regex must be a literal string")
    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]", t.value):
        raise QueryError("regexes have no lookaround and no backreferences")
    return re.sub(r"\(\?P?<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", t.value)


@fn("replace", 3)
def _(_, s, pattern, to):
    return Typed(F.regexp_replace(text(s), F.lit(java_regex(pattern)), to.col), S)


@fn("split", 2)
def _(_, s, sep):
    return Typed(F.split(text(s), F.lit(re.escape(sep.value)) if sep.value is not None else F.concat(F.lit("\\Q"), sep.col, F.lit("\\E")), -1), T.ArrayType(S))


@fn("join", 2)
def _(_, a, sep):
    if a.kind != "array":
        return Typed(nothing(S), S)
    return Typed(F.array_join(F.transform(a.col, lambda x: text(Typed(x, a.type.elementType))), sep.value if sep.value is not None else ","), S)


@fn("starts_with", 2)
def _(_, s, p):
    return Typed(text(s).startswith(p.col), B)


@fn("ends_with", 2)
def _(_, s, p):
    return Typed(text(s).endswith(p.col), B)


@fn("printf", 1, None)
def _(_, form, *args):
    if not isinstance(form.value, str):
        raise QueryError("printf takes a literal format")
    verbs = re.findall(r"%(?:%|[-+# 0]*\d*(?:\.\d+)?[a-zA-Z])", form.value)
    cols, k = [], 0
    for v in verbs:
        if v == "%%" or k >= len(args):
            continue
        a = args[k]
        cols.append(a.col.cast("double") if v[-1] in "feg" else a.col.cast("bigint") if v[-1] in "dxo" else text(a))
        k += 1
    return Typed(F.format_string(re.sub(r"%([-+# 0]*\d*)[vqt]", r"%\1s", form.value), *cols) if cols else F.lit(form.value.replace("%%", "%")), S)


@fn("urldecode", 1)
def _(_, s):
    return Typed(F.try_url_decode(text(s)), S)


@fn("url_parse", 1)
def _(_, s):
    part = lambda p: F.try_parse_url(text(s), F.lit(p))
    authority = F.try_parse_url(text(s), F.lit("AUTHORITY"))
    pairs = F.when(part("QUERY").isNotNull(), F.map_from_entries(F.transform(F.split(part("QUERY"), "&"), lambda p: F.struct(F.coalesce(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.lit("")).alias("key"), F.try_url_decode(F.split_part(p, F.lit("="), F.lit(2))).alias("value")))))
    t = T.StructType([T.StructField(n, x) for n, x in (("scheme", S), ("host", S), ("port", L), ("path", S), ("query", T.MapType(S, S)), ("fragment", S))])
    out = F.struct(F.try_parse_url(text(s), F.lit("PROTOCOL")).alias("scheme"), part("HOST").alias("host"), F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit("")).try_cast("bigint").alias("port"), part("PATH").alias("path"), pairs.alias("query"), part("REF").alias("fragment"))
    return Typed(F.when(F.try_parse_url(text(s), F.lit("PROTOCOL")).isNotNull(), out), t)


@fn("path_normalize", 1)
def _(_, s):
    """Segments that are UUIDs, long hex numbers or numbers become placeholders."""
    x = F.regexp_replace(text(s), r"(?i)(?<=/)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?=/|$)", ":uuid")
    x = F.regexp_replace(x, r"(?<=/)\d+(?=/|$)", ":id")
    return Typed(F.regexp_replace(x, r"(?i)(?<=/)(?=[0-9a-f]*\d)[0-9a-f]{8,}(?=/|$)", ":hex"), S)


@fn("useragent_parse", 1)
def _(_, s):
    """browser, version and os by their usual names; null parts where none is known."""
    x = text(s)
    first = lambda p, i: F.nullif(F.regexp_extract(x, p, i), F.lit(""))
    browser = r"(Edg|OPR|Firefox|Chrome|Version|curl|Wget|[A-Za-z-]+bot)/([\d.]+)"
    os_ = F.coalesce(*(F.when(x.contains(k), F.lit(v)) for k, v in (("Windows", "Windows"), ("Android", "Android"), ("iPhone", "iOS"), ("Mac OS X", "macOS"), ("Linux", "Linux"))))
    return Typed(F.when(x.isNotNull(), F.struct(first(browser, 1).alias("browser"), first(browser, 2).alias("version"), os_.alias("os"))), T.StructType([T.StructField(k, S) for k in ("browser", "version", "os")]))


# search
def token_test(field: Column, word: str) -> Column:
    """Whether every token (run of letters and digits) of word is a token of field; case doesn't matter."""
    out = F.lit(True)
    for t in re.findall(r"[^\W_]+", word.lower()):
        # the plain test is cheap and rules out most rows before the regex runs
        out = out & F.lower(field).contains(t) & F.lower(field).rlike(rf"(?<![\p{{L}}\p{{Nd}}]){re.escape(t)}(?![\p{{L}}\p{{Nd}}])")
    return out


def glob_regex(pattern: str) -> str:
    return "".join("(?s:.*)" if c == "*" else "(?s:.)" if c == "?" else re.escape(c) for c in pattern)


@fn("has", 2)
def _(_, f, word):
    return Typed(token_test(text(f), str(word.value)) if word.value is not None else F.array_contains(F.split(F.lower(text(f)), r"[^\p{L}\p{Nd}]+"), F.lower(word.col)), B)


@fn("contains", 2)
def _(_, f, s):
    return Typed(F.lower(text(f)).contains(F.lower(text(s))), B)


@fn("contains_cs", 2)
def _(_, f, s):
    return Typed(text(f).contains(text(s)), B)


@fn("glob", 2)
def _(_, f, p):
    return Typed(text(f).rlike("^" + glob_regex(str(p.value)) + "$"), B)


@fn("has_glob", 2)
def _(_, f, p):
    inner = "".join(r"[\p{L}\p{Nd}]*" if c == "*" else r"[\p{L}\p{Nd}]" if c == "?" else re.escape(c) for c in str(p.value).lower())
    return Typed(F.lower(text(f)).rlike(rf"(?<![\p{{L}}\p{{Nd}}]){inner}(?![\p{{L}}\p{{Nd}}])"), B)


@fn("matches", 2)
def _(_, f, p):
    return Typed(text(f).rlike(java_regex(p)), B)


@fn("extract", 2)
def _(_, f, p):
    r = java_regex(p)
    return Typed(F.when(text(f).rlike(r), F.regexp_extract(text(f), r, 1 if re.compile(re.sub(r"\(\?<", "(?P<", r)).groups else 0)), S)


@fn("extract_all", 2)
def _(_, f, p):
    r = java_regex(p)
    found = F.regexp_extract_all(text(f), F.lit(r), F.lit(1 if re.compile(re.sub(r"\(\?<", "(?P<", r)).groups else 0))
    return Typed(F.when(F.size(found) > 0, found), T.ArrayType(S))


# numbers
def _number(x: Typed) -> Column:
    return x.col.cast("double") if x.kind in ("int", "float") else nothing(D)


@fn("abs", 1)
def _(_, x):
    return Typed(F.abs(x.col), x.type) if x.kind in ("int", "float") else null()


@fn("round", 1, 2)
def _(_, x, d=None):
    return Typed(F.round(_number(x), int(d.value) if d and d.value is not None else 0).cast("double"), D)


fn("floor", 1)(lambda _, x: Typed(F.floor(_number(x)).cast("bigint"), L))
fn("ceil", 1)(lambda _, x: Typed(F.ceil(_number(x)).cast("bigint"), L))
fn("sqrt", 1)(lambda _, x: Typed(F.when(_number(x) >= 0, F.sqrt(_number(x))), D))
fn("exp", 1)(lambda _, x: Typed(F.exp(_number(x)), D))
fn("ln", 1)(lambda _, x: Typed(F.when(_number(x) > 0, F.ln(_number(x))), D))


@fn("log", 1, 2)
def _(_, x, base=None):
    v = _number(x)
    if base is None:
        return Typed(F.when(v > 0, F.log10(v)), D)
    b = _number(base)
    return Typed(F.when((v > 0) & (b > 0) & (b != 1), F.ln(v) / F.ln(b)), D)


fn("pow", 2)(lambda _, x, y: Typed(F.pow(_number(x), _number(y)), D))


@fn("clamp", 3)
def _(_, x, lo, hi):
    t = common([x.type, lo.type, hi.type]) or D
    a, b, c = (v.col.cast(t) for v in (x, lo, hi))
    return Typed(F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.least(F.greatest(a, b), c)), t)


@fn("bucket", 2)
def _(_, x, bounds):
    return Typed(F.when(x.col.isNotNull(), F.array_max(F.filter(bounds.col, lambda b: b <= x.col))), bounds.type.elementType) if bounds.kind == "array" else null()


for _name in ("sin", "cos", "tan", "asin", "acos", "atan"):
    fn(_name, 1)(lambda _, x, f=getattr(F, _name): Typed(f(_number(x)), D))
fn("atan2", 2)(lambda _, y, x: Typed(F.atan2(_number(y), _number(x)), D))


# time
@fn("now", 0)
def _(scope):
    return Typed(F.lit(scope.now).cast(TS), TS)


def bin_micros(us: Column, span: int) -> Column:
    return us - F.pmod(us, F.lit(int(span)).cast("bigint"))


@fn("bin", 2)
def _(_, x, span):
    if not isinstance(span.value, int) or span.value <= 0:
        return Typed(nothing(TS if x.kind == "timestamp" else x.type), x.type)
    if x.kind == "string":
        x = _to_time(None, x)
    if x.kind == "timestamp":
        return Typed(F.timestamp_micros(bin_micros(F.unix_micros(x.col.cast(TS)), span.value)), TS)
    if x.kind == "duration":
        return Typed(from_micros(bin_micros(micros(x), span.value)), DURATION)
    if x.kind == "int":
        return Typed(bin_micros(x.col, span.value), L)
    if x.kind == "float":
        return Typed(F.floor(x.col / span.value) * float(span.value), D)
    return null()


#: strftime tokens and what Java calls them (fixed values).
_TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%p": "a", "%I": "hh", "%Z": "z", "%z": "Z", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%f": "SSSSSS", "%j": "DDD", "%y": "yy"}


def java_layout(layout: str) -> str:
    out = []
    for part in re.split(r"(%.)", layout):
        out.append(_TOKENS.get(part, "%" if part == "%%" else None) or (re.sub(r"([A-Za-z]+)", r"'\1'", part) if not part.startswith("%") else part))
    return "".join(out)


@fn("strftime", 2)
def _(_, x, layout):
    col = F.timestamp_seconds(x.col) if x.kind in ("int", "float") else x.col.cast(TS) if x.kind == "timestamp" else x.col.try_cast(TS)
    return Typed(F.date_format(col, java_layout(str(layout.value))), S)


def _strptime(_, s, layout):
    return Typed(F.try_to_timestamp(text(s), F.lit(java_layout(str(layout.value)))), TS)


FUNCTIONS["strptime"] = Spec(2, 2, _strptime, False, True, _strictly(_strptime, "strptime"))
fn("time_of_day", 1)(lambda _, x: Typed(x.col - F.date_trunc("day", x.col), DURATION) if x.kind == "timestamp" else Typed(nothing(DURATION), DURATION))
fn("day_of_week", 1)(lambda _, x: Typed((F.dayofweek(x.col) - 1).cast("bigint") if x.kind == "timestamp" else nothing(L), L))


# hashes and addresses
fn("md5", 1)(lambda _, x: Typed(F.md5(text(x)), S))
fn("sha1", 1)(lambda _, x: Typed(F.sha1(text(x)), S))
fn("sha256", 1)(lambda _, x: Typed(F.sha2(text(x), 256), S))


def _arrow_udf(f, returns):
    @F.pandas_udf(returns)
    def run(s):
        import pandas as pd

        return pd.Series([None if v is None or v != v else f(v) for v in s], dtype=object)

    return run


@fn("xxhash64", 1)
def _(_, x):
    """Seed 0, which Spark's own function doesn't offer, as hex digits without leading zeros."""

    def hashed(s):
        import xxhash

        return f"{xxhash.xxh64_intdigest(s):x}"

    return Typed(_arrow_udf(hashed, "string")(text(x)), S)


def ipv4(x: Column) -> Column:
    """An IPv4 address as a number, else null."""
    ok = x.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    p = F.split(x, r"\.")
    return F.when(ok, sum((p[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)), p[0].cast("bigint") * (1 << 24)))


@fn("cidr_match", 2)
def _(_, cidr, ip):
    import ipaddress

    if isinstance(cidr.value, str):
        try:
            net = ipaddress.ip_network(cidr.value, strict=False)
        except ValueError:
            return Typed(F.lit(None).cast("boolean"), B)
        if net.version == 4:
            return Typed(ipv4(text(ip)).between(int(net.network_address), int(net.broadcast_address)), B)

    def inside(s):
        c, a = s.split("|", 1)
        try:
            return ipaddress.ip_address(a) in ipaddress.ip_network(c, strict=False)
        except ValueError:
            return None

    return Typed(_arrow_udf(inside, "boolean")(F.concat(text(cidr), F.lit("|"), text(ip))), B)


@fn("ip_parse", 1)
def _(_, x):
    def parsed(s):
        import ipaddress

        try:
            a = ipaddress.ip_address(s)
        except ValueError:
            return None
        return f"{a.version}|{str(a.is_private).lower()}|{str(a.is_loopback).lower()}"

    p = F.split(_arrow_udf(parsed, "string")(text(x)), r"\|")
    return Typed(F.when(p.isNotNull(), F.struct(p[0].cast("bigint").alias("version"), p[1].cast("boolean").alias("private"), p[2].cast("boolean").alias("loopback"))), T.StructType([T.StructField("version", L), T.StructField("private", B), T.StructField("loopback", B)]))


@fn("ipmask", 2)
def _(_, mask, ip):
    n = ipv4(text(mask)).bitwiseAND(ipv4(text(ip)))
    return Typed(F.when(n.isNotNull(), F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))), S)


# arrays and objects
@fn("slice", 2, 3)
def _(_, a, i, j=None):
    if a.kind != "array":
        return null()
    n = F.size(a.col).cast("bigint")
    low, high = _clamped(i.col, n), _clamped(j.col, n) if j else n
    return Typed(F.when(a.col.isNotNull(), F.slice(a.col, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))), a.type)


@fn("array_concat", 1, None)
def _(_, *xs):
    t = common([x.type.elementType for x in xs if x.kind == "array"])
    return Typed(F.concat(*(x.col.cast(T.ArrayType(t)) for x in xs)), T.ArrayType(t)) if t is not None and all(x.kind == "array" for x in xs) else null()


fn("array_distinct", 1)(lambda _, a: Typed(F.array_distinct(a.col), a.type) if a.kind == "array" else null())
fn("array_sort", 1)(lambda _, a: Typed(F.array_sort(a.col), a.type) if a.kind == "array" else null())
fn("flatten", 1)(lambda _, a: (Typed(F.flatten(a.col), a.type.elementType) if kind(a.type.elementType) == "array" else a) if a.kind == "array" else null())


def _over(args, scope: Scope):
    a = bind(args[0], scope)
    if a.kind != "array" or args[1][0] != "lambda":
        return a, None
    body = lambda x: bind(args[1][2], scope.with_local(args[1][1], Typed(x, a.type.elementType)))
    return a, body


def _truth(t: Typed) -> Column:
    return t.col if t.kind == "bool" else F.lit(None).cast("boolean")


@fn("any", 2, raw=True)
def _(args, scope):
    a, body = _over(args, scope)
    return Typed(F.exists(a.col, lambda x: _truth(body(x))), B) if body else Typed(nothing(B), B)


@fn("all", 2, raw=True)
def _(args, scope):
    a, body = _over(args, scope)
    return Typed(F.forall(a.col, lambda x: _truth(body(x))), B) if body else Typed(nothing(B), B)


@fn("filter", 2, raw=True)
def _(args, scope):
    a, body = _over(args, scope)
    return Typed(F.filter(a.col, lambda x: _truth(body(x))), a.type) if body else null()


@fn("map", 2, raw=True)
def _(args, scope):
    a, body = _over(args, scope)
    if not body:
        return null()
    return Typed(F.transform(a.col, lambda x: body(x).col), T.ArrayType(body(F.lit(None).cast(a.type.elementType)).type))


@fn("keys", 1)
def _(_, o):
    if isinstance(o.type, T.StructType):
        return Typed(F.when(o.col.isNotNull(), F.array(*(F.lit(k) for k in sorted(o.type.names)))), T.ArrayType(S))
    return Typed(F.array_sort(F.map_keys(o.col)), T.ArrayType(S)) if isinstance(o.type, T.MapType) else null()


@fn("values", 1)
def _(_, o):
    if isinstance(o.type, T.StructType):
        names = sorted(o.type.names)
        t = common([o.type[k].dataType for k in names])
        cols = [o.col.getField(k).cast(t) if t is not None else text(Typed(o.col.getField(k), o.type[k].dataType)) for k in names]
        return Typed(F.when(o.col.isNotNull(), F.array(*cols)), T.ArrayType(t if t is not None else S))
    if isinstance(o.type, T.MapType):
        return Typed(F.transform(F.array_sort(F.map_keys(o.col)), lambda k: F.try_element_at(o.col, k)), T.ArrayType(o.type.valueType))
    return null()


@fn("merge", 2)
def _(_, a, b):
    if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        names = {k: (a, a.type[k].dataType) for k in a.type.names} | {k: (b, b.type[k].dataType) for k in b.type.names}
        return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), F.struct(*(o.col.getField(k).alias(k) for k, (o, _) in names.items()))), T.StructType([T.StructField(k, t) for k, (_, t) in names.items()]))
    if isinstance(a.type, T.MapType) and a.type == b.type:
        kept = F.map_filter(a.col, lambda k, v: ~F.map_contains_key(b.col, k))
        return Typed(F.map_concat(kept, b.col), a.type)
    return null()


@fn("has_key", 2)
def _(_, o, k):
    if isinstance(o.type, T.StructType):
        return Typed(F.when(o.col.isNotNull(), F.lit(k.value in o.type.names)), B)
    if isinstance(o.type, T.MapType):
        return Typed(F.map_contains_key(o.col, k.col), B)
    return Typed(F.try_variant_get(o.col, f"$.{k.value}", "variant").isNotNull() if o.kind == "any" else nothing(B), B)


@fn("to_json", 1)
def _(_, x):
    if x.kind in ("array", "object", "any"):
        return Typed(F.to_json(x.col), S)
    if x.kind in ("string", "timestamp"):
        body = F.to_json(F.array(text(x)))
        return Typed(F.substring(body, F.lit(2), F.length(body) - 2), S)
    return Typed(text(x), S)


def _from_json(_, s):
    return Typed(F.try_parse_json(text(s)), T.VariantType())


FUNCTIONS["from_json"] = Spec(1, 1, _from_json, False, True, lambda s: Typed(F.parse_json(text(s)), T.VariantType()))
