"""Mixed timestamp layouts and zones, normalised to one UTC instant.

An ordered cascade of anchored patterns, each rewriting a text to the same list of
parts (kind|year|month|day|hour|minute|second|fraction|half|zone); the parts are then
checked strictly (no month 13, no second 60, no 30 February). All of it runs as
Catalyst expressions.

Policies:
- explicit offset or Z: that instant; no zone or a zone abbreviation: the zone of the source;
- an ambiguous local time (clocks set back) with a zone abbreviation of summer or standard
  time: the one it names; without one, and for a date without a year and digits whose order
  nothing settles, several instants are left: the latest not after received_at, the
  earliest of all if every one is later (or received_at is null: the earliest);
- a nonexistent local time (clocks set forward) is read with the offset before the change;
- digits beyond microseconds are cut off;
- null, blank and placeholder texts, and texts no pattern accepts, state no time (null);
- a null zone is UTC, an unknown one makes local times null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.shared import fence, small_side

#: Texts that state no time (fixed values).
PLACEHOLDERS = ("", "-", "--", "null", "none", "nil", "n/a", "na", "nan", "unknown", "undefined", "?")

#: Abbreviations of summer time, and of standard time (fixed values).
SUMMER, STANDARD = "^([A-Z]{1,3}DT|CEST|EEST|WEST|MEST|MESZ|BST|IST)$", "^(CET|EET|WET|MET|MEZ|GMT|[A-Z]{1,3}ST)$"

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_MONTH = r"([A-Za-z]{3})[A-Za-z]{0,6}\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_ZONE = r"\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})?(?:\s*\([A-Za-z ]+\))?"
#: name, pattern, parts. In order: the first pattern that accepts a text reads it.
CASCADE = (
    ("epoch", r"^(\d{9,19})(?:[.,](\d{1,12}))?$", "e|$1|||||$2||||"),
    ("iso", rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:T|t|\s+){_CLOCK}{_ZONE}$", "f|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,12}))?" + _ZONE + "$", "f|$1|$2|$3|$4|$5|$6|$7||$8"),
    ("clf", rf"^(\d{{1,2}})/{_MONTH}/(\d{{4}}):{_CLOCK}{_ZONE}$", "f|$3|$2|$1|$4|$5|$6|$7||$8"),
    ("mail", rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "f|$3|$2|$1|$4|$5|$6|$7||$8"),
    ("asctime", rf"^(?:[A-Za-z]{{3}}\s+)?{_MONTH}\s+(\d{{1,2}})\s+(?:(\d{{4}})\s+)?{_CLOCK}(?:\s+(\d{{4}}))?{_ZONE}$", "f|$3$8|$1|$2|$4|$5|$6|$7||$9"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "f|$3|$2|$1|$4|$5|$6|$7||$8"),
    ("digits", rf"^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}}),?\s+{_CLOCK}\s*([AaPp][Mm])?{_ZONE}$", "o|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("glog", rf"^[A-Z]?(\d{{2}})(\d{{2}})\s+{_CLOCK}$", "f||$1|$2|$3|$4|$5|$6||"),
)

#: How an entry's own timestamp is written in its head.
STAMP = (
    r"\d{4}[-/]\d{2}[-/]\d{2}[Tt ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,12})?)?(?:\s?(?:Z|[+-]\d{2}:?\d{2})(?![\w:])| (?!INFO?|WARN|WRN|DBG|TRC|ERR|CRIT|FTL|LOG)[A-Z]{3,4}(?=[\] ]))?"
    r"|\d{8}T\d{6}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|(?:[A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}(?: (?:[+-]\d{4}|[A-Z]{3,4}))?"
    r"|[A-Z][a-z]{2} +\d{1,2} (?:\d{4} )?\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
    r"|\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}"
)
#: What may stand before an entry's own timestamp, and the timestamp, as one text.
_STAMP = STAMP + r"|\d{1,2}[./]\d{1,2}[./]\d{4},? \d{1,2}:\d{2}(?::\d{2})?(?: [AP]M)?"
ENTRY_HEAD = (
    r"^\s*(?:<\d{1,3}>(?:\d{1,2} )?)?\[?(?:(?:ts|time|timestamp|@timestamp|t|date)=)?\"?"
    rf"({_STAMP}|(?<=[=\[])\d{{10,19}}(?:\.\d{{1,9}})?(?![\w:])|[A-Z]\d{{4}} \d{{2}}:\d{{2}}:\d{{2}}\.\d+)"
)
ACCESS_HEAD = rf"^\s*\S+ \S+ \S+ \[({_STAMP})\]"
JSON_KEYS = ("timestamp", "ts", "@timestamp", "time", "_time", "date")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _unless_placeholder(bare: Column) -> Column:
    return F.when(~F.lower(bare).isin(*PLACEHOLDERS), bare)


def entry_stamp(event: Column) -> Column:
    """The entry's own timestamp, as text: in the head of its layout, or under a time key of a JSON object."""
    json = F.coalesce(*(F.get_json_object(event, f"$['{k}']") for k in JSON_KEYS))
    first, access = (F.nullif(F.regexp_extract(event, p, 1), F.lit("")) for p in (ENTRY_HEAD, ACCESS_HEAD))
    return F.when(F.ltrim(event).startswith("{"), json).otherwise(F.coalesce(first, access))


def parts(text: Column) -> Column:
    """array(kind, year, month, day, hour, minute, second, fraction, half, zone), or null."""
    out = None
    for _, pattern, to in CASCADE:
        step = F.regexp_replace(text, pattern, to)
        out = F.when(text.rlike(pattern), step) if out is None else out.when(text.rlike(pattern), step)
    return F.split(out, r"\|", -1)


def _micros(fraction: Column) -> Column:
    return F.coalesce(F.nullif(F.rpad(F.substring(fraction, 1, 6), 6, "0"), F.lit("000000")).try_cast("bigint"), F.lit(0).cast("bigint"))


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _month(text: Column) -> Column:
    at = F.call_function("locate", F.lower(F.substring(text, 1, 3)), F.lit(MONTHS))
    return F.when(text.rlike("^[0-9]"), _number(text)).when(at % 3 == 1, ((at + 2) / 3).cast("int"))


def _date(y: Column, m: Column, d: Column) -> Column:
    """Midnight as microseconds, null unless there is such a day."""
    return F.unix_micros(F.call_function("try_make_timestamp", y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")))


def _latest(candidates: Column, received: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(candidates, lambda x: x <= received)), F.array_min(candidates))


def with_instant(df: DataFrame, text: Column, zone: Column, order: Column, received_at: Column, out: str = "utc_us") -> DataFrame:
    """df with the UTC microseconds of a timestamp text, or null, in column out.

    Built in steps of helper columns (names begin with two underscores), each of which
    is used several times by the next and computed once.
    """
    kept = [c for c in df.columns if c != out]
    step = df.select(
        *(F.col(f"`{c}`") for c in kept),
        fence(parts(text)).alias("__p"),
        F.coalesce(zone, F.lit("UTC")).alias("__zone"),
        F.lower(order).alias("__dmy"),
        F.unix_micros(received_at).alias("__received"),
        F.year(received_at).alias("__now"),
    )
    p = [F.col("__p")[i] for i in range(10)]
    digits = F.length(p[1])
    whole, fraction = p[1].try_cast("decimal(20,0)"), _micros(p[6])
    of_epoch = (
        F.when(digits <= 11, whole * 1_000_000 + fraction)
        .when(digits <= 14, whole * 1_000 + F.floor(fraction / 1_000))
        .when(digits <= 17, whole)
        .otherwise(F.floor(whole / 1_000))
        .try_cast("bigint")
    )
    minutes = F.substring(F.replace(p[9], F.lit(":"), F.lit("")), 4, 2)
    offset = F.when(F.lower(p[9]) == "z", F.lit(0)).when(
        p[9].rlike("^[+-]"),
        F.when(p[9].startswith("-"), -1).otherwise(1)
        * (F.substring(p[9], 2, 2).cast("int") * 60 + F.coalesce(_number(minutes), F.lit(0))),
    )
    step = step.withColumns(
        {
            "__epoch": fence(F.when(p[0] == "e", of_epoch)),
            "__offset": offset.cast("bigint") * 60_000_000,
            "__year": _number(p[1]), "__a": _month(p[2]), "__b": _number(p[3]),
            "__hour": _number(p[4]), "__minute": _number(p[5]), "__second": F.coalesce(_number(p[6]), F.lit(0)),
            "__micros": _micros(p[7]),
            "__half": F.lower(p[8]),
            "__abbr": F.upper(p[9]),
            "__kind": p[0],
        }
    ).drop("__p")
    c = F.col
    hour = (
        F.when(c("__half") == "", c("__hour"))
        .when(c("__hour").between(1, 12), c("__hour") % 12 + F.when(c("__half") == "pm", 12).otherwise(0))
    )
    step = step.withColumn("__hour", hour).withColumn(
        "__clock",
        fence(F.when(
            (c("__hour") < 24) & (c("__minute") < 60) & (c("__second") < 60),
            (c("__hour") * 3600 + c("__minute") * 60 + c("__second")).cast("bigint") * 1_000_000 + c("__micros"),
        )),
    )
    y, a, b = c("__year"), c("__a"), c("__b")
    month_first, day_first = _date(y, a, b), _date(y, b, a)
    dates = (
        F.when(c("__clock").isNull() | c("__epoch").isNotNull(), None)
        .when((c("__kind") == "o") & (c("__dmy") == "mdy"), F.array(F.coalesce(month_first, day_first)))
        .when((c("__kind") == "o") & (c("__dmy") == "dmy"), F.array(F.coalesce(day_first, month_first)))
        .when(c("__kind") == "o", F.array(day_first, month_first))
        .when(y.isNotNull(), F.array(month_first))
        .otherwise(F.array(*(_date(c("__now") + k, a, b) for k in (1, 0, -1))))
    )
    step = step.withColumn("__dates", fence(F.filter(dates, lambda x: x.isNotNull())))
    step = step.withColumn("__locals", fence(F.transform("__dates", lambda x: x + c("__clock"))))
    day = 86_400_000_000

    def to_utc(x: Column) -> Column:
        return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(x), c("__zone")))

    # read with the offset before a change of clocks and with the one after: an overlap has two valid instants
    read = F.transform(c("__locals"), lambda x: F.struct(x.alias("local"), to_utc(x).alias("u"), (to_utc(x + day) - day).alias("v")))
    back = lambda x: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(x.v), c("__zone"))) == x.local
    # clocks go back from summer to standard time: an abbreviation that names one of them settles which
    two = lambda x: F.when(c("__abbr").rlike(SUMMER), F.array(F.least(x.u, x.v))).when(c("__abbr").rlike(STANDARD), F.array(F.greatest(x.u, x.v))).otherwise(F.array(x.u, x.v))
    both = F.flatten(F.transform(read, lambda x: F.when((x.u == x.v) | ~back(x), F.array(x.u)).otherwise(two(x))))
    step = step.withColumn(
        "__all",
        F.when(c("__offset").isNotNull(), F.transform(c("__locals"), lambda x: x - c("__offset"))).when(F.size("__locals") > 0, both),
    )
    found = F.coalesce(c("__epoch"), _latest(c("__all"), c("__received")))
    return step.select(*(F.col(f"`{k}`") for k in kept), fence(found).alias(out))


def normalise_times(df: DataFrame, sources: DataFrame) -> DataFrame:
    """df with utc_us: event_time, or where it states none the entry's own timestamp. Null if neither states one.

    sources has source, tz and date_order; a source it doesn't hold counts as UTC with open order.
    A column utc_us of df is replaced; columns of df must not begin with two underscores.
    """
    known = sources.filter("source is not null").groupBy("source").agg(F.max("tz").alias("__tz"), F.max("date_order").alias("__order"))
    joined = df.drop("utc_us").withColumn("__sent", _bare(F.col("event_time"))).join(small_side(known), "source", "left")
    joined = joined.withColumn("__sent", _unless_placeholder(F.col("__sent")))
    joined = joined.withColumn("__text", F.coalesce(F.col("__sent"), _unless_placeholder(_bare(entry_stamp(F.col("event"))))))
    timed = with_instant(joined, F.col("__text"), F.col("__tz"), F.col("__order"), F.col("received_at"))
    return timed.select(*(F.col(f"`{c}`") for c in df.drop("utc_us").columns), "utc_us")


def found_times(df: DataFrame, sources: DataFrame) -> DataFrame:
    """row_id, utc_us of the rows that state a time."""
    return normalise_times(df.select("row_id", "event", "event_time", "source", "received_at"), sources).select("row_id", "utc_us").filter("utc_us is not null")
