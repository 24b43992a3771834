import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.engine import Engine, bounds, instant
from brindle.plans.syntax import QueryError
from brindle.sources import sinks

NOW = dt.datetime(2026, 2, 10, 12, 0, 30, tzinfo=dt.UTC)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, now=NOW)
    rows = [
        (1, "2026-02-10 11:00:00", "web", 200, 10.0, "GET /a ok", None), (2, "2026-02-10 11:10:00", "web", 500, 90.0, "GET /b Timeout", "u1"), (3, "2026-02-10 11:10:00", "db", None, 20.0, "slow query", "u1"),
        (4, "2026-02-10 11:50:01", "db", 200, None, "db-timeout again", "u2"), (5, None, None, 404, 30.0, None, "u2"), (6, "2026-02-10 12:00:00", "web", 200, 20.0, 'say "hi" id=7', None),
    ]
    df = spark.createDataFrame(rows, "id int, t string, svc string, status int, ms double, _raw string, user string").withColumn("_time", F.col("t").cast("timestamp"))
    e.catalog.add("main", df, order=("id",))
    e.catalog.add("logs-a", df.filter("id < 3"), order=("id",))
    e.catalog.add("logs-b", df.filter("id > 4").drop("user"), order=("id",))
    e.catalog.add("kv", spark.createDataFrame([(1, 'a=1 b="x y" c=2.5'), (2, "a=2 b=z"), (3, "nothing")], "id int, _raw string"), order=("id",))
    e.catalog.add("empty", df.limit(0))
    return e


def rows(engine, text, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in engine.query(text).collect()]


def value(engine, expr):
    return engine.query(f"from main | head 1 | extend x = {expr}").first()["x"]


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("null or true", True), ("null and false", False), ("null and true", None), ("not null", None), ("1 == 1.0", True), ('1 == "1"', None), ("null == null", None), ('"a" + "b"', "ab"), ('"a" + 1', None), ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5),
        ("5 / 0", None), ("5 % 0", None), ("7 % 3", 1), ("9223372036854775807 + 1", None), ("3 in [1, 2]", False), ("3 in [1, null]", None), ("1 in [1, null]", True), ("2 between 1 and 2", True), ("nosuch ?? 4", 4), ("[1, 2, 3][-1]", 3), ("[1][5]", None),
        ("{a: 1}.a", 1), ("{a: 1}.b", None), ("1h / 30m", 2.0), ("2 * 30m == 1h", True), ('int("7.9")', 7), ('int("x")', None), ('bool("no")', False), ('float("1e2")', 100.0), ("string(5)", "5"), ('len("añb")', 3), ('substr("abcdef", 1, 3)', "bcd"), ('substr("abc", -2)', "bc"),
        ('substr("abc", 9)', ""), ('replace("a1b2", r"\\d", "#")', "a#b#"), ('trim("xxaxx", "x")', "a"), ('has("Foo-Bar baz", "bar")', True), ('has("foobar", "bar")', False), ('contains("FooBar", "obA")', True), ('glob("abc", "a?c")', True), ('has_glob("one two3", "tw*")', True),
        ('extract("k=5", r"k=(\\d)")', "5"), ('extract("x", r"(\\d)")', None), ("round(2.5)", 3.0), ("floor(-1.5)", -2), ("ln(0)", None), ("log(8, 2) > 2.999", True), ("clamp(9, 1, 5)", 5), ("bucket(12, [0, 10, 20])", 10), ('xxhash64("")', "ef46db3751d8e999"),
        ('cidr_match("10.0.0.0/8", "10.2.3.4")', True), ('cidr_match("fd00::/8", "fd00::1")', True), ('ip_parse("::1").loopback', True), ('ipmask("255.255.255.0", "1.2.3.4")', "1.2.3.0"), ("any([], x -> x > 1)", False), ("all([], x -> x > 1)", True), ("map([1, 2], x -> x + 1)[1]", 3),
        ("len(filter([1, null, 3], x -> x > 1))", 1), ('from_json("{\\"a\\": [1, 2]}").a[1] == 2.0', True), ('to_json("a\\"b")', '"a\\"b"'), ("is_missing(nosuch)", True), ("exists(nosuch)", False), ("typeof(nosuch)", "missing"), ('if(null, 1, 2)', None), ('path_normalize("/u/42/x")', "/u/:id/x"),
        ('url_parse("http://h:81/p?a=1#f").port', 81), ('strftime(timestamp("2026-01-02T03:04:05Z"), "%d/%m/%y %H")', "02/01/26 03"), ("day_of_week(timestamp(\"2026-02-08T00:00:00Z\"))", 0), ('printf("%v-%03d", "a", 7)', "a-007"), ("coalesce(null, 3)", 3), ("nullif(3, 3)", None),
        ('join(split("a.b", "."), "|")', "a|b"), ("slice([1, 2, 3], -2)[0]", 2), ("array_sort([3, null, 1])[0]", 1), ("len(flatten([[1], [2]]))", 2), ("merge({a: 1}, {a: 2}).a", 2), ('"x".upper()', "X"),
    ],
)
def test_expressions(engine, expr, want):
    got = value(engine, expr)
    assert (got == pytest.approx(want)) if isinstance(want, float) else got == want


def test_strict_conversion_fails_the_query(engine):
    with pytest.raises(Exception, match="convert"):
        engine.query('from main | extend x = int!("junk")').collect()


def test_where_drops_null_and_groups_keep_it(engine):
    assert rows(engine, "from main | where status >= 500 | keep id", "id") == [2]
    assert sorted(rows(engine, "from main | stats count() as n by svc", "svc", "n"), key=str) == [("db", 2), ("web", 3), (None, 1)]


def test_order_and_limits(engine):
    assert rows(engine, "from main | sort -ms, id | keep id", "id") == [4, 2, 5, 3, 6, 1]  # null first going down
    assert rows(engine, "from main | sort ms, id | keep id", "id") == [1, 3, 6, 5, 2, 4]  # last going up
    assert rows(engine, "from main | where exists(_time) | tail 2 | keep id", "id") == [4, 6]
    assert rows(engine, "from main | sort -svc, id | head 2 | keep id", "id") == [5, 1]


def test_aggregates(engine):
    r = engine.query("from main | stats sum(ms) as s, avg(ms) as a, p50(ms) as p, dc(user) as d, mode(svc) as m, first(ms) as f, last(ms) as l, values(svc) as v, count(where status == 200) as ok, stdev(status) as sd, earliest(id) as e, latest(id) as t, list(user) as u").first()
    assert (r.s, r.a, r.p, r.d, r.m, r.ok) == (170.0, 34.0, 20.0, 2, "web", 3)
    assert (r.f, r.l, r.e, r.t, sorted(r.v), r.u) == (30.0, 20.0, 1, 6, ["db", "web"], ["u2", "u1", "u1", "u2"])
    assert engine.query("from empty | stats count() as n, sum(ms) as s").collect()[0][:] == (0, None)
    assert engine.query("from empty | stats count() as n by svc").count() == 0


def test_conditions_and_expressions_in_windows(engine):
    got = rows(engine, "from main | eventstats sum(ms, where status == 200) as s by svc | sort id | keep s", "s")
    assert got == [30.0, 30.0, None, None, None, 30.0]
    got = rows(engine, "from main | where exists(_time) | streamstats current=false window=2 sum(ms * 2) as s, count() as n | sort id | keep s, n", "s", "n")
    assert got == [(None, 0), (20.0, 1), (200.0, 2), (220.0, 2), (40.0, 2)]


def test_joins(engine):
    assert rows(engine, 'from main | join on user with [from main | stats max(ms) as top by user] | sort id | keep id, top', "id", "top") == [(2, 90.0), (3, 90.0), (4, 30.0), (5, 30.0)]
    with pytest.raises(QueryError):
        engine.query("from main | join on id with [from main | extend id = string(id)]")
    assert engine.query("from main | join type=outer on user with [from main | stats count() as n by user]").count() == 7


def test_union_glob_and_ctes(engine):
    assert rows(engine, "from logs-*,!logs-b | stats count() as n", "n") == [2]
    assert rows(engine, "from logs-* | stats count() as n, count(user) as u", "n", "u") == [(4, 1)]
    assert rows(engine, "let $e = from main | where status >= 500; from $e | union [from main | head 1] | stats count() as n", "n") == [2]


def test_parse_modes(engine):
    r = engine.query("from kv | parse logfmt | sort id").collect()
    assert [(x.a, x.b, x.c) for x in r] == [(1, "x y", 2.5), (2, "z", None), (None, None, None)] and r[2]["_error"].startswith("parse:logfmt")
    assert engine.query("from kv | parse logfmt on_error drop").count() == 2
    with pytest.raises(Exception, match="can't read"):
        engine.query("from kv | parse logfmt on_error strict").collect()
    r = engine.query('from kv | parse pattern "a=<first> b=<_>" into (first as int) on_error null | sort id').collect()
    assert [x.first for x in r] == [1, 2, None]
    r = engine.query('from kv | extend a = 9 | parse logfmt into (a as int) | sort id').first()
    assert r.a == 9  # never overwritten


def test_parse_formats(spark):
    e = Engine(spark, now=NOW)
    lines = {
        "combined": '1.2.3.4 - bob [10/Feb/2026:08:12:03 +0000] "GET /x HTTP/1.1" 200 17 "-" "curl/8"',
        "syslog": "<34>1 2026-02-10T08:12:03Z host app 77 ID - hello",
        "nginx_error": '2026/02/10 08:12:03 [error] 7#8: *9 open failed, client: 1.2.3.4, server: s, request: "GET / HTTP/1.1", host: "h"',
        "apache_error": "[Tue Feb 10 08:12:03 2026] [core:error] [pid 7:tid 8] [client 1.2.3.4:99] AH00001: oops",
        "redis": "77:M 10 Feb 2026 08:12:03.456 * Ready", "postgres": "2026-02-10 08:12:03.456 UTC [77] bob@db LOG:  duration: 1.5 ms  statement: select 1",
        "haproxy": '1.2.3.4:99 [10/Feb/2026:08:12:03.456] fe be/s1 1/2/3/4/10 200 17 - - ---- 1/2/3/4/0 0/0 "GET /x HTTP/1.1"',
        "cef": "CEF:0|ven|prod|1.0|100|name|5|src=1.2.3.4 msg=two words dst=5.6.7.8", "leef": "LEEF:1.0|ven|prod|1|77|src=1.2.3.4\tdst=5.6.7.8",
        "mysql_slow": "# User@Host: root[root] @ localhost [1.2.3.4]  Id: 7\n# Query_time: 1.5  Lock_time: 0.1 Rows_sent: 3  Rows_examined: 9\nselect 1",
        "docker": '{"log": "hello\\n", "stream": "stdout", "time": "2026-02-10T08:12:03Z"}',
    }
    want = {"combined": ("status", 200), "syslog": ("severity_name", "critical"), "nginx_error": ("client", "1.2.3.4"), "apache_error": ("error_code", "AH00001"), "redis": ("level", "notice"), "postgres": ("duration_ms", 1.5), "haproxy": ("tt", 10), "cef": ("msg", "two words"), "leef": ("dst", "5.6.7.8"), "mysql_slow": ("rows_examined", 9), "docker": ("log", "hello")}
    for name, line in lines.items():
        e.catalog.add(name, spark.createDataFrame([(line,)], "_raw string"))
        r = e.query(f"from {name} | parse {name}").first()
        assert r[want[name][0]] == want[name][1], (name, r)
        assert r["_error"] is None


def test_parse_format_fields(spark):
    e = Engine(spark, now=NOW)
    for name, line, want in [
        ("syslog", "<165>1 2026-02-10T08:12:03Z host app 77 ID [a b=\"c\"] hello", {"facility_name": "local4", "severity_name": "notice", "structured_data": '[a b="c"]', "msgid": "ID", "procid": "77", "message": "hello"}),
        ("syslog", "Feb 10 08:12:03 host app[9]: hi", {"priority": None, "severity_name": None, "appname": "app", "procid": "9", "format": "rfc3164"}),
        ("redis", "9:C 10 Feb 2026 08:12:03.456 # saved", {"role": "rdb_child", "level": "warning", "message": "saved"}),
        ("leef", "LEEF:2.0|v|p|1|e|0x5E|a=1^b=x=y", {"event_id": "e", "leef_version": 2.0, "a": 1, "b": "x=y"}),
        ("leef", "LEEF:1.0|v|p|1|e|a=1\tb=2", {"event_id": "e", "a": 1, "b": 2}),
        ("clf", '1.2.3.4 - - [10/Feb/2026:08:12:03 +0000] "GET /x HTTP/1.1" 200 -', {"user": None, "ident": None, "bytes": None, "uri": "/x"}),
        ("nginx_error", "2026/01/01 00:00:00 [warn] 1#1: *0 simple, with comma", {"message": "simple, with comma", "client": None}),
        ("mysql_slow", "# User@Host: r[r] @ h [1.2.3.4]\n# Query_time: 1.5  Lock_time: 0.1 Rows_sent: 3  Rows_examined: 9\nselect 1;\n", {"statement": "select 1", "connection_id": None}),
        ("haproxy", '10.0.0.1:80 [01/Jan/2026:00:00:00.000] fe~ be/srv -1/0/-1/-1/0 503 0 - - CD-- 0/0/0/0/0 0/0 "GET / HTTP/1.0"', {"frontend": "fe", "tq": -1, "term_state": "CD--"}),
    ]:
        e.catalog.add("one", spark.createDataFrame([(line,)], "_raw string"))
        r = e.query(f"from one | parse {name}").first()
        assert {k: r[k] for k in want} == want and r["_error"] is None, (name, r)


def test_analysis(engine):
    assert rows(engine, "from main | where exists(_time) | sessionize maxpause=10m by svc | sort id | keep _session_id", "_session_id") == [3, 3, 1, 2, 4]
    r = engine.query("from main | where exists(_time) and exists(svc) | transaction svc maxspan=10m | sort svc, _time").collect()
    assert [(x.svc, x.eventcount, x.duration) for x in r] == [("db", 1, 0.0), ("db", 1, 0.0), ("web", 2, 600.0), ("web", 1, 0.0)]
    assert engine.query("from main | outliers field=ms method=iqr").filter("_outlier").count() == 1
    assert engine.query("from main | head 3 | outliers field=ms").filter("_outlier").count() == 0
    assert engine.query("from main | correlate id id").first()[:3] == (1.0, "pearson", 6)
    r = {x["pattern"]: x["count"] for x in engine.query("from main | patterns").collect()}
    assert sum(r.values()) == 5
    got = rows(engine, "from main | stats count() as n by svc, status | xyseries svc status n | where svc == \"web\"", "200", "500")
    assert got == [(2, 1)]
    assert rows(engine, "from main[-2h] | where exists(_time) | stats count() as n | compare previous 1h", "n", "previous_n", "change_n") == [(5, 1, 4)]


def test_trace_terminates(spark):
    e = Engine(spark, now=NOW)
    spans = [("t", "a", "", "root"), ("t", "b", "a", "kid"), ("t", "c", "b", "kid2"), ("t", "d", "zz", "orphan"), ("t", "x", "y", "loop1"), ("t", "y", "x", "loop2"), ("t", "s", "s", "self")]
    e.catalog.add("s", spark.createDataFrame(spans, "trace_id string, span_id string, parent_id string, operation string"))
    r = {x.span_id: x._span_depth for x in e.query("from s | trace").collect()}
    assert r == {"a": 0, "b": 1, "c": 2, "d": 0, "s": 0, "x": 0, "y": 1}


def test_views(engine):
    engine.query('from main | stats count() as n, sum(ms) as s, avg(ms) as a, range(ms) as r by svc, status | materialize "v"')
    direct = Engine(engine.spark, now=NOW)
    direct.catalog = engine.catalog
    text = "from main | stats count() as n, sum(ms) as s, avg(ms) as a by svc"
    assert sorted(engine.query(text).collect(), key=str) == sorted(direct.query(text).collect(), key=str)
    assert "batch" in engine.explain(text)  # read from the view's folders
    more = engine.catalog.open("logs-a").df
    for _ in range(2):  # the same batch again takes its own place
        engine.append_to_view("v", more, "b1")
    assert engine.query("from v | stats sum(n) as n").first()["n"] == 8.0
    whole = engine.query("from v | stats sum(n) as n, sum(s) as s by svc").collect()
    assert engine.query(text).collect() and "batch" not in engine.explain(text)  # it now holds more than its source
    engine.refresh_view("v")
    assert engine.query("from v | stats sum(n) as n").first()["n"] == 6.0 and whole
    engine.views.delete("v")
    assert not engine.views.has("v")


def test_views_answer_only_for_their_own_time_and_rows(spark, tmp_path):
    path, store = str(tmp_path / "src"), "file://" + str(tmp_path / "views")
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 4).alias("k"), F.timestamp_seconds(F.unix_timestamp(F.lit(NOW)) - F.col("id") * 3600).alias("t"))
    rows.write.parquet(path)
    def fresh():
        e = Engine(spark, now=NOW, store=store)
        e.catalog.add("x", spark.read.parquet(path), time="t")
        return e

    e, q = fresh(), "from x | stats count() as n by k"
    n = lambda e, text=q, **o: sum(r.n for r in e.query(text, **o).collect())
    e.query(q + ' | materialize "all"')
    assert n(e) == 100 and n(e, since="-10h") == 11 and n(e, text="from x[-10h] | stats count() as n by k") == 11
    e.query('from x[-10h] | stats count() as n by k | materialize "late"')
    e.now = NOW - dt.timedelta(days=1)
    assert n(e, text="from x[-10h] | stats count() as n by k") == 11  # of the day before
    # another session knows the views, and a source that has changed is read itself
    again = fresh()
    assert {v["name"] for v in again.views.list()} == {"all", "late"} and "batch" in again.explain(q)
    rows.limit(5).write.mode("append").parquet(path)
    changed = fresh()
    assert n(changed) == 105 and "batch" not in changed.explain(q)
    changed.refresh_view("all")
    assert n(changed) == 105 and "batch" in fresh().explain(q)


def test_views_backfill_alter_and_expire(spark, tmp_path):
    e = Engine(spark, store="file://" + str(tmp_path / "v"))
    now = dt.datetime.now(dt.UTC)
    e.catalog.add("x", spark.createDataFrame([(now - dt.timedelta(days=d), d) for d in range(10)], "_time timestamp, d bigint"))
    e.query('from x | where d < 0 | stats count() as n by bin(_time, 1d) | materialize "empty"')
    e.query('from x | every 1d stats count() as n | materialize "days"')
    e.query('from x[-3d..now] | stats count() as n, max(d) as m | materialize "slice"')
    for _ in range(2):
        e.backfill("slice", "-20d", "-5d")
    assert e.query("from slice").first()["m"] == 9
    assert e.query("from days").count() == 10 and e.query("from empty").count() == 0
    e.views.alter("days", retention=4 * 86_400_000_000)
    kept = e.query("from days").count()
    e.views.expire("days")
    again = Engine(spark, store="file://" + str(tmp_path / "v"))
    assert kept < 7 and again.query("from days").count() == kept and again.views.list()[0]["created"]


def test_sketches_in_views(spark):
    e = Engine(spark, now=NOW, approximate=True)
    e.catalog.add("n", spark.range(20_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 4).alias("g")))
    q = "from n | stats dc(v) as d, p50(v) as p by g"
    e.query(q + ' | materialize "s"')
    r = e.query("from n | stats dc(v) as d, p50(v) as p").first()
    assert abs(r.d - 20_000) < 1_500 and abs(r.p - 10_000) < 300 and e.query("from s").count() == 4


def test_tee_writes_once_and_not_for_plans(spark, tmp_path):
    e = Engine(spark, now=NOW)
    e.catalog.add("x", spark.createDataFrame([(NOW, 1)], "_time timestamp, a bigint"))
    at = str(tmp_path / "tee")
    text = f'from x[-2h] | tee "{at}" | stats count() as n | compare previous 1h'
    e.explain(text)
    assert not (tmp_path / "tee").exists()
    assert e.query(text).count() == 1 and spark.read.json(at).count() == 1


def test_running_without_groups(spark, monkeypatch):
    """Blocks against one window over all rows; and no plan that brings all rows into one task."""
    from pyspark.sql import Window

    from brindle.operators import runs

    monkeypatch.setattr(runs, "BLOCK_ROWS", 7)
    monkeypatch.setattr(runs, "FEW", 20)
    rows = spark.range(200).select("id", F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.col("id") * 37 % 3_000)).alias("_time"), F.when(F.col("id") % 5 != 0, (F.col("id") * 7919 % 101).cast("double")).alias("v"), (F.col("id") % 3).alias("g")).repartition(4)
    e = Engine(spark, now=NOW)
    e.catalog.add("r", rows, order=("id",))
    w = Window.orderBy("_time", "id")
    want = {r.id: r for r in rows.select("id", "_time", "v", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.stddev_samp("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("d"), F.avg("v").over(w.rowsBetween(-3, 0)).alias("m"), F.lag("v", 2).over(w).alias("l"), F.lead("v").over(w).alias("n"), F.row_number().over(w).alias("i"), F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lo"), F.first("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.count("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"), F.avg("v").over(w.rowsBetween(-10, -1)).alias("b"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p")).collect()}
    near = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-9 * max(1, abs(b)))
    for text in ("from r", "from r | sort _time, id"):
        got = {r.id: r for r in e.query(text + " | streamstats sum(v) as s, stdev(v) as d, moving_avg(v, 4) as m, lag(v, 2) as l, lead(v) as n, row_number() as i, min(v) as lo, first(v) as f").collect()}
        if "sort" not in text:
            assert all(near(getattr(got[k], c), getattr(r, c)) for k, r in want.items() for c in ("s", "d", "m", "l", "n", "i", "lo", "f"))
        assert len(got) == 200 and got[1].s is not None
    got = {r.id: r for r in e.query("from r | streamstats current=false count(v) as c").collect()}
    assert all(got[k].c == r.c for k, r in want.items())
    got = {r.id: r for r in e.query("from r | baseline v window=10").collect()}
    assert all(near(got[k].baseline_avg, r.b) for k, r in want.items())
    changed = {r.id for r in e.query("from r | changes v").collect()}
    assert changed == {k for k, r in want.items() if r.v is not None and r.p is not None and r.v != r.p}
    one = {r.id: r for r in e.query("from r | sessionize maxpause=5s").collect()}
    assert len(one) == 200 and {r._session_id for r in one.values()} == set(range(1, max(r._session_id for r in one.values()) + 1)) and all(r._session_start is None or r._session_start <= r._time <= r._session_end for r in one.values() if r._time)
    n, q = runs.quantiles(rows.select(F.col("v").alias("x")).filter("x is not null"), [0.0, 0.25, 0.5, 0.9, 1.0])
    assert (n, q) == (160, rows.agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.9, 1.0))))).first()[0])
    for text in ("streamstats sum(v) as s, lag(v) as l", "baseline v window=10", "changes v", "sessionize maxpause=5s", "sessionize maxpause=5s by g", "correlate id v method=spearman", "describe", "outliers field=v", "outliers field=v method=mad"):
        plan = e.explain(f"from r | {text}")
        for part in plan.split("Exchange")[1:]:
            if "SinglePartition" in part[:400]:
                assert "__block" in part[:400] or "avg" in part[:900] or "count" in part[:900] or "corr" in part[:900] or "Range" in plan, (text, part[:900])


def test_hot_groups_run_in_blocks(spark, monkeypatch):
    """The same rows whether a group is a task or many blocks."""
    from brindle.operators import runs

    rows = spark.range(300).select("id", F.when(F.col("id") % 13 != 0, F.timestamp_seconds(F.col("id") * 37 % 3_001)).alias("_time"), F.when(F.col("id") % 5 != 0, (F.col("id") * 7919 % 101).cast("double")).alias("v"), F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 8 == 0, F.col("id").cast("string"))).alias("g"), F.lit("x").alias("_raw")).repartition(4)
    e = Engine(spark, now=NOW)
    e.catalog.add("r", rows, order=("id",))
    texts = [
        "streamstats sum(v) as s, row_number() as i, lag(v, 2) as l, lead(v) as n, moving_avg(v, 4) as m, max(v) as hi, stdev(v) as d by g | extend d = round(d, 6)", "streamstats current=false window=3 avg(v) as a, count(v) as c by g", "baseline v window=5 by g | extend z = round(z, 6)",
        "changes v by g", "sessionize maxpause=20s by g", "where exists(_time) | transaction g maxspan=20s", "where exists(_time) | transaction g startswith=v > 90.0 endswith=v < 10.0 | keep g, _time, eventcount, duration, id",
    ]
    plain = [sorted(e.query(f"from r | {t}").collect(), key=str) for t in texts]
    monkeypatch.setattr(runs, "HOT_BYTES", 0)
    monkeypatch.setattr(runs, "HOT_ROWS", 100)
    monkeypatch.setattr(runs, "BLOCK_ROWS", 9)
    for t, want in zip(texts, plain):
        assert sorted(e.query(f"from r | {t}").collect(), key=str) == want, t


def test_time_ranges():
    assert instant("-1h", NOW) == NOW - dt.timedelta(hours=1)
    assert instant("@d", NOW) == dt.datetime(2026, 2, 10, tzinfo=dt.UTC)
    assert bounds("-7d..-1d", NOW) == (NOW - dt.timedelta(days=7), NOW - dt.timedelta(days=1))
    assert bounds("-1h][@h", NOW)[0] == dt.datetime(2026, 2, 10, 11, tzinfo=dt.UTC)
    with pytest.raises(QueryError):
        instant("soon", NOW)


def test_methods_saved_and_sinks(engine, tmp_path):
    assert engine.table("main").where("status == 200").stats("count() as n").result().first()["n"] == 3
    engine.fragments["ok"] = "where status == 200"
    assert engine.query('from main | use "@ok"').count() == 3
    assert engine.columns().filter("source = 'main' and field = 'ms'").first()["type"] == "double" and engine.tail("main", 2).count() == 2 and len(list(engine.watch("from main", 1))) == 1
    assert engine.sources().count() == 5 and engine.sample("main", 2).count() == 2 and engine.histogram("main", "1h", "svc").count() >= 3
    df = engine.query("from main | sort id | keep id, svc | head 2")
    assert sinks.render(df, "csv") == "id,svc\n1,web\n2,web" and "id: 1" in sinks.render(df, "vertical") and sinks.render(df, "markdown").startswith("| id")
    sinks.write(df, str(tmp_path / "o"), "csv")
    assert engine.spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 2


def test_shown_results(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n bigint, t string")
    assert sinks.render(df, "box") == "┌───┬───┐\n│ n │ t │\n├───┼───┤\n│ 1 │ a │\n│ 2 │   │\n└───┴───┘" and sinks.render(df, "ascii").startswith("+---+---+\n| n | t |")
    assert sinks.render(df.limit(1), "auto") == sinks.render(df.limit(1), "G") == "n: 1\nt: a" and "more than 1 rows" in sinks.render(df, "table", 1)
    with pytest.raises(ValueError):
        sinks.render(df, "json", 1)


def test_readers_and_ingest(spark, tmp_path):
    from brindle.sources import ingest, readers

    (tmp_path / "a.log").write_text("lost\n2026 one\n  more\n\n2026 two\n")
    (tmp_path / "b.log").write_text("  own\n2026 three\n")
    got = sorted(r["_raw"] for r in readers.read_entries(spark, str(tmp_path / "*.log"), "^2026").collect())
    assert got == ["  own", "2026 one\n  more", "2026 three", "2026 two", "lost"]
    (tmp_path / "bulk").write_text('{"index": {"_index": "x"}}\n{"a": 1}\n{"create": {}}\n{"a": 2}\n{"a": 3}\n')
    assert sorted((r["_raw"], r["index"]) for r in readers.read_bulk(spark, str(tmp_path / "bulk")).collect()) == [('{"a": 1}', "x"), ('{"a": 2}', "main"), ('{"a": 3}', "main")]
    df = spark.createDataFrame([("<11>Feb 10 08:12:03 host app[7]: k=v j=\"two words\"",), (None,)], "_raw string")
    df = ingest.with_pairs(ingest.with_format(df, "syslog"))
    df = ingest.with_time(df, F.col("timestamp"), F.lit("Europe/Berlin"), F.lit(NOW))
    r = {x["_raw"]: x for x in ingest.routed(ingest.with_json(df, {"q": "$.q"}), [(F.col("severity") <= 3, "errors")]).collect()}
    one = next(v for k, v in r.items() if k)
    assert one["fields"] == {"k": "v", "j": "two words"} and one["appname"] == "app" and one["index"] == "errors" and one["_time"] == dt.datetime(2026, 2, 10, 7, 12, 3) and one["q"] is None and r[None]["index"] == "main"
    for text, kind in (('{"log":"x","stream":"s"}', "docker"), ("a:1,b:2", "kv"), ("CEF:0|a", "cef"), ("#Fields: a", "w3c"), ("x a=1 b=2", "logfmt")):
        assert readers.detect_format(spark.createDataFrame([(text,)], "_raw string")) == kind


def test_collector_sums_go_beyond_bigint(spark, tmp_path):
    from brindle.plans.io_queries import reader_collector

    first = 1_704_067_200_000_001
    for n, kind in ((100, "bigint"), (12_000, "decimal(38,0)")):
        d = str(tmp_path / str(n))
        spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") + first).alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type")).write.parquet(f"{d}/events.parquet")
        got = reader_collector(spark, d)
        assert dict(got.dtypes)["t"] == kind
        assert sorted((r["index"], r.n, r.hosts, int(r.t)) for r in got.collect()) == [(x, n // 2, 7, sum(range(first + odd, first + n, 2))) for x, odd in (("main", 1), ("web", 0))]


def test_live(spark, tmp_path):
    from brindle.streaming.live import live_query, session_counts

    src = str(tmp_path / "in")
    spark.createDataFrame([(f"2026-01-01 00:{m:02d}:00", k) for m, k in ((1, "a"), (2, "a"), (7, "b"), (59, "z"))], "t string, k string").select(F.col("t").cast("timestamp").alias("_time"), "k").write.parquet(src)
    stream = spark.readStream.schema("_time timestamp, k string").parquet(src)
    for name, df in (("w", live_query(stream, "from x | where k != \"q\" | every 5m by k stats count() as n", "0 seconds")), ("s", session_counts(stream, "5 minutes", ["k"], "0 seconds"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.n) for r in spark.table("w").collect()} == {("a", 2), ("b", 1)}
    assert {(r.k, r.eventcount) for r in spark.table("s").collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(QueryError):
        live_query(stream, "from x | sort k")


def test_running_on_a_stream(spark, tmp_path):
    from brindle.streaming.live import running

    src = tmp_path / "in"
    for part in ([(1, "a", 2.0), (3, "b", 5.0), (2, "a", 4.0)], [(5, "a", None), (4, "a", 1.0)]):
        spark.createDataFrame(part, "t int, k string, v double").select(F.timestamp_seconds("t").alias("_time"), "k", "v").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("_time timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = running(stream, ["k"], {"n": ("count", "v"), "s": ("sum", "v"), "m": ("avg", "v"), "lo": ("min", "v")})
    out.writeStream.format("memory").queryName("run").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = {(r.k, r._time.second): (r.n, r.s, r.m, r.lo) for r in spark.table("run").collect()}
    assert len(rows) == 5 and rows["b", 3] == (1, 5.0, 5.0, 5.0) and max(r[1] for k, r in rows.items() if k[0] == "a") == 7.0 and max(r[0] for r in rows.values()) == 3
    with pytest.raises(QueryError):
        running(stream, ["k"], {"x": ("mode", "v")})


def test_saved_queries_are_kept(spark, tmp_path):
    store = "file://" + str(tmp_path)
    e = Engine(spark, now=NOW, store=store)
    e.catalog.add("x", spark.range(10), order=("id",))
    e.saved["few"] = "from x | where id < 3"
    e.saved["few"] = "from x | where id < 4"
    e.fragments["odd"] = "where id % 2 == 1"
    with pytest.raises(QueryError):
        e.saved["bad"] = "from x | nonsense"
    again = Engine(spark, now=NOW, store=store)
    again.catalog = e.catalog
    assert again.run_saved("few").count() == 4 and again.query('from x | use "@odd"').count() == 5 and [s["name"] for s in again.saved.list()] == ["few"]
    del again.saved["few"]
    assert "few" not in Engine(spark, store=store).saved


def test_system_tables(spark, tmp_path):
    e = Engine(spark, now=NOW)
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "x"))
    e.catalog.add("x", spark.read.parquet(str(tmp_path / "x")), order=("id",))
    e.catalog.add("memory", spark.createDataFrame([(1,)], "a int"))
    e.query('from x | stats count() as n | materialize "v"')
    assert e.query("from system.parts | stats sum(event_count) as n, count() as files by source").collect() == [("x", 10.0, 2)]
    assert {(r.source, r.field, r.type) for r in e.query("from system.columns").collect()} == {("x", "id", "bigint"), ("memory", "a", "bigint")}
    assert e.query("from system.views").first()["name"] == "v" and e.query("from system.queries | where bind_seconds >= 0.0").count() >= 3


def test_analyze_tells_what_nodes_did(spark):
    e = Engine(spark, now=NOW)
    e.catalog.add("x", spark.range(1_000), order=("id",))
    text = e.analyze("from x | where id < 100 | extend g = id % 7 | stats count() as n by g")
    assert "HashAggregate" in text and "numOutputRows=7" in text and "numOutputRows=100" in text or "numOutputRows=1000" in text


def test_approximate_engine(spark):
    e = Engine(spark, now=NOW, approximate=True)
    e.catalog.add("n", spark.range(10_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("g")))
    r = e.query("from n | stats p50(v) as a, p90(v) as b, perc(v, 10) as c, dc(v) as d, count() as n by g | sort g").first()
    assert r.n == 5_000 and abs(r.a - 5_000) < 20 and abs(r.b - 9_000) < 20 and abs(r.c - 1_000) < 20 and abs(r.d - 5_000) < 250


def test_w3c_lines_are_read_by_the_last_header_of_their_file(spark):
    e = Engine(spark, now=NOW)
    lines = [("a", "early 1"), ("a", "#Fields: date status"), ("a", "d1 200"), ("b", "#Fields: verb path"), ("b", "GET /x"), ("a", "d2"), ("a", "d3  - extra"), ("a", "#Fields: status date"), ("a", "404 d4"), ("b", "PUT -")]
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(lines)], "n int, _source string, _raw string")
    e.catalog.add("w", df, order=("n",))
    got = {r.n: (r.date, r.status, r.verb, r.path) for r in e.query("from w | parse w3c").collect()}
    assert {n: got[n] for n in (0, 2, 4, 5, 6, 8, 9)} == {
        0: (None,) * 4, 2: ("d1", "200", None, None), 4: (None, None, "GET", "/x"), 5: ("d2", None, None, None), 6: ("d3", None, None, None), 8: ("d4", "404", None, None), 9: (None, None, "PUT", None),
    }
    e.catalog.add("one", df.filter("n in (3, 4)"))
    assert rows(e, "from one | parse w3c | where verb == \"GET\"", "path") == ["/x"]
    e.catalog.add("unordered", df)
    with pytest.raises(QueryError):
        e.query("from unordered | parse w3c")
