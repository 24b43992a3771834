"""The data-engineering operators: defined results on small fixtures, against plain models."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import slots
from brindle.operators import compaction, dedup, instants, nesting, templates
from brindle.plans import problems
from brindle.plans.shared import work_path

UTC = dt.UTC


# messages delivered more than once
def deliveries(spark, tmp_path, rows, extra=True):
    df = spark.createDataFrame(rows, "row_id bigint, msg_id string, source string, fields_json string, event string")
    if extra:
        df = df.withColumns({"file": F.lit("f"), "pos": F.lit(1), "bits": F.lit("b"), "bucket": F.lit(0)})
    path = str(tmp_path / "d")
    df.repartition(2).write.parquet(path)
    return path


U = "7e783651-8129-e35b-eabb-ed848e1edc58"
ROWS = [
    (0, U, "a", None, None), (1, "URN:uuid:" + U.upper(), "a", None, "x"), (2, "{" + U + "}", "b", None, None), (3, None, "a", '{"msg_id": "' + U.replace("-", "") + '"}', None), (4, None, "a", '{"parent_message": "' + U + '"}', "m"),
    (5, None, "a", None, f"text message_id=\"{U}\""), (6, None, "a", "broken {", '{"k": 1, "message_id": "' + U + '"}'), (7, None, None, None, None), (8, None, None, None, None), (9, " - ", "a", "", ""), (10, "q-1", None, None, None), (11, "Q1", None, None, None),
    (12, None, "a", None, "x" * 200_000 + " msg_id=q9"), (13, "Q-9", "a", None, None),
]


@pytest.mark.parametrize("limit", [dedup.VECTOR_BYTES, 0])
def test_one_delivery_of_each_message(spark, tmp_path, limit):
    path = deliveries(spark, tmp_path, ROWS)
    pairs = {(r.row_id_a, r.row_id_b) for r in dedup.duplicate_pairs(spark.read.parquet(path)).collect()}
    assert pairs == {(0, 1), (0, 3), (0, 5), (0, 6), (10, 11), (12, 13)}
    kept = dedup.keep_first_delivery(spark, path, limit)
    assert sorted(r.row_id for r in kept.collect()) == [0, 2, 4, 7, 8, 9, 10, 12]
    assert kept.columns == spark.read.parquet(path).columns


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    path = deliveries(spark, tmp_path, [(1, "a", "s", None, None)] * 3, False)
    assert dedup.keep_first_delivery(spark, path).count() == 1
    spark.read.parquet(path).limit(0).write.parquet(str(tmp_path / "e"))
    assert dedup.keep_first_delivery(spark, str(tmp_path / "e")).count() == 0


def test_paths_as_arrow_names_them():
    assert [dedup._arrow_uri(p) for p in ("s3a://b/x", "dbfs:/x/y", "hdfs://h/x", "file:///x", "/tmp/x")] == ["s3://b/x", "file:///dbfs/x/y", "hdfs://h/x", "file:///x", "file:///tmp/x"]


def test_hot_message(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_ROWS", 5)
    path = deliveries(spark, tmp_path, [(i, "same" if i % 3 == 0 else f"m{i}", "s", None, None) for i in range(60)], False)
    got = {(r.row_id_a, r.row_id_b) for r in dedup.duplicate_pairs(spark.read.parquet(path)).collect()}
    assert got == {(0, i) for i in range(3, 60, 3)}


# timestamps
def at(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


TIMES = [
    ("2025-10-20T10:00:00.123456789Z", "UTC", at(2025, 10, 20, 10, 0, 0, 123456)), ("2025-10-20T10:00:00+05:45", None, at(2025, 10, 20, 4, 15)), ("20251020T100000Z", None, at(2025, 10, 20, 10)), ("1760954400", None, at(2025, 10, 20, 10)), ("1760954400123", None, at(2025, 10, 20, 10, 0, 0, 123000)),
    ("1760954400123456", None, at(2025, 10, 20, 10, 0, 0, 123456)), ("1760954400123456789", None, at(2025, 10, 20, 10, 0, 0, 123456)), ("1760954400.5", None, at(2025, 10, 20, 10, 0, 0, 500000)), ("20/Oct/2025:12:00:00 +0200", None, at(2025, 10, 20, 10)), ("Mon, 20 Oct 2025 12:00:00 +0200", None, at(2025, 10, 20, 10)),
    ("Oct 20 12:00:00", "Europe/Berlin", at(2025, 10, 20, 10)), ("Dec 20 12:00:00", "UTC", at(2024, 12, 20, 12)), ("2025-10-20 12:00:00 CEST", "Europe/Berlin", at(2025, 10, 20, 10)), ("20.10.2025 12:00:00", "Europe/Berlin", at(2025, 10, 20, 10)), ("10/20/2025 08:00:00 PM", "UTC", at(2025, 10, 20, 20)),
    ("05/10/2025 12:00:00", "UTC", at(2025, 10, 5, 12)), ("2025-10-26 02:30:00", "Europe/Berlin", at(2025, 10, 26, 1, 30)), ("2025-03-30 02:30:00", "Europe/Berlin", at(2025, 3, 30, 1, 30)), ("2025-02-30 10:00:00", "UTC", None), ("2025-10-20 10:00:60", "UTC", None), ("2025-13-01T00:00:00Z", "UTC", None), ("soon", "UTC", None), ("12", "UTC", None),
]


def test_instants(spark):
    rows = [(i, t, z) for i, (t, z, _) in enumerate(TIMES)]
    df = spark.createDataFrame(rows, "row_id bigint, event_time string, source string").withColumns({"event": F.lit(None).cast("string"), "received_at": F.lit(dt.datetime(2025, 11, 1, tzinfo=UTC)), "tz": F.lit("x"), "utc_us": F.lit(1)})
    sources = spark.createDataFrame([(z, z, None) for z in {z for _, z, _ in TIMES if z}], "source string, tz string, date_order string")
    got = {r.row_id: r.utc_us for r in instants.normalise_times(df, sources).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(TIMES)}


def test_folded_time_and_open_order_take_the_latest_possible(spark):
    df = spark.createDataFrame([(1, "2025-10-26 02:30:00", dt.datetime(2025, 10, 26, 0, 45)), (2, "05/10/2025 00:00:00", dt.datetime(2025, 6, 1)), (3, "05/10/2025 00:00:00", dt.datetime(2024, 1, 1)), (4, "2025-10-20T00:00:00Z", None), (5, "2025-10-26 02:30:00 CEST", dt.datetime(2025, 11, 1)), (6, "2025-10-26 02:30:00 CET", dt.datetime(2025, 11, 1)), (7, "2025-10-26 02:30:00 XYZ", dt.datetime(2025, 11, 1))], "row_id bigint, event_time string, received_at timestamp").withColumns({"source": F.lit("s"), "event": F.lit("")})
    src = spark.createDataFrame([("s", "Europe/Berlin", None)], "source string, tz string, date_order string")
    got = {r.row_id: r.utc_us for r in instants.found_times(df, src).collect()}
    assert got == {1: at(2025, 10, 26, 0, 30), 2: at(2025, 5, 9, 22), 3: at(2025, 5, 9, 22), 4: at(2025, 10, 20), 5: at(2025, 10, 26, 0, 30), 6: at(2025, 10, 26, 1, 30), 7: at(2025, 10, 26, 1, 30)}


def test_entry_states_the_time_only_in_its_head(spark):
    events = ["2025-10-20T10:00:00Z x", "<13>Oct 20 10:00:00 h a: x", "ts=1760954400.0 level=info", '{"timestamp": 1760954400000}', '1.2.3.4 - - [20/Oct/2025:10:00:00 +0000] "GET"', "last seen at 2025-10-20T10:00:00Z", "", None, "x" * 100_000]
    df = spark.createDataFrame([(i, e, t) for i, e in enumerate(events) for t in ("null",)], "row_id bigint, event string, event_time string").withColumns({"source": F.lit(None).cast("string"), "received_at": F.lit(dt.datetime(2025, 11, 1, tzinfo=UTC))})
    src = spark.createDataFrame([], "source string, tz string, date_order string")
    got = {r.row_id: r.utc_us for r in instants.found_times(df, src).collect()}
    assert got == {i: at(2025, 10, 20, 10) for i in range(5)}


# nested records
def test_nested_records(spark):
    texts = [
        '{"a": [{"b": 1}, {"b": [[{"c": 2}]]}], "o": {"p": [{"q": null}]}}', '{"s": "[{\\"x\\": \\"{\\\\\\"y\\\\\\": [{}]}\\"}]"}', '[1, {"k": "v"}, "{\\"z\\": 1}"]', '{"a": [{}], "a": [1]}', '{"broken": [{}', "plain", "", None, '{"n": NaN}', "[" * 5000 + "{}" + "]" * 5000, '"[{}]"',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id bigint, event string").withColumns({"fields_json": F.lit(None).cast("string"), "record": F.lit("clash")})
    got = {}
    for r in nesting.records(nesting.triples(df)).collect():
        got.setdefault(r.row_id, set()).add((r.parent_path, r.child_path))
    assert got[0] == {("$", "$.a[0]"), ("$", "$.a[1]"), ("$.a[1]", "$.a[1].b[0][0]"), ("$", "$.o.p[0]")}
    assert got[1] == {("$", "$.s[0]"), ("$.s[0]", "$.s[0].x.y[0]")}
    assert got[2] == {("$", "$[1]"), ("$", "$[2]")} and got[10] == {("$", "$[0]")} and len(got[9]) == 1
    assert set(got) == {0, 1, 2, 9, 10}


def test_flat_tables_keep_the_links(spark, monkeypatch):
    df = spark.createDataFrame([(7, '{"t": 1, "a": [{"b": 1, "tags": ["x", "y"], "none": []}, {"c": {"d": true, "e": {}}}]}'), (8, '{"a": [{"b": null}]}'), (9, "plain")], "row_id bigint, event string").withColumn("fields_json", F.lit(None).cast("string"))
    tables = nesting.FlatTables.write(spark, nesting.triples(df))
    assert {(r.table, r.leaf): r.n_values for r in tables.columns.collect()} == {("$", "t"): 1, ("$.a[]", "b"): 1, ("$.a[]", "tags[]"): 2, ("$.a[]", "none"): 1, ("$.a[]", "c.d"): 1, ("$.a[]", "c.e"): 1}
    rows = {(r.row_id, r.path): r for r in tables.open("$.a[]").collect()}
    one, two = rows[7, "$.a[0]"], rows[7, "$.a[1]"]
    assert one.f_b == "1" and one["f_tags[]"] == '["x","y"]' and one.f_none == "[]" and two.f_none is None and two["f_c.d"] == "true" and two["f_c.e"] == "{}" and two.parent_path == "$" and two.parent == 0 and len(rows) == 3
    monkeypatch.setattr(nesting, "WIDTH", 3)
    parts = [tables.open("$.a[]", i) for i in range(3)]
    assert [c for p in parts[:2] for c in p.columns if c[:2] == "f_"] == ["f_b", "f_c.d", "f_c.e", "f_none", "f_tags[]"] and parts[2] is None and parts[1].count() == 3
    assert nesting.FlatTables.write(spark, nesting.triples(df.limit(0))).columns.count() == 0


def test_records_of_keys_that_look_alike_stay_apart(spark):
    df = spark.createDataFrame([(1, '{"a.b": [{"x": 1}], "a": {"b": [{"x": 2}]}, "a[]": {"": [{"x": 3}]}}')], "row_id bigint, event string").withColumn("fields_json", F.lit(None).cast("string"))
    rows = nesting.grouped(nesting.triples(df)).select("table", "record", F.col("leaves")[0]["v"].alias("v")).collect()
    assert sorted((r.table, r.v) for r in rows if r.record) == [("$.a.b[]", "2"), ("$['a.b'][]", "1"), ("$['a[]'][''][]", "3")]
    assert nesting.records(nesting.triples(df, leaves=False)).count() == 3


def test_links_come_out_of_the_flat_tables(spark, tmp_path, monkeypatch):
    wide = '{"w": [{' + ", ".join(f'"k{i}": [{i}, {i}]' for i in range(3_000)) + "}]}"
    rows = [(1, '{"a": [{"b": 1}, {"c": [{}]}]}', None), (1, '{"a": [{"b": 2}]}', '{"a": [{"b": 3}]}'), (None, '{"a": [{"b": 4}]}', "plain"), (2, wide, "{}"), (3, "{", None)]
    spark.createDataFrame(rows, "row_id bigint, event string, fields_json string").repartition(2).write.parquet(f"{tmp_path}/nested_events.parquet")
    read = lambda: sorted(map(str, map(tuple, problems.p4_found(spark, str(tmp_path)).collect())))
    inner = (1, "event", "$.a[1]", "$.a[1].c[0]")
    want = [(1, "event", "$", "$.a[0]"), (1, "event", "$", "$.a[0]"), (1, "event", "$", "$.a[1]"), inner, (1, "fields_json", "$", "$.a[0]"), (None, "event", "$", "$.a[0]"), (2, "event", "$", "$.w[0]")]
    assert read() == sorted(map(str, want))
    tables = nesting.FlatTables.write(spark, nesting.triples(spark.read.parquet(f"{tmp_path}/nested_events.parquet")))
    assert sorted(r.f_b or "" for r in tables.open("$.a[]").collect()) == ["", "1", "2", "3", "4"]
    assert tables.columns.filter("table = '$.w[]'").agg(F.count("*"), F.sum("n_values")).first()[:] == (3_000, 6_000)
    pivoted = nesting.pivoted
    monkeypatch.setattr(nesting, "pivoted", lambda found: pivoted(found).filter("table <> '$.a[]'"))
    assert read() == sorted(map(str, [inner, want[-1]]))


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5) | st.sampled_from(["[]", '{"k": [{}]}', '"[{}]"', "[1", "{}x"]), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


def tree_model(text):
    """The records and leaves of a text by way of its tree."""
    import json

    def opened(s):
        while isinstance(s, str) and s.strip(" \t\n\r")[:1] in ("{", "[", '"'):
            try:
                s = json.loads(s)
            except ValueError:
                return None
        return s if isinstance(s, (dict, list)) else None

    out = []

    def walk(v, path, own, element):
        if isinstance(v, str) and (inner := opened(v)) is not None:
            v = inner
        if isinstance(v, dict):
            if element:
                out.append((path, own, None))
                own = path
            for k, x in v.items():
                walk(x, f"{path}.{k}", own, False)
            if not v and not element and path != "$":
                out.append((own, None, "{}"))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", own, True)
            if not v:
                out.append((own, None, "[]"))
        else:
            out.append((own, None, None if v is None else v if isinstance(v, str) else json.dumps(v)))

    root = opened(text)
    if root is not None:
        walk(root, "$", "$", False)
    return out


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_stream_agrees_with_the_tree(value):
    import json

    text = json.dumps(value)
    got = [(path, parent, None) if leaf is None else (path, None, v) for _, _, path, parent, _, leaf, v, _ in nesting.triples_of(text)]
    assert got == tree_model(text)
    assert [x[:4] for x in nesting.triples_of(text, leaves=False)] == [x[:4] for x in nesting.triples_of(text) if x[5] is None]
    if isinstance(value, (list, dict)):
        assert nesting.triples_of(text + "x") == [] and nesting.triples_of(text[:-1]) == []


# small files
def test_pending_parts(spark):
    p = lambda i, level, n, gone=None, inputs=None, at=1: (i, level, n, gone, inputs, dt.datetime(2025, 1, at), "main", 1)
    rows = [
        p("a", 0, 1), p("b", 0, 2), p("c", 0, 3), p("d", 0, 4), p("e", 0, 5, dt.datetime(2025, 1, 2)), p("f", 0, 6), p("g", 0, 7), p("g", 0, 7, dt.datetime(2025, 1, 3), None, 5), p("h", 0, None),
        p("M1", 1, 3, dt.datetime(2025, 1, 2), '["a", "b"]'), p("M2", 2, 3, None, "/x/M1.lsg"), p("M3", 1, 4, None, "c; d"), p("M4", 1, 6, dt.datetime(2025, 1, 2), "f"), p("M5", 1, None, None, "c"), p("M6", 1, 0, None, "zz"), p("M7", 1, 9, None, ""),
    ]
    df = spark.createDataFrame(rows, "part_id string, level int, event_count bigint, removed_at timestamp, inputs string, listed_at timestamp, index_name string, size_bytes bigint")
    pending = lambda df: {r.part_id for r in compaction.pending_parts(spark, df, work_path(spark, "t"))[0].collect()}
    assert pending(df) == {"c", "d", "f", "h"}
    assert pending(df.limit(0)) == set()
    # levels that don't fall along the links, a huge one, and merged parts that hold each other
    odd = [
        p("a", 0, 1), p("b", 0, 2), p("m1", 1, 3, dt.datetime(2025, 1, 2), "a,b"), p("m2", 1, 3, None, "m1"), p("c", 0, 1), p("d", 0, 5), p("n1", 1_000_000_000, 1, None, "c"), p("x", 2, 5, None, "y"), p("y", 2, 5, dt.datetime(2025, 1, 2), "x"),
    ]
    assert pending(spark.createDataFrame(odd, df.schema)) == {"d"}


def test_consolidation_keeps_every_row(spark):
    rows = spark.range(500).select("id", F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("part_id"), F.when(F.col("id") % 3 == 0, F.lit("web")).alias("index_name"), F.lit("x").alias("to_index"), F.array(F.lit(1)).alias("arr"))
    rows = rows.unionByName(rows.limit(20))
    parts = spark.createDataFrame([(f"p{i}", 0, 10, None if i else dt.datetime(2025, 1, 1), None, dt.datetime(2025, 1, 1), "main", 1) for i in range(50)], "part_id string, level int, event_count bigint, removed_at timestamp, inputs string, listed_at timestamp, index_name string, size_bytes bigint")
    inputs, outputs, at_ = compaction.consolidate(spark, rows, parts)
    assert inputs.count() == 49 and outputs.agg(F.sum("event_count")).first()[0] == rows.filter("part_id <> 'p0'").count() and outputs.count() <= 4
    written = spark.read.parquet(at_ + "/staged").drop("__x")
    assert compaction.checksum(written, rows.columns).first() == compaction.checksum(rows.filter("part_id <> 'p0'"), rows.columns).first()
    assert inputs.agg(F.sum("rows_written")).first()[0] == written.count()
    layout = compaction.part_layout(spark, rows, parts)
    assert layout.agg(F.sum("event_count")).first()[0] == rows.count()
    empty = compaction.consolidate(spark, rows.limit(0), parts.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0


# log lines
HEADS = [
    ("2025-10-07 04:02:12,781 - bloom.index - ERROR - view merged", ("ERROR", "bloom.index")), ("2025-10-07 22:35:37,273 INFO  [worker-11] io.x.auth - replayed", ("INFO", "io.x.auth")), ("2025/10/08 20:33:46 [notice] 5#3: *8 shard queued, client: 1.2.3.4, module: quota-guard", ("INFO", "quota-guard")),
    ("2025-10-08 11:47:08.118 UTC [72] tail broker WARNING:  sealed", ("WARN", "tail broker")), ("E1028 07:05:18.964160   22439 part_writer.go:193] view", ("ERROR", "part_writer")), ('ts=1761059540.486 lvl=trc comp=view-refresher msg="queued"', ("TRACE", "view-refresher")),
    ("2025-10-06T22:28:44.532Z [INF] [shard-router] token | fid_ms=8", ("INFO", "shard-router")), ('{"msg": "x", "ts": "2025-10-24T06:49:46Z", "severity": "CRITICAL"}', ("FATAL", "")), ("<142>1 2025-10-11T02:08:30+00:00 host ledger-sync 23 - - row", ("INFO", "ledger-sync")), ("<11>Oct 11 02:27:59 host router[14]: part", ("ERROR", "router")),
    ("[Thu, 23 Oct 2025 11:39:54 +0000] wrn quota-guard: merged", ("WARN", "quota-guard")), ("[2025-10-23 21:07:42 UTC] panic gw: lease", ("FATAL", "gw")),
]


def raw(spark, lines):
    rows = [(i, "s", i + 1, t, dt.datetime(2025, 11, 1, tzinfo=UTC)) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "line_id bigint, source string, line_no bigint, event string, received_at timestamp").repartition(2)


def test_heads(spark):
    plain = ["", None, "\tat io.x(Unit.java:1)", "{", '  "level": "DEBUG",', "2025-11-04 |  847 | evicted", "INFO level was raised, last seen at 2025-10-12T13:20:12Z", "WHERE code > 4 -- WARN rows"]
    got = {r.line_id: (r.log_level, r.component) for r in templates.found_entries(spark, raw(spark, [t for t, _ in HEADS] + plain)).collect()}
    assert got == {i: w for i, (_, w) in enumerate(HEADS)}
    assert slots.level_of("Notice") == "INFO" and slots.level_of("loud") == ""


UNSEEN = [
    ("2025-10-01T12:00:00Z|ERROR|auth-svc|boom", ("ERROR", "auth-svc", "boom")), ("[2025-10-01T12:00:00Z][ERROR][auth-svc] boom", ("ERROR", "auth-svc", "boom")), ("01.10.2025 12:00:00 WARN gate: shut", ("WARN", "gate", "shut")),
    ("1759312800.123 ERROR auth-svc: boom", ("ERROR", "auth-svc", "boom")), ('{"service": "a", "time": 1759312800, "lvl": "wrn", "msg": "x \\"y\\""}', ("WARN", "a", 'x "y"')), ("10/Oct/2025:13:55:36 +0000 | info | store | full", ("INFO", "store", "full")),
]


def test_layouts_that_no_pattern_names(spark):
    got = {r.line_id: (r.log_level, r.component, r.message) for r in templates.entries(spark, raw(spark, [t for t, _ in UNSEEN])).collect()}
    assert got == {i: w for i, (_, w) in enumerate(UNSEEN)}


def test_templates_decide_the_rows(spark):
    """What a slot holds in the other lines of its template says what it is in this one."""
    threads = [f"2025-10-07 22:35:{i:02d},273 [exec-{i}] - token {i} merged" for i in range(20)] + ["2025-10-07 22:36:00,273 [main] - token 4 merged"]
    with_ = {r.line_id: r.component for r in templates.found_entries(spark, raw(spark, threads)).collect()}
    alone = {r.line_id: r.component for r in templates.found_entries(spark, raw(spark, threads), tau=1.1).collect()}
    assert with_ == dict.fromkeys(range(21), "") and alone == with_ | {20: "main"}
    quoted = [f"{i} rows of 7 left at {w}" for i, w in enumerate("abcdefghijkl")] + ["1759312800 rows of 4 left at z"]
    assert templates.found_entries(spark, raw(spark, quoted)).count() == 0 and templates.found_entries(spark, raw(spark, quoted), tau=1.1).count() == 1


def test_rounds_of_small_shards_agree(spark):
    lines = [t.replace("4", str(i % 7)) + " " + "ab cd ef gh".split()[i % 4] * (i % 3) for i in range(40) for t, _ in HEADS]
    rows = [sorted(templates.found_entries(spark, raw(spark, lines), shard_items=n).collect()) for n in (10, 4_000)]
    assert rows[0] == rows[1] and len(rows[0]) > 400


def test_templates_follow_from_the_sequences_alone(spark, tmp_path):
    """The number and size of tasks, and how lines are spread over them, change no template."""
    lines = [t.replace("4", str(i % 7)) + " " + "ab cd ef gh".split()[i % 4] * (i % 3) + f" {'uvwxyz'[i % 6]} {'klm'[i % 3]} {i}" for i in range(60) for t, _ in HEADS]
    found = []
    for n, parts in ((10, 1), (200, 5), (4_000, 2)):
        at = f"{tmp_path}/{n}"
        templates.tokenised(raw(spark, lines).repartition(parts).select("event")).write.parquet(f"{at}/lines")
        found.append(sorted((bytes(r.key), r.event, r.template) for r in templates.mine_templates(spark, spark.read.parquet(f"{at}/lines"), at, shard_items=n).collect()))
    assert found[0] == found[1] == found[2] and len({k for k, _, _ in found[0]}) == len(found[0])
    assert all(slots.aligned(t.split("\x1f")[1:], slots.tokenised(e).symbols) is not None for _, e, t in found[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "<*>"]), min_size=5, max_size=5), max_size=12))
def test_templates_looked_up_are_those_compared(sequences):
    few, templates.FEW = templates.FEW, 0
    try:
        looked_up = templates.alike(sequences)
    finally:
        templates.FEW = few
    assert looked_up == templates.alike(sequences)


def test_entries_of_lines(spark, monkeypatch):
    monkeypatch.setattr(templates, "BLOCK_LINES", 3)
    lines = ["orphan", HEADS[0][0], "\tat x", "", "2025-11-04 |  847 | x", HEADS[1][0], HEADS[2][0], None, "y" * 50_000, "z"]
    rows = [(10 * i, "s", i + 1, t, "host") for i, t in enumerate(lines)] + [(1000, None, 1, HEADS[3][0], None), (1001, None, 2, "more", None), (1002, "t", None, "lost", None)]
    df = spark.createDataFrame(rows, "line_id bigint, source string, line_no bigint, event string, block string").withColumn("received_at", F.lit(dt.datetime(2025, 11, 1, tzinfo=UTC))).repartition(3)
    got = {r.line_id: (r.n_lines, r.log_level, r.component) for r in templates.found_entries(spark, df).collect()}
    assert got == {10: (4, "ERROR", "bloom.index"), 50: (1, "INFO", "io.x.auth"), 60: (4, "INFO", "quota-guard"), 1000: (2, "WARN", "tail broker")}
    whole = {r.line_id: r.message for r in templates.entries(spark, df).collect()}
    assert whole[10] == "view merged\n\tat x\n\n2025-11-04 |  847 | x" and whole[1000] == "sealed\nmore"
    assert templates.found_entries(spark, df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc<>"), max_size=9), st.lists(st.sampled_from("abc<>"), max_size=9))
def test_lcs_is_longest(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def n(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + n(i + 1, j + 1) if a[i] == b[j] else max(n(i + 1, j), n(i, j + 1))

    assert len(templates.lcs(a, b)) == n(0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc<>"), max_size=9), st.lists(st.sampled_from("abc<>"), max_size=9))
def test_length_without_a_table(a, b):
    assert templates.lcs_length(templates.masks_of(a), len(a), b) == len(templates.lcs(a, b))


def test_very_long_sequences_have_a_common_one(monkeypatch):
    monkeypatch.setattr(templates, "CELLS", 10)
    a, b = list("abcdefghxij"), list("zbcyefghij")
    assert [a[i] for i in templates.lcs(a, b)] == list("bcefghij")


def test_templates_record_gaps_at_every_place():
    assert templates.mine(["a b c d e".split(), "a X b c d e".split(), "a b c X d e".split()])[1] == ["a <*> b c <*> d e".split()]
    # a template that is contained whole isn't taken if another has more in common
    assert templates.mine([list("abcdef"), list("abcdefghiYZ"), list("abcdefghij")])[0] == [0, 1, 1]
    assert slots.aligned("a <*> b".split(), "a b".split()) == [0, 2] and slots.aligned("a b".split(), "a x b".split()) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "<num>", "<*>"]), min_size=2, max_size=8), max_size=8))
def test_every_sequence_matches_its_template(sequences):
    for cluster in (templates.mine, templates.cluster):
        of, made = cluster(sequences)
        assert all(slots.aligned(made[k], s) is not None for k, s in zip(of, sequences))


def test_words_of_a_message_are_constants():
    made = [slots.tokenised(f"2025-10-07 05:02:12 {t}").symbols for t in ("queue full for shard 7", "queue full for shard 8", "disk failed again and again while it was in use")]
    of, found = templates.mine(made)
    assert of == [0, 0, 1] and found[0][-5:] == [" queue", " full", " for", " shard", " <num>"] and found[1][-10:-7] == [" disk", " failed", " again"]
