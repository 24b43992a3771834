"""Deeply nested semi-structured records, turned into related flat tables.

Every JSON text is read as a stream, token by token, into triples of path, value and
ordinal; no tree of it is built. Triples are grouped by their repeated ancestor (the
nearest enclosing object that is an element of an array), and each group is pivoted into
one table whose rows keep row_id, origin, their own number and path and their parent's.

Defined results:
- null, blank, plain text and broken JSON (as a whole text) give no triples;
- a string that holds a valid JSON array or object counts as that value, however deep;
- an object key given twice: the last one counts; NaN and Infinity aren't JSON;
- depth is limited only by the length of the text;
- a key that holds a dot, a bracket or a quote stands in table and column names as ['key'],
  so that different keys never share a name, and records are told apart by their numbers;
- empty arrays and objects are leaves [] and {}, which absent keys aren't;
- equal rows give equal triples, each of its own row_id, and rows of one row_id keep their
  records apart; an empty table gives empty tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.shared import remove_path, work_path

#: Columns of one flat table; further leaf names follow in tables of the same keys beside it.
WIDTH = 2_000

_COLUMNS = "row_id origin record parent path parent_path table leaf value type ordinal text".split()
_NUMBERS = {"row_id", "record", "parent", "ordinal", "text"}
TRIPLES = T.StructType([T.StructField(n, T.LongType() if n in _NUMBERS else T.StringType()) for n in _COLUMNS])

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
_SPACE = re.compile(r"[ \t\n\r]*\Z")
_ODD = re.compile(r"[.\[\]'\"]|^$")


def _named(key: str) -> str:
    """A key as part of a table's or column's name: as it is, or quoted where it could be taken for several."""
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" if _ODD.search(key) else key


class _Reader:
    """Reads one text. out holds (record, parent, path, parent path, table, leaf or None, value, type), or None for what a later key replaced."""

    def __init__(self, leaves: bool):
        self.leaves = leaves
        self.out: list = []
        self.records = 0

    def text(self, text: str) -> list:
        self.opened(text, ("$", "$", 0, -1, "$", "", "", False))
        return [x for x in self.out if x is not None]

    def opened(self, text: str, at: tuple) -> bool:
        """Reads a string that holds an array or object, perhaps as a string again. False if it doesn't."""
        from json.decoder import scanstring

        while True:
            bare = text.strip(" \t\n\r")
            c = bare[:1]
            if c == "{" or c == "[":
                return self.stream(bare, at)
            if c != '"':
                return False
            m = _TOKEN.match(bare)
            if not m or m.end() != len(bare):
                return False
            text = scanstring(m[2], 1, True)[0]

    def leaf(self, at: tuple, value, kind: str) -> None:
        if self.leaves:
            path, table, record, parent, own, parent_path, leaf, _ = at
            self.out.append((record, parent, own, parent_path, table, leaf, value, kind))

    def stream(self, text: str, at: tuple) -> bool:
        """at: path, table, number of the record, of its parent, path of the record, of its parent, leaf name, whether an array's element."""
        from json.decoder import scanstring

        out, match = self.out, _TOKEN.match
        begun, records = len(out), self.records
        # of each open container: [is object, where it is, elements or keys with where their triples begin, the last key]
        stack: list[list] = []
        pos, want, here = 0, "value", at
        while m := match(text, pos):
            pos = m.end()
            k = m.lastindex
            raw = m[k]
            if want == "value" or want == "first":
                if k == 1:
                    if raw == "{" or raw == "[":
                        path, table, record, parent, own, parent_path, leaf, element = here
                        if raw == "{":
                            if element:
                                # an element of an array is a record of its own
                                self.records += 1
                                here = (path, table + leaf_sep(leaf), self.records, record, path, own, "", False)
                                out.append((self.records, record, path, own, here[1], None, None, None))
                            stack.append([True, here, {}, None, len(out)])
                            want = "first key"
                        else:
                            stack.append([False, here, 0, None, len(out)])
                            here = inside(stack[-1])
                            want = "first"
                        continue
                    if raw != "]" or want != "first":
                        break
                    frame = stack.pop()
                    self.leaf(frame[1], "[]", "array")
                elif k == 2:
                    value = scanstring(raw, 1, True)[0]
                    if not (value and value.lstrip(" \t\n\r")[:1] in ("{", "[", '"') and self.opened(value, here)):
                        self.leaf(here, value, "string")
                elif k == 3:
                    self.leaf(here, raw, "number")
                else:
                    self.leaf(here, None if raw == "null" else raw, "null" if raw == "null" else "bool")
            elif want == "comma":
                top = stack[-1]
                if raw == "," and k == 1:
                    if top[0]:
                        want = "key"
                    else:
                        top[2] += 1
                        here, want = inside(top), "value"
                    continue
                if k != 1 or raw != ("}" if top[0] else "]"):
                    break
                stack.pop()
            elif want == "colon":
                if k != 1 or raw != ":":
                    break
                want = "value"
                continue
            elif want == "end":
                break
            else:  # a key, or the end of an object that may be empty
                top = stack[-1]
                if k == 2:
                    key = scanstring(raw, 1, True)[0]
                    keys = top[2]
                    if key in keys:
                        low, high = keys[key]
                        out[low:high] = [None] * (high - low)
                    top[3] = key
                    keys[key] = (len(out), len(out))
                    path, table, record, parent, own, parent_path, leaf, _ = top[1]
                    name = _named(key)
                    here = (f"{path}.{key}", table, record, parent, own, parent_path, f"{leaf}.{name}" if leaf and name[0] != "[" else leaf + name, False)
                    want = "colon"
                    continue
                if k != 1 or raw != "}" or want != "first key":
                    break
                stack.pop()
                if top[1][6]:
                    self.leaf(top[1], "{}", "object")
            # a value has ended
            if stack:
                top = stack[-1]
                if top[0]:
                    top[2][top[3]] = (top[2][top[3]][0], len(out))
                want = "comma"
            else:
                want = "end"
        if want == "end" and _SPACE.match(text, pos):
            return True
        del out[begun:]
        self.records = records
        return False


def leaf_sep(leaf: str) -> str:
    return leaf if not leaf or leaf[0] == "[" else "." + leaf


def inside(frame: list) -> tuple:
    """Where the next element of an open array is."""
    path, table, record, parent, own, parent_path, leaf, _ = frame[1]
    return f"{path}[{frame[2]}]", table, record, parent, own, parent_path, f"{leaf}[]", True


def triples_of(text: str | None, leaves: bool = True) -> list[tuple]:
    """(record, parent, path, parent path, table, leaf, value, type) in document order; leaf is null for a record itself. Record 0 is what lies outside of arrays."""
    if not text or text.lstrip(" \t\n\r")[:1] not in ("{", "[", '"'):
        return []
    return _Reader(leaves).text(text)


def triples(df: DataFrame, origins: tuple[str, ...] = ("event", "fields_json"), leaves: bool = True) -> DataFrame:
    """The triples of all JSON texts in df, which has row_id and the columns named in origins; without leaves only records. text numbers the texts."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(n, pa.int64() if n in _NUMBERS else pa.string()) for n in _COLUMNS])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            rows: list[tuple] = []
            ids = b.column(0).to_pylist()
            for i, origin in enumerate(origins, 1):
                for row_id, text in zip(ids, b.column(i).to_pylist()):
                    number += 1
                    rows += [(row_id, origin, *t, n, number) for n, t in enumerate(triples_of(text, leaves))]
                    if len(rows) > 20_000:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return df.select(F.col("row_id").cast("bigint"), *(F.col(o).cast("string") for o in origins)).mapInArrow(run, TRIPLES)


def records(found: DataFrame) -> DataFrame:
    """row_id, origin, parent_path, child_path, one row for each nested record."""
    return found.filter("leaf is null").select("row_id", "origin", "parent_path", F.col("path").alias("child_path"))


KEY = ["table", "row_id", "origin", "record", "parent", "path", "parent_path"]


#: The nearest repeated ancestor of a triple; its other columns follow from it.
_RECORD = ["text", "row_id", "origin", "record"]


def _of_record() -> Column:
    return F.max(F.struct("table", "parent", "path", "parent_path")).alias("s")


def _of_records(one: DataFrame, held: str) -> DataFrame:
    return one.select("s.table", "row_id", "origin", "record", F.when(F.col("s.parent") >= 0, F.col("s.parent")).alias("parent"), "s.path", F.when(F.col("s.parent") >= 0, F.col("s.parent_path")).alias("parent_path"), held)


def grouped(found: DataFrame) -> DataFrame:
    """Every record of every table with its leaves (k, o, v) in document order; record 0 of a text stands for what lies outside of arrays."""
    leaf = F.when(F.col("leaf").isNotNull(), F.struct(F.col("leaf").alias("k"), F.col("ordinal").alias("o"), F.col("value").alias("v")))
    return _of_records(found.groupBy(*_RECORD).agg(_of_record(), F.array_sort(F.collect_list(leaf)).alias("leaves")), "leaves")


def pivoted(found: DataFrame) -> DataFrame:
    """Every record of every table as one row with its cells: for each leaf name its values in document order."""
    value = F.when(F.col("leaf").isNotNull(), F.struct(F.col("ordinal").alias("o"), F.col("value").alias("v")))
    # one shuffle for both steps: the triples of a record lie in one partition
    cells = found.repartition(*_RECORD).groupBy(*_RECORD, "leaf").agg(_of_record(), F.transform(F.array_sort(F.collect_list(value)), lambda x: x.v).alias("values"))
    cell = F.when(F.col("leaf").isNotNull(), F.struct("leaf", "values"))
    return _of_records(cells.groupBy(*_RECORD).agg(F.max("s").alias("s"), F.map_from_entries(F.collect_list(cell)).alias("cells")), "cells")


class FlatTables:
    """The flat tables of parsed records, written once below path: rows by table, and the columns of each table.

    Neither tables nor columns are brought to the driver but for those of a table that is
    opened; sender-made keys may make as many as they will.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rows = spark.read.parquet(f"{path}/rows")
        self.columns = spark.read.parquet(f"{path}/columns")

    @classmethod
    def write(cls, spark: SparkSession, found: DataFrame) -> FlatTables:
        """One parse; the rows lie sorted by table, so that opening one reads its own row groups only."""
        path = work_path(spark, "flat")
        pivoted(found).write.parquet(f"{path}/records")
        stored = spark.read.parquet(f"{path}/records")
        # ranges split a table that holds most of the rows
        stored.repartitionByRange("table", "row_id").sortWithinPartitions("table", "row_id").write.parquet(f"{path}/rows")
        given = F.when(F.col("values").isNotNull(), F.size(F.filter("values", lambda v: v.isNotNull()))).otherwise(0)
        stored.select("table", F.explode_outer("cells").alias("leaf", "values")).groupBy("table", "leaf").agg(F.sum(given).alias("n_values")).write.parquet(f"{path}/columns")
        remove_path(spark, f"{path}/records")
        return cls(spark, path)

    def links(self) -> DataFrame:
        """row_id, origin, parent_path, child_path of every nested record of all tables."""
        return self.rows.filter("parent is not null").select("row_id", "origin", "parent_path", F.col("path").alias("child_path"))

    def open(self, table: str, part: int = 0) -> DataFrame | None:
        """row_id, origin, record, parent, path, parent_path and a column f_... for each leaf; values of an array share one column, as a JSON array in order.

        A table of more than WIDTH leaf names goes on in further parts of the same rows; None beyond the last.
        """
        of = self.columns.filter((F.col("table") == table) & F.col("leaf").isNotNull())
        names = [r["leaf"] for r in of.select("leaf").orderBy("leaf").offset(part * WIDTH).limit(WIDTH).collect()]
        if not names and part:
            return None
        at = lambda k: F.try_element_at("cells", F.lit(k))
        return self.rows.filter(F.col("table") == table).select(
            *KEY[1:], *((F.to_json(at(k)) if k.endswith("[]") else F.try_element_at(at(k), F.lit(1))).alias(f"f_{k}") for k in names)
        )
