"""Syntax of expressions to typed Spark columns.

Types are resolved against the DataFrame's schema while the column is built, since the
language never converts silently: a comparison of different kinds is null, + joins two
strings or adds two numbers, division of two integers truncates and division by zero is null.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.syntax import QueryError, closest

DURATION = T.DayTimeIntervalType(0, 3)
NULL = T.NullType()


class Typed(NamedTuple):
    col: Column
    type: T.DataType
    missing: bool = False
    value: object = None  # of a literal

    @property
    def kind(self) -> str:
        return kind(self.type)


def kind(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    for k, cls in (("string", T.StringType), ("bool", T.BooleanType), ("null", T.NullType), ("array", T.ArrayType), ("duration", T.DayTimeIntervalType), ("any", T.VariantType)):
        if isinstance(t, cls):
            return k
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "object" if isinstance(t, (T.StructType, T.MapType)) else "any"


def null() -> Typed:
    return Typed(F.lit(None), NULL)


def nothing(t: T.DataType) -> Column:
    return F.lit(None).cast(t)


def literal(value) -> Typed:
    if value is None:
        return null()
    if isinstance(value, bool):
        return Typed(F.lit(value), T.BooleanType(), value=value)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), T.LongType(), value=value)
    if isinstance(value, float):
        return Typed(F.lit(value), T.DoubleType(), value=value)
    return Typed(F.lit(value), T.StringType(), value=value)


@dataclass
class Scope:
    """Columns in reach: the schema, parameters of lambdas, and the query's own now."""

    schema: T.StructType
    now: dt.datetime
    json_from: str | None = None  # column to look for unknown names in, if the source allows that
    locals: dict[str, Typed] = field(default_factory=dict)
    unknown: list[str] = field(default_factory=list)
    approximate: bool = False

    def with_local(self, name: str, typed: Typed) -> Scope:
        return Scope(self.schema, self.now, self.json_from, self.locals | {name: typed}, self.unknown, self.approximate)

    def lookup(self, name: str) -> Typed | None:
        if name in self.locals:
            return self.locals[name]
        name = {"source": "_source" if "source" not in self.names else "source", "sourcetype": "_sourcetype" if "sourcetype" not in self.names else "sourcetype"}.get(name, name)
        if name in self.names:
            return Typed(F.col(f"`{name}`"), self.schema[name].dataType)
        return None

    @property
    def names(self) -> list[str]:
        return self.schema.names


def common(types: list[T.DataType]) -> T.DataType | None:
    """The type that all can take without a silent change of kind; None if there is none."""
    real = [t for t in types if kind(t) != "null"]
    if not real:
        return NULL
    kinds = {kind(t) for t in real}
    if len(kinds) == 1:
        return real[0]
    return T.DoubleType() if kinds == {"int", "float"} else None


def as_number(t: Typed) -> Column:
    return t.col.cast("double") if t.kind == "float" else t.col


def bind(e, scope: Scope) -> Typed:
    return globals()[f"_{e[0]}"](e, scope)


def predicate(e, scope: Scope) -> Column:
    t = bind(e, scope)
    return t.col if t.kind == "bool" else F.lit(None).cast("boolean")


def _lit(e, scope):
    value, sort = e[1], e[2]
    if sort == "duration":
        return Typed(F.lit(dt.timedelta(microseconds=int(value))), DURATION, value=value)
    return literal(value)


def _paren(e, scope):
    return bind(e[1], scope)


def _name(e, scope):
    found = scope.lookup(e[1])
    if found:
        return found
    if scope.json_from and scope.json_from in scope.names:
        text = F.get_json_object(F.col(f"`{scope.json_from}`"), "$." + e[1])
        return Typed(text, T.StringType())
    scope.unknown.append(e[1])
    return Typed(F.lit(None), NULL, missing=True)


def _path(e) -> str | None:
    if e[0] == "name" and not e[2]:
        return e[1]
    if e[0] == "member":
        head = _path(e[1])
        return head and f"{head}.{e[2]}"
    return None


def _member(e, scope):
    flat = _path(e)
    if flat and flat in scope.names:
        return scope.lookup(flat)
    return member(bind(e[1], scope), e[2])


def member(of: Typed, name: str) -> Typed:
    t = of.type
    if isinstance(t, T.StructType):
        return Typed(of.col.getField(name), t[name].dataType) if name in t.names else Typed(F.lit(None), NULL, missing=True)
    if isinstance(t, T.MapType):
        return Typed(F.try_element_at(of.col, F.lit(name)), t.valueType)
    if isinstance(t, T.VariantType):
        return Typed(F.try_variant_get(of.col, f"$.{name}", "variant"), T.VariantType())
    return Typed(F.lit(None), NULL, missing=True)


def _index(e, scope):
    of, at = bind(e[1], scope), bind(e[2], scope)
    if of.kind == "array" and at.kind == "int":
        # try_element_at counts from 1, and from the end below 0
        place = F.when(at.col >= 0, at.col + 1).otherwise(at.col).cast("int")
        return Typed(F.try_element_at(of.col, place), of.type.elementType)
    if at.kind == "string" and isinstance(at.value, str):
        return member(of, at.value)
    if of.kind == "any" and isinstance(at.value, int):
        return Typed(F.try_variant_get(of.col, f"$[{at.value}]", "variant"), T.VariantType())
    if isinstance(of.type, T.MapType) and at.kind == "string":
        return Typed(F.try_element_at(of.col, at.col), of.type.valueType)
    return null()


def plain(t: Typed, like: Typed) -> Typed:
    """A VARIANT next to a typed value takes that value's type where it can."""
    if t.kind != "any" or like.kind in ("any", "null", "array", "object"):
        return t
    want = {"int": "double", "float": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp"}.get(like.kind)
    return Typed(F.try_variant_get(t.col, "$", want), T._parse_datatype_string(want)) if want else t


def _binary(e, scope):
    op = e[1]
    a, b = bind(e[2], scope), bind(e[3], scope)
    if op in ("and", "or"):
        x, y = (t.col if t.kind == "bool" else F.lit(None).cast("boolean") for t in (a, b))
        return Typed((x & y) if op == "and" else (x | y), T.BooleanType())
    if op == "??":
        t = common([a.type, b.type])
        if t is None:
            a, b = plain(a, b), plain(b, a)
            t = common([a.type, b.type])
        if t is None:
            return a
        return Typed(F.coalesce(a.col.cast(t), b.col.cast(t)) if kind(t) != "null" else F.lit(None), t)
    a, b = plain(a, b), plain(b, a)
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return Typed(compare(op, a, b), T.BooleanType())
    return arithmetic(op, a, b)


def compare(op: str, a: Typed, b: Typed) -> Column:
    numeric = {"int", "float"}
    if a.kind != b.kind and not {a.kind, b.kind} <= numeric or "null" in (a.kind, b.kind) or (op not in ("==", "!=") and a.kind in ("object", "any")) or a.kind == "any":
        return F.lit(None).cast("boolean")
    x, y = (a.col.cast("double"), b.col.cast("double")) if {a.kind, b.kind} == numeric else (a.col, b.col)
    return {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()


def micros(t: Typed) -> Column:
    """A duration as microseconds."""
    return F.unix_micros(F.timestamp_micros(F.lit(0).cast("bigint")) + t.col)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    numeric = {"int", "float"}
    pair = (a.kind, b.kind)
    if set(pair) <= numeric:
        if pair == ("int", "int"):
            call = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}
            if op == "/":
                return Typed(_div(a.col, b.col), T.LongType())
            return Typed(call[op](a.col, b.col).cast("bigint"), T.LongType())
        x, y = a.col.cast("double"), b.col.cast("double")
        if op == "%":
            return Typed(nothing(T.DoubleType()), T.DoubleType())
        return Typed(F.try_divide(x, y) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op], T.DoubleType())
    if op == "+" and pair == ("string", "string"):
        return Typed(F.concat(a.col, b.col), T.StringType())
    if pair == ("timestamp", "timestamp") and op == "-":
        return Typed(a.col - b.col, DURATION)
    if pair == ("timestamp", "duration") and op in "+-":
        return Typed(a.col + b.col if op == "+" else a.col - b.col, T.TimestampType())
    if pair == ("duration", "timestamp") and op == "+":
        return Typed(b.col + a.col, T.TimestampType())
    if pair == ("duration", "duration"):
        if op in "+-":
            return Typed(a.col + b.col if op == "+" else a.col - b.col, DURATION)
        if op == "/":
            return Typed(F.try_divide(micros(a).cast("double"), micros(b).cast("double")), T.DoubleType())
        if op == "%":
            return Typed(from_micros(F.try_mod(micros(a), micros(b))), DURATION)
    if a.kind == "duration" and b.kind in numeric and op in "*/":
        n = micros(a) * b.col if op == "*" else F.try_divide(micros(a).cast("double"), b.col.cast("double"))
        return Typed(from_micros(n.cast("bigint")), DURATION)
    if a.kind in numeric and b.kind == "duration" and op == "*":
        return Typed(from_micros((micros(b) * a.col).cast("bigint")), DURATION)
    return null()


def _div(a: Column, b: Column) -> Column:
    """Truncating division; exact, since it stays with integers."""
    return F.try_divide(F.try_subtract(a, F.try_mod(a, b)).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("bigint")


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n) - F.timestamp_micros(F.lit(0).cast("bigint"))


def _not(e, scope):
    return Typed(~predicate(e[1], scope), T.BooleanType())


def _neg(e, scope):
    t = bind(e[1], scope)
    if t.kind in ("int", "float", "duration"):
        return Typed(-t.col, t.type, value=-t.value if isinstance(t.value, (int, float)) else None)
    return null()


def _in(e, scope):
    left = bind(e[1], scope)
    if e[2][0] == "array":
        tests = [compare("==", plain(left, x), x) if x.kind != "null" else F.lit(None).cast("boolean") for x in (bind(i, scope) for i in e[2][1])]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return Typed(out, T.BooleanType())
    right = bind(e[2], scope)
    if right.kind != "array" or common([left.type, right.type.elementType]) is None:
        return Typed(F.lit(None).cast("boolean"), T.BooleanType())
    return Typed(F.exists(right.col, lambda x: x == left.col), T.BooleanType())


def _between(e, scope):
    return bind(("binary", "and", ("binary", ">=", e[1], e[2]), ("binary", "<=", e[1], e[3])), scope)


def _array(e, scope):
    items = [bind(i, scope) for i in e[1]]
    t = common([i.type for i in items])
    if t is None:
        return Typed(F.array(*(F.to_variant_object(i.col) if i.kind in ("array", "object") else F.try_parse_json(F.to_json(F.struct(i.col.alias("v")))) for i in items)), T.ArrayType(T.VariantType()))
    return Typed(F.array(*(i.col.cast(t) if kind(t) != "null" else i.col for i in items)), T.ArrayType(t))


def _object(e, scope):
    items = [(k, bind(v, scope)) for k, v in e[1]]
    if not items:
        return Typed(F.create_map().cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()))
    return Typed(F.struct(*(t.col.alias(k) for k, t in items)), T.StructType([T.StructField(k, t.type) for k, t in items]))


def _lambda(e, scope):
    raise QueryError("a lambda is only valid as a direct argument")


def _call(e, scope):
    from brindle.functions.scalar import FUNCTIONS

    name = e[1].lower()
    strict = name.endswith("!")
    spec = FUNCTIONS.get(name.rstrip("!"))
    if spec is None or strict and not spec.strict:
        raise QueryError(f"{e[1]} isn't a function", hint=closest(name, FUNCTIONS))
    n = len(e[2])
    if n < spec.least or (spec.most is not None and n > spec.most):
        raise QueryError(f"{name} takes {spec.least} to {spec.most if spec.most is not None else 'any number of'} arguments, not {n}")
    if spec.raw:
        return spec.build(e[2], scope)
    args = [bind(a, scope) for a in e[2]]
    return spec.strict_build(*args) if strict else spec.build(scope, *args)
