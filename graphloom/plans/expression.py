"""Expressions of the query language as Spark SQL text, chosen by the types that the rows have.

A node is struct<id, labels, properties>, a relationship struct<id, src, dst, type, properties>, a path struct<nodes, rels>,
a point struct<srid, x, y[, z]>, a time of day struct<time_of_day> in microseconds, a zoned time struct<ts, tz>, a duration an
interval of days to seconds. Types come from an empty frame with the rows' schema, so nothing is read to find them.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import AGGREGATES, FUNCTIONS
from ..functions.registry import SCALARS

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, _WHOLE):
        return "int"
    if isinstance(t, _REAL):
        return "float"
    if isinstance(t, T.StructType):
        names = t.fieldNames()
        if names[:2] == ["id", "labels"]:
            return "node"
        if names[:4] == ["id", "src", "dst", "type"] or names[:3] == ["id", "src", "dst"] and "type" in names:
            return "rel"
        if names == ["nodes", "rels"]:
            return "path"
        if names == ["nodes", "edges"]:
            return "graph"
        if names in (["srid", "x", "y"], ["srid", "x", "y", "z"]):
            return "point"
        if names == ["time_of_day"]:
            return "time"
        if names == ["ts", "tz"]:
            return "zoned"
        return "struct"
    for cls, name in (
        (T.StringType, "string"), (T.BooleanType, "bool"), (T.ArrayType, "list"), (T.MapType, "map"), (T.DateType, "date"), (T.TimestampNTZType, "local"),
        (T.TimestampType, "instant"), (T.DayTimeIntervalType, "duration"), (T.NullType, "null"), (T.BinaryType, "binary"),
    ):
        if isinstance(t, cls):
            return name
    return "variant"


NUMBERS = ("int", "float")
#: Kinds whose values can be equal to one another.
_GROUPS = {"int": "number", "float": "number", "instant": "time stamp", "local": "time stamp", "struct": "map"}


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    if isinstance(value, dict):
        return f"named_struct({', '.join(f'{quoted(str(k))}, {literal(v)}' for k, v in value.items())})"
    if isinstance(value, int):
        return f"{value}L" if -(2**63) <= value < 2**63 else f"cast('{value}' as decimal(38,0))"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, datetime.datetime):
        return f"timestamp_ntz'{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"date'{value.isoformat()}'"
    if isinstance(value, datetime.timedelta):
        return micros_interval(str(round(value / datetime.timedelta(microseconds=1))))
    return quoted(str(value))


def micros_interval(micros: str) -> str:
    """SQL of a duration of so many microseconds."""
    return f"make_dt_interval(cast(({micros}) div 86400000000L as int), 0, 0, cast((({micros}) % 86400000000L) as decimal(20,0)) / 1000000)"


def interval_micros(sql: str) -> str:
    """SQL of a duration's microseconds."""
    return f"(cast(extract(DAY FROM {sql}) as bigint) * 86400000000L + cast(extract(HOUR FROM {sql}) as bigint) * 3600000000L + cast(extract(MINUTE FROM {sql}) as bigint) * 60000000L + cast(extract(SECOND FROM {sql}) * 1000000 as bigint))"


@dataclass
class Scope:
    """Rows so far; for node variables the tables that they may come from.

    Inside a subquery hidden columns tell apart the rows of its callers, all of which are in callers. unit: the one row that a query starts with.
    """

    df: DataFrame
    keys: dict[str, frozenset[str]] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()
    callers: DataFrame | None = None
    unit: bool = False

    @cached_property
    def probe(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame([], self.df.schema)

    @cached_property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}

    def over(self, df: DataFrame, keys: dict[str, frozenset[str]] | None = None) -> Scope:
        return Scope(df, dict(self.keys) if keys is None else keys, self.hidden, self.callers)

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("_")]


@dataclass
class V:
    """An expression's SQL; its type is asked for only where it matters."""

    sql: str
    ask: object = None
    known: T.DataType | None = None

    @property
    def type(self) -> T.DataType:
        if self.known is None:
            self.known = self.ask(self.sql)
        return self.known

    @property
    def kind(self) -> str:
        return kind_of(self.type)


class Writer:
    """Writes one expression over a scope. bound holds the variables of the lambdas around it, each with the list it runs over."""

    def __init__(self, scope: Scope, params: dict[str, object], graph=None) -> None:
        self.scope, self.params, self.graph = scope, params, graph
        self.bound: list[tuple[str, str]] = []
        self.aggregate = False

    def ask(self, sql: str) -> T.DataType:
        wrapped = sql
        for var, items in reversed(self.bound):
            wrapped = f"transform({items}, `{var}` -> {wrapped})"
        out = self.scope.probe.select(F.expr(wrapped).alias("x")).schema[0].dataType
        for _ in self.bound:
            out = out.elementType
        return out

    def v(self, sql: str, known: T.DataType | None = None) -> V:
        return V(sql, self.ask, known)

    def sql(self, tree: tuple) -> str:
        return self.write(tree).sql

    def write(self, tree: tuple) -> V:
        return getattr(self, f"_{tree[0]}")(*tree[1:])

    def within(self, var: str, items: str, tree: tuple) -> V:
        self.bound.append((var, items))
        try:
            out = self.write(tree)
            _ = out.type  # asked while the variable is bound
            return out
        finally:
            self.bound.pop()

    # leaves

    def _value(self, value: object) -> V:
        known = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}.get(type(value))
        return self.v(literal(value), known)

    def _param(self, name: str) -> V:
        if name not in self.params:
            raise ValueError(f"the parameter ${name} has no value")
        return self._value(self.params[name])

    def _column(self, name: str) -> V:
        return self.v(f"`{name}`", self.scope.types.get(name))

    def _sqltext(self, sql: str) -> V:
        return self.v(sql)

    def _var(self, name: str) -> V:
        if any(name == v for v, _ in self.bound):
            return self.v(f"`{name}`")
        if name not in self.scope.types:
            raise SyntaxError(f"the variable {name} is not bound")
        return self._column(name)

    def _enum(self, name: str, value: str) -> V:
        values = (getattr(self.graph, "enums", None) or {}).get(name)
        if values is None or value not in values:
            raise ValueError(f"there is no enum value {name}::{value}")
        return self._value(f"{name}::{value}")

    # logic

    def truth(self, tree: tuple) -> str:
        out = self.write(tree)
        return "cast(null as boolean)" if out.known is not None and out.kind == "null" else out.sql

    def _or(self, a: tuple, b: tuple) -> V:
        return self.v(f"({self.truth(a)} or {self.truth(b)})", T.BooleanType())

    def _and(self, a: tuple, b: tuple) -> V:
        return self.v(f"({self.truth(a)} and {self.truth(b)})", T.BooleanType())

    def _xor(self, a: tuple, b: tuple) -> V:
        return self.v(f"({self.truth(a)} <> {self.truth(b)})", T.BooleanType())

    def _not(self, a: tuple) -> V:
        return self.v(f"(not {self.truth(a)})", T.BooleanType())

    def _isnull(self, a: tuple) -> V:
        return self.v(f"({self.sql(a)} is null)", T.BooleanType())

    def _notnull(self, a: tuple) -> V:
        return self.v(f"({self.sql(a)} is not null)", T.BooleanType())

    @staticmethod
    def comparable(x: V) -> str:
        """SQL that Spark can compare: ids for entities, sorted entries for maps."""
        if x.kind in ("node", "rel"):
            return f"{x.sql}.id"
        if x.kind == "path":
            return f"struct(transform({x.sql}.nodes, n -> n.id), transform({x.sql}.rels, r -> r.id))"
        if x.kind == "map":
            return f"array_sort(map_entries({x.sql}))"
        return x.sql

    def _compare(self, op: str, a: tuple, b: tuple) -> V:
        x, y = self.write(a), self.write(b)
        p, q = x.kind, y.kind
        if "null" in (p, q):
            return self.v("cast(null as boolean)", T.BooleanType())
        if _GROUPS.get(p, p) != _GROUPS.get(q, q) and "variant" not in (p, q):
            if op not in ("=", "<>"):
                raise TypeError(f"cannot compare {p} with {q}")
            return self.v(f"(case when {x.sql} is not null and {y.sql} is not null then {'false' if op == '=' else 'true'} end)", T.BooleanType())
        if p == "struct" and q == "struct" and sorted(x.type.fieldNames()) != sorted(y.type.fieldNames()):
            return self.v("false" if op == "=" else "true", T.BooleanType())
        return self.v(f"({self.comparable(x)} {op} {self.comparable(y)})", T.BooleanType())

    def _in(self, a: tuple, b: tuple) -> V:
        x = self.write(a)
        if b[0] == "list" and b[1] and all(i[0] == "value" and i[1] is not None for i in b[1]):
            same = [i for i in b[1] if x.kind == "null" or _GROUPS.get(x.kind, x.kind) == _GROUPS.get(self.write(i).kind, self.write(i).kind)]
            if same and x.kind != "null":
                return self.v(f"({x.sql} in ({', '.join(self.sql(i) for i in same)}))", T.BooleanType())
            return self.v(f"(case when {x.sql} is not null then false end)", T.BooleanType())
        items = self.write(b)
        if items.kind == "null":
            return self.v("cast(null as boolean)", T.BooleanType())
        inner = kind_of(items.type.elementType)
        if x.kind in ("node", "rel") and inner == x.kind:
            return self.v(f"exists({items.sql}, _i -> _i.id = {x.sql}.id)", T.BooleanType())
        if x.kind == "null":
            return self.v(f"(case when size({items.sql}) = 0 then false end)", T.BooleanType())
        if inner != "null" and _GROUPS.get(inner, inner) != _GROUPS.get(x.kind, x.kind):
            return self.v(f"(case when {items.sql} is not null and {x.sql} is not null then false end)", T.BooleanType())
        return self.v(f"(case when size({items.sql}) = 0 then false else array_contains({items.sql}, {x.sql}) end)", T.BooleanType())

    def _matches(self, a: tuple, b: tuple) -> V:
        x = self.write(a)
        if x.kind not in ("string", "null"):
            return self.v("cast(null as boolean)", T.BooleanType())
        pattern = quoted(f"^(?:{b[1]})\\z") if b[0] == "value" and isinstance(b[1], str) else f"concat('^(?:', {self.sql(b)}, ')\\\\z')"
        return self.v(f"rlike({x.sql}, {pattern})", T.BooleanType())

    def _startswith(self, a: tuple, b: tuple) -> V:
        return self.v(f"startswith({self.sql(a)}, {self.sql(b)})", T.BooleanType())

    def _endswith(self, a: tuple, b: tuple) -> V:
        return self.v(f"endswith({self.sql(a)}, {self.sql(b)})", T.BooleanType())

    def _contains(self, a: tuple, b: tuple) -> V:
        return self.v(f"contains({self.sql(a)}, {self.sql(b)})", T.BooleanType())

    def _haslabels(self, a: tuple, labels: list) -> V:
        x = self.write(a)

        def one(label: object) -> str:
            name = label if isinstance(label, str) else None
            value = quoted(name) if name else self.sql(label)
            return f"({x.sql}.type = {value})" if x.kind == "rel" else f"array_contains({x.sql}.labels, {value})"

        tests = ["(" + " or ".join(one(label) for label in some) + ")" for some in labels]
        return self.v(f"({' and '.join(tests)})", T.BooleanType())

    # arithmetic

    def _negative(self, a: tuple) -> V:
        if a[0] == "value" and isinstance(a[1], (int, float)) and not isinstance(a[1], bool):
            return self._value(-a[1])
        x = self.write(a)
        return self.v(f"(- {x.sql})", x.type)

    def _arith(self, op: str, a: tuple, b: tuple) -> V:
        x, y = self.write(a), self.write(b)
        p, q = x.kind, y.kind
        if op == "+" and "list" in (p, q) and "null" not in (p, q):
            if p == q:
                return self.v(f"concat({x.sql}, {y.sql})")
            return self.v(f"concat({x.sql}, array({y.sql}))" if p == "list" else f"concat(array({x.sql}), {y.sql})")
        if "null" in (p, q):
            return self.v("null", T.NullType())
        if op == "+" and "string" in (p, q):
            other = q if p == "string" else p
            if other not in ("string", "int", "float"):
                raise TypeError(f"cannot add {p} and {q}")
            return self.v(f"concat(cast({x.sql} as string), cast({y.sql} as string))", T.StringType())
        timed = self._moments(op, x, y)
        if timed:
            return timed
        if p not in NUMBERS or q not in NUMBERS:
            raise TypeError(f"cannot apply {op} to {p} and {q}")
        whole = p == q == "int"
        known = T.LongType() if whole else T.DoubleType()
        if op == "^":
            return self.v(f"pow({x.sql}, {y.sql})", T.DoubleType())
        if op == "/" and whole:
            return self.v(f"({x.sql} div {y.sql})", known)
        if op in ("/", "%") and not whole:
            a1, b1 = (f"cast({z.sql} as double)" for z in (x, y))
            if b[0] == "value" and b[1]:
                return self.v(f"({a1} {op} {b1})", known)
            over = f"case when {a1} > 0 then double('Infinity') when {a1} < 0 then double('-Infinity') when {a1} is not null then double('NaN') end" if op == "/" else f"case when {a1} is not null then double('NaN') end"
            return self.v(f"(case when {b1} = 0D then {over} else {a1} {op} {b1} end)", known)
        if whole and op in "+-*" and not isinstance(x.type, T.LongType) and not isinstance(y.type, T.LongType):
            return self.v(f"(cast({x.sql} as bigint) {op} {y.sql})", known)
        return self.v(f"({x.sql} {op} {y.sql})", known)

    def _moments(self, op: str, x: V, y: V) -> V | None:
        p, q = x.kind, y.kind
        span = T.DayTimeIntervalType()
        if op in "+-" and p == q == "duration":
            return self.v(f"({x.sql} {op} {y.sql})", span)
        if op == "*" and {p, q} <= {"duration", "int", "float"} and "duration" in (p, q):
            return self.v(f"({x.sql} * {y.sql})", span)
        if op in "+-" and q == "duration" or op == "+" and p == "duration":
            at, by = (x, y) if q == "duration" else (y, x)
            if at.kind == "date":
                return self.v(f"cast((cast({at.sql} as timestamp_ntz) {op} {by.sql}) as date)", T.DateType())
            if at.kind in ("local", "instant"):
                return self.v(f"({at.sql} {op} {by.sql})", at.type)
            if at.kind == "zoned":
                return self.v(f"named_struct('ts', {at.sql}.ts {op} {by.sql}, 'tz', {at.sql}.tz)", at.type)
            if at.kind == "time":
                return self.v(f"named_struct('time_of_day', pmod({at.sql}.time_of_day {op} {interval_micros(by.sql)}, 86400000000L))", at.type)
        if op == "-" and p == q and p in ("date", "local", "instant"):
            return self.v(f"cast((cast({x.sql} as timestamp_ntz) - cast({y.sql} as timestamp_ntz)) as interval day to second)", span)
        if op == "-" and p == q == "zoned":
            return self.v(f"cast(({x.sql}.ts - {y.sql}.ts) as interval day to second)", span)
        if op == "-" and p == q == "time":
            return self.v(micros_interval(f"{x.sql}.time_of_day - {y.sql}.time_of_day"), span)
        return None

    # structures

    def _get(self, a: tuple, key: str) -> V:
        x = self.write(a)
        k = x.kind
        if k == "null":
            return self.v("null", T.NullType())
        if k in ("struct", "node", "rel", "path", "graph"):
            if key in x.type.fieldNames():
                return self.v(f"{x.sql}.`{key}`", x.type[key].dataType)
            if k == "graph" or k == "path" and key == "edges":
                return self.v(f"{x.sql}.rels")
            return self.v("null", T.NullType())
        if k == "map":
            return self.v(f"try_element_at({x.sql}, {quoted(key)})", x.type.valueType)
        if k == "variant":
            return self.v(f"try_variant_get({x.sql}, {quoted('$.' + key)}, 'variant')")
        found = self._part(x, key)
        if found is None:
            raise TypeError(f"{k} has no property {key}")
        return found

    def _part(self, x: V, key: str) -> V | None:
        """A part of a point or of a temporal value."""
        k, long = x.kind, T.LongType()
        if k == "point":
            place = {"x": "x", "y": "y", "z": "z", "longitude": "x", "latitude": "y", "height": "z"}.get(key)
            if place:
                if place not in x.type.fieldNames():
                    return None
                if place != key:
                    return self.v(f"(case when {x.sql}.srid in (4326, 4979) then {x.sql}.{place} else raise_error('Use {place} instead of {key} for cartesian point types') end)", T.DoubleType())
                return self.v(f"{x.sql}.{place}", T.DoubleType())
            if key == "srid":
                return self.v(f"cast({x.sql}.srid as bigint)", long)
            if key == "crs":
                return self.v(f"element_at(map(7203, 'cartesian', 9157, 'cartesian-3d', 4326, 'wgs-84', 4979, 'wgs-84-3d'), {x.sql}.srid)", T.StringType())
            return None
        if k == "duration":
            rest = f"({interval_micros(x.sql)} % 86400000000L)"
            per = {"hour": 3600000000, "minute": 60000000, "second": 1000000, "millisecond": 1000, "microsecond": 1}
            if key == "day":
                return self.v(f"cast(extract(DAY FROM {x.sql}) as bigint)", long)
            if key == "nanosecond":
                return self.v(f"({rest} * 1000L)", long)
            return self.v(f"({rest} div {per[key]}L)", long) if key in per else None
        clock = {"hour": ("3600000000", "24"), "minute": ("60000000", "60"), "second": ("1000000", "60"), "millisecond": ("1000", "1000"), "microsecond": ("1", "1000")}
        day = x.sql
        if k == "zoned":
            if key == "timezone":
                return self.v(f"{x.sql}.tz", T.StringType())
            day = f"cast(from_utc_timestamp({x.sql}.ts, {x.sql}.tz) as timestamp_ntz)"
        if k in ("date", "local", "instant", "zoned") and key in ("year", "month", "day"):
            return self.v(f"cast({key}({day}) as bigint)", long)
        if key in clock and k in ("time", "local", "instant", "zoned"):
            micros = f"{x.sql}.time_of_day" if k == "time" else f"(unix_micros(cast({day} as timestamp)) - unix_micros(cast(cast({day} as date) as timestamp)))"
            per, wrap = clock[key]
            return self.v(f"(({micros} div {per}L) % {wrap}L)", long)
        return None

    def _index(self, a: tuple, b: tuple) -> V:
        x = self.write(a)
        if x.kind == "null":
            return self.v("null", T.NullType())
        if x.kind in ("struct", "node", "rel", "point", "date", "local", "duration", "time"):
            if b[0] != "value":
                raise TypeError("the key of a map with typed fields has to be a constant")
            return self._get(a, b[1])
        i = self.write(b)
        if x.kind == "map":
            return self.v(f"try_element_at({x.sql}, {i.sql})", x.type.valueType)
        if x.kind == "string":
            raise TypeError("a string has no items")
        if b[0] == "value" and isinstance(b[1], int):
            return self.v(f"try_element_at({x.sql}, {b[1] + 1 if b[1] >= 0 else b[1]})", x.type.elementType)
        return self.v(f"try_element_at({x.sql}, cast(case when {i.sql} < 0 then {i.sql} else {i.sql} + 1 end as int))", x.type.elementType)

    def _slice(self, a: tuple, low: tuple | None, high: tuple | None) -> V:
        x = self.write(a)
        size = f"size({x.sql})"

        def place(tree: tuple | None, none: str) -> str:
            if tree is None:
                return none
            at = self.sql(tree)
            return f"(case when {at} < 0 then greatest({size} + {at}, 0) else least({at}, {size}) end)"

        begin, end = place(low, "0"), place(high, size)
        return self.v(f"slice({x.sql}, cast({begin} + 1 as int), cast(greatest({end} - {begin}, 0) as int))", x.type)

    def _list(self, parts: list) -> V:
        each = [self.write(p) for p in parts]
        kinds = {_GROUPS.get(x.kind, x.kind) for x in each} - {"null"}
        if len(kinds) > 1:  # values of several types
            return self.v(f"array({', '.join(f'cast({x.sql} as variant)' for x in each)})")
        return self.v(f"array({', '.join(x.sql for x in each)})")

    def _map(self, pairs: list) -> V:
        if not pairs:
            return self.v("cast(map() as map<string,string>)")
        return self.v(f"named_struct({', '.join(f'{quoted(k)}, {self.sql(x)}' for k, x in dict(pairs).items())})")

    def fields_of(self, x: V) -> dict[str, str]:
        """Property -> SQL of an entity or a map with typed fields."""
        hide = {"node": ("id", "labels"), "rel": ("id", "src", "dst", "type")}.get(x.kind, ())
        return {f: f"{x.sql}.`{f}`" for f in x.type.fieldNames() if f not in hide}

    def _projection(self, a: tuple, items: list) -> V:
        x = self.write(a)
        out: dict[str, str] = {}
        if x.kind == "null":
            return x
        for item in items:
            if item[0] == "all":
                out.update(self.fields_of(x) if x.kind != "map" else {})
            elif item[0] == "key":
                out[item[1]] = self._get(a, item[1]).sql
            else:
                out[item[1]] = self.sql(item[2])
        if not out:
            return self.v(f"(case when {x.sql} is not null then cast(map() as map<string,string>) end)")
        return self.v(f"(case when {x.sql} is not null then named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in out.items())}) end)")

    def _case(self, test: tuple | None, branches: list, other: tuple | None) -> V:
        out = "case"
        for when, then in branches:
            out += f" when {self.truth(when) if test is None else self._compare('=', test, when).sql} then {self.sql(then)}"
        if other is not None:
            out += f" else {self.sql(other)}"
        return self.v(f"({out} end)")

    def _comprehension(self, var: str, items: tuple, keep: tuple | None, body: tuple | None) -> V:
        x = self.write(items)
        sql = x.sql
        if x.kind == "null":
            return x
        if keep is not None:
            sql = f"filter({sql}, `{var}` -> {self.within(var, x.sql, keep).sql})"
        if body is not None:
            sql = f"transform({sql}, `{var}` -> {self.within(var, x.sql, body).sql})"
        return self.v(sql)

    def _quantifier(self, kind: str, var: str, items: tuple, keep: tuple) -> V:
        x = self.write(items)
        if x.kind == "null":
            return self.v("cast(null as boolean)", T.BooleanType())
        body = f"`{var}` -> {self.within(var, x.sql, keep).sql}"
        sql = {"all": f"forall({x.sql}, {body})", "any": f"exists({x.sql}, {body})", "none": f"(not exists({x.sql}, {body}))", "single": f"(size(filter({x.sql}, {body})) = 1)"}[kind]
        return self.v(sql, T.BooleanType())

    def _reduce(self, acc: str, start: tuple, var: str, items: tuple, body: tuple) -> V:
        x, s = self.write(items), self.write(start)
        if x.kind == "null":
            return x
        kind = s.type.simpleString()
        for _ in range(2):  # the total may be of a wider type than its start
            self.bound.append((acc, f"array(cast({s.sql} as {kind}))" if kind != "void" else f"array({s.sql})"))
            try:
                step = self.within(var, x.sql, body)
            finally:
                self.bound.pop()
            wider = step.type.simpleString()
            if wider == kind:
                break
            kind = wider
        return self.v(f"aggregate({x.sql}, cast({s.sql} as {kind}), (`{acc}`, `{var}`) -> cast({step.sql} as {kind}))", step.type)

    # calls

    def _call(self, name: str, distinct: bool, args: list) -> V:
        if name in AGGREGATES:
            return self._aggregated(name, distinct, args)
        if name in SCALARS:
            return self.v(SCALARS[name](*[self.sql(a) for a in args]))
        own = getattr(self, f"call_{name.replace('.', '_')}", None)
        given = [self.write(a) for a in args]
        if own is not None:
            return own(*given)
        if name not in FUNCTIONS:
            raise SyntaxError(f"there is no function {name}")
        sqls = [x.sql for x in given]
        return self.v(FUNCTIONS[name].format(*sqls, all=", ".join(sqls), rest=", ".join(sqls[1:])))

    def _aggregated(self, name: str, distinct: bool, args: list) -> V:
        outer, self.aggregate = self.aggregate, False
        given = [self.write(a) for a in args]
        if self.aggregate:
            raise SyntaxError("an aggregate cannot hold another")
        self.aggregate = True
        live = " filter (where `_live`)" if self.scope.hidden else ""
        if name == "count" and not args:
            return self.v(f"count(1){live}", T.LongType())
        x = given[0]
        one = f"{x.sql}.id" if name == "count" and x.kind in ("node", "rel") else x.sql
        d = "distinct " if distinct else ""
        if name == "sum" and x.kind == "string":
            raise TypeError("a string cannot be summed")
        if name == "collect" and len(given) == 2:
            pairs = f"collect_list(struct({x.sql} as k, {given[1].sql} as v)){live}"
            return self.v(f"map_from_entries(filter({pairs}, (e, i) -> not exists(slice({pairs}, i + 2, size({pairs})), f -> f.k = e.k)))")
        if name == "collect" and distinct and x.kind in ("node", "rel"):
            return self.v(f"map_values(aggregate(collect_list({x.sql}){live}, cast(map() as map<bigint,{x.type.simpleString()}>), (m, e) -> case when map_contains_key(m, e.id) then m else map_concat(m, map(e.id, e)) end))")
        if name == "project":
            return self._subgraph(given, live)
        if name == "derive":
            return self._derived(given, args, live)
        if name in ("min", "max", "avg", "sum") and x.kind == "null":
            return self.v({"sum": "coalesce(sum(0L), 0L)"}.get(name, f"cast({name}(cast(null as double)) as double)"))
        return self.v(AGGREGATES[name].format(one, *[g.sql for g in given[1:]], d=d, live=live, collect="collect_set" if distinct else "collect_list"))

    def _subgraph(self, given: list[V], live: str) -> V:
        """PROJECT(path) or PROJECT(nodes, relationships): the union as one graph value."""
        def once(lists: str) -> str:
            return f"transform(filter(transform({lists}, (x, i) -> struct(x, i)), s -> not exists(slice({lists}, 1, s.i), y -> y.id = s.x.id)), s -> s.x)"

        if len(given) == 1:
            whole = [f"flatten(collect_list({given[0].sql}.{part}){live})" for part in ("nodes", "rels")]
        else:
            whole = [f"filter(flatten(collect_list({g.sql}){live}), x -> x is not null)" for g in given]
        nodes, rels = map(once, whole)
        if len(given) == 2:
            rels = f"filter({rels}, r -> (exists({nodes}, n -> n.id = r.src) and exists({nodes}, n -> n.id = r.dst)) or raise_error('a relationship has an end outside the nodes'))"
        return self.v(f"named_struct('nodes', {nodes}, 'edges', {rels})")

    def _derived(self, given: list[V], args: list, live: str) -> V:
        """DERIVE(path, {edgeType}): each path as one virtual relationship between its ends; negative ids."""
        options = {k: x for k, x in (args[1][1] if len(args) > 1 and args[1][0] == "map" else [])}
        kind = self.sql(options.get("edgeType") or options.get("virtualEdgeType") or ("value", "VIRTUAL"))
        p = given[0].sql
        edge = f"named_struct('id', - 1 - abs(xxhash64(element_at({p}.nodes, 1).id, element_at({p}.nodes, -1).id)), 'src', element_at({p}.nodes, 1).id, 'dst', element_at({p}.nodes, -1).id, 'type', {kind})"
        nodes = f"flatten(collect_list(array(element_at({p}.nodes, 1), element_at({p}.nodes, -1))){live})"
        return self.v(f"named_struct('nodes', transform(filter(transform({nodes}, (x, i) -> struct(x, i)), s -> not exists(slice({nodes}, 1, s.i), y -> y.id = s.x.id)), s -> s.x), 'edges', collect_set({edge}){live})")

    def call_size(self, x: V) -> V:
        if x.kind == "string":
            return self.v(f"cast(char_length({x.sql}) as bigint)", T.LongType())
        if x.kind == "path":
            return self.v(f"cast(size({x.sql}.rels) as bigint)", T.LongType())
        if x.kind == "null":
            return x
        if x.kind == "struct":
            return self.v(f"{len(x.type.fields)}L", T.LongType())
        return self.v(f"(case when {x.sql} is not null then size({x.sql}) end)", T.IntegerType())

    call_length = call_size

    def call_nodes(self, x: V) -> V:
        return self.v(f"{x.sql}.nodes")

    def call_relationships(self, x: V) -> V:
        return self.v(f"{x.sql}.rels" if x.kind == "path" else x.sql)

    call_rels = call_relationships

    def call_keys(self, x: V) -> V:
        if x.kind == "map":
            return self.v(f"map_keys({x.sql})")
        if x.kind == "null":
            return x
        own = self.fields_of(x)
        if not own:
            return self.v(f"(case when {x.sql} is not null then cast(array() as array<string>) end)")
        return self.v(f"(case when {x.sql} is not null then array_compact(array({', '.join(f'case when {s} is not null then {quoted(k)} end' for k, s in own.items())})) end)")

    def call_values(self, x: V) -> V:
        if x.kind == "map":
            return self.v(f"map_values({x.sql})")
        if x.kind == "null":
            return x
        own = [self.v(s) for s in self.fields_of(x).values()]
        mixed = len({_GROUPS.get(o.kind, o.kind) for o in own} - {"null"}) > 1
        return self.v(f"(case when {x.sql} is not null then array_compact(array({', '.join(f'cast({o.sql} as variant)' if mixed else o.sql for o in own)})) end)")

    def call_properties(self, x: V) -> V:
        if x.kind in ("map", "struct", "null"):
            return x
        own = self.fields_of(x)
        inner = f"named_struct({', '.join(f'{quoted(k)}, {s}' for k, s in own.items())})" if own else "cast(map() as map<string,string>)"
        return self.v(f"(case when {x.sql} is not null then {inner} end)")

    def call_propertysize(self, x: V, name: V) -> V:
        """Bytes of a property's text form; the store's own size is not defined here."""
        key = name.sql.strip("'")
        own = self.fields_of(x)
        return self.v(f"cast(coalesce(octet_length(cast({own[key]} as string)), 0) as bigint)" if key in own else "0L", T.LongType())

    def call_id(self, x: V) -> V:
        return self.v(f"{x.sql}.id")

    def call_startnode(self, x: V) -> V:
        return self.v(f"{x.sql}.src")

    def call_endnode(self, x: V) -> V:
        return self.v(f"{x.sql}.dst")

    def call_range(self, a: V, b: V, step: V | None = None) -> V:
        s = step.sql if step else "1L"
        lists = "cast(array() as array<bigint>)"
        return self.v(f"(case when ({s} > 0 and {a.sql} > {b.sql}) or ({s} < 0 and {a.sql} < {b.sql}) then {lists} else sequence(cast({a.sql} as bigint), cast({b.sql} as bigint), cast({s} as bigint)) end)")

    def call_substring(self, x: V, at: V, size: V | None = None) -> V:
        return self.v(f"substring({x.sql}, cast({at.sql} + 1 as int)" + (f", cast({size.sql} as int))" if size else ")"), T.StringType())

    def call_tointeger(self, x: V) -> V:
        if x.kind in ("int", "bool"):
            return self.v(f"cast({x.sql} as bigint)", T.LongType())
        if x.kind == "string":
            return self.v(f"coalesce(try_cast({x.sql} as bigint), cast(try_cast({x.sql} as double) as bigint))", T.LongType())
        return self.v(f"cast(try_cast({x.sql} as double) as bigint)", T.LongType())

    def call_tostring(self, x: V) -> V:
        """Numbers, truth values and temporal values in their written forms."""
        s = x.sql
        clock = "concat(lpad(cast({0} div 3600000000L as string), 2, '0'), ':', lpad(cast(({0} div 60000000L) % 60 as string), 2, '0'), ':', lpad(cast(({0} div 1000000L) % 60 as string), 2, '0'), '.', lpad(cast({0} % 1000000L as string), 6, '0'), '000')"
        if x.kind == "time":
            s = clock.format(f"{s}.time_of_day")
        elif x.kind in ("local", "instant"):
            s = f"date_format({s}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000'\")"
        elif x.kind == "zoned":
            s = f"concat(date_format(cast(from_utc_timestamp({s}.ts, {s}.tz) as timestamp_ntz), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000'\"), '[', {s}.tz, ']')"
        elif x.kind == "duration":
            s = f"cast({s} as string)"
        else:
            s = f"cast({s} as string)"
        return self.v(f"(case when {x.sql} is not null then {s} end)", T.StringType())

    def call_valuetype(self, x: V) -> V:
        #: The names of the value types.
        name = {"int": "INTEGER", "float": "FLOAT", "string": "STRING", "bool": "BOOLEAN", "list": "LIST", "map": "MAP", "struct": "MAP", "node": "NODE", "rel": "RELATIONSHIP", "path": "PATH", "date": "DATE", "local": "LOCAL_DATE_TIME", "instant": "LOCAL_DATE_TIME", "time": "LOCAL_TIME", "zoned": "ZONED_DATE_TIME", "duration": "DURATION", "point": "POINT", "graph": "GRAPH", "null": "NULL"}
        return self.v(f"(case when {x.sql} is null then 'NULL' else {quoted(name.get(x.kind, 'STRING'))} end)", T.StringType())

    # moments

    def _part_or(self, x: V, key: str, other: str) -> str:
        return f"coalesce({x.sql}.`{key}`, {other})" if key in x.type.fieldNames() else other

    def _clock_micros(self, x: V) -> str:
        parts = [f"cast({self._part_or(x, k, '0')} as bigint) * {m}L" for k, m in (("hour", 3600000000), ("minute", 60000000), ("second", 1000000), ("millisecond", 1000), ("microsecond", 1))]
        return f"({' + '.join(parts)})"

    def _day_of(self, x: V) -> str:
        return "make_date(" + ", ".join(f"cast({self._part_or(x, k, o)} as int)" for k, o in (("year", "1970"), ("month", "1"), ("day", "1"))) + ")"

    def call_date(self, x: V | None = None) -> V:
        if x is None:
            return self.v("current_date()", T.DateType())
        if x.kind == "struct":
            return self.v(self._day_of(x), T.DateType())
        if x.kind == "zoned":
            return self.v(f"cast(from_utc_timestamp({x.sql}.ts, {x.sql}.tz) as date)", T.DateType())
        if x.kind == "string":
            return self.v(f"(case when {x.sql} rlike '^[0-9]{{8}}$' then to_date({x.sql}, 'yyyyMMdd') else to_date({x.sql}) end)", T.DateType())
        return self.v(f"to_date({x.sql})", T.DateType())

    def call_localtime(self, x: V | None = None) -> V:
        if x is None:
            micros = "(unix_micros(current_timestamp()) - unix_micros(cast(current_date() as timestamp)))"
        elif x.kind == "struct":
            micros = self._clock_micros(x)
        elif x.kind == "time":
            return x
        elif x.kind in ("local", "instant"):
            micros = f"(unix_micros(cast({x.sql} as timestamp)) - unix_micros(cast(cast({x.sql} as date) as timestamp)))"
        else:
            piece = f"replace(replace({x.sql}, 'T', ''), ':', '')"
            whole = f"split_part({piece}, '.', 1)"
            micros = (
                f"(cast(substring({whole}, 1, 2) as bigint) * 3600000000L + cast(coalesce(nullif(substring({whole}, 3, 2), ''), '0') as bigint) * 60000000L"
                f" + cast(coalesce(nullif(substring({whole}, 5, 2), ''), '0') as bigint) * 1000000L + cast(rpad(substring(split_part({piece}, '.', 2), 1, 6), 6, '0') as bigint))"
            )
            return self.v(f"(case when {x.sql} is not null then named_struct('time_of_day', {micros}) end)")
        return self.v(f"named_struct('time_of_day', {micros})")

    def call_localdatetime(self, x: V | None = None) -> V:
        if x is None:
            return self.v("cast(current_timestamp() as timestamp_ntz)", T.TimestampNTZType())
        if x.kind == "struct":
            return self.v(f"(cast({self._day_of(x)} as timestamp_ntz) + {micros_interval(self._clock_micros(x))})", T.TimestampNTZType())
        if x.kind == "zoned":
            return self.v(f"cast(from_utc_timestamp({x.sql}.ts, {x.sql}.tz) as timestamp_ntz)", T.TimestampNTZType())
        return self.v(f"to_timestamp_ntz({x.sql})" if x.kind == "string" else f"cast({x.sql} as timestamp_ntz)", T.TimestampNTZType())

    def call_datetime(self, x: V | None = None) -> V:
        if x is None:
            return self.v("named_struct('ts', current_timestamp(), 'tz', 'Z')")
        if x.kind == "struct":
            tz = self._part_or(x, "timezone", "'Z'")
            local = f"(cast({self._day_of(x)} as timestamp_ntz) + {micros_interval(self._clock_micros(x))})"
        elif x.kind == "zoned":
            return x
        else:
            s = x.sql
            tz = f"coalesce(nullif(regexp_extract({s}, '\\\\[(.+)\\\\]$', 1), ''), nullif(regexp_extract({s}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})(?:\\\\[|$)', 1), ''), 'Z')"
            local = f"to_timestamp_ntz(regexp_replace({s}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?(\\\\[.+\\\\])?$', ''))"
            return self.v(f"(case when {s} is not null then named_struct('ts', to_utc_timestamp(cast({local} as timestamp), {tz}), 'tz', {tz}) end)")
        return self.v(f"named_struct('ts', to_utc_timestamp(cast({local} as timestamp), {tz}), 'tz', {tz})")

    def call_duration(self, x: V) -> V:
        span = T.DayTimeIntervalType()
        if x.kind == "duration":
            return x
        if x.kind == "struct":
            parts = [f"cast(cast({self._part_or(x, k, '0')} as double) * {m}D as bigint)" for k, m in (("day", 86400000000), ("hour", 3600000000), ("minute", 60000000), ("second", 1000000), ("millisecond", 1000), ("microsecond", 1))]
            return self.v(micros_interval(" + ".join(parts)), span)
        s = x.sql

        def part(unit: str, micros: int, timed: bool) -> str:
            lead = "^P[^T]*T.*?" if timed else "^P[^T]*?"
            found = f"nullif(regexp_extract({s}, '{lead}(-?[0-9]+(?:[.][0-9]+)?){unit}', 1), '')"
            return f"cast(cast(coalesce({found}, '0') as decimal(24,6)) * {micros} as bigint)"

        micros = " + ".join([part("D", 86400000000, False), part("H", 3600000000, True), part("M", 60000000, True), part("S", 1000000, True)])
        fits = f"{s} rlike '^P(?=.)(-?[0-9.]+D)?(T(?=.)(-?[0-9.]+H)?(-?[0-9.]+M)?(-?[0-9.]+S)?)?$'"
        return self.v(f"(case when {s} is null then null when not ({fits}) then raise_error(concat('not a duration: ', {s})) else {micros_interval(micros)} end)", span)

    def call_timestamp(self, x: V | None = None) -> V:
        if x is None:
            return self.v("unix_micros(current_timestamp())", T.LongType())
        if x.kind == "duration":
            return self.v(interval_micros(x.sql), T.LongType())
        if x.kind == "time":
            return self.v(f"{x.sql}.time_of_day", T.LongType())
        return self.v(f"unix_micros({x.sql}.ts)" if x.kind == "zoned" else f"unix_micros(cast({x.sql} as timestamp))", T.LongType())

    # points

    def call_point(self, x: V) -> V:
        """7203 and 9157 are the plane and space, 4326 and 4979 the earth without and with heights."""
        if x.kind == "null":
            return x
        names = x.type.fieldNames()
        earth = "longitude" in names
        a, b, c = ("longitude", "latitude", "height") if earth else ("x", "y", "z")
        deep = c in names or "z" in names
        c = c if c in names else "z"
        srid = (4979 if deep else 4326) if earth else (9157 if deep else 7203)
        own = str(srid)
        if "srid" in names:
            own = f"cast({x.sql}.srid as int)"
        elif "crs" in names:
            own = f"element_at(map('cartesian', 7203, 'cartesian-3d', 9157, 'wgs-84', 4326, 'wgs-84-3d', 4979), lower({x.sql}.crs))"
        fields = [("srid", own), ("x", f"cast({x.sql}.`{a}` as double)"), ("y", f"cast({x.sql}.`{b}` as double)")] + ([("z", f"cast({x.sql}.`{c}` as double)")] if deep else [])
        every = " and ".join(f"{s} is not null" for _, s in fields)
        return self.v(f"(case when {every} then named_struct({', '.join(f'{quoted(k)}, {s}' for k, s in fields)}) end)")

    def _as_point(self, x: V) -> V:
        return x if x.kind in ("point", "null") else self.call_point(x)

    def call_point_distance(self, x: V, y: V) -> V:
        x, y = self._as_point(x), self._as_point(y)
        if "null" in (x.kind, y.kind):
            return self.v("cast(null as double)", T.DoubleType())
        p, q = x.sql, y.sql
        deep = "z" in x.type.fieldNames() and "z" in y.type.fieldNames()
        flat = f"pow({p}.x - {q}.x, 2) + pow({p}.y - {q}.y, 2)" + (f" + pow({p}.z - {q}.z, 2)" if deep else "")
        arc = f"(2 * 6371000D * asin(sqrt(pow(sin(radians({q}.y - {p}.y) / 2), 2) + cos(radians({p}.y)) * cos(radians({q}.y)) * pow(sin(radians({q}.x - {p}.x) / 2), 2))))"
        earth = f"sqrt(pow({arc}, 2) + pow({p}.z - {q}.z, 2))" if deep else arc
        return self.v(f"(case when {p}.srid <> {q}.srid then null when {p}.srid in (4326, 4979) then {earth} else sqrt({flat}) end)", T.DoubleType())

    def call_point_withinbbox(self, x: V, low: V, high: V) -> V:
        x, low, high = map(self._as_point, (x, low, high))
        if "null" in (x.kind, low.kind, high.kind):
            return self.v("cast(null as boolean)", T.BooleanType())
        p, a, b = x.sql, low.sql, high.sql
        # on the earth a box may go across the date line
        across = f"(case when {p}.srid in (4326, 4979) and {a}.x > {b}.x then {p}.x >= {a}.x or {p}.x <= {b}.x else {p}.x between {a}.x and {b}.x end)"
        deep = f" and {p}.z between {a}.z and {b}.z" if all("z" in v.type.fieldNames() for v in (x, low, high)) else ""
        return self.v(f"(case when {p}.srid = {a}.srid and {p}.srid = {b}.srid then {across} and {p}.y between {a}.y and {b}.y{deep} end)", T.BooleanType())


def replaced(tree: object, known: list[tuple[tuple, tuple]]) -> object:
    """The tree with every part that equals a known one replaced."""
    for old, new in known:
        if tree == old:
            return new
    if isinstance(tree, tuple):
        return tuple(replaced(p, known) for p in tree)
    if isinstance(tree, list):
        return [replaced(p, known) for p in tree]
    return tree


def unified(types: list[T.StructType]) -> T.StructType:
    """A struct type with every field of the types; fields of several types become doubles or strings."""
    fields: dict[str, T.DataType] = {}
    for t in types:
        for f in t.fields:
            old = fields.setdefault(f.name, f.dataType)
            if old != f.dataType and not isinstance(f.dataType, T.NullType):
                numbers = kind_of(old) in NUMBERS and kind_of(f.dataType) in NUMBERS
                whole = kind_of(old) == kind_of(f.dataType) == "int"
                fields[f.name] = f.dataType if isinstance(old, T.NullType) else T.LongType() if whole else T.DoubleType() if numbers else old if kind_of(old) == kind_of(f.dataType) == "list" else T.StringType()
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def widened(sql: str, have: T.StructType, want: T.StructType) -> str:
    """SQL of a struct with the fields of want."""
    if have == want or have.simpleString() == want.simpleString():
        return sql
    names = set(have.fieldNames())
    each = [f"{quoted(f.name)}, cast({f'{sql}.`{f.name}`' if f.name in names else 'null'} as {f.dataType.simpleString()})" for f in want.fields]
    return f"(case when {sql} is not null then named_struct({', '.join(each)}) end)"


def is_name(text: str) -> bool:
    return re.fullmatch(r"\w+", text) is not None
