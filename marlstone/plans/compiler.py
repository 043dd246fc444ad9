"""Parsed queries to DataFrames. Everything becomes Column expressions, joins and aggregates that Catalyst plans.

``mode`` "ansi" has Spark's semantics; "xbase" the historical ones (see ``operators.compat``): two-valued comparisons, folded
join keys, blanks that do not count, integer averages, first values for ungrouped items, groups in ascending order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..operators import compat
from .syntax import AGGREGATES

HIDDEN = ("_recno", "_deleted")


class CompileError(ValueError):
    sqlstate = "42000"


def parts(e: tuple) -> list[tuple]:
    """The expressions directly within an expression."""
    out, todo = [], list(e[1:])
    while todo:
        x = todo.pop(0)
        if isinstance(x, tuple):
            if x and isinstance(x[0], str):
                out.append(x)
            else:
                todo = [*x, *todo]
    return out


def walk(e: tuple) -> list[tuple]:
    """An expression and all within it."""
    return [e, *(y for x in parts(e) for y in walk(x))]


def aggregates(e: tuple | None) -> list[tuple]:
    """The outermost aggregate calls of an expression."""
    if e is None:
        return []
    if e[0] == "call" and e[1] in AGGREGATES:
        return [e]
    return [y for x in parts(e) for y in aggregates(x)]


def names(e) -> set[tuple]:
    return {x for x in walk(e) if x[0] in ("col", "star", "recno")} if e is not None else set()


def plain(column: str) -> str:
    """A scan's column under the name that the table has for it."""
    return column.split("_", 1)[1]


@dataclass
class Scope:
    """Which DataFrame column a name means; ``done`` maps expressions that are columns already."""

    df: DataFrame
    columns: list[tuple[str, str, str]]  # alias, name, column of df
    mode: str = "ansi"
    params: Sequence = ()
    done: dict = field(default_factory=dict)

    def find(self, qualifier: str | None, name: str) -> str:
        hits = [c for a, n, c in self.columns if n == name and (qualifier is None or a == qualifier)]
        if not hits:
            raise CompileError(f"Column not found: {qualifier + '.' if qualifier else ''}{name}")
        if len(hits) > 1:
            raise CompileError(f"Column is ambiguous: {name}")
        return hits[0]

    def star(self, qualifier: str | None) -> list[tuple[str, str]]:
        """(label, column) in order; names that several tables have get their table's name in front."""
        own = [(a, n, c) for a, n, c in self.columns if (qualifier is None or a == qualifier) and n.lower() not in HIDDEN]
        if not own:
            raise CompileError(f"Table not found: {qualifier}")
        count = [n for _, n, _ in own]
        return [(plain(c) if count.count(n) == 1 else f"{a}_{plain(c)}", c) for a, n, c in own]

    def kind(self, e) -> T.DataType | None:
        """The type of a column or a literal, and of arithmetic; None if it takes an analysis to know."""
        if e[0] == "col":
            return self.df.schema[self.find(e[1], e[2])].dataType if self.columns else None
        if e[0] in ("num", "neg"):
            return T.LongType() if e[0] == "num" and isinstance(e[1], int) else T.DoubleType() if e[0] == "num" or isinstance(self.kind(e[1]), T.NumericType) else None
        if e[0] == "recno":
            return T.LongType()
        if e[0] == "op" and e[1] in "+-*/" and all(isinstance(self.kind(x), T.NumericType) for x in e[2:]):
            return T.DoubleType()
        return {"str": T.StringType(), "date": T.DateType(), "bool": T.BooleanType()}.get(e[0])

    def value(self, e) -> object:
        """Of a literal."""
        if e[0] == "neg" and e[1][0] == "num":
            return -e[1][1]
        return e[1] if e[0] in ("num", "str", "date") else None

    def condition(self, e) -> Column:
        if self.mode != "xbase":
            return self(e)
        if e[0] in ("not", "like", "in", "between", "null?", "bool") or (e[0] == "op" and e[1] not in "+-*/"):
            return self(e)
        return compat.truth(self(e), self.kind(e))

    def __call__(self, e) -> Column:
        if e in self.done:
            return self.done[e]
        return getattr(self, f"_{e[0].rstrip('?')}")(*e[1:])

    def _num(self, v) -> Column:
        return F.lit(v)

    _str = _date = _bool = _num

    def _null(self, *rest) -> Column:
        if not rest:
            return F.lit(None)
        return self(rest[0]).isNull()

    def _param(self, i) -> Column:
        if i >= len(self.params):
            raise CompileError(f"Parameter {i + 1} is not set")
        return F.lit(self.params[i])

    def _col(self, qualifier, name) -> Column:
        return F.col(f"`{self.find(qualifier, name)}`")

    def _recno(self) -> Column:
        return F.col(f"`{self.find(None, '_RECNO')}`") if len({a for a, _, _ in self.columns}) == 1 else F.col(f"`{self.find(self.columns[0][0], '_RECNO')}`")

    def _star(self, *_) -> Column:
        raise CompileError("* is not an expression")

    def _not(self, a) -> Column:
        return ~self.condition(a)

    def _neg(self, a) -> Column:
        return -self(a)

    def _op(self, op, a, b) -> Column:
        if op in ("AND", "OR"):
            x, y = self.condition(a), self.condition(b)
            return x & y if op == "AND" else x | y
        x, y = self(a), self(b)
        if op in "+-*/":
            return self._arithmetic(op, a, b, x, y)
        if self.mode == "xbase":
            return compat.compare(op, x, y, (self.kind(a), self.kind(b)), (self.value(a), self.value(b)))
        if "date" in (a[0], b[0]):
            x, y = x.cast("date"), y.cast("date")
        return {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}.get(op) if op not in ("<>", "!=") else x != y

    def _texts(self, *es) -> bool:
        return any(e[0] == "str" or isinstance(self.kind(e), T.StringType) or (e[0] == "call" and e[1] in TEXTS) or (e[0] == "op" and e[1] == "+" and self._texts(*e[2:])) for e in es)

    def _arithmetic(self, op, a, b, x, y) -> Column:
        if op == "/":
            return compat.divide(x, y) if self.mode == "xbase" else F.try_divide(x.cast("double"), y.cast("double"))
        if op == "+" and self._texts(a, b):
            return F.concat(scalar.text(x), scalar.text(y))
        return {"+": x + y, "-": x - y, "*": x * y}[op]

    def _like(self, a, b) -> Column:
        return compat.like(self(a), self(b)) if self.mode == "xbase" else F.call_function("like", scalar.text(self(a)), F.replace(self(b), F.lit("\\"), F.lit("\\\\")))

    def _between(self, a, lo, hi) -> Column:
        return self(("op", ">=", a, lo)) & self(("op", "<=", a, hi))

    def _in(self, a, items) -> Column:
        kind, values = self.kind(a), [self.value(x) for x in items]
        if all(v is not None for v in values) and (self.mode != "xbase" and len({type(v) for v in values}) == 1 and not any(x[0] == "date" for x in items) or isinstance(kind, T.IntegralType) and all(isinstance(v, int) for v in values)):
            c = self(a)  # one set, however long
            return c.isNotNull() & c.isin(values) if self.mode == "xbase" else c.isin(values)
        out = None
        for x in items:
            same = self(("op", "=", a, x))
            out = same if out is None else out | same
        return out

    def _case(self, operand, whens, default) -> Column:
        out = None
        for when, then in whens:
            hit = self.condition(when) if operand is None else self(("op", "=", operand, when))
            out = F.when(hit, self(then)) if out is None else out.when(hit, self(then))
        return out.otherwise(self(default)) if default is not None else out

    def _cast(self, a, kind) -> Column:
        return scalar.cast(self(a), kind, self.mode)

    def _extract(self, part, a) -> Column:
        if part not in scalar.EXTRACTS:
            raise CompileError(f"EXTRACT of {part}")
        return scalar.call(scalar.EXTRACTS[part], self(a), mode=self.mode)

    def _call(self, name, args, distinct) -> Column:
        if name in AGGREGATES:
            return self.aggregate(name, args, distinct)
        if name == "IIF":
            return F.when(self.condition(args[0]), self(args[1])).otherwise(self(args[2]))
        try:
            return scalar.call(name, *[self(a) for a in args], mode=self.mode)
        except TypeError as e:
            raise CompileError(f"arguments of {name}: {e}") from e

    def aggregate(self, name, args, distinct) -> Column:
        if not args or args[0][0] == "star":
            if name != "COUNT":
                raise CompileError(f"{name}(*)")
            return F.count(F.lit(1))
        c = self(args[0])
        if self.mode == "xbase":
            kind = self.df.select(c.alias("c")).schema["c"].dataType
            return compat.aggregate(name, c, distinct, kind)
        plain = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
        once = {"COUNT": F.count_distinct, "SUM": F.sum_distinct, "AVG": lambda c: F.call_function("try_divide", F.sum_distinct(c).cast("double"), F.count_distinct(c))}
        return once.get(name, plain[name])(c) if distinct else plain[name](c)


#: Functions whose value is text, for ``+``.
TEXTS = frozenset("UPPER UCASE LOWER LCASE TRIM ALLTRIM LTRIM RTRIM LEFT RIGHT SUBSTR SUBSTRING MID CONCAT REPLACE LPAD RPAD REPEAT SPACE REVERSE CHR CHAR INITCAP STR MONTHNAME DAYNAME".split())


def used(query: dict) -> list:
    out = [e for e, _ in query["items"]] + [query["where"], query["having"], *query["group"]] + [e for e, _ in query["order"]] + [on for _, _, on in query["joins"]]
    return [e for e in out if e is not None]


def needed(query: dict, alias: str) -> set[str] | None:
    """Upper-case names that the query may want of a table; None: all. The star of COUNT(*) wants none."""
    if any(e[0] == "star" and e[1] in (None, alias) for e, _ in query["items"]):
        return None
    every = set().union(*[names(e) for e in used(query)], set())
    return {x[2] for x in every if x[0] == "col" and x[1] in (None, alias)} | {"_RECNO" for x in every if x[0] == "recno"}


def source(query: dict, table: Callable[[str, set[str] | None], DataFrame], mode: str, params: Sequence = ()) -> Scope:
    """FROM and its joins."""

    def scan(name: str, alias: str, i: int) -> tuple[DataFrame, list[tuple[str, str, str]]]:
        df = table(name, needed(query, alias))
        cols = [(alias, c.upper(), f"t{i}_{c}") for c in df.columns]
        return df.select(*[F.col(f"`{c}`").alias(f"t{i}_{c}") for c in df.columns]), cols

    df, cols = scan(*query["from"], 0)
    for i, (kind, (name, alias), on) in enumerate(query["joins"], 1):
        right, more = scan(name, alias, i)
        if mode == "xbase":
            cond = _folded(on, Scope(df, cols, mode, params), Scope(right, more, mode, params))
        else:
            cond = Scope(df.join(right, F.lit(False)), cols + more, mode, params)(on)
        df, cols = df.join(right, cond, kind), cols + more
    return Scope(df, cols, mode, params)


def _folded(on, left: Scope, right: Scope) -> Column:
    """ON as equalities of folded keys; other conditions are not of this mode."""
    if on[0] == "op" and on[1] == "AND":
        return _folded(on[2], left, right) & _folded(on[3], left, right)
    if on[0] != "op" or on[1] != "=" or on[2][0] != "col" or on[3][0] != "col":
        raise CompileError("ON takes equalities of columns joined by AND")
    for a, b in ((on[2], on[3]), (on[3], on[2])):
        try:
            return compat.join_on(left(a), right(b), (left.kind(a), right.kind(b)))
        except CompileError:
            continue
    raise CompileError("ON must name a column of either side")


def select(query: dict, table: Callable[[str, set[str] | None], DataFrame], mode: str = "ansi", params: Sequence = (), max_rows: int | None = None) -> DataFrame:
    s = source(query, table, mode, params)
    if query["where"] is not None:
        s.df = s.df.filter(s.condition(query["where"]))
    items: list[tuple[str, tuple]] = []  # label, expression
    grouped = bool(query["group"]) or any(aggregates(e) for e, _ in query["items"]) or bool(aggregates(query["having"]))
    for e, label in query["items"]:
        if e[0] == "star":
            if grouped:
                raise CompileError("SELECT * with aggregates")
            items += [(n, ("col", *next((a, m) for a, m, x in s.columns if x == c))) for n, c in s.star(e[1])]
        else:
            items.append((label or (plain(s.find(e[1], e[2])) if e[0] == "col" else _label(e, len(items))), e))
    labels = {label.upper(): e for label, e in reversed(items)}
    order = []
    for e, up in query["order"]:
        if e[0] == "num" and isinstance(e[1], int):
            if not 1 <= e[1] <= len(items):
                raise CompileError(f"ORDER BY {e[1]}: there are {len(items)} items")
            e = items[e[1] - 1][1]
        elif e[0] == "col" and e[1] is None and e[2] in labels:
            e = labels[e[2]]
        order.append((e, up))
    if grouped:
        order = _grouped(query, s, items, labels, order)
    keys = [s(e) for e, _ in order]
    n = min([x for x in (query["limit"], max_rows) if x is not None], default=None)
    out = s.df
    if query["distinct"]:
        labelled = out.select(*[s(e).alias(label) for label, e in items], *[k.alias(f"_o{i}") for i, k in enumerate(keys)]).distinct()
        out = labelled.orderBy(*[F.col(f"_o{i}").asc_nulls_first() if up else F.col(f"_o{i}").desc_nulls_last() for i, (_, up) in enumerate(order)]) if order else labelled
        out = out.limit(n) if n is not None else out
        return out.select(*[F.col(f"`{label}`") for label, _ in items])
    if order:
        ties = [F.col(f"`{c}`") for _, n_, c in s.columns if n_ == "_RECNO"]  # equals stay in the order of their records
        out = out.orderBy(*[k.asc_nulls_first() if up else k.desc_nulls_last() for k, (_, up) in zip(keys, order)], *ties)
    if n is not None:
        out = out.limit(n)
    return out.select(*[(s(e).cast("string") if e == ("null",) else s(e)).alias(label) for label, e in items])


def _label(e, i: int) -> str:
    if e[0] == "recno":
        return "RECNO"
    if e[0] == "call" and e[1] in AGGREGATES:
        return f"{e[1]}_{i}"
    return f"EXPR{i}"


def _grouped(query: dict, s: Scope, items, labels, order):
    """Aggregates ``s.df``; afterwards ``s`` knows group keys and aggregates as columns."""
    having = query["having"]
    group = []
    for e in query["group"]:
        if e[0] == "num" and isinstance(e[1], int) and 1 <= e[1] <= len(items):
            e = items[e[1] - 1][1]
        elif e[0] == "col" and e[1] is None and e[2] in labels and not any(n == e[2] for _, n, _ in s.columns):
            e = labels[e[2]]
        group.append(e)

    def named(e):
        """HAVING may use labels."""
        if not isinstance(e, tuple):
            return e
        if e and e[0] == "col" and e[1] is None and e[2] in labels and not any(n == e[2] for _, n, _ in s.columns):
            return labels[e[2]]
        return tuple(named(x) for x in e)

    having = named(having) if having is not None else None
    calls = list(dict.fromkeys(x for e in [e for _, e in items] + [e for e, _ in order] + ([having] if having else []) for x in aggregates(e)))
    loose = []
    if s.mode == "xbase":  # ungrouped columns show the group's first value
        for _, e in items:
            loose += [x for x in walk(e) if x[0] == "col" and x not in group and not any(x in walk(c) for c in calls) and not any(x in walk(g) and g in walk(e) for g in group)]
    loose = list(dict.fromkeys(loose))
    keys = [(f"k{i}", s(g)) for i, g in enumerate(group)]
    by = [(compat.strip(c) if s.mode == "xbase" and s._texts(g) else c).alias(k) for (k, c), g in zip(keys, group)]
    places = [F.col(f"`{c}`") for _, n, c in s.columns if n == "_RECNO"]
    first = (lambda c: F.min_by(F.struct(c.alias("v")), F.struct(*places))["v"]) if places else F.first  # of the first record
    aggs = [s(c).alias(f"a{i}") for i, c in enumerate(calls)] + [first(s(c)).alias(f"f{i}") for i, c in enumerate(loose)]
    if s.mode == "xbase":
        shown = first if places else lambda c: F.array_min(F.collect_set(c))  # of the few ways to write a key; a table without places has no first
        aggs += [shown(c).alias(f"s{k}") for (k, c), g in zip(keys, group) if s._texts(g)]
    df = s.df.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("a_")])) if group else s.df.agg(*(aggs or [F.count(F.lit(1)).alias("a_")]))
    shown = {k: f"s{k}" if f"s{k}" in df.columns else k for k, _ in keys}
    s.done = {g: F.col(shown[k]) for (k, _), g in zip(keys, group)} | {c: F.col(f"a{i}") for i, c in enumerate(calls)} | {c: F.col(f"f{i}") for i, c in enumerate(loose)}
    for (k, _), g in zip(keys, group):  # a column may be named with or without its table
        if g[0] == "col":
            s.done |= {("col", a, n): F.col(shown[k]) for a, n, c in s.columns if c == s.find(g[1], g[2])} | {("col", None, g[2]): F.col(shown[k])}
    s.df, s.columns = df, []
    if having is not None:
        s.df = df.filter(s.condition(having))
    if s.mode == "xbase" and not order and group:
        return [(g, True) for g in group]
    return order
