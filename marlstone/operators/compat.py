"""The historical rules for comparisons, arithmetic, join keys and aggregates, as Column expressions.

Comparisons have two values: null equals null, differs from anything else, and is on neither side of an order. Texts that
look like numbers compare as numbers. Join keys fold case and blanks; a blank key matches nothing.

Most columns have a type that settles what a comparison does, so the general rules, which look at texts, are for texts only:
``compare``, ``join_on``, ``truth`` and ``aggregate`` take the operands' types and give plain comparisons, sums and keys where
types allow, which Spark pushes down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import number, strip, text

NEAR = 1e-10


def _both(a: Column, b: Column) -> Column:
    return number(a).isNotNull() & number(b).isNotNull()


def equal(a: Column, b: Column) -> Column:
    same = F.when(_both(a, b), F.abs(number(a) - number(b)) < NEAR).otherwise(text(a) == text(b))
    return F.when(a.isNull() & b.isNull(), F.lit(True)).when(a.isNull() | b.isNull(), F.lit(False)).otherwise(same)


def before(a: Column, b: Column, strict: bool = True) -> Column:
    x, y, s, t = number(a), number(b), text(a), text(b)
    low = F.when(_both(a, b), x < y if strict else x <= y).otherwise(s < t if strict else s <= t)
    return F.coalesce(low, F.lit(False))


def compare(op: str, a: Column, b: Column, kinds: tuple[T.DataType | None, T.DataType | None] = (None, None), values: tuple = (None, None)) -> Column:
    """``kinds``: types of the operands, None if not known; ``values``: of literals, else None."""
    if op in ("<>", "!="):
        return ~compare("=", a, b, kinds, values)
    if all(isinstance(k, T.NumericType) for k in kinds):
        return _numbers(op, a, b, kinds, values)
    if all(isinstance(k, T.StringType) for k in kinds) and any(isinstance(v, str) and not any(c.isdigit() for c in v) and v.strip().lower().lstrip("+-") not in WORDS for v in values):
        return _plain(op, a, b, values)  # one of them is no number
    if all(isinstance(k, T.DateType) for k in kinds):
        return _plain(op, a, b, values)
    if op == "=":
        return equal(a, b)
    return before(a, b, op == "<") if op in ("<", "<=") else before(b, a, op == ">")


#: Words that are numbers.
WORDS = frozenset(("nan", "inf", "infinity"))


def _plain(op: str, a: Column, b: Column, values: tuple) -> Column:
    if op == "=" and all(v is None for v in values):
        return a.eqNullSafe(b)
    out = {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    for c, v in ((a, values[0]), (b, values[1])):
        if v is None:
            out = c.isNotNull() & out
    return out


def _numbers(op: str, a: Column, b: Column, kinds: tuple, values: tuple) -> Column:
    whole = [isinstance(k, T.IntegralType) or isinstance(v, int) for k, v in zip(kinds, values)]
    if op != "=" or all(whole):
        return _plain(op, a, b, values)
    if values[0] is not None or values[1] is not None:  # a range, for the scan
        c, v = (b, values[0]) if values[0] is not None else (a, values[1])
        if any(whole) and values[0] is None and values[1] is not None and float(v).is_integer() and isinstance(kinds[0], T.IntegralType):
            return _plain("=", c, F.lit(int(v)), (None, int(v)))
        return c.isNotNull() & (c > F.lit(float(v) - NEAR)) & (c < F.lit(float(v) + NEAR))
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(F.abs(a.cast("double") - b.cast("double")) < NEAR, F.lit(False)))


def like(a: Column, pattern: Column) -> Column:
    """Case-sensitive, % and _ only; a null operand does not match."""
    escaped = F.replace(text(pattern), F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.call_function("like", text(a), escaped), F.lit(False))


def truth(c: Column, kind: T.DataType | None = None) -> Column:
    """A condition's value where it is none: null and blank text are false, numbers but 0 true."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return c.isNotNull() & (c != 0)
    n = number(c)
    return F.coalesce(F.when(text(c).isin("true", "false"), text(c) == "true").when(n.isNotNull(), n != 0).otherwise(strip(c) != ""), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(number(a), number(b))


def join_key(c: Column) -> Column:
    """One text for all keys that match: numbers by value, other texts trimmed and in upper case; null if blank."""
    t = strip(c)
    return F.coalesce(number(t).cast("string"), F.upper(F.when(t != "", t)))


def join_on(a: Column, b: Column, kinds: tuple[T.DataType | None, T.DataType | None]) -> Column:
    """Equal keys: numbers by value, where both are numbers without a detour over texts."""
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return a == b
    if all(isinstance(k, T.NumericType) for k in kinds):
        return a.cast("double") == b.cast("double")
    return join_key(a) == join_key(b)


def present(c: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(strip(c) != "", c)


def aggregate(name: str, c: Column, distinct: bool, kind: T.DataType) -> Column:
    """COUNT, SUM, AVG, MIN and MAX of what is not blank; SUM and AVG of integers are integers."""
    if not isinstance(kind, T.StringType) and (name in ("COUNT", "MIN", "MAX") or isinstance(kind, T.NumericType)):
        return _plain_aggregate(name, c, distinct, isinstance(kind, T.IntegralType))
    v = F.nullif(strip(c), F.lit("")) if distinct else present(c)
    if name == "COUNT":
        return F.count_distinct(v) if distinct else F.count(v)
    if name in ("MIN", "MAX"):
        return F.min(present(c)) if name == "MIN" else F.max(present(c))
    total = F.sum_distinct(number(v)) if distinct else F.sum(number(v))
    return total if name == "SUM" else F.try_divide(total, F.count_distinct(v) if distinct else F.count(v))


def _plain_aggregate(name: str, c: Column, distinct: bool, whole: bool) -> Column:
    """Of a column that cannot be blank."""
    if name in ("MIN", "MAX"):
        return F.min(c) if name == "MIN" else F.max(c)
    n = F.count_distinct(c) if distinct else F.count(c)
    if name == "COUNT":
        return n
    v = c.cast("bigint" if whole else "double")
    total = F.sum_distinct(v) if distinct else F.sum(v)
    if name == "SUM":
        return total
    return F.call_function("try_divide", total - total % n, n).cast("bigint") if whole else F.try_divide(total, n)
