"""A forward-only cursor over a query's rows, with typed getters; rows come partition by partition and are not held.

``cursor.next()`` steps on, ``cursor.get(column, kind)`` reads a value of the row by place (from 1) or label. Without a kind it is
the value as it is. A null reads as 0, 0.0 or False where the kind is a number or a truth, else as None; ``was_null`` tells.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import EngineError


class Column(NamedTuple):
    label: str
    type: str
    precision: int
    scale: int


def number(v: object) -> int | float | None:
    if v is None or isinstance(v, (int, float)):
        return v
    s = str(v).strip()
    try:
        return float(s) if "." in s else int(s)
    except ValueError:
        return None


def truth(v: object) -> bool:
    if isinstance(v, (bool, int, float, Decimal)):
        return int(v) != 0
    return str(v).upper() in ("Y", "T", "TRUE") if v is not None else False


def text(v: object) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def exact(v: object, scale: int = 0) -> Decimal | None:
    n = number(v)
    return None if n is None else Decimal(str(n)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)


def day(v: object) -> date | None:
    if isinstance(v, datetime):
        return v.date()
    if v is None or isinstance(v, date):
        return v
    try:
        return date.fromisoformat(str(v))
    except ValueError:
        return None


def moment(v: object) -> datetime | None:
    d = v if isinstance(v, datetime) else day(v)
    return datetime(d.year, d.month, d.day) if d is not None and not isinstance(d, datetime) else d


KINDS: dict[str, Callable[[object], object]] = {
    "string": text, "bool": truth, "int": lambda v: int(number(v) or 0), "float": lambda v: float(number(v) or 0), "decimal": exact, "date": day, "timestamp": moment,
    "bytes": lambda v: v if v is None or isinstance(v, bytes) else str(v).encode(),
}


class Cursor:
    def __init__(self, df: DataFrame, timeout: float | None = None):
        """``timeout``: seconds from the first row asked for, after which no further one is given."""
        self.df, self.was_null, self.timeout = df, False, timeout
        self._row = self._rows = None
        self._until = float("inf")

    @property
    def columns(self) -> list[Column]:
        """Label, type, digits (or characters) and decimals of each column, by the table's fields where it has some."""
        out = []
        for c in self.df.schema:
            if "xbase" in (c.metadata or {}):
                _, size, scale = c.metadata["xbase"].split(",")
            else:
                size, scale = (c.dataType.precision, c.dataType.scale) if isinstance(c.dataType, T.DecimalType) else (0, 0)
            out.append(Column(c.name, c.dataType.simpleString(), int(size), int(scale)))
        return out

    def next(self) -> bool:
        """Steps to the next row; whether there is one."""
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
            self._until = time.monotonic() + self.timeout if self.timeout else self._until
        self._row = next(self._rows, None)
        if time.monotonic() > self._until:
            self._row, self._rows = None, iter(())
            raise EngineError(f"more than {self.timeout} seconds", "HYT00")
        return self._row is not None

    def get(self, column: int | str, kind: str | None = None) -> object:
        if self._row is None:
            raise EngineError("no row: call next() first", "02000")
        if isinstance(column, str):
            at = next((i for i, c in enumerate(self.df.columns) if c.upper() == column.upper()), -1)
        else:
            at = column - 1
        if not 0 <= at < len(self.df.columns):
            raise EngineError(f"Column not found: {column}", "42S22")
        if kind is not None and kind not in KINDS:
            raise EngineError(f"no such kind: {kind}", "22000")
        v = self._row[at]
        self.was_null = v is None
        return v if kind is None else KINDS[kind](v)

    def __iter__(self) -> Iterator:
        while self.next():
            yield self._row
