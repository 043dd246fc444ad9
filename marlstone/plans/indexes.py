"""Which part of an index answers a condition: text columns pinned by ``=`` from the key's start, then at most one prefix LIKE.

The part is given as a prefix of keys. It holds every row that meets the condition, and maybe others: the condition is applied
to the rows again. Where the prefix says all that the condition says, and the query wants the index's own order, its first
entries are the query's first rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..operators.compat import WORDS
from ..sources.layout import Field
from . import syntax

#: Names of one function.
UPPER = ("UPPER", "UCASE")


@dataclass(frozen=True)
class Reach:
    """Entries whose key begins with ``prefix``; ``ordered``: the first of them in the index's order are those that are wanted."""

    prefix: str
    ordered: bool


def flat(e: tuple, op: str) -> list[tuple]:
    return flat(e[2], op) + flat(e[3], op) if e[0] == "op" and e[1] == op else [e]


def terms(expression: str, fields: Sequence[Field]) -> list[tuple[Field, bool]]:
    """The text columns that the key begins with, and whether each is in upper case."""
    at, out = {f.name.upper(): f for f in fields}, []
    for e in flat(syntax.Parser(expression).expr(), "+"):
        upper = e[0] == "call" and e[1] in UPPER
        f = at.get(e[2][0][2] if upper and e[2][0][0] == "col" else e[2] if e[0] == "col" else "")
        if f is None or f.type != "C":
            break
        out.append((f, upper))
    return out


def _is(e: tuple, f: Field, upper: bool) -> bool:
    if upper:
        return e[0] == "call" and e[1] in UPPER and _is(e[2][0], f, False)
    return e[0] == "col" and e[2] == f.name.upper()


def _number_like(v: str) -> bool:
    return any(c.isdigit() for c in v) or v.strip().lower().lstrip("+-") in WORDS


def reach(where: tuple | None, order: Sequence[tuple[tuple, bool]], limit: int | None, expression: str, fields: Sequence[Field], mode: str) -> Reach | None:
    if where is None:
        return None
    key, wanted = terms(expression, fields), flat(where, "AND")
    prefix, used, pinned, open_ = "", 0, 0, None
    for f, upper in key:
        own = None
        for c in wanted:
            for x, y in ((c[2], c[3]), (c[3], c[2])) if c[0] == "op" and c[1] == "=" else ():
                if _is(x, f, upper) and y[0] == "str" and y[1].isascii() and y[1] and not (mode == "xbase" and _number_like(y[1])):
                    own = own or ("=", y[1])
            if c[0] == "like" and _is(c[1], f, upper) and c[2][0] == "str" and c[2][1].isascii():
                start = c[2][1].split("%")[0].split("_")[0]
                if start and "\\" not in c[2][1]:
                    own = own or ("like", start, c[2][1] == start + "%")
        if own is None:
            break
        prefix += own[1]
        if own[0] == "like" or len(own[1]) < f.length:
            used += own[0] == "like" and own[2]
            open_ = own[0]
            break
        used, pinned = used + 1, pinned + 1
    if not prefix:
        return None
    rest = key[pinned:]
    in_order = bool(order) and len(order) <= len(rest) and all(up and _is(e, *t) for (e, up), t in zip(order, rest))
    return Reach(prefix, limit is not None and used == len(wanted) and open_ != "=" and (in_order or not order))
