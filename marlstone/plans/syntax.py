"""The dialect's grammar: text to plain tuples.

Expressions: ("num", v), ("str", s), ("null",), ("col", qualifier or None, name), ("recno",), ("star", qualifier or None),
("call", NAME, args, distinct), ("op", op, a, b), ("not", a), ("neg", a), ("like", a, b), ("in", a, items),
("between", a, lo, hi), ("null?", a), ("case", operand or None, ((when, then), ...), default or None), ("cast", a, TYPE),
("param", i). Statements are dicts.
"""

from __future__ import annotations

import re
from datetime import date

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
BARE = ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP")
CLAUSES = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT ON JOIN INNER LEFT RIGHT FULL OUTER AS AND OR NOT SET VALUES ASC DESC BETWEEN IN LIKE IS THEN WHEN ELSE END BY TOP DISTINCT".split())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<date>\#[^#\n]*\#)"""
    r"""|(?P<quoted>`[^`]*`|\[[^\]]*\])|(?P<word>[^\W\d]\w*)|(?P<op><>|!=|<=|>=|[=<>+\-*/(),.;?])""",
    re.S,
)


class SyntaxProblem(ValueError):
    sqlstate = "42000"


def tokens(sql: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SyntaxProblem(f"unexpected {sql[at]!r} at {at}")
        at = m.end()
        kind, s = m.lastgroup, m[0]
        if kind == "num":
            out.append(("num", float(s) if re.search("[.eE]", s) else int(s)))
        elif kind == "str":
            body = s[1:-1].replace("''", "'") if s[0] == "'" else s[1:-1]
            out.append(("str", re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), body, flags=re.S)))
        elif kind == "date":
            out.append(("date", _date(s[1:-1])))
        elif kind == "quoted":
            out.append(("name", s[1:-1]))
        elif kind:
            out.append((kind, s))
    return [*out, ("end", "")]


def _date(s: str) -> str:
    if m := re.fullmatch(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*", s):
        y, mo, d = map(int, m.groups())
    elif m := re.fullmatch(r"\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*", s):
        mo, d, y = map(int, m.groups())
    else:
        raise SyntaxProblem(f"no date: #{s}#")
    try:
        return date(y, mo, d).isoformat()
    except ValueError as e:
        raise SyntaxProblem(f"no date: #{s}#") from e


class Parser:
    def __init__(self, sql: str):
        self.toks, self.i, self.params = tokens(sql), 0, 0

    # tokens
    def word(self) -> str:
        kind, v = self.toks[self.i]
        return v.upper() if kind == "word" else ""

    def op(self) -> object:
        kind, v = self.toks[self.i]
        return v if kind == "op" else None

    def take(self, *words: str) -> bool:
        """Takes a run of words or one operator, if it is there."""
        at = self.i
        for w in words:
            kind, v = self.toks[self.i]
            if (kind == "word" and v.upper() == w) or (kind == "op" and v == w):
                self.i += 1
            else:
                self.i = at
                return False
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxProblem(f"expected {' '.join(words)} before {self.toks[self.i][1]!r}")

    def name(self) -> str:
        kind, v = self.toks[self.i]
        if kind not in ("word", "name", "str"):
            raise SyntaxProblem(f"expected a name before {v!r}")
        self.i += 1
        return str(v)

    def integer(self) -> int:
        kind, v = self.toks[self.i]
        if kind != "num" or not isinstance(v, int):
            raise SyntaxProblem(f"expected a whole number before {v!r}")
        self.i += 1
        return v

    def end(self) -> None:
        self.take(";")
        if self.toks[self.i][0] != "end":
            raise SyntaxProblem(f"unexpected {self.toks[self.i][1]!r}")

    def several(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # expressions
    def expr(self):
        a = self._and()
        while self.take("OR"):
            a = ("op", "OR", a, self._and())
        return a

    def _and(self):
        a = self._not()
        while self.take("AND"):
            a = ("op", "AND", a, self._not())
        return a

    def _not(self):
        return ("not", self._not()) if self.take("NOT") else self._predicate()

    def _predicate(self):
        a = self._sum()
        while True:
            if self.op() in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.op()
                self.i += 1
                a = ("op", op, a, self._sum())
            elif self.take("IS"):
                negated = self.take("NOT")
                self.need("NULL")
                a = ("not", ("null?", a)) if negated else ("null?", a)
            else:
                negated = self.word() == "NOT" and self.toks[self.i + 1][0] == "word" and self.toks[self.i + 1][1].upper() in ("BETWEEN", "IN", "LIKE") and self.take("NOT")
                if self.take("BETWEEN"):
                    lo = self._sum()
                    self.need("AND")
                    b = ("between", a, lo, self._sum())
                elif self.take("IN"):
                    self.need("(")
                    b = ("in", a, tuple(self.several(self.expr)))
                    self.need(")")
                elif self.take("LIKE"):
                    b = ("like", a, self._sum())
                else:
                    return a
                a = ("not", b) if negated else b

    def _sum(self):
        a = self._product()
        while self.op() in ("+", "-"):
            op = self.op()
            self.i += 1
            a = ("op", op, a, self._product())
        return a

    def _product(self):
        a = self._factor()
        while self.op() in ("*", "/"):
            op = self.op()
            self.i += 1
            a = ("op", op, a, self._factor())
        return a

    def _factor(self):
        kind, v = self.toks[self.i]
        if self.take("("):
            a = self.expr()
            self.need(")")
            return a
        if self.take("-"):
            a = self._factor()
            return ("num", -a[1]) if a[0] == "num" else ("neg", a)
        if self.take("+"):
            return self._factor()
        if self.take("?"):
            self.params += 1
            return ("param", self.params - 1)
        if kind in ("num", "str", "date"):
            self.i += 1
            return (kind, v)
        if kind == "name" or kind == "word":
            return self._named()
        raise SyntaxProblem(f"unexpected {v!r}")

    def _named(self):
        quoted = self.toks[self.i][0] == "name"
        word = self.name()
        up = word.upper()
        if quoted or self.op() == ".":
            if self.take("."):
                return ("star", word.upper()) if self.take("*") else ("col", word.upper(), self.name().upper())
            return ("col", None, word.upper())
        if up == "NULL":
            return ("null",)
        if up in ("TRUE", "FALSE"):
            return ("bool", up == "TRUE")
        if up == "CASE":
            return self._case()
        if up == "RECNO":
            if self.take("("):
                self.need(")")
            return ("recno",)
        if up in BARE and self.op() != "(":
            return ("call", up, (), False)
        if not self.take("("):
            if up in CLAUSES:
                raise SyntaxProblem(f"unexpected {word}")
            return ("col", None, up)
        if up == "CAST":
            a = self.expr()
            self.need("AS")
            kind = self._type()[0]
            self.need(")")
            return ("cast", a, kind)
        if up == "EXTRACT":
            field = self.name().upper()
            self.need("FROM")
            a = self.expr()
            self.need(")")
            return ("extract", field, a)
        distinct = up in AGGREGATES and self.take("DISTINCT")
        if self.take("*"):
            args = (("star", None),)
        else:
            args = () if self.op() == ")" else tuple(self.several(self.expr))
        self.need(")")
        return ("call", up, args, distinct)

    def _case(self):
        operand = None if self.word() == "WHEN" else self.expr()
        whens = []
        while self.take("WHEN"):
            when = self.expr()
            self.need("THEN")
            whens.append((when, self.expr()))
        default = self.expr() if self.take("ELSE") else None
        self.need("END")
        if not whens:
            raise SyntaxProblem("CASE without WHEN")
        return ("case", operand, tuple(whens), default)

    def _type(self) -> tuple[str, list[int]]:
        kind, sizes = self.name().upper(), []
        if self.take("("):
            sizes = self.several(self.integer)
            self.need(")")
        return kind, sizes

    # statements
    def select(self) -> dict:
        self.need("SELECT")
        q = {"distinct": False, "limit": None, "where": None, "group": [], "having": None, "order": []}
        if self.take("TOP"):
            q["limit"] = self.integer()
            self.take("PERCENT")
        q["distinct"] = self.take("DISTINCT")
        q["items"] = self.several(self._item)
        self.need("FROM")
        q["from"], q["joins"] = self._tables()
        q["where"] = self.expr() if self.take("WHERE") else None
        q["group"] = self.several(self.expr) if self.take("GROUP", "BY") else []
        q["having"] = self.expr() if self.take("HAVING") else None
        q["order"] = self.several(self._ordered) if self.take("ORDER", "BY") else []
        if self.take("LIMIT"):
            q["limit"] = self.integer()
        self.end()
        return q

    def _item(self):
        if self.take("*"):
            return ("star", None), None
        e = self.expr()
        if self.take("AS"):
            return e, self.name()
        kind, v = self.toks[self.i]
        if kind == "name" or (kind == "word" and v.upper() not in CLAUSES):
            return e, self.name()
        return e, None

    def _ordered(self):
        e = self.expr()
        if self.take("DESC"):
            return e, False
        self.take("ASC")
        return e, True

    def _table(self) -> tuple[str, str]:
        name = self.name()
        if self.take("AS"):
            return name, self.name().upper()
        kind, v = self.toks[self.i]
        if kind == "name" or (kind == "word" and v.upper() not in CLAUSES):
            return name, self.name().upper()
        return name, name.upper()

    def _tables(self):
        """The first table, and (kind, table, condition) of each joined one; parentheses only group."""
        if self.take("("):
            first, joins = self._tables()
            self.need(")")
        else:
            first, joins = self._table(), []
        while True:
            kind = "inner"
            if self.take("INNER"):
                pass
            elif self.word() in ("LEFT", "RIGHT", "FULL"):
                kind = self.name().lower()
                self.take("OUTER")
            elif self.word() != "JOIN":
                return first, joins
            self.need("JOIN")
            if self.take("("):
                table, more = self._tables()
                self.need(")")
            else:
                table, more = self._table(), []
            self.need("ON")
            joins = [*joins, (kind, table, self.expr()), *more]

    def statement(self) -> dict:
        if self.word() == "SELECT":
            return {"do": "select", "query": self.select()}
        if self.take("INSERT", "INTO"):
            table, cols = self.name(), None
            if self.take("("):
                cols = [c.upper() for c in self.several(self.name)]
                self.need(")")
            self.need("VALUES")
            out = {"do": "insert", "table": table, "columns": cols, "rows": self.several(self._row)}
        elif self.take("UPDATE"):
            first, joins = self._tables()
            self.need("SET")
            sets = self.several(self._set)
            out = {"do": "update", "from": first, "joins": joins, "set": sets, "where": self.expr() if self.take("WHERE") else None}
        elif self.take("DELETE", "FROM"):
            out = {"do": "delete", "table": self.name(), "where": self.expr() if self.take("WHERE") else None}
        elif self.take("CREATE", "TABLE"):
            quiet = self.take("IF", "NOT", "EXISTS")
            table = self.name()
            self.need("(")
            cols = self.several(lambda: (self.name(), *self._type()))
            self.need(")")
            out = {"do": "create", "table": table, "quiet": quiet, "columns": cols}
        elif self.take("DROP", "TABLE"):
            quiet = self.take("IF", "EXISTS")
            out = {"do": "drop", "table": self.name(), "quiet": quiet}
        elif self.take("ALTER", "TABLE"):
            out = {"do": "alter", "table": self.name()} | self._change()
        else:
            raise SyntaxProblem(f"unknown statement {self.toks[0][1]!r}")
        self.end()
        return out

    def _row(self):
        self.need("(")
        out = self.several(self.expr)
        self.need(")")
        return out

    def _set(self):
        name = self.name()
        if self.take("."):
            name = self.name()
        self.need("=")
        return name.upper(), self.expr()

    def _change(self) -> dict:
        if self.take("ADD"):
            self.take("COLUMN")
            return {"change": "add", "column": (self.name(), *self._type())}
        if self.take("DROP"):
            self.take("COLUMN")
            return {"change": "drop", "name": self.name().upper()}
        self.need("RENAME")
        if self.take("TO"):
            return {"change": "rename", "to": self.name()}
        self.need("COLUMN")
        old = self.name().upper()
        self.need("TO")
        return {"change": "rename column", "name": old, "to": self.name()}


def parse(sql: str) -> dict:
    return Parser(sql).statement()
