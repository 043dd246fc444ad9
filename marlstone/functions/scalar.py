"""Scalar functions by name, as Column builders, so that Catalyst sees plain expressions.

``ANSI`` has Spark's meaning of a name. ``XBASE`` overrides it where the historical meaning differs (nulls skipped by CONCAT,
LENGTH of null 0, rounding half up, lenient numbers and dates, ...). ``call`` picks by mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]


def text(c: Column) -> Column:
    return c.cast("string")


def number(c: Column) -> Column:
    """As a double; null where the text is no number."""
    return text(c).try_cast("double")


def day(c: Column) -> Column:
    """A date from a date, a timestamp, yyyy-MM-dd or yyyyMMdd."""
    s = text(c)
    return F.coalesce(F.substring(s, 1, 10).try_cast("date"), F.try_to_date(s, "yyyyMMdd"))


def moment(c: Column) -> Column:
    return F.coalesce(text(c).try_cast("timestamp_ntz"), day(c).cast("timestamp_ntz"))


#: Control characters and the space.
BLANKS = "".join(map(chr, range(0x21)))


def strip(c: Column, left: bool = True, right: bool = True) -> Column:
    """Without control characters and spaces at the ends."""
    cut = F.btrim if left and right else F.ltrim if left else F.rtrim
    return cut(text(c), F.lit(BLANKS))


def truthy(c: Column) -> Column:
    """Of a condition's value: true; Y, T, TRUE or 1; a number other than 0. Never null."""
    s = F.upper(strip(c))
    return F.coalesce(s.isin("Y", "T", "TRUE", "1") | (F.coalesce(number(c), F.lit(0.0)) != 0), F.lit(False))


def _alike(a: Column, b: Column) -> Column:
    """Equal as numbers if both are, else as trimmed text; null equals null."""
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(strip(a).eqNullSafe(strip(b)))


def _scaled(x: Column, n: Column, f: Builder) -> Column:
    p = F.pow(F.lit(10.0), n)
    return f(x.cast("double") * p) / p


def _decode(e: Column, *rest: Column, same: Builder = Column.eqNullSafe) -> Column:
    out = None
    for i in range(0, len(rest) - 1, 2):
        hit = same(e, rest[i])
        out = F.when(hit, rest[i + 1]) if out is None else out.when(hit, rest[i + 1])
    default = rest[-1] if len(rest) % 2 else F.lit(None)
    return default if out is None else out.otherwise(default)


def _from_one(start: Column) -> Column:
    return F.greatest(start.cast("int"), F.lit(1))


def _mid(s: Column, start: Column, length: Column | None = None) -> Column:
    size = F.lit(2**31 - 1) if length is None else F.greatest(length.cast("int"), F.lit(0))
    return F.substr(text(s), _from_one(start), size)


def _locate(sub: Column, s: Column, start: Column | None = None) -> Column:
    blank = lambda c: F.coalesce(text(c), F.lit(""))
    return F.call_function("locate", blank(sub), blank(s), _from_one(start if start is not None else F.lit(1))).cast("long")


def _char(n: Column) -> Column:
    """The character of a 16-bit code."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(65535))), 4, "0")), "UTF-16BE")


def _initcap(s: Column) -> Column:
    """Letters and digits after anything else in upper case, the rest in lower case."""
    words = F.regexp_extract_all(F.lower(text(s)), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def _str(x: Column, length: Column | None = None, decimals: Column | None = None) -> Column:
    if decimals is None:
        return F.coalesce(number(x), F.lit(0.0)).cast("long").cast("string")
    return _scaled(number(x), decimals, lambda v: F.floor(v + 0.5)).cast("string")


def _log(a: Column, b: Column | None = None) -> Column:
    return F.ln(a.cast("double")) if b is None else F.ln(b.cast("double")) / F.ln(a.cast("double"))


def _log_x(a: Column, b: Column | None = None) -> Column:
    def ln(c: Column) -> Column:
        c = number(c)
        return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))

    return ln(a) if b is None else ln(b) / ln(a)


def _trunc(x: Column, n: Column | None = None) -> Column:
    x = x.cast("double")
    return F.sign(x) * _scaled(F.abs(x), n if n is not None else F.lit(0), F.floor)


def _best(pick: Builder) -> Builder:
    return lambda *c: c[0] if len(c) == 1 else pick(*c)


def _pad(f: str) -> Builder:
    return lambda s, n, p=None: F.call_function(f, text(s), F.greatest(n.cast("int"), F.lit(0)), text(p) if p is not None else F.lit(" "))


ANSI: dict[str, Builder] = {
    # conditions and nulls
    "ISNULL": lambda x, y=None: x.isNull() if y is None else F.coalesce(x, y),
    "ISBLANK": lambda x: x.isNull() | (F.trim(text(x)) == ""),
    "NVL": lambda x, y: F.coalesce(x, y),
    "NVL2": lambda x, a, b: F.when(x.isNotNull(), a).otherwise(b),
    "COALESCE": lambda *c: F.coalesce(*c),
    "NULLIF": lambda a, b: F.nullif(a, b),
    "IIF": lambda c, a, b: F.when(c, a).otherwise(b),
    "DECODE": _decode,
    "GREATEST": _best(F.greatest),
    "LEAST": _best(F.least),
    # text
    **{k: (lambda s: F.upper(text(s))) for k in ("UPPER", "UCASE")},
    **{k: (lambda s: F.lower(text(s))) for k in ("LOWER", "LCASE")},
    **{k: (lambda s: F.trim(text(s))) for k in ("TRIM", "ALLTRIM")},
    "LTRIM": lambda s: F.ltrim(text(s)),
    "RTRIM": lambda s: F.rtrim(text(s)),
    **{k: (lambda s: F.length(text(s)).cast("long")) for k in ("LEN", "LENGTH", "CHAR_LENGTH", "CHARACTER_LENGTH")},
    "OCTET_LENGTH": lambda s: F.octet_length(text(s)).cast("long"),
    "LEFT": lambda s, n: F.left(text(s), n.cast("int")),
    "RIGHT": lambda s, n: F.right(text(s), n.cast("int")),
    **{k: _mid for k in ("SUBSTR", "SUBSTRING", "MID")},
    "CONCAT": lambda *c: F.concat(*[text(x) for x in c]),
    "REPLACE": lambda s, a, b=None: F.replace(text(s), text(a), text(b) if b is not None else F.lit("")),
    "LPAD": _pad("lpad"),
    "RPAD": _pad("rpad"),
    "REPEAT": lambda s, n: F.repeat(text(s), F.greatest(n.cast("int"), F.lit(0))),
    "SPACE": lambda n: F.repeat(F.lit(" "), F.greatest(n.cast("int"), F.lit(0))),
    "REVERSE": lambda s: F.reverse(text(s)),
    "ASCII": lambda s: F.ascii(text(s)).cast("long"),
    **{k: _char for k in ("CHR", "CHAR")},
    "INITCAP": lambda s: F.initcap(text(s)),
    **{k: _locate for k in ("LOCATE", "POSITION")},
    "INSTR": lambda s, sub: _locate(sub, s),
    "STR": _str,
    "VAL": lambda s: F.when(s.isNotNull(), F.coalesce(number(s), F.lit(0.0))),
    # numbers
    "ABS": F.abs,
    "ROUND": lambda x, n=None: F.call_function("round", x, n.cast("int") if n is not None else F.lit(0)),
    "INT": lambda x: x.cast("long"),
    "MOD": lambda a, b: F.try_mod(a, b),
    **{k: (lambda x: F.ceil(x).cast("long")) for k in ("CEIL", "CEILING")},
    "FLOOR": lambda x: F.floor(x).cast("long"),
    **{k: (lambda a, b: F.pow(a, b)) for k in ("POWER", "POW")},
    "SQRT": F.sqrt,
    "EXP": F.exp,
    "LN": F.ln,
    "LOG": _log,
    "LOG10": F.log10,
    "SIGN": lambda x: F.sign(x).cast("long"),
    **{k: _trunc for k in ("TRUNC", "TRUNCATE")},
    "PI": F.pi,
    **{k: F.rand for k in ("RAND", "RANDOM")},
    # dates
    **{k: (lambda d, f=f: f(d).cast("long")) for k, f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DAYOFWEEK": F.dayofweek, "DAYOFYEAR": F.dayofyear, "QUARTER": F.quarter, "WEEK": F.weekofyear}.items()},
    "CURRENT_DATE": F.current_date,
    "CURRENT_TIME": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"),
    **{k: F.current_timestamp for k in ("CURRENT_TIMESTAMP", "NOW")},
    "DATEDIFF": lambda a, b: F.date_diff(a.cast("date"), b.cast("date")).cast("long"),
    "DATEADD": lambda d, n: F.date_add(d.cast("date"), n.cast("int")),
    "LAST_DAY": lambda d: F.last_day(d.cast("date")),
    "MONTHNAME": lambda d: F.date_format(d.cast("date"), "MMMM"),
    "DAYNAME": lambda d: F.date_format(d.cast("date"), "EEEE"),
    "TO_DATE": lambda d: day(d),
}

XBASE: dict[str, Builder] = ANSI | {
    "ISBLANK": lambda x: x.isNull() | (strip(x) == ""),
    "NULLIF": lambda a, b: F.when(~_alike(a, b), a),
    "IIF": lambda c, a, b: F.when(truthy(c), a).otherwise(b),
    "DECODE": lambda e, *rest: _decode(e, *rest, same=_alike),
    **{k: strip for k in ("TRIM", "ALLTRIM")},
    "LTRIM": lambda s: strip(s, right=False),
    "RTRIM": lambda s: strip(s, left=False),
    **{k: (lambda s: F.coalesce(F.length(text(s)), F.lit(0)).cast("long")) for k in ("LEN", "LENGTH")},
    "CONCAT": lambda *c: F.concat_ws("", *[text(x) for x in c]),
    "REPLACE": lambda s, a, b=None: F.replace(text(s), F.coalesce(text(a), F.lit("")), F.coalesce(text(b), F.lit("")) if b is not None else F.lit("")),
    "INITCAP": _initcap,
    "ABS": lambda x: F.abs(number(x)),
    "ROUND": lambda x, n: _scaled(number(x), n, lambda v: F.floor(v + 0.5)),
    "INT": lambda x: number(x).cast("long"),
    "MOD": lambda a, b: F.when(number(b) == 0, F.lit(float("nan"))).otherwise(F.try_mod(number(a), number(b))),
    "LN": _log_x,
    "LOG": _log_x,
    "LOG10": lambda x: F.when(number(x) > 0, F.log10(number(x))).otherwise(_log_x(x)),
    **{k: (lambda d, f=f: f(day(d)).cast("long")) for k, f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "DAYOFWEEK": F.dayofweek, "DAYOFYEAR": F.dayofyear, "QUARTER": F.quarter, "WEEK": F.weekofyear}.items()},
    **{k: (lambda d, f=f: f(moment(d)).cast("long")) for k, f in {"HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}.items()},
    "DATEDIFF": lambda a, b: F.date_diff(day(a), day(b)).cast("long"),
    "DATEADD": lambda d, n: F.date_add(day(d), n.cast("int")),
    "LAST_DAY": lambda d: F.last_day(day(d)),
    "MONTHNAME": lambda d: F.date_format(day(d), "MMMM"),
    "DAYNAME": lambda d: F.date_format(day(d), "EEEE"),
}

#: Target types of CAST.
CASTS = {
    **dict.fromkeys(("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"), "bigint"),
    **dict.fromkeys(("NUMERIC", "DECIMAL", "FLOAT", "DOUBLE", "REAL", "DEC"), "double"),
    **dict.fromkeys(("BOOL", "BOOLEAN", "LOGICAL"), "boolean"),
    **dict.fromkeys(("DATE", "DATETIME"), "date"),
}
EXTRACTS = {"YEAR": "YEAR", "MONTH": "MONTH", "DAY": "DAY", "HOUR": "HOUR", "MINUTE": "MINUTE", "SECOND": "SECOND", "QUARTER": "QUARTER", "WEEK": "WEEK", "DOW": "DAYOFWEEK", "DAYOFWEEK": "DAYOFWEEK", "DOY": "DAYOFYEAR", "DAYOFYEAR": "DAYOFYEAR"}


class UnknownFunction(ValueError):
    pass


def call(name: str, *args: Column, mode: str = "ansi") -> Column:
    table = XBASE if mode == "xbase" else ANSI
    if name.upper() not in table:
        raise UnknownFunction(f"Unknown function {name}")
    return table[name.upper()](*args)


def cast(c: Column, kind: str, mode: str = "ansi") -> Column:
    """CAST by type name; lengths are of no account. In xBase mode text that is no number is 0."""
    to = CASTS.get(kind.upper(), "string")
    if mode != "xbase":
        return c.cast(to)
    if to in ("bigint", "double"):
        return F.when(c.isNotNull(), F.coalesce(number(c), F.lit(0.0)).cast(to))
    return {"boolean": F.when(c.isNotNull(), truthy(c)), "date": day(c)}.get(to, text(c))
