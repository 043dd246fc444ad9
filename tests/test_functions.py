"""Scalar functions in both modes, with values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar

D = dt.date(2024, 5, 6)  # a Monday
BOTH = [
    ("ISNULL", [None], True), ("ISNULL", [None, 3], 3), ("ISBLANK", ["  "], True), ("ISBLANK", ["a"], False), ("NVL", [None, 2], 2), ("NVL2", [1, "a", "b"], "a"), ("NVL2", [None, "a", "b"], "b"),
    ("COALESCE", [None, None, 7], 7), ("NULLIF", [5, 5], None), ("NULLIF", [5, 6], 5), ("DECODE", ["b", "a", 1, "b", 2, 9], 2), ("DECODE", ["z", "a", 1], None), ("DECODE", [None, None, 4, 5], 4),
    ("GREATEST", [3, None, 9], 9), ("LEAST", [3, None, 9], 3), ("UPPER", ["aé"], "AÉ"), ("UCASE", ["a"], "A"), ("LOWER", ["A"], "a"), ("LCASE", ["A"], "a"), ("TRIM", [" a "], "a"), ("ALLTRIM", [" a "], "a"),
    ("LTRIM", [" a "], "a "), ("RTRIM", [" a "], " a"), ("LEN", ["abc"], 3), ("LENGTH", ["é"], 1), ("CHAR_LENGTH", [None], None), ("CHARACTER_LENGTH", ["ab"], 2), ("OCTET_LENGTH", ["é"], 2),
    ("LEFT", ["abc", 2], "ab"), ("LEFT", ["abc", -1], ""), ("RIGHT", ["abc", 9], "abc"), ("SUBSTR", ["abcdef", 2, 3], "bcd"), ("SUBSTRING", ["abc", 0], "abc"), ("SUBSTR", ["abc", 0, 2], "ab"), ("MID", ["abc", 9], ""),
    ("REPLACE", ["aXa", "X", "-"], "a-a"), ("LPAD", ["a", 3], "  a"), ("RPAD", ["abc", 2, "*"], "ab"), ("LPAD", ["a", 4, "xy"], "xyxa"), ("REPEAT", ["ab", 2], "abab"), ("REPEAT", ["ab", -2], ""), ("SPACE", [2], "  "),
    ("REVERSE", ["abc"], "cba"), ("ASCII", ["A"], 65), ("ASCII", [""], 0), ("CHR", [65], "A"), ("CHAR", [8364], "€"), ("LOCATE", ["b", "abcb"], 2), ("LOCATE", ["b", "abcb", 3], 4), ("LOCATE", ["z", "abc"], 0),
    ("POSITION", ["c", "abc"], 3), ("INSTR", ["abc", "b"], 2), ("STR", [12.9], "12"), ("STR", [2.5, 9, 0], "3.0"), ("VAL", ["1.5"], 1.5), ("VAL", ["x"], 0.0), ("VAL", [None], None), ("ABS", [-2.5], 2.5),
    ("CEIL", [1.2], 2), ("CEILING", [-1.2], -1), ("FLOOR", [-1.2], -2), ("POWER", [2.0, 3.0], 8.0), ("POW", [2.0, 3.0], 8.0), ("SQRT", [9.0], 3.0), ("EXP", [0.0], 1.0), ("LN", [1.0], 0.0), ("LOG", [1.0], 0.0),
    ("LOG", [2.0, 8.0], 3.0), ("LOG10", [1000.0], 3.0), ("SIGN", [-3.5], -1), ("TRUNC", [-2.78, 1], -2.7), ("TRUNCATE", [2.78], 2.0), ("PI", [], math.pi), ("YEAR", [D], 2024), ("MONTH", [D], 5), ("DAY", [D], 6),
    ("HOUR", [dt.datetime(2024, 5, 6, 7, 8, 9)], 7), ("MINUTE", [dt.datetime(2024, 5, 6, 7, 8, 9)], 8), ("SECOND", [dt.datetime(2024, 5, 6, 7, 8, 9)], 9), ("DATEDIFF", [D, dt.date(2024, 5, 1)], 5),
    ("DATEADD", [D, 30], dt.date(2024, 6, 5)), ("DAYOFWEEK", [D], 2), ("DAYOFYEAR", [D], 127), ("QUARTER", [D], 2), ("WEEK", [D], 19), ("LAST_DAY", [D], dt.date(2024, 5, 31)), ("MONTHNAME", [D], "May"), ("DAYNAME", [D], "Monday"),
    ("TO_DATE", ["20240506"], D), ("TO_DATE", ["2024-05-06"], D), ("MOD", [-7, 3], -1), ("INT", [2.9], 2),
]
ANSI = [("CONCAT", ["a", None], None), ("LENGTH", [None], None), ("ROUND", [-2.5, 0], -3.0), ("LN", [0.0], None), ("INITCAP", ["foo-bar baz"], "Foo-bar Baz"), ("IIF", [True, 1, 2], 1), ("MOD", [1, 0], None)]
XBASE = [
    ("CONCAT", ["a", None, "b"], "ab"), ("LENGTH", [None], 0), ("LEN", [None], 0), ("ROUND", [-2.5, 0], -2.0), ("ROUND", [2.345, 2], 2.35), ("LN", [0.0], -math.inf), ("INITCAP", ["foo-bar BAZ é1a"], "Foo-Bar Baz É1a"), ("IIF", ["T", 1, 2], 1),
    ("IIF", ["x", 1, 2], 2), ("IIF", [0, 1, 2], 2), ("TRIM", ["\t a \n"], "a"), ("NULLIF", ["5 ", " 5.0"], None), ("NULLIF", ["a ", "a"], None), ("REPLACE", ["abc", "b", None], "ac"), ("ABS", [-3], 3.0), ("INT", ["4.9"], 4),
    ("YEAR", ["20240506"], 2024), ("DAY", ["2024-05-06"], 6), ("HOUR", [D], 0), ("DATEADD", ["2024-05-06", 1], dt.date(2024, 5, 7)), ("LOCATE", [None, "abc"], 1), ("MOD", [7.5, 2.0], 1.5),
]


@pytest.mark.parametrize("mode,cases", [("ansi", BOTH + ANSI), ("xbase", BOTH + XBASE)])
def test_values(spark, mode, cases):
    row = spark.range(1).select(*[scalar.call(name, *[F.lit(a) for a in args], mode=mode).alias(f"c{i}") for i, (name, args, _) in enumerate(cases)]).first()
    wrong = []
    for i, (name, args, want) in enumerate(cases):
        got = row[i]
        same = math.isclose(got, want, rel_tol=1e-12) if isinstance(got, float) and isinstance(want, (int, float)) and not isinstance(want, bool) else got == want
        if not same:
            wrong.append((name, args, want, got))
    assert wrong == []


def test_all_names_are_there(spark):  # and CAST, which has a grammar of its own
    assert len(scalar.ANSI) == 84 and scalar.ANSI.keys() == scalar.XBASE.keys()
    for name in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "NOW", "RAND", "RANDOM"):
        assert spark.range(1).select(scalar.call(name)).first()[0] is not None
    with pytest.raises(scalar.UnknownFunction):
        scalar.call("NOPE")


def test_casts(spark):
    one = lambda v, kind, mode: spark.range(1).select(scalar.cast(F.lit(v), kind, mode)).first()[0]
    assert [one("12.7", "INTEGER", "xbase"), one("x", "NUMERIC", "xbase"), one(None, "INT", "xbase"), one("T", "LOGICAL", "xbase"), one("20240506", "DATE", "xbase"), one(5, "CHAR", "xbase")] == [12, 0.0, None, True, D, "5"]
    assert [one("12", "INTEGER", "ansi"), one(2, "DOUBLE", "ansi"), one("2024-05-06", "DATE", "ansi")] == [12, 2.0, D]
