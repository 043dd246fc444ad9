"""Errors that carry an SQLSTATE and a code of their own."""

from __future__ import annotations

import re

#: Codes by SQLSTATE, or by its class; the last is of all others.
CODES = {"42S22": 17006, "42S02": 17007, "42000": 17001, "07001": 17008, "02000": 17003, "55006": 17012, "58030": 17011, "08": 17005, "22": 17009, "0A": 17090, "": 17000}


def code_of(sqlstate: str) -> int:
    return CODES.get(sqlstate) or CODES.get(sqlstate[:2]) or CODES[""]


def failure(e: BaseException) -> str:
    """The SQLSTATE of an error: its own, that of the engine's error that a task has reported, or Spark's."""
    own = getattr(e, "sqlstate", None)
    if own:
        return own
    if told := re.search(r"\[SQLSTATE (\w{5})\]", str(e)):
        return told[1]
    return (e.getSqlState() if hasattr(e, "getSqlState") else None) or "HY000"


class EngineError(Exception):
    def __init__(self, message: str, sqlstate: str = "42000"):
        super().__init__(message)
        self.sqlstate = sqlstate

    @property
    def code(self) -> int:
        return code_of(self.sqlstate)
