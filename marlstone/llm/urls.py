"""URL filters: rules by host suffix and path prefix, and a Bloom filter cascade over listed urls (host and path).

The cascade gives exact membership for every key of the universe it was built over: level 1 encodes the listed keys, level
2 those other keys that pass level 1, level 3 the listed keys that pass level 2, and so on until nothing passes wrongly.
A key is judged by the first level that it does not pass. Levels are bit arrays, built and tested by DataFrame operations
and read as scalar subqueries, so judging joins nothing. The bytes of all levels are checked against ``most_bytes``; a
list beyond that is judged by an exact left join instead.

Nulls: a null url, or one without ``://``, has an empty host and path; no rule fits it and it is never listed (allow).
Repeated rows are judged alike. Very long urls are read whole. Empty tables and empty lists give their plain results. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Action, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MOST_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, ascii_uppercase, ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The rule (host and path) that fits best, and its action; null where none fits. Rules are a parameter, tested in turn."""
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), action.otherwise(none))


class Level:
    """One Bloom filter: ``bits`` is a table of one row with an array of 64-bit words."""

    def __init__(self, keys: DataFrame, count: int, rate: float, seed: int):
        self.seed, self.hashes = seed, max(1, round(-math.log2(rate)))
        self.size = 64 * max(1, math.ceil(count * self.hashes / math.log(2) / 64))
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        set_ = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        dense = keys.sparkSession.range(self.size // 64).join(set_, F.col("id") == F.col("word"), "left")
        rows = dense.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
        self.bits = materialize(rows.select(F.transform("all", lambda x: x["bits"]).alias("bits")), "bloom")

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.size)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = self.bits.scalar()
        out = F.lit(True)
        for place in self._places(key):
            word = F.get(words, F.call_function("shiftrightunsigned", place, F.lit(6)).cast("int"))
            out &= F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return out


class Cascade:
    """Exact membership of the keys of ``universe`` (distinct, column ``key``) in ``listed`` (column ``key``; others are of no account)."""

    def __init__(self, universe: DataFrame, listed: DataFrame, most_bytes: int = MOST_BYTES, seed: int = 7):
        tagged = materialize(universe.join(listed.select(F.col("key").alias("listed_key")).distinct(), F.col("key") == F.col("listed_key"), "left").select("key", F.col("listed_key").isNotNull().alias("listed")), "universe")
        self.levels: list[Level] = []
        self.listed = tagged.filter("listed").select("key")
        inner, outer = self.listed, tagged.filter("not listed").select("key")
        n_in, n_out = inner.count(), outer.count()
        rate = min(0.5, max(1e-9, n_in * math.sqrt(0.5) / max(n_out, 1)))
        self.exact = n_in * max(1, -math.log2(rate)) / math.log(2) / 8 * 2 > most_bytes
        while n_in and not self.exact:
            level = Level(inner, n_in, rate, seed + len(self.levels))
            self.levels.append(level)
            wrong = materialize(outer.filter(level.passes(F.col("key"))), "false-positives")
            inner, outer, n_in, n_out, rate = wrong, inner, wrong.count(), n_in, 0.5

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; of no meaning for others."""
        out = F.lit(len(self.levels) % 2 == 1)  # what passes all levels is of the last one's kind
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, listed. ``listed`` has host and path in column ``key``; a rule goes before the list."""
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    of = F.concat("host", "path")
    cascade = Cascade(split.select(of.alias("key")).distinct(), listed, most_bytes)
    if cascade.exact:
        split = split.join(cascade.listed, of == F.col("key"), "left").withColumn("listed", F.col("key").isNotNull())
    else:
        split = split.withColumn("listed", cascade.contains(of))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
