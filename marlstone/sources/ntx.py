"""Clipper-style .NTX indexes: B-trees of 1024-byte pages that give record numbers in the order of a key expression.

``spark.read.format("ntx").load(path)`` gives key and recno; option ``prefix`` walks only the part of the tree whose keys begin
with it. The children of the root are partitions, each walked by a task of its own. ``key_expression`` builds the key of a
table's rows as a Column; ``build`` writes an index of them.

A page holds a 16-bit count, a 16-bit place for each entry and one more, and entries of a child's offset, a record number
and the key; the last entry has only a child. Keys are in ascending order, what is in a child goes before its entry. Keys are
Latin-1; a character beyond it stands as ``?``, so a prefix or an order is taken from an index only where it is ASCII. Rows with a
null have blanks there. Equal keys go by record number. An empty table gives a tree of one empty page.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import syntax
from .layout import Field
from .xbase import open_at

#: Fixed values of the format.
PAGE, SIGNATURE = 1024, 6


class IndexError_(ValueError):
    pass


@dataclass(frozen=True)
class Tree:
    root: int
    key_length: int
    expression: str
    unique: bool

    @classmethod
    def of(cls, f) -> Tree:
        f.seek(0)
        head = f.read(PAGE)
        if len(head) < PAGE:
            raise IndexError_("the file is shorter than a page")
        root, _, _, length = struct.unpack("<IIHH", head[4:16])
        return cls(root, length, head[22:278].split(b"\0")[0].decode("latin-1").strip(), bool(head[278]))

    def page(self, f, at: int) -> tuple[list[tuple[int, int, bytes]], int]:
        """(child, record number, key) of each entry, and the last child."""
        f.seek(at)
        raw = f.read(PAGE)
        n = struct.unpack("<H", raw[:2])[0]
        slots = struct.unpack(f"<{n + 1}H", raw[2 : 2 * n + 4])
        out = []
        for s in slots[:n]:
            child, recno = struct.unpack("<II", raw[s : s + 8])
            out.append((child, recno, raw[s + 8 : s + 8 + self.key_length]))
        return out, struct.unpack("<I", raw[slots[n] : slots[n] + 4])[0]

    def walk(self, f, at: int, prefix: bytes = b"") -> Iterator[tuple[bytes, int]]:
        """Entries below a page, in order, that begin with the prefix; parts that cannot are not read."""
        if not at:
            return
        entries, last = self.page(f, at)
        n = len(prefix)
        for child, recno, key in entries:
            if key[:n] >= prefix:
                yield from self.walk(f, child, prefix)
            if key[:n] == prefix:
                yield key, recno
            if key[:n] > prefix:
                return
        yield from self.walk(f, last, prefix)


@dataclass
class Part(InputPartition):
    page: int
    own: tuple[tuple[bytes, int], ...]
    place: int


class NtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ntx"

    def schema(self) -> str:
        return "key string, recno bigint, part int"

    def reader(self, schema) -> DataSourceReader:
        return NtxReader(dict(self.options))


class NtxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.prefix = options["path"], options.get("prefix", "").encode("latin-1", "replace")

    def partitions(self) -> list[Part]:
        with open_at(self.path) as f:
            tree = Tree.of(f)
            entries, last = tree.page(f, tree.root)
        parts, n = [], len(self.prefix)
        for i, (child, recno, key) in enumerate(entries):
            if key[:n] >= self.prefix:
                parts.append(Part(child, ((key, recno),) if key[:n] == self.prefix else (), i))
            if key[:n] > self.prefix:
                return parts
        return [*parts, Part(last, (), len(entries))]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with open_at(self.path) as f:
            tree = Tree.of(f)
            found = [*tree.walk(f, part.page, self.prefix), *part.own]
        yield pa.RecordBatch.from_arrays([pa.array([k.decode("latin-1") for k, _ in found]), pa.array([r for _, r in found], pa.int64()), pa.array([part.place] * len(found), pa.int32())], names=["key", "recno", "part"])


def key_expression(expression: str, fields: tuple[Field, ...]) -> Column:
    """A key of ``+``-joined terms over a table's columns: fields padded to their length, UPPER, SUBSTR, DTOS, STR and the like."""
    at = {f.name.upper(): f for f in fields}

    def text(e) -> Column:
        kind = e[0]
        if kind == "op" and e[1] == "+":
            return F.concat(text(e[2]), text(e[3]))
        if kind == "str":
            return F.lit(e[1])
        if kind == "col":
            f = at.get(e[2])
            if not f:
                raise IndexError_(f"no column {e[2]}")
            if f.type in "NF":
                return _number(F.col(f.name), f.length, f.decimals)
            if f.type == "D":
                return F.coalesce(F.date_format(F.col(f.name), "yyyyMMdd"), F.lit(" " * 8))
            return F.rpad(F.coalesce(F.col(f.name).cast("string"), F.lit("")), f.length, " ")
        if kind == "recno":
            return _number(F.col("_recno"), 10, 0)
        if kind == "call":
            return call(e[1], e[2])
        raise IndexError_(f"not a key: {expression}")

    def call(name: str, args: tuple) -> Column:
        whole = lambda i: int(args[i][1])
        if name in ("UPPER", "UCASE"):
            return F.upper(text(args[0]))
        if name in ("LOWER", "LCASE"):
            return F.lower(text(args[0]))
        if name == "LTRIM":
            return F.ltrim(text(args[0]))
        if name in ("RTRIM", "TRIM"):
            return F.rtrim(text(args[0]))
        if name == "ALLTRIM":
            return F.trim(text(args[0]))
        if name in ("SUBS", "SUBSTR"):
            return F.substring(text(args[0]), whole(1), whole(2) if len(args) > 2 else 1 << 15)
        if name == "DTOS":
            return text(args[0])
        if name in ("YEAR", "MONTH", "DAY"):
            day = F.col(at[args[0][2]].name)
            return {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}[name](day).cast("string")
        if name == "STR":
            f = at.get(args[0][2]) if args[0][0] == "col" else None
            value = F.col("_recno") if args[0][0] == "recno" else F.col(f.name)
            return _number(value, whole(1) if len(args) > 1 else f.length, whole(2) if len(args) > 2 else f.decimals if f and len(args) == 1 else 0)
        if name in ("RECN", "RECNO"):
            return text(("recno",))
        raise IndexError_(f"function {name} in a key")

    parser = syntax.Parser(expression)
    tree = parser.expr()
    parser.end()
    return text(tree)


def _number(c: Column, length: int, decimals: int) -> Column:
    shown = F.format_string(f"%.{decimals}f", c.cast("double")) if decimals else c.cast("bigint").cast("string")
    return F.coalesce(F.lpad(shown, length, " "), F.lit(" " * length))


def build(table: DataFrame, fields: tuple[Field, ...], expression: str, path: str) -> int:
    """Writes an index of a table's live rows; the number of its entries. Spark sorts, the driver streams the file."""
    keyed = table.select(F.encode(key_expression(expression, fields), "ISO-8859-1").alias("key"), F.col("_recno").alias("recno"))
    length = keyed.agg(F.max(F.length("key"))).first()[0] or 1
    room = min((PAGE - 4) // (length + 10), 255)
    rows = ((bytes(r.key).ljust(length), r.recno) for r in keyed.orderBy("key", "recno").toLocalIterator())
    pages, n = [0], 0  # pages written, entries

    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(aside, "wb") as f:
        f.write(bytes(PAGE))

        def put(entries: list[tuple[int, bytes, int]], last: int) -> int:
            slots = [2 + 2 * (room + 1) + i * (length + 8) for i in range(room + 1)]
            raw = struct.pack(f"<H{room + 1}H", len(entries), *slots)
            for child, key, recno in entries:
                raw += struct.pack("<II", child, recno) + key
            raw += struct.pack("<I", last)
            f.write(raw.ljust(PAGE, b"\0"))
            pages[0] += 1
            return pages[0] * PAGE

        # Of each level: the entries of its open page. An entry's child is the page that was closed before it.
        levels: list[list[tuple[int, bytes, int]]] = [[]]

        def push(level: int, child: int, key: bytes, recno: int) -> None:
            if level == len(levels):
                levels.append([])
            if len(levels[level]) < room - 1:
                levels[level].append((child, key, recno))
            else:  # full: its last child is this entry's, which moves up
                push(level + 1, put(levels[level], child), key, recno)
                levels[level] = []

        for key, recno in rows:
            n += 1
            push(0, 0, key, recno)
        at = put(levels[0], 0)
        for entries in levels[1:]:
            at = put(entries, at)
        f.seek(0)
        f.write(struct.pack("<HHIIHHHHH256sB", SIGNATURE, 1, at, 0, length + 8, length, 0, room, room // 2, expression.encode("latin-1", "replace")[:255], 0))
    os.replace(aside, path)  # a reader has the old index or the new one
    return n


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NtxSource)
