"""xBase tables as a Spark data source: ``spark.read.format("xbase").load(path)`` and ``df.write.format("xbase").save(path)``.

A table's records have one size, so a scan is split by record ranges that know their offsets; each is read and decoded by a
task of its own, column by column. ``_recno`` is the physical place from 1, deleted records counted; ``_deleted`` the flag.

Read options: charset (utf-8), include_deleted (false), rtrim (false), columns (comma-separated; others are not decoded),
vfp_datetime_epoch (serial or julian), partition_records. Filters on ``_recno`` narrow the ranges, lists of them to runs of records, where Spark's setting
spark.sql.python.filterPushdown.enabled lets a source see them.

Write options: charset, fields (name,type,length,decimals;...). A write makes one file, and one of memos: tasks format their
records side by side in a folder next to it, and the commit streams the pieces together in order of partitions and renames the
results. Paths may be URIs of any file system that Arrow knows, for reading and for writing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from . import layout
from .layout import Field, Header

CHUNK = 16_384
#: Records between two that are asked for, below which what lies between is read along.
GAP = 64
HIDDEN = ("_recno", "_deleted")


def _split(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def open_at(path: str):
    store, at = _split(path)
    return store.open_input_file(at)


def _siblings(path: str, ext: str) -> str | None:
    """The file beside ``path`` with the extension in any case."""
    from pyarrow import fs

    store, at = _split(path)
    folder, base = os.path.split(os.path.splitext(at)[0])
    for info in store.get_file_info(fs.FileSelector(folder)):
        name, e = os.path.splitext(info.base_name)
        if name.lower() == base.lower() and e.lower() == f".{ext}":
            return path[: len(path) - len(os.path.basename(path))] + info.base_name
    return None


def header_of(path: str, charset: str = "utf-8") -> Header:
    with open_at(path) as f:
        return layout.read_header(f, charset)


@dataclass
class Range(InputPartition):
    first: int
    end: int
    runs: tuple[tuple[int, int], ...] = ()


def ranges(first: int, end: int, options: dict[str, str]) -> list[Range]:
    """Records from ``first`` to before ``end``, some for each task."""
    step = int(options.get("partition_records", 1_000_000))
    return [Range(i, min(i + step, end)) for i in range(first, end, step)] or [Range(1, 1)]


class XBaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xbase"

    def _header(self) -> Header:
        return header_of(self.options["path"], self.options.get("charset", "utf-8"))

    def schema(self) -> T.StructType:
        wanted = [c.strip().lower() for c in self.options.get("columns", "").split(",") if c.strip()]
        fields = [f.spark() for f in self._header().fields if not wanted or f.name.lower() in wanted]
        return T.StructType([*fields, T.StructField("_recno", T.LongType()), T.StructField("_deleted", T.BooleanType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return XBaseReader(dict(self.options), schema, self._header())

    def streamReader(self, schema: T.StructType):
        from ..streaming import Appended

        return Appended(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return XBaseWriter(dict(self.options), schema, overwrite)


class XBaseReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType, header: Header):
        self.options, self.schema, self.header = options, schema, header
        self.first, self.end = 1, header.records + 1
        self.listed: set[int] | None = None

    def pushFilters(self, filters):
        """Narrows the range by what is asked of ``_recno``; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, In) and f.attribute == ("_recno",):
                some = {v for v in f.value if isinstance(v, int)}
                self.listed = some if self.listed is None else self.listed & some
            if getattr(f, "attribute", None) == ("_recno",) and isinstance(getattr(f, "value", None), int):
                v = f.value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, v + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Range]:
        if self.listed is not None:  # runs of records that are asked for one by one, close ones together
            runs: list[list[int]] = []
            for n in sorted(x for x in self.listed if self.first <= x < self.end):
                if runs and n - runs[-1][1] < GAP:
                    runs[-1][1] = n + 1
                else:
                    runs.append([n, n + 1])
            return [Range(0, 0, tuple(map(tuple, runs[i : i + CHUNK]))) for i in range(0, len(runs), CHUNK)] or [Range(1, 1)]
        return ranges(self.first, self.end, self.options)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        h, opt = self.header, self.options
        fields = {f.name: f for f in h.fields}
        charset, keep = opt.get("charset", "utf-8"), opt.get("include_deleted", "false").lower() == "true"
        memo = None
        with open_at(opt["path"]) as f:
            for kind in ("fpt", "dbt") if any(fields[c.name].type == "M" for c in self.schema if c.name in fields) else ():
                if side := _siblings(opt["path"], kind):
                    memo = layout.Memo(open_at(side), kind)
                    break
            for lo, end in [(lo, min(lo + CHUNK, end)) for first, end in part.runs or ((part.first, part.end),) for lo in range(first, end, CHUNK)]:
                f.seek(h.size + (lo - 1) * h.record)
                raw = f.read((end - lo) * h.record)
                n = len(raw) // h.record
                rows = np.frombuffer(raw[: n * h.record], np.uint8).reshape(n, h.record)
                recno, deleted = np.arange(lo, lo + n), rows[:, 0] == layout.DELETED
                if not keep:
                    rows, recno = rows[~deleted], recno[~deleted]
                    deleted = deleted[~deleted]
                out = []
                for c in self.schema:
                    if c.name == "_recno":
                        out.append(pa.array(recno, pa.int64()))
                    elif c.name == "_deleted":
                        out.append(pa.array(deleted))
                    else:
                        out.append(self._column(rows, fields[c.name], c, charset, memo))
                if len(recno):
                    yield pa.RecordBatch.from_arrays(out, names=[c.name for c in self.schema])

    def _column(self, rows: np.ndarray, f: Field, c: T.StructField, charset: str, memo) -> pa.Array:
        kind = to_arrow_type(c.dataType)
        cells = np.ascontiguousarray(rows[:, f.offset : f.offset + f.length])
        if cells.shape[1] < f.length:
            return pa.nulls(len(rows), kind)
        if f.type in "IO" and f.length == {"I": 4, "O": 8}[f.type]:
            return pa.array(cells.view("<i4" if f.type == "I" else "<f8")[:, 0])
        empty = (cells <= 32).all(axis=1)
        if f.type == "L":
            return pa.array(np.isin(cells[:, 0], np.frombuffer(b"YyTt", np.uint8)))
        if f.type in "CNF":
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(f.length), len(rows), [None, pa.py_buffer(cells)])
            try:
                if f.type == "C" and charset.lower() not in ("utf-8", "utf8"):
                    raise pa.ArrowInvalid
                s = pc.if_else(pa.array(empty), None, fixed.cast(pa.binary()).cast(pa.string()))
                if f.type == "C":
                    return pc.ascii_rtrim_whitespace(s) if self._rtrim() else s
                return pc.ascii_trim_whitespace(s).cast(kind)
            except pa.ArrowInvalid:
                pass
        one = {"C": lambda x: x.decode(charset, "replace"), "D": layout.day, "Y": lambda x: None, "M": lambda x: memo.read(layout.memo_block(x), charset) if memo else None}.get(f.type)
        if f.type in "NF":
            one = lambda x: layout.number(x, f.type == "N" and not f.decimals)
        elif f.type == "Y":
            from decimal import Decimal

            one = lambda x: Decimal(int.from_bytes(x[:8], "little", signed=True)).scaleb(-4)
        elif f.type == "T":
            one = lambda x: layout.moment(x, self.options.get("vfp_datetime_epoch", "serial"))
        elif one is None:
            one = lambda x: x.decode(charset, "replace").strip() or None
        values = [None if e and f.type not in "YTM" else one(x.tobytes()) for x, e in zip(cells, empty)]
        if f.type == "C" and self._rtrim():
            values = [v.rstrip() if v is not None else None for v in values]
        return pa.array(values, kind)

    def _rtrim(self) -> bool:
        return self.options.get("rtrim", "false").lower() == "true"


def fields_for(schema: T.StructType, spec: str | None = None) -> list[Field]:
    """Fields by ``spec``, else by the columns' metadata, else by their types."""
    if spec:
        return list(layout.placed([Field(n, k, int(a), int(d)) for n, k, a, d in (x.split(",") for x in spec.split(";"))]))
    out = []
    for c in schema:
        if c.name in HIDDEN:
            continue
        if "xbase" in (c.metadata or {}):
            k, a, d = c.metadata["xbase"].split(",")
        else:
            k, a, d = {"bigint": "N,18,0", "int": "N,11,0", "smallint": "N,6,0", "tinyint": "N,4,0", "double": "N,20,5", "float": "N,20,5", "boolean": "L,1,0", "date": "D,8,0"}.get(c.dataType.simpleString(), "C,254,0").split(",")
            if isinstance(c.dataType, T.DecimalType):
                k, a, d = "N", c.dataType.precision + 2, c.dataType.scale
        out.append(Field(c.name, k, int(a), int(d)))
    return list(layout.placed(out))


@dataclass
class Piece(WriterCommitMessage):
    partition: int
    records: int
    blocks: int
    name: str


class XBaseWriter(DataSourceArrowWriter):
    """Tasks format whole columns of batches; each makes a piece of records and a piece of memo blocks, which the commit strings together."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path = options["path"]
        store, self.at = _split(self.path)
        self.schema, self.charset = schema, options.get("charset", "utf-8")
        self.append = not overwrite and store.get_file_info(self.at).is_file
        self.fields = list(header_of(self.path).fields) if self.append else fields_for(schema, options.get("fields"))
        layout.check_fields(self.fields)
        self.aside = f"{self.at}.{uuid.uuid4().hex}.tmp"
        store.create_dir(self.aside)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Piece:
        from pyspark import TaskContext

        store, _ = _split(self.path)
        part, name, n, block = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0
        with store.open_output_stream(f"{self.aside}/{name}") as out, store.open_output_stream(f"{self.aside}/{name}.memo") as side:
            for batch in batches:
                by = {c.lower(): batch.column(i) for i, c in enumerate(batch.schema.names)}
                rows = np.full((batch.num_rows, self.fields[-1].offset + self.fields[-1].length), layout.LIVE, np.uint8)
                if "_deleted" in by:
                    rows[by["_deleted"].fill_null(False).to_numpy(zero_copy_only=False), 0] = layout.DELETED
                for f in self.fields:
                    if (column := by.get(f.name.lower())) is None:
                        continue
                    if f.type != "M":
                        rows[:, f.offset : f.offset + f.length] = layout.cells(column, f, self.charset)
                        continue
                    for i, text in enumerate(column.to_pylist()):  # a memo's place is counted from its piece's first block
                        if text is not None:
                            made = layout.memo_blocks(str(text).encode(self.charset, "replace"))
                            side.write(made)
                            rows[i, f.offset : f.offset + f.length] = np.frombuffer(str(block).encode().rjust(f.length), np.uint8)
                            block += len(made) // layout.MEMO_BLOCK
                out.write(rows.tobytes())
                n += batch.num_rows
        return Piece(part, n, block, name)

    def commit(self, messages) -> None:
        store, _ = _split(self.path)
        pieces = sorted((m for m in messages if m), key=lambda m: m.partition)
        memos = [f for f in self.fields if f.type == "M"]
        old = header_of(self.path) if self.append else None
        old_memo = _siblings(self.path, "dbt") if memos else None
        first = 1
        if memos:
            if old and old_memo:
                first = -(-store.get_file_info(_split(old_memo)[1]).size // layout.MEMO_BLOCK)
            with store.open_output_stream(f"{self.aside}/memo") as out:
                out.write(layout.memo_head(first + sum(p.blocks for p in pieces)))
                if old and old_memo:
                    with open_at(old_memo) as f:
                        f.seek(layout.MEMO_BLOCK)
                        copied = layout.MEMO_BLOCK + _copy(f, out)
                        out.write(b"\0" * (first * layout.MEMO_BLOCK - copied))
                for p in pieces:
                    with store.open_input_file(f"{self.aside}/{p.name}.memo") as f:
                        _copy(f, out)
        with store.open_output_stream(f"{self.aside}/table") as out:
            out.write(layout.header_bytes(self.fields, (old.records if old else 0) + sum(p.records for p in pieces)))
            if old:
                with open_at(self.path) as f:
                    f.seek(old.size)
                    _copy(f, out, old.records * old.record)
            for p in pieces:
                with store.open_input_file(f"{self.aside}/{p.name}") as f:
                    if memos:
                        self._placed(f, out, memos, first)
                    else:
                        _copy(f, out)
                first += p.blocks
            out.write(bytes([layout.EOF]))
        # The memo goes first: of an append it holds what the old table points to as well.
        if memos:
            _move(store, f"{self.aside}/memo", _split(old_memo)[1] if old_memo else f"{os.path.splitext(self.at)[0]}.dbt")
        _move(store, f"{self.aside}/table", self.at)
        store.delete_dir(self.aside)

    def _placed(self, f, out, memos: list[Field], first: int) -> None:
        """Copies a piece's records with memos' places in the whole file."""
        record = self.fields[-1].offset + self.fields[-1].length
        while raw := f.read(record * CHUNK):
            rows = np.frombuffer(raw, np.uint8).reshape(-1, record).copy()
            for m in memos:
                own = rows[:, m.offset : m.offset + m.length]
                has = np.flatnonzero((own != 32).any(axis=1))
                places = np.ascontiguousarray(own[has]).view(f"S{m.length}")[:, 0].astype(np.int64) + first if len(has) else []
                if len(has):
                    shown = np.char.rjust(np.char.mod("%d", places).astype(f"S{m.length}"), m.length)
                    own[has] = np.frombuffer(shown.astype(f"S{m.length}").tobytes(), np.uint8).reshape(-1, m.length)
            out.write(rows.tobytes())

    def abort(self, messages) -> None:
        store, _ = _split(self.path)
        if store.get_file_info(self.aside).type.name == "Directory":
            store.delete_dir(self.aside)


def _copy(f, out, most: int | None = None) -> int:
    """Copies a file from where it stands, a few megabytes at a time; how many bytes."""
    done = 0
    while (most is None or done < most) and (chunk := f.read(4 << 20 if most is None else min(4 << 20, most - done))):
        out.write(chunk)
        done += len(chunk)
    return done


def _move(store, source: str, target: str) -> None:
    try:
        store.move(source, target)
    except OSError:  # a store that does not replace
        store.delete_file(target)
        store.move(source, target)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XBaseSource)
