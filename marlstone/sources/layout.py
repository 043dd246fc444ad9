"""The xBase file layout: header, field descriptors, cells and memo files, as bytes."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

#: Fixed values of the format.
DELETED, LIVE, END, EOF = 0x2A, 0x20, 0x0D, 0x1A
VERSION, VERSION_MEMO = 0x03, 0x83
DBASE4_MEMO = b"\xff\xff\x08\x00"
MOST_MEMO = 16 << 20
MOST_RECORD = MOST_HEADER = 65535
DEFAULT_BLOCK = {"dbt": 512, "fpt": 64}
MEMO_BLOCK = DEFAULT_BLOCK["dbt"]


class LayoutError(ValueError):
    """A file that is not in the layout, or a value that does not fit."""

    def __init__(self, message: str, sqlstate: str = "58030"):
        super().__init__(f"{message} [SQLSTATE {sqlstate}]")  # a task's error comes to the driver as a text
        self.sqlstate = sqlstate


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    length: int
    decimals: int = 0
    offset: int = 0

    def spark(self) -> T.StructField:
        kinds = {"C": T.StringType(), "F": T.DoubleType(), "D": T.DateType(), "L": T.BooleanType(), "M": T.StringType(), "I": T.IntegerType(), "O": T.DoubleType(), "Y": T.DecimalType(19, 4), "T": T.TimestampNTZType()}
        kind = (T.DoubleType() if self.decimals else T.LongType()) if self.type == "N" else kinds.get(self.type, T.StringType())
        return T.StructField(self.name, kind, True, {"xbase": f"{self.type},{self.length},{self.decimals}"})


@dataclass(frozen=True)
class Header:
    version: int
    records: int
    size: int
    record: int
    fields: tuple[Field, ...]

    @property
    def has_memo(self) -> bool:
        return any(f.type == "M" for f in self.fields)


def read_header(f, charset: str = "utf-8") -> Header:
    f.seek(0)
    head = f.read(32)
    if len(head) < 32:
        raise LayoutError("the file is shorter than a header")
    version, (records, size, record) = head[0], struct.unpack("<iHH", head[4:12])
    if records < 0 or size < 33 or record < 1:
        raise LayoutError(f"corrupt header: {records} records, header of {size}, record of {record} bytes")
    raw = f.read(size - 32)
    ends = 2 if size % 32 == 2 else 1  # one maker ends the descriptors with two bytes
    fields, offset = [], 1
    for i in range((size - 32 - ends) // 32):
        d = raw[32 * i : 32 * i + 32]
        if len(d) < 32 or d[0] == END:
            break
        field = Field(d[:11].split(b"\0")[0].decode(charset, "replace").strip(), chr(d[11]), d[16], d[17], offset)
        fields.append(field)
        offset += field.length
    return Header(version, records, size, record, tuple(fields))


def header_bytes(fields: list[Field], records: int, today: date | None = None) -> bytes:
    check_fields(fields)
    today = today or date.today()
    version = VERSION_MEMO if any(f.type == "M" for f in fields) else VERSION
    size, record = 33 + 32 * len(fields), 1 + sum(f.length for f in fields)
    out = struct.pack("<BBBBiHH20x", version, today.year % 100, today.month, today.day, records, size, record)
    for f in fields:
        out += struct.pack("<11sc4xBB14x", f.name.encode("ascii", "replace")[:10], f.type.encode(), f.length, f.decimals)
    return out + bytes([END])


def check_fields(fields: list[Field]) -> None:
    if not fields:
        raise LayoutError("a table needs a column", "42000")
    for f in fields:
        if not 0 < f.length <= 255:
            raise LayoutError(f"length {f.length} of column {f.name}", "42000")
    if 1 + sum(f.length for f in fields) > MOST_RECORD:
        raise LayoutError("the record is longer than 65535 bytes", "54000")
    if 33 + 32 * len(fields) > MOST_HEADER:
        raise LayoutError("too many columns", "54000")


def placed(fields: list[Field]) -> tuple[Field, ...]:
    out, at = [], 1
    for f in fields:
        out.append(Field(f.name, f.type, f.length, f.decimals, at))
        at += f.length
    return tuple(out)


# cells to values


def blank(cell: bytes) -> bool:
    return all(b <= 32 for b in cell)


def number(cell: bytes, whole: bool) -> float | int | None:
    s = cell.decode("ascii", "replace").strip("\0 \t\r\n")
    try:
        v = float(s) if not whole or "." in s else int(s)
    except ValueError:
        return None
    return int(v) if whole else v


def day(cell: bytes) -> date | None:
    s = cell.decode("ascii", "replace").strip()
    if not re.fullmatch(r"[0-9]{8}", s):
        return None
    try:
        return date(int(s[:4]), int(s[4:6]), int(s[6:]))
    except ValueError:
        return None


def moment(cell: bytes, epoch: str = "serial") -> datetime | None:
    """``serial``: days since 1899-12-30; ``julian``: Julian day numbers."""
    days, ms = struct.unpack("<ii", cell[:8])
    if not days and not ms or blank(cell):
        return None
    try:
        return datetime(1970, 1, 1) + timedelta(days=days - (25569 if epoch == "serial" else 2440588), milliseconds=ms)
    except OverflowError:
        return None


def memo_block(cell: bytes) -> int:
    s = cell.decode("ascii", "replace").strip()
    if s.isdigit():
        return int(s)
    return struct.unpack("<i", cell)[0] if len(cell) == 4 else 0


class Memo:
    """Reads a memo file; ``kind`` is fpt or dbt."""

    def __init__(self, f, kind: str):
        self.f, self.kind = f, kind
        f.seek(0, 2)
        self.size = f.tell()
        f.seek(0)
        head = f.read(22)
        size = int.from_bytes(head[6:8], "big") if kind == "fpt" else int.from_bytes(head[20:22], "little")
        self.block = size if size >= (1 if kind == "fpt" else 16) else DEFAULT_BLOCK[kind]

    def read(self, block: int, charset: str) -> str | None:
        if block <= 0:
            return None
        if block * self.block >= self.size:
            return ""
        self.f.seek(block * self.block)
        head = self.f.read(8)
        if self.kind == "fpt":
            kind, n = struct.unpack(">ii", head.ljust(8, b"\0"))
            data = self.f.read(min(n, MOST_MEMO)) if n > 0 else b""
            return data.decode(charset if kind == 1 else "latin-1", "replace")
        if head[:4] == DBASE4_MEMO:
            n = struct.unpack("<i", head[4:8])[0] - 8
            return self.f.read(min(n, MOST_MEMO)).decode(charset, "replace") if n > 0 else ""
        text = head
        while EOF not in text and len(text) < MOST_MEMO and (more := self.f.read(self.block)):
            text += more
        return text.split(bytes([EOF]))[0].decode(charset, "replace")


def memo_blocks(text: bytes) -> bytes:
    """A memo of the oldest kind: its text and two ends, in whole blocks."""
    return (text + bytes([EOF, EOF])).ljust(-(-(len(text) + 2) // MEMO_BLOCK) * MEMO_BLOCK, b"\0")


def memo_head(blocks: int) -> bytes:
    """The first block of a memo file of so many blocks, itself included."""
    return struct.pack("<i12xB495x", blocks, VERSION)


# values to cells


def cell(value: object, f: Field, charset: str) -> bytes:
    if value is None:
        return b" " * f.length
    if f.type in "NF":
        return _number_cell(value, f)
    if f.type == "D":
        s = value.strftime("%Y%m%d") if isinstance(value, date) else str(value).strip().replace("-", "")
        if s and not re.fullmatch(r"[0-9]{8}", s):
            raise LayoutError(f"no date: {value!r} for column {f.name}", "22007")
        return s.encode().ljust(f.length)[: f.length]
    if f.type == "L":
        return b"Y" if value is True or (isinstance(value, str) and value.upper() in ("Y", "T", "TRUE")) else b"N"
    if f.type == "I":
        return struct.pack("<i", int(value))
    if f.type == "O":
        return struct.pack("<d", float(value))
    return str(value)[: f.length].encode(charset, "replace")[: f.length].ljust(f.length)


def cells(column: pa.Array, f: Field, charset: str) -> np.ndarray:
    """The cells of a column, a row of bytes each: as a whole where Arrow can format it, else value by value."""
    n, shown = len(column), None
    try:
        if f.type == "C" and pa.types.is_string(column.type) and charset.lower() in ("utf-8", "utf8") and pc.all(pc.string_is_ascii(column)).as_py() is not False:
            shown = pc.utf8_rpad(pc.utf8_slice_codeunits(column.fill_null(""), 0, f.length), f.length, " ")
        elif f.type == "N" and pa.types.is_integer(column.type) and not f.decimals:
            shown = pc.utf8_lpad(column.cast(pa.string()).fill_null(""), f.length, " ")
        elif f.type == "N" and f.decimals and (pa.types.is_floating(column.type) or pa.types.is_decimal(column.type)):
            exact = (column.cast(pa.string()) if pa.types.is_floating(column.type) else column).cast(pa.decimal128(38, 16))
            shown = pc.utf8_lpad(pc.round(exact, f.decimals, "half_towards_infinity").cast(pa.decimal128(38, f.decimals)).cast(pa.string()).fill_null(""), f.length, " ")
        elif f.type == "D" and pa.types.is_date32(column.type):
            shown = pc.utf8_rpad(pc.strftime(column, "%Y%m%d").fill_null(""), f.length, " ")
        elif f.type == "L" and pa.types.is_boolean(column.type):
            shown = pc.if_else(column, "Y", "N").fill_null(" ")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        shown = None
    if shown is not None and n:
        data = shown.cast(pa.binary()) if shown.offset == 0 else pa.concat_arrays([shown]).cast(pa.binary())
        size = np.frombuffer(data.buffers()[1], np.int32, n + 1)
        if (np.diff(size) == f.length).all():
            return np.frombuffer(data.buffers()[2], np.uint8)[size[0] : size[-1]].reshape(n, f.length)
    return np.frombuffer(b"".join(cell(v, f, charset) for v in column.to_pylist()), np.uint8).reshape(n, f.length)


def _number_cell(value: object, f: Field) -> bytes:
    if isinstance(value, str):
        if not value.strip():
            return b" " * f.length
        try:
            value = Decimal(value.strip())
        except ArithmeticError as e:
            raise LayoutError(f"{value!r} is no number (column {f.name})", "22018") from e
    exact = value if isinstance(value, Decimal) else Decimal(repr(value)) if isinstance(value, float) else Decimal(int(value))
    if not exact.is_finite():
        raise LayoutError(f"{value} is no finite number (column {f.name})", "22003")
    s = str(exact.quantize(Decimal(1).scaleb(-f.decimals), ROUND_HALF_UP)) if f.decimals else str(int(exact))
    if len(s) > f.length:
        raise LayoutError(f"{value} does not fit column {f.name} {f.type}({f.length},{f.decimals})", "22003")
    return s.encode().rjust(f.length)
