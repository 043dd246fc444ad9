"""Records as they are appended to an xBase table, as a stream: ``spark.readStream.format("xbase").load(path)``.

An offset is a number of records, so a micro-batch is the range of records appended since the last one, read and decoded like
any other range, and a replay after a failure reads the same records. Records that are changed in place, deleted or packed later
are not sent again; a table that has become shorter than its offset is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceStreamReader

from ..sources import xbase
from ..sources.layout import LayoutError


class Appended(DataSourceStreamReader):
    """Options are those of a read, and ``starting_record`` (1): the first record that is sent."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema

    def _header(self):
        return xbase.header_of(self.options["path"], self.options.get("charset", "utf-8"))

    def initialOffset(self) -> dict:
        return {"records": int(self.options.get("starting_record", 1)) - 1}

    def latestOffset(self) -> dict:
        return {"records": self._header().records}

    def partitions(self, start: dict, end: dict) -> list[xbase.Range]:
        if end["records"] < start["records"]:
            raise LayoutError(f"the table has {end['records']} records, {start['records']} were read before")
        return xbase.ranges(start["records"] + 1, end["records"] + 1, self.options)

    def read(self, part: xbase.Range) -> Iterator[pa.RecordBatch]:
        return xbase.XBaseReader(self.options, self.schema, self._header()).read(part)
