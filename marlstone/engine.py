"""A folder of tables as a database: queries as DataFrames, changes as new versions of a table's file.

``Database(spark, folder).sql("SELECT ...")`` gives a DataFrame; ``execute`` runs any statement. Tables are ``<name>.dbf``
(names in any case) or, to read only, ``<name>.parquet``. The folder is one that driver and executors share.

A change writes the whole new table beside the old one, by Spark, and swaps the files; within ``transaction()`` all swaps wait
for its end, and an error drops them. What is to be swapped is first written to a journal, by one rename; a folder with a journal
is put right when it is opened, so a crash leaves either all of a change or nothing. A writer holds ``<table>.lck`` from before it
reads a table until its change is in place, so no change is lost to another; readers do not wait. Old readers keep the old file.

Indexes (.ntx) of a table are built anew with each change, unless ``index_write`` is off. A query over one table reads the records
that a fresh index of it gives, unless ``index_read`` is off; ``plan`` tells which.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .cursor import Cursor
from .errors import EngineError
from .plans import compiler, indexes, syntax
from .session import importable
from .sources import layout, ntx, xbase
from .sources.layout import Field

#: SQL types to (field type, default length, decimals).
TYPES = {
    **dict.fromkeys(("CHAR", "CHARACTER", "VARCHAR"), ("C", 30, 0)),
    **dict.fromkeys(("NUMERIC", "DECIMAL", "NUMBER"), ("N", 10, 0)),
    **dict.fromkeys(("INT", "INTEGER"), ("N", 10, 0)),
    "SMALLINT": ("N", 6, 0), "BIGINT": ("N", 18, 0),
    **dict.fromkeys(("DOUBLE", "FLOAT", "REAL"), ("N", 18, 5)),
    "DATE": ("D", 8, 0),
    **dict.fromkeys(("BOOLEAN", "LOGICAL", "BIT"), ("L", 1, 0)),
    **dict.fromkeys(("MEMO", "TEXT", "CLOB", "LONGVARCHAR"), ("M", 10, 0)),
}
MOST = {"C": 254, "N": 19}
#: Records that an index gives a query at most; a share of the table's; entries looked at to tell whose an index is.
MOST_FOUND, MOST_SHARE, SAMPLE = 10_000, 4, 64
JOURNAL = ".journal"


def field_of(name: str, kind: str, sizes: Sequence[int]) -> Field:
    if len(name) > 10 or not name.isascii() or not name.replace("_", "a").isalnum() or not name[0].isalpha():
        raise EngineError(f"column name {name!r}: up to 10 letters, digits and _, a letter first")
    if kind.upper() not in TYPES:
        raise EngineError(f"unsupported column type {kind}")
    code, length, decimals = TYPES[kind.upper()]
    if sizes and (code == "C" or kind.upper() in ("NUMERIC", "DECIMAL", "NUMBER")):
        length, decimals = sizes[0], sizes[1] if len(sizes) > 1 else 0
        if not 1 <= length <= MOST[code]:
            raise EngineError(f"length {length} of {name}: 1 to {MOST[code]}")
        if decimals and decimals > length - 2:
            raise EngineError(f"scale {decimals} of {name} leaves no room for the integer part")
    return Field(name.upper(), code, length, decimals)


def spec(fields: Sequence[Field]) -> str:
    return ";".join(f"{f.name},{f.type},{f.length},{f.decimals}" for f in fields)


class Database:
    def __init__(self, spark: SparkSession, folder: str, mode: str = "ansi", charset: str = "utf-8", max_rows: int | None = None,
                 index_read: bool = True, index_write: bool = True, lock_seconds: float = 10.0, **read_options: object):
        if not os.path.isdir(folder):
            raise EngineError(f"no folder: {folder}", "08001")
        importable(spark)
        xbase.register(spark)
        ntx.register(spark)
        self.spark, self.folder, self.mode, self.charset, self.max_rows, self.read_options = spark, folder, mode, charset, max_rows, read_options
        self.index_read, self.index_write, self.lock_seconds = index_read, index_write, lock_seconds
        self._staged: dict[str, str | None] | None = None
        self._held: list[str] = []
        self._owners: dict[tuple, bool] = {}
        if os.path.exists(os.path.join(folder, JOURNAL)):
            with self._writing(".journal-replay"):
                self._replay()

    # catalog
    def tables(self) -> list[str]:
        return sorted({os.path.splitext(f)[0] for f in os.listdir(self.folder) if f.lower().endswith((".dbf", ".parquet"))})

    def columns(self, table: str) -> DataFrame:
        """table, column, type, length, decimals, position."""
        fields = xbase.header_of(self._dbf(table), self.charset).fields
        return self.spark.createDataFrame([(table, f.name, f.type, f.length, f.decimals, i) for i, f in enumerate(fields, 1)], "table string, column string, type string, length int, decimals int, position int")

    def _path(self, table: str) -> str | None:
        base = table[:-4] if table.lower().endswith(".dbf") else table
        if self._staged is not None and base.lower() in self._staged:
            return self._staged[base.lower()]
        for ext in (".dbf", ".parquet"):
            for f in os.listdir(self.folder):
                if f.lower() == base.lower() + ext:
                    return os.path.join(self.folder, f)
        return None

    def _dbf(self, table: str) -> str:
        path = self._path(table)
        if not path or path.endswith(".parquet"):
            raise EngineError(f"Table not found: {table}" if not path else f"{table} is read-only", "42S02")
        return path

    def table(self, name: str, columns: set[str] | None = None, include_deleted: bool = False) -> DataFrame:
        """A table, with hidden columns ``_recno`` and ``_deleted`` if it is an xBase one; ``columns``: decode no others."""
        path = self._path(name)
        if not path:
            raise EngineError(f"Table not found: {name}", "42S02")
        if path.endswith(".parquet"):
            return self.spark.read.parquet(path)
        reader = self.spark.read.format("xbase").option("charset", self.charset).option("include_deleted", str(include_deleted).lower())
        for k, v in self.read_options.items():
            reader = reader.option(k, str(v))
        if columns is not None:
            reader = reader.option("columns", ",".join(sorted(columns)) or "_recno")
        df = reader.load(path)
        return df.drop(*[c for c in df.columns if columns is not None and c.upper() not in columns and c not in compiler.HIDDEN])

    # indexes
    def indexes(self, table: str) -> DataFrame:
        """index, expression, key_length, is_unique of the table's .ntx files (those whose key the table's columns can make)."""
        fields, rows = xbase.header_of(self._dbf(table), self.charset).fields, []
        for f in sorted(os.listdir(self.folder)):
            if f.lower().endswith(".ntx"):
                with xbase.open_at(os.path.join(self.folder, f)) as at:
                    tree = ntx.Tree.of(at)
                try:
                    ntx.key_expression(tree.expression, fields)
                except ValueError:
                    continue
                rows.append((f, tree.expression, tree.key_length, tree.unique))
        return self.spark.createDataFrame(rows, "index string, expression string, key_length int, is_unique boolean")

    def create_index(self, table: str, expression: str, name: str) -> int:
        """Builds ``<name>.ntx`` of a table's live records."""
        fields = xbase.header_of(self._dbf(table), self.charset).fields
        return ntx.build(self.table(table), fields, expression, os.path.join(self.folder, f"{name}.ntx"))

    def seek(self, table: str, index: str, prefix: str = "") -> DataFrame:
        """The records whose key in the index begins with ``prefix``, with ``_key``; deleted ones, and those whose key is another by now, are left out."""
        at = os.path.join(self.folder, index)
        with xbase.open_at(at) as f:
            expression = ntx.Tree.of(f).expression
        found = self.spark.read.format("ntx").option("prefix", prefix).load(at)
        rows = self.table(table).withColumn("_now", ntx.key_expression(expression, xbase.header_of(self._dbf(table), self.charset).fields))
        same = (F.col("_recno") == F.col("_at")) & F.col("_now").startswith(F.rtrim("_key"))
        return rows.join(found.select(F.col("key").alias("_key"), F.col("recno").alias("_at")), same).drop("_at", "_now")

    def _trees(self, path: str) -> Iterator[tuple[str, ntx.Tree]]:
        """The indexes that a table's columns can make, and that its records bear out."""
        fields = xbase.header_of(path, self.charset).fields
        for f in sorted(os.listdir(self.folder)):
            if not f.lower().endswith(".ntx"):
                continue
            at = os.path.join(self.folder, f)
            try:
                with xbase.open_at(at) as file:
                    tree = ntx.Tree.of(file)
                    stamp = (at, os.path.getmtime(at), path, os.path.getmtime(path))
                    if stamp not in self._owners:
                        key = ntx.key_expression(tree.expression, fields)
                        self._owners[stamp] = self._bears_out(path, tree, key, [x for _, x in zip(range(SAMPLE), tree.walk(file, tree.root))])
                if self._owners[stamp]:
                    yield at, tree
            except (ValueError, OSError, IndexError):
                continue  # an index of another table, or none

    def _bears_out(self, path: str, tree: ntx.Tree, key, sample: list[tuple[bytes, int]]) -> bool:
        if not sample:
            return xbase.header_of(path, self.charset).records == 0
        every = self.spark.read.format("xbase").option("charset", self.charset).option("include_deleted", "true").load(path)
        have = {r[0]: r[1] for r in every.filter(F.col("_recno").isin([n for _, n in sample])).select("_recno", F.encode(key, "ISO-8859-1")).collect()}
        return all(bytes(have.get(n) or b"").ljust(tree.key_length)[: tree.key_length] == k for k, n in sample)

    def _indexed(self, query: dict, mode: str) -> tuple[str, list[int], indexes.Reach] | None:
        """An index for a query over one table, the records that it gives, and the part that was read."""
        if not self.index_read or query["joins"] or query["where"] is None or self._staged is not None:
            return None
        path = self._path(query["from"][0])
        if not path or path.endswith(".parquet") or not any(f.lower().endswith(".ntx") for f in os.listdir(self.folder)):
            return None
        header, best = xbase.header_of(path, self.charset), None
        rowwise = not (query["group"] or query["having"] or query["distinct"] or any(compiler.aggregates(e) for e, _ in query["items"]))
        limit = min([x for x in (query["limit"], self.max_rows) if x is not None], default=None) if rowwise else None
        for at, tree in self._trees(path):
            r = None if tree.unique or os.path.getmtime(at) < os.path.getmtime(path) else indexes.reach(query["where"], query["order"], limit, tree.expression, header.fields, mode)
            if r is None:
                continue
            most = limit if r.ordered else min(MOST_FOUND, header.records // MOST_SHARE)
            if most > MOST_FOUND:
                continue
            with xbase.open_at(at) as f:
                found = [x for _, x in zip(range(most + (not r.ordered)), tree.walk(f, tree.root, r.prefix.encode("latin-1")))]
            if r.ordered and all(k.isascii() and b"?" not in k for k, _ in found):
                return os.path.basename(at), [n for _, n in found], r
            if not r.ordered and len(found) <= most and (best is None or len(found) < len(best[1])):
                best = os.path.basename(at), [n for _, n in found], r
        return best

    def plan(self, text: str, mode: str | None = None) -> dict[str, object] | None:
        """The index that a query reads: index, prefix, ordered, records; None if it scans."""
        hit = self._indexed(syntax.parse(text)["query"], mode or self.mode)
        return hit and {"index": hit[0], "prefix": hit[2].prefix, "ordered": hit[2].ordered, "records": hit[1]}

    # queries
    def sql(self, text: str, params: Sequence = (), mode: str | None = None) -> DataFrame:
        s = syntax.parse(text)
        if s["do"] != "select":
            raise EngineError("not a query; use execute()")
        return self._select(s["query"], params, mode)

    def _select(self, query: dict, params: Sequence, mode: str | None = None) -> DataFrame:
        hit = self._indexed(query, mode or self.mode)

        def table(name: str, columns: set[str] | None = None) -> DataFrame:
            df = self.table(name, columns)
            return df.filter(F.col("_recno").isin(hit[1])) if hit else df

        return compiler.select(query, table, mode or self.mode, params, self.max_rows)

    def cursor(self, text: str, params: Sequence = (), mode: str | None = None, timeout: float | None = None) -> Cursor:
        """A query's rows one after the other, with typed getters."""
        return Cursor(self.sql(text, params, mode), timeout)

    def execute(self, text: str, params: Sequence = ()) -> DataFrame | int:
        """A query's DataFrame, or how many rows a change has touched (0 for definitions)."""
        s = syntax.parse(text)
        if s["do"] == "select":
            return self._select(s["query"], params)
        named = [s["from"][0], *(t for _, (t, _), _ in s["joins"])] if s["do"] == "update" else [s["table"], *([s["to"]] if s.get("change") == "rename" else [])]
        with self._writing(*named):
            return getattr(self, f"_{s['do']}")(s, params)

    def execute_many(self, text: str, rows: Sequence[Sequence]) -> DataFrame:
        """One INSERT with parameters for all rows, as a single append; gives the new record numbers (column RECNO)."""
        s = syntax.parse(text)
        if s["do"] != "insert":
            raise EngineError("execute_many takes INSERT")
        with self._writing(s["table"]):
            return self._append(s, [(r, params) for params in rows for r in s["rows"]])

    def batch(self, statements: Sequence[str]) -> list[int]:
        """Runs changes in turn; -3 for each that fails."""
        out = []
        for text in statements:
            try:
                n = self.execute(text)
                out.append(n if isinstance(n, int) else 0)
            except Exception:  # noqa: BLE001  the batch goes on, as callers of batches expect
                out.append(-3)
        return out

    # transactions
    @contextmanager
    def transaction(self):
        """All changes within become visible to others at the end; an error drops them."""
        if self._staged is not None:
            raise EngineError("a transaction is open", "25001")
        self._staged = {}
        try:
            yield self
            staged, self._staged = self._staged, None
            self._swap(staged)
        except BaseException:
            for path in (self._staged or {}).values():
                _discard(path)
            self._staged = None
            raise
        finally:
            self._release(self._held)

    @contextmanager
    def _writing(self, *tables: str):
        """Holds the tables' locks; within a transaction, until its end."""
        taken = []
        try:
            for base in sorted({_base(t) for t in tables}):
                if base not in self._held:
                    self._lock(base)
                    taken.append(base)
            yield
        finally:
            if self._staged is None:
                self._release(taken)

    def _lock(self, base: str) -> None:
        path, until = os.path.join(self.folder, f"{base}.lck"), time.monotonic() + self.lock_seconds
        while True:
            try:
                with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(f"{os.getpid()}")
                self._held.append(base)
                return
            except FileExistsError:
                if time.monotonic() >= until:
                    raise EngineError(f"{base} is locked by another writer ({path})", "55006") from None
                time.sleep(0.05)

    def _release(self, bases: Sequence[str]) -> None:
        for base in list(bases):
            if base in self._held:
                self._held.remove(base)
                os.remove(os.path.join(self.folder, f"{base}.lck"))

    def _fresh(self, base: str) -> str:
        folder = os.path.join(self.folder, f".{base}.{uuid.uuid4().hex}")
        os.makedirs(folder)
        return os.path.join(folder, f"{base}.dbf")

    def _swap(self, staged: dict[str, str | None]) -> None:
        """Puts new versions in the tables' places; None drops a table. All of it or, before the journal's rename, nothing."""
        moves, gone, rebuild = [], [], []
        for base, path in staged.items():
            old = self._path(base)
            if path is None:
                gone += [f for f in (old, *(xbase._siblings(old, e) for e in ("dbt", "fpt", "ndx", "mdx"))) if f]
                continue
            target = old or os.path.join(self.folder, f"{base}.dbf")
            if old and self.index_write:
                rebuild += [(base, at, tree.expression) for at, tree in self._trees(old)]
            side = os.path.splitext(path)[0] + ".dbt"
            if os.path.exists(side):
                moves.append((side, (xbase._siblings(target, "dbt") if old else None) or os.path.splitext(target)[0] + ".dbt"))
            moves.append((path, target))
        journal = os.path.join(self.folder, JOURNAL)
        with open(f"{journal}.{uuid.uuid4().hex}", "w") as f:
            json.dump({"moves": moves, "gone": gone}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, journal)
        self._replay()
        for base, at, expression in rebuild:
            try:
                ntx.build(self.table(base), xbase.header_of(self._dbf(base), self.charset).fields, expression, at)
            except ValueError:
                os.remove(at)  # its columns are no more

    def _replay(self) -> None:
        """Does what the journal says and is not done yet."""
        journal = os.path.join(self.folder, JOURNAL)
        with open(journal) as f:
            what = json.load(f)
        for source, target in what["moves"]:
            if os.path.exists(source):
                os.replace(source, target)
        for path in what["gone"]:
            if os.path.exists(path):
                os.remove(path)
        for folder in {os.path.dirname(source) for source, _ in what["moves"]}:
            shutil.rmtree(folder, ignore_errors=True)
        os.remove(journal)

    def _publish(self, table: str, df: DataFrame, fields: Sequence[Field]) -> None:
        base = _base(table)
        path = self._fresh(base)
        df.write.format("xbase").option("charset", self.charset).option("fields", spec(fields)).mode("overwrite").save(path)
        if self._staged is not None:
            _discard(self._staged.get(base))
            self._staged[base] = path
        else:
            self._swap({base: path})

    # changes
    def _whole(self, table: str) -> tuple[DataFrame, list[Field]]:
        fields = list(xbase.header_of(self._dbf(table), self.charset).fields)
        return self.table(table, include_deleted=True), fields

    def _scope(self, df: DataFrame, alias: str, params: Sequence) -> compiler.Scope:
        return compiler.Scope(df, [(alias, c.upper(), c) for c in df.columns], self.mode, params)

    def _insert(self, s: dict, params: Sequence) -> int:
        return self._append(s, [(r, params) for r in s["rows"]]).count()

    def _append(self, s: dict, rows: Sequence[tuple]) -> DataFrame:
        path = self._dbf(s["table"])
        header = xbase.header_of(path, self.charset)
        fields = list(header.fields)
        at = {f.name.upper(): f for f in fields}
        cols = s["columns"] or list(at)
        if unknown := [c for c in cols if c not in at]:
            raise EngineError(f"Column not found: {unknown[0]}", "42S22")
        values = []
        for row, params in rows:
            if len(row) > len(cols):
                raise EngineError("more values than columns", "21S01")
            given = dict(zip(cols, row))
            values.append([_literal(given.get(f.name.upper(), ("null",)), params) for f in fields])
        kinds = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
        new = self.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in values], kinds).coalesce(1)
        if self._staged is not None:
            old, _ = self._whole(s["table"])
            kept = old.orderBy("_recno").select(*[F.col(f.name).cast("string") for f in fields], F.col("_deleted"))
            self._publish(s["table"], kept.unionByName(new, allowMissingColumns=True), fields)
        else:
            owned = [(at, tree.expression) for at, tree in self._trees(path)] if self.index_write else []
            new.write.format("xbase").option("charset", self.charset).mode("append").save(path)
            for at, expression in owned:
                ntx.build(self.table(s["table"]), fields, expression, at)
        return self.spark.range(header.records + 1, header.records + len(values) + 1).withColumnRenamed("id", "RECNO")

    def _update(self, s: dict, params: Sequence) -> int:
        table, alias = s["from"]
        df, fields = self._whole(table)
        known = {f.name.upper(): f.name for f in fields}
        if unknown := [c for c, _ in s["set"] if c not in known]:
            raise EngineError(f"Column not found: {unknown[0]}", "42S22")
        if s["joins"]:
            return self._update_join(s, df, fields, known, params)
        scope = self._scope(df, alias, params)
        hit = ~F.col("_deleted") & (F.coalesce(scope.condition(s["where"]), F.lit(False)) if s["where"] else F.lit(True))
        new = {known[c]: scope(e) for c, e in s["set"]}
        out = df.select(*[_changed(f, F.when(hit, new[f.name].cast(df.schema[f.name].dataType)).otherwise(F.col(f.name)) if f.name in new else F.col(f.name)) for f in fields], "_deleted", "_recno")
        n = df.filter(hit).count()
        self._publish(table, out.orderBy("_recno").drop("_recno"), fields)
        return n

    def _update_join(self, s: dict, df: DataFrame, fields: list[Field], known: dict[str, str], params: Sequence) -> int:
        """Every record takes the values of the first row that it joins with."""
        query = {"from": s["from"], "joins": s["joins"], "items": [(("star", None), None)], "where": None, "having": None, "group": [], "order": []}
        joined = compiler.source({**query, "joins": [("inner", t, on) for _, t, on in s["joins"]]}, self.table, self.mode, params)
        if s["where"]:
            joined.df = joined.df.filter(joined.condition(s["where"]))
        firsts = [c for a, n, c in joined.columns if n == "_RECNO"]
        new = joined.df.select(F.col(firsts[0]).alias("_at"), *[joined(e).alias(f"_n{i}") for i, (_, e) in enumerate(s["set"])], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(firsts[1:])])
        rank = Window.partitionBy("_at").orderBy(*[f"_r{i}" for i in range(len(firsts) - 1)])
        new = new.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1")
        place = {known[c]: f"_n{i}" for i, (c, _) in enumerate(s["set"])}
        both = df.join(new, F.col("_recno") == F.col("_at"), "left")
        out = both.select(*[_changed(f, F.when(F.col("_at").isNotNull(), F.col(place[f.name]).cast(df.schema[f.name].dataType)).otherwise(F.col(f.name)) if f.name in place else F.col(f.name)) for f in fields], "_deleted", "_recno")
        n = new.count()
        self._publish(s["from"][0], out.orderBy("_recno").drop("_recno"), fields)
        return n

    def _delete(self, s: dict, params: Sequence) -> int:
        df, fields = self._whole(s["table"])
        scope = self._scope(df, s["table"].upper(), params)
        hit = ~F.col("_deleted") & (F.coalesce(scope.condition(s["where"]), F.lit(False)) if s["where"] else F.lit(True))
        n = df.filter(hit).count()
        self._publish(s["table"], df.withColumn("_deleted", F.col("_deleted") | hit).orderBy("_recno").drop("_recno"), fields)
        return n

    def undelete(self, table: str, where: str | None = None) -> int:
        """Takes back the deleted flag."""
        with self._writing(table):
            return self._undelete(table, where)

    def _undelete(self, table: str, where: str | None) -> int:
        df, fields = self._whole(table)
        hit = F.col("_deleted") & (F.expr(where) if where else F.lit(True))
        n = df.filter(hit).count()
        self._publish(table, df.withColumn("_deleted", F.col("_deleted") & ~hit).orderBy("_recno").drop("_recno"), fields)
        return n

    def pack(self, table: str) -> int:
        """Drops deleted records for good."""
        with self._writing(table):
            return self._pack(table)

    def _pack(self, table: str) -> int:
        df, fields = self._whole(table)
        n = df.filter("_deleted").count()
        self._publish(table, df.filter("not _deleted").orderBy("_recno").drop("_recno"), fields)
        return n

    def _create(self, s: dict, params: Sequence) -> int:
        if self._path(s["table"]):
            if s["quiet"]:
                return 0
            raise EngineError(f"Table exists: {s['table']}", "42S01")
        fields = [field_of(*c) for c in s["columns"]]
        layout.check_fields(fields)
        self._publish(s["table"], self._rows(fields), fields)
        return 0

    def _rows(self, fields: Sequence[Field]) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([f.spark() for f in fields]))

    def _drop(self, s: dict, params: Sequence) -> int:
        if not self._path(s["table"]):
            if s["quiet"]:
                return 0
            raise EngineError(f"Table not found: {s['table']}", "42S02")
        self._dbf(s["table"])
        if self._staged is not None:
            self._staged[_base(s["table"])] = None
        else:
            self._swap({_base(s["table"]): None})
        return 0

    def _alter(self, s: dict, params: Sequence) -> int:
        df, fields = self._whole(s["table"])
        at = {f.name.upper(): f.name for f in fields}
        change = s["change"]
        if change == "rename":
            if self._path(s["to"]):
                raise EngineError(f"Table exists: {s['to']}", "42S01")
            self._publish(s["to"], df.orderBy("_recno").drop("_recno"), fields)
            return self._drop({"table": s["table"], "quiet": False}, params)
        if change == "add":
            new = field_of(*s["column"])
            if new.name in at:
                raise EngineError(f"Column exists: {new.name}", "42S21")
            df, fields = df.withColumn(new.name, F.lit(None).cast(new.spark().dataType)), [*fields, new]
        else:
            if s["name"] not in at:
                raise EngineError(f"Column not found: {s['name']}", "42S22")
            if change == "drop":
                if len(fields) == 1:
                    raise EngineError("a table needs a column")
                df, fields = df.drop(at[s["name"]]), [f for f in fields if f.name.upper() != s["name"]]
            else:
                name = field_of(s["to"], "DATE", []).name
                if name in at:
                    raise EngineError(f"Column exists: {name}", "42S21")
                df = df.withColumnRenamed(at[s["name"]], name)
                fields = [Field(name, f.type, f.length, f.decimals) if f.name.upper() == s["name"] else f for f in fields]
        self._publish(s["table"], df.orderBy("_recno").drop("_recno"), fields)
        return 0


def _base(table: str) -> str:
    return (table[:-4] if table.lower().endswith(".dbf") else table).lower()


def _changed(f: Field, c) -> object:
    return c.alias(f.name)


def _discard(path: str | None) -> None:
    if path:
        shutil.rmtree(os.path.dirname(path), ignore_errors=True)


def _literal(e: tuple, params: Sequence) -> object:
    """The value of a VALUES item."""
    if e[0] in ("num", "str", "date", "bool"):
        return e[1]
    if e[0] == "null":
        return None
    if e[0] == "param":
        if e[1] >= len(params):
            raise EngineError(f"Parameter {e[1] + 1} is not set", "07001")
        return params[e[1]]
    if e[0] == "neg" and e[1][0] == "num":
        return -e[1][1]
    raise EngineError("VALUES takes literals and parameters")
