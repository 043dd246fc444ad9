"""The dialect over xBase files: reading, changing, defining, transactions, both modes."""

import datetime as dt
import struct

import pytest

from marlstone.engine import Database, EngineError
from marlstone.plans.compiler import CompileError
from marlstone.plans.syntax import SyntaxProblem
from marlstone.sources import layout, xbase


def by_hand(path, fields, records, tail=b"\x1a", version=3, ends=1):
    """A file put together from bytes, not by the writer under test."""
    size, rec = 32 + 32 * len(fields) + ends, 1 + sum(f[2] for f in fields)
    out = bytes([version, 124, 1, 2]) + struct.pack("<iHH", len(records), size, rec) + bytes(20)
    for name, kind, n, dec in fields:
        out += name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([n, dec]) + bytes(14)
    out += b"\x0d" * ends
    for r in records:
        assert len(r) == rec
        out += r
    path.write_bytes(out + tail)


@pytest.fixture()
def folder(tmp_path):
    by_hand(tmp_path / "Master.dbf", [("C_HEAD", "N", 6, 0), ("NAME", "C", 8, 0), ("BAL", "N", 10, 2), ("DOB", "D", 8, 0), ("OK", "L", 1, 0)], [
        b" " + b"     1" + b"CAlpha  " + b"    100.50" + b"20240229" + b"Y",
        b"*" + b"     2" + b"Gone    " + b"      1.00" + b"20240101" + b"N",
        b" " + b"     3" + b"cabeta  " + b"     -2.25" + b"20230230" + b"t",
        b" " + b"     4" + b"        " + b"          " + b"        " + b"?",
        b" " + b"   abc" + b"CAgamma " + b"      7.00" + b"20250401" + b" ",
    ])
    by_hand(tmp_path / "tran.dbf", [("ENTRY", "N", 4, 0), ("DEBIT", "C", 6, 0), ("AMT", "N", 8, 0)], [b" " + b"   1" + b"01    " + b"      10", b" " + b"   2" + b"3     " + b"      21", b" " + b"   3" + b"1.0   " + b"       2", b" " + b"   4" + b"      " + b"       5"], ends=2)
    return tmp_path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_decode(spark, folder):
    db = Database(spark, str(folder))
    assert rows(db.sql("SELECT RECNO(), * FROM master")) == [
        (1, 1, "CAlpha  ", 100.5, dt.date(2024, 2, 29), True), (3, 3, "cabeta  ", -2.25, None, True), (4, 4, None, None, None, False), (5, None, "CAgamma ", 7.0, dt.date(2025, 4, 1), False)]
    assert rows(db.sql("SELECT NAME FROM MASTER WHERE RECNO = 5")) == [("CAgamma ",)]
    assert [r[0] for r in rows(db.sql("SELECT RECNO() n FROM master WHERE RECNO() BETWEEN 2 AND 4 ORDER BY n"))] == [3, 4]
    assert db.tables() == ["Master", "tran"] and db.columns("tran").count() == 3
    full = spark.read.format("xbase").option("include_deleted", "true").option("partition_records", 2).load(str(folder / "Master.dbf"))
    assert full.rdd.getNumPartitions() == 3 and [r._deleted for r in full.orderBy("_recno").collect()] == [False, True, False, False, False]


def test_flagship_and_order(spark, folder):
    db = Database(spark, str(folder))
    assert rows(db.sql("SELECT TOP 25 C_HEAD, NAME FROM MASTER WHERE OK = TRUE AND UCASE(NAME) LIKE 'CA%' ORDER BY UCASE(NAME)")) == [(3, "cabeta  "), (1, "CAlpha  ")]
    assert [r[0] for r in rows(db.sql("SELECT BAL FROM master ORDER BY BAL"))] == [None, -2.25, 7.0, 100.5]
    assert [r[0] for r in rows(db.sql("SELECT BAL FROM master ORDER BY 1 DESC LIMIT 2"))] == [100.5, 7.0]
    assert rows(db.sql("SELECT NAME FROM master WHERE DOB = #4/1/2025#")) == [("CAgamma ",)]
    assert rows(db.sql("SELECT `NAME`, [BAL] AS 'b', 'it''s' q, null n, 1.5 x, -2 y, 'a\\nb' z FROM master WHERE C_HEAD = ?", [1])) == [("CAlpha  ", 100.5, "it's", None, 1.5, -2, "a\nb")]


def test_aggregates(spark, folder):
    db = Database(spark, str(folder))
    assert rows(db.sql("SELECT OK, COUNT(*) n, SUM(BAL) s, MAX(BAL) + 1 m FROM master GROUP BY OK HAVING COUNT(*) > 1 ORDER BY n, OK")) == [(False, 2, 7.0, 8.0), (True, 2, 98.25, 101.5)]
    assert db.sql("SELECT COUNT(*), SUM(AMT), AVG(AMT) FROM tran").columns == ["COUNT_0", "SUM_1", "AVG_2"]
    assert rows(db.sql("SELECT COUNT(*) c, MIN(AMT) m FROM tran WHERE AMT > 99")) == [(0, None)]
    x = Database(spark, str(folder), mode="xbase")
    assert rows(x.sql("SELECT SUM(AMT) s, AVG(AMT) a, COUNT(DEBIT) c, COUNT(DISTINCT AMT) d FROM tran")) == [(38, 9, 3, 4)]
    assert [r[0] for r in rows(x.sql("SELECT LEFT(NAME, 2) p, COUNT(*) c FROM master GROUP BY LEFT(NAME, 2)"))] == [None, "CA", "ca"]
    with pytest.raises(CompileError):
        db.sql("SELECT *, COUNT(*) FROM master")


def test_joins(spark, folder):
    x = Database(spark, str(folder), mode="xbase")
    q = "SELECT t.ENTRY, m.NAME FROM tran t {} JOIN master m ON t.DEBIT = m.C_HEAD ORDER BY t.ENTRY"
    assert rows(x.sql(q.format("INNER"))) == [(1, "CAlpha  "), (2, "cabeta  "), (3, "CAlpha  ")]
    assert rows(x.sql(q.format("LEFT OUTER")))[-1] == (4, None)
    assert len(rows(x.sql(q.format("RIGHT")))) == 5 and len(rows(x.sql(q.format("FULL")))) == 6
    tree = "SELECT a.ENTRY, m.NAME n1, b.NAME n2 FROM ((tran a LEFT JOIN master m ON a.DEBIT = m.C_HEAD) LEFT JOIN master b ON a.ENTRY = b.C_HEAD) WHERE a.AMT > 4 ORDER BY a.ENTRY"
    assert rows(x.sql(tree)) == [(1, "CAlpha  ", "CAlpha  "), (2, "cabeta  ", None), (4, None, None)]
    assert x.sql("SELECT * FROM tran t JOIN tran u ON t.ENTRY = u.ENTRY").columns == ["T_ENTRY", "T_DEBIT", "T_AMT", "U_ENTRY", "U_DEBIT", "U_AMT"]
    with pytest.raises(CompileError):
        x.sql("SELECT t.ENTRY FROM tran t JOIN master m ON t.AMT > m.BAL")
    with pytest.raises(CompileError):
        x.sql("SELECT ENTRY FROM tran t JOIN tran u ON t.ENTRY = u.ENTRY")


def test_two_valued(spark, folder):
    x = Database(spark, str(folder), mode="xbase")
    count = lambda w: len(rows(x.sql(f"SELECT RECNO() r FROM master WHERE {w}")))
    assert [count(w) for w in ("NAME = NULL", "NAME <> NULL", "NOT (BAL > 1)", "NAME NOT LIKE 'C%'", "BAL NOT BETWEEN 0 AND 50", "C_HEAD IS NULL", "BAL IN (7, '100.5')", "OK")] == [1, 3, 2, 2, 3, 1, 2, 2]
    assert rows(x.sql("SELECT '10' + 'x' a, 1 + 2 b, 7 / 2 c, 1 / 0 d, LENGTH(NULL) e, CONCAT('a', NULL, 'b') f, ROUND(-2.5, 0) g, IIF('T', 1, 2) h FROM tran LIMIT 1")) == [("10x", 3, 3.5, None, 0, "ab", -2.0, 1)]
    assert rows(Database(spark, str(folder)).sql("SELECT CASE WHEN AMT > 9 THEN 'big' ELSE 'small' END c, CASE ENTRY WHEN 1 THEN 'one' END o, EXTRACT(YEAR FROM #2024-5-6#) y, CAST('12' AS INTEGER) i FROM tran WHERE ENTRY < 2")) == [("big", "one", 2024, 12)]


def test_changes(spark, folder):
    db = Database(spark, str(folder))
    db.execute("CREATE TABLE t (ID NUMERIC(6), NAME CHAR(10), BAL NUMERIC(12,2), DOB DATE, OK LOGICAL, NOTE MEMO)")
    db.execute("CREATE TABLE IF NOT EXISTS T (X INT)")
    assert db.execute("INSERT INTO t (ID, NAME, DOB, OK, NOTE) VALUES (1, 'Alice', #2024-01-31#, TRUE, 'a long note')") == 1
    assert [r.RECNO for r in db.execute_many("INSERT INTO t VALUES (?, ?, ?)", [(2, "Bob", 2.675), (3, "Al\tice the third", -0.5)]).collect()] == [2, 3]
    assert db.execute("INSERT INTO t (ID, NOTE) VALUES (4, 'second note'), (5, NULL)") == 2
    assert rows(db.sql("SELECT ID, RTRIM(NAME) n, BAL, DOB, OK, NOTE FROM t ORDER BY ID"))[:4] == [
        (1, "Alice", None, dt.date(2024, 1, 31), True, "a long note"), (2, "Bob", 2.68, None, False, None), (3, "Al\tice the", -0.5, None, False, None), (4, None, None, None, False, "second note")]
    assert db.execute("UPDATE t SET BAL = ID * 2, NAME = 'x' + NAME WHERE ID < 3") == 2
    assert db.execute("DELETE FROM t WHERE ID = 3") == 1
    assert rows(db.sql("SELECT RECNO() r, BAL FROM t WHERE BAL IS NOT NULL ORDER BY r")) == [(1, 2.0), (2, 4.0)]
    assert rows(db.sql("SELECT NOTE FROM t WHERE NOTE IS NOT NULL ORDER BY ID")) == [("a long note",), ("second note",)]
    assert db.undelete("t") == 1 and db.sql("SELECT ID FROM t").count() == 5
    assert db.execute("UPDATE t a JOIN tran b ON a.ID = b.ENTRY SET BAL = b.AMT WHERE b.AMT > 2") == 3
    assert [r[0] for r in rows(db.sql("SELECT BAL FROM t ORDER BY RECNO()"))] == [10.0, 21.0, -0.5, 5.0, None]
    db.execute("DELETE FROM t WHERE ID > 3")
    assert db.pack("t") == 2 and [r[0] for r in rows(db.sql("SELECT RECNO() FROM t"))] == [1, 2, 3]
    db.execute("ALTER TABLE t ADD COLUMN EMAIL CHAR(40)")
    db.execute("ALTER TABLE t DROP COLUMN OK")
    db.execute("ALTER TABLE t RENAME COLUMN NAME TO FULLNAME")
    db.execute("ALTER TABLE t RENAME TO people")
    assert db.sql("SELECT * FROM people").columns == ["ID", "FULLNAME", "BAL", "DOB", "NOTE", "EMAIL"]
    assert db.batch(["DELETE FROM people WHERE ID = 1", "DELETE FROM nowhere", "DROP TABLE people"]) == [1, -3, 0]
    db.execute("DROP TABLE IF EXISTS people")
    for bad in ("DROP TABLE people", "INSERT INTO tran (NOPE) VALUES (1)", "CREATE TABLE b (ABCDEFGHIJK INT)", "CREATE TABLE b (A NUMERIC(25))", "CREATE TABLE b (A POINT)", "CREATE TABLE tran (A INT)"):
        with pytest.raises(EngineError):
            db.execute(bad)
    with pytest.raises(Exception, match="does not fit"):
        db.execute("INSERT INTO tran (ENTRY) VALUES (123456)")
    assert db.sql("SELECT ENTRY FROM tran").count() == 4 and not [p for p in folder.iterdir() if "tmp" in p.name]


def test_transactions(spark, folder):
    db, other = Database(spark, str(folder)), Database(spark, str(folder))
    with pytest.raises(RuntimeError), db.transaction():
        db.execute("UPDATE tran SET AMT = 0")
        db.execute("INSERT INTO tran VALUES (9, 'x', 9)")
        assert rows(db.sql("SELECT SUM(AMT) s, COUNT(*) c FROM tran")) == [(9, 5)] and rows(other.sql("SELECT SUM(AMT) s FROM tran")) == [(38,)]
        raise RuntimeError
    assert rows(db.sql("SELECT SUM(AMT) s FROM tran")) == [(38,)]
    with db.transaction():
        db.execute("UPDATE tran SET AMT = AMT + 1 WHERE ENTRY = 1")
        db.execute("DELETE FROM tran WHERE ENTRY = 4")
        db.execute("DROP TABLE master")
    assert rows(other.sql("SELECT SUM(AMT) s FROM tran")) == [(34,)] and other.tables() == ["tran"]
    assert not [p for p in folder.iterdir() if p.name.startswith(".")]


def test_binary_types_memos_and_charsets(spark, tmp_path):
    cell = b" " + struct.pack("<i", -7) + struct.pack("<d", 2.5) + struct.pack("<q", 123456) + struct.pack("<ii", 45000, 3_600_000) + "é".encode("cp1252") + b" " + b"         1" + struct.pack("<i", 2)
    by_hand(tmp_path / "v.dbf", [("I", "I", 4, 0), ("O", "O", 8, 0), ("Y", "Y", 8, 0), ("T", "T", 8, 0), ("C", "C", 2, 0), ("M", "M", 10, 0), ("M2", "M", 4, 0)], [cell], version=0x30)
    (tmp_path / "v.FPT").write_bytes(struct.pack(">iHH", 3, 0, 64).ljust(64, b"\0") + (struct.pack(">ii", 1, 5) + b"first").ljust(64, b"\0") + (struct.pack(">ii", 1, 6) + b"second").ljust(64, b"\0"))
    db = Database(spark, str(tmp_path), charset="cp1252")
    r = db.sql("SELECT * FROM v").first()
    assert (r.I, r.O, float(r.Y), r.T, r.C, r.M, r.M2) == (-7, 2.5, 12.3456, dt.datetime(2023, 3, 15, 1), "é ", "first", "second")
    (tmp_path / "d.dbt").write_bytes(struct.pack("<i", 4).ljust(512, b"\0") + (b"three" + b"\x1a" * 2).ljust(512, b"\0") + (layout.DBASE4_MEMO + struct.pack("<i", 12) + b"four").ljust(512, b"\0"))
    by_hand(tmp_path / "d.dbf", [("M", "M", 10, 0)], [b" " + b"         1", b" " + b"         2", b" " + b" " * 10, b" " + b"        99"])
    assert [x[0] for x in rows(Database(spark, str(tmp_path)).sql("SELECT M FROM d ORDER BY RECNO()"))] == ["three", "four", None, ""]


def test_bad_input(spark, folder):
    (folder / "short.dbf").write_bytes(b"\x03")
    (folder / "bad.dbf").write_bytes(b"\x03" + bytes(3) + struct.pack("<iHH", -1, 5, 0) + bytes(40))
    for name in ("short", "bad"):
        with pytest.raises(layout.LayoutError):
            xbase.header_of(str(folder / f"{name}.dbf"))
    db = Database(spark, str(folder))
    for q in ("SELECT", "SELECT 1 FROM", "SELECT A FROM t WHERE", "SELECT 'x FROM t", "SELECT A FROM t LIMIT 1 2", "SELECT #2024-13-01# FROM tran"):
        with pytest.raises(SyntaxProblem):
            db.sql(q)
    with pytest.raises(CompileError):
        db.sql("SELECT NOPE FROM tran")
    with pytest.raises(EngineError):
        Database(spark, str(folder / "nowhere"))
    for f in (layout.Field("A", "N", 3, 0), layout.Field("A", "N", 5, 2)):
        with pytest.raises(layout.LayoutError):
            layout.cell(12345, f, "utf-8")
    with pytest.raises(layout.LayoutError):
        layout.cell("x", layout.Field("A", "N", 3), "utf-8")
    with pytest.raises(layout.LayoutError):
        layout.cell("2024-1", layout.Field("A", "D", 8), "utf-8")


def test_locks(spark, folder):
    db = Database(spark, str(folder))
    other = Database(spark, str(folder), lock_seconds=0.2)
    with db.transaction():
        db.execute("UPDATE tran SET AMT = AMT + 1")
        with pytest.raises(EngineError, match="locked"):
            other.execute("INSERT INTO tran VALUES (9, 'x', 9)")
        assert rows(other.sql("SELECT SUM(AMT) s FROM tran")) == [(38,)]
    assert other.execute("INSERT INTO tran VALUES (9, 'x', 9)") == 1
    assert rows(db.sql("SELECT SUM(AMT) s, COUNT(*) c FROM tran")) == [(51, 5)] and not list(folder.glob("*.lck"))


def test_journal(spark, folder, monkeypatch):
    """A crash before the journal's rename leaves nothing of a change, one after it all, once the folder is opened."""
    import os

    db, real = Database(spark, str(folder)), os.replace
    both = lambda d: (rows(d.sql("SELECT SUM(AMT) s FROM tran")), rows(d.sql("SELECT COUNT(*) n FROM master")))

    def dies_at(n):
        calls = iter(range(100))

        def replace(a, b):
            if next(calls) == n:
                raise KeyboardInterrupt
            real(a, b)
        return replace

    for n, want in ((0, ([(38,)], [(4,)])), (2, ([(42,)], [(0,)]))):  # at the journal; between the two tables
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            with db.transaction():
                db.execute("UPDATE tran SET AMT = AMT + 1")
                db.execute("DELETE FROM master")
                m.setattr(os, "replace", dies_at(n))
        db = Database(spark, str(folder))
        assert both(db) == want
    assert not [p for p in folder.iterdir() if p.name == ".journal"]


def test_lists_of_records(spark, folder):
    db = Database(spark, str(folder))
    assert [r[0] for r in rows(db.sql("SELECT RECNO() r FROM master WHERE RECNO() IN (5, 1, 2, 77) ORDER BY r"))] == [1, 5]
    df = db.table("master").filter("_recno IN (1, 4)")
    assert df.rdd.getNumPartitions() == 1 and [r._recno for r in df.collect()] == [1, 4]


def test_cursor(spark, folder):
    from decimal import Decimal

    db = Database(spark, str(folder))
    c = db.cursor("SELECT C_HEAD, NAME, BAL, DOB, OK, '12.5' t FROM master ORDER BY RECNO()")
    assert [tuple(x) for x in c.columns][:3] == [("C_HEAD", "bigint", 6, 0), ("NAME", "string", 8, 0), ("BAL", "double", 10, 2)]
    with pytest.raises(EngineError):
        c.get(1)
    assert c.next() and c.get(1) == 1 and c.get("name", "string") == "CAlpha  " and c.get("BAL", "int") == 100 and c.get("bal", "decimal") == Decimal(101)
    assert c.get("DOB", "timestamp") == dt.datetime(2024, 2, 29) and c.get("dob", "string") == "2024-02-29" and c.get("OK", "bool") is True and c.get("ok", "string") == "true"
    assert c.get("t", "float") == 12.5 and c.get("t", "int") == 12 and c.get("t", "bytes") == b"12.5" and c.get("name", "int") == 0 and c.get("name", "date") is None
    assert c.next() and c.next() and c.get("BAL", "int") == 0 and c.was_null and c.get("BAL") is None and c.get("BAL", "decimal") is None and c.get("ok", "bool") is False and not c.was_null
    for bad in (0, 7, "nope"):
        with pytest.raises(EngineError, match="Column not found") as e:
            c.get(bad)
        assert (e.value.sqlstate, e.value.code) == ("42S22", 17006)
    assert len(list(c)) == 1 and not c.next()
    slow = db.cursor("SELECT ENTRY FROM tran", timeout=0.5)
    slow.timeout = 1e-6
    with pytest.raises(EngineError) as e:
        slow.next()
    assert e.value.sqlstate == "HYT00"
    with pytest.raises(EngineError) as e:
        db.sql("SELECT A FROM nowhere")
    assert (e.value.sqlstate, e.value.code) == ("42S02", 17007)
