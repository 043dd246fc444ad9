"""Index files: a hand-made tree, and built ones against sorting."""

import random
import struct

import pytest

from marlstone.engine import Database
from marlstone.sources import ntx


def page(entries, last, room=10, length=4):
    slots = [2 + 2 * (room + 1) + i * (length + 8) for i in range(room + 1)]
    raw = struct.pack(f"<H{room + 1}H", len(entries), *slots)
    for child, recno, key in entries:
        raw += struct.pack("<II", child, recno) + key
    return (raw + struct.pack("<I", last)).ljust(1024, b"\0")


def test_hand_made_tree(spark, tmp_path):
    head = struct.pack("<HHIIHHHHH256sB", 6, 1, 1024, 0, 12, 4, 0, 10, 5, b"NAME", 0).ljust(1024, b"\0")
    root = page([(2048, 7, b"CAT "), (3072, 2, b"DOG ")], 4096)
    leaves = [page([(0, 1, b"ANT "), (0, 9, b"CAB ")], 0), page([(0, 3, b"CATS"), (0, 4, b"COW ")], 0), page([(0, 5, b"EEL ")], 0)]
    (tmp_path / "a.ntx").write_bytes(head + root + b"".join(leaves))
    ntx.register(spark)
    read = lambda prefix: [(r.key, r.recno) for r in spark.read.format("ntx").option("prefix", prefix).load(str(tmp_path / "a.ntx")).collect()]
    assert read("") == [("ANT ", 1), ("CAB ", 9), ("CAT ", 7), ("CATS", 3), ("COW ", 4), ("DOG ", 2), ("EEL ", 5)]
    assert read("CA") == [("CAB ", 9), ("CAT ", 7), ("CATS", 3)] and read("CAT ") == [("CAT ", 7)] and read("Z") == []


def test_build_and_seek(spark, tmp_path):
    db, dice = Database(spark, str(tmp_path)), random.Random(9)
    db.execute("CREATE TABLE t (NAME CHAR(8), N NUMERIC(5), D DATE)")
    names = ["".join(dice.choice("ABC") for _ in range(dice.randint(1, 8))) for _ in range(700)]
    db.execute_many("INSERT INTO t VALUES (?, ?, ?)", [(n, i % 50, "2024-01-%02d" % (i % 28 + 1)) for i, n in enumerate(names)])
    db.execute("DELETE FROM t WHERE N = 7")
    assert db.create_index("t", "UPPER(NAME)+STR(N,5)+DTOS(D)", "byname") == 686
    assert [r["index"] for r in db.indexes("t").collect()] == ["byname.ntx"]
    keys = [r.key for r in spark.read.format("ntx").load(str(tmp_path / "byname.ntx")).collect()]
    want = sorted(n.ljust(8) + str(i % 50).rjust(5) + "202401%02d" % (i % 28 + 1) for i, n in enumerate(names) if i % 50 != 7)
    assert keys == want
    for prefix in ("AB", "C", "BBBB", names[3].ljust(8)):
        got = sorted(r.NAME.rstrip() for r in db.seek("t", "byname.ntx", prefix).collect())
        assert got == sorted(n for i, n in enumerate(names) if i % 50 != 7 and n.ljust(8).startswith(prefix))
    assert db.create_index("t", "RECNO()", "empty") == 686
    for bad in ("NOPE", "SOUNDEX(NAME)", "NAME+"):
        with pytest.raises(ValueError):
            db.create_index("t", bad, "bad")


def test_indexes_follow_changes(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.execute("CREATE TABLE t (ID NUMERIC(4), NAME CHAR(4))")
    db.execute_many("INSERT INTO t VALUES (?, ?)", [(1, "AA"), (2, "BB"), (3, "CC"), (4, "DD")])
    db.create_index("t", "NAME", "byname")
    found = lambda d, p: sorted(r.ID for r in d.seek("t", "byname.ntx", p).collect())
    db.execute("DELETE FROM t WHERE ID = 1")
    db.pack("t")
    assert found(db, "CC") == [3]
    db.execute("INSERT INTO t VALUES (5, 'CC')")
    assert found(db, "CC") == [3, 5]
    with db.transaction():
        db.execute("UPDATE t SET NAME = 'ZZ' WHERE ID = 3")
    assert found(db, "CC") == [5] and found(db, "Z") == [3]
    loose = Database(spark, str(tmp_path), index_write=False)  # the index goes stale: what it finds is still right
    loose.execute("UPDATE t SET NAME = 'EE' WHERE ID = 5")
    assert found(loose, "CC") == [] and loose.plan("SELECT ID FROM t WHERE NAME LIKE 'CC%'") is None
    assert [r.ID for r in loose.sql("SELECT ID FROM t WHERE NAME LIKE 'EE%'").collect()] == [5]
    db.execute("ALTER TABLE t DROP COLUMN NAME")


def test_plans(spark, tmp_path):
    db, dice = Database(spark, str(tmp_path)), random.Random(4)
    db.execute("CREATE TABLE t (ID NUMERIC(5), A CHAR(2), B CHAR(4))")
    db.execute("CREATE TABLE u (ID NUMERIC(5), A CHAR(2), B CHAR(4))")
    rows = [(i, dice.choice("XYZ") + dice.choice("XYZ"), "".join(dice.choice("pqr") for _ in range(dice.randint(1, 4)))) for i in range(600)]
    db.execute_many("INSERT INTO t VALUES (?, ?, ?)", rows)
    db.execute_many("INSERT INTO u VALUES (?, ?, ?)", [(i, "XX", "p") for i in range(600)])
    db.create_index("t", "A+UPPER(B)", "ab")
    scan = Database(spark, str(tmp_path), index_read=False)
    for text, prefix, ordered in (
        ("SELECT ID FROM t WHERE A = 'XY' AND UPPER(B) LIKE 'PQ%'", "XYPQ", False), ("SELECT ID FROM t WHERE UCASE(B) LIKE 'P%' AND ID < 300 AND 'XZ' = A", "XZP", False),
        ("SELECT ID FROM t WHERE A LIKE 'X%' AND ID > 20", None, False), ("SELECT TOP 5 B FROM t WHERE A = 'ZZ' ORDER BY UPPER(B)", "ZZ", True),
        ("SELECT B FROM t WHERE A = 'ZZ' AND B LIKE 'p%' ORDER BY B LIMIT 5", "ZZ", False), ("SELECT TOP 7 A FROM t WHERE A LIKE 'Y%' ORDER BY A", "Y", True),
        ("SELECT COUNT(*) n FROM t WHERE A = 'YX'", "YX", False), ("SELECT ID FROM t WHERE A = 'XY' OR A = 'XX'", None, False), ("SELECT ID FROM u WHERE A = 'XX' AND UPPER(B) = 'NONE'", None, False),
        ("SELECT t.ID FROM t JOIN u ON t.ID = u.ID WHERE t.A = 'XY'", None, False),
    ):
        plan = db.plan(text)
        assert (plan and plan["prefix"]) == prefix and bool(plan and plan["ordered"]) == ordered, text
        assert sorted(map(str, db.sql(text).collect())) == sorted(map(str, scan.sql(text).collect()))
    assert "In(_recno" in db.sql("SELECT ID FROM t WHERE A = 'XY' AND UPPER(B) LIKE 'PQ%'")._jdf.queryExecution().toString() or db.plan("SELECT ID FROM t WHERE A = 'XY' AND UPPER(B) LIKE 'PQ%'")
