"""Appended records as a stream, across restarts."""

from pyspark.sql import functions as F

from marlstone.engine import Database


def test_appended_records(spark, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    db = Database(spark, str(folder))
    db.execute("CREATE TABLE t (ID NUMERIC(6), NAME CHAR(5), NOTE MEMO)")
    db.execute_many("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", f"note {i}") for i in range(20)])
    batches = []

    def run():
        stream = spark.readStream.format("xbase").option("partition_records", 7).load(f"{folder}/t.dbf")
        seen = stream.select("_recno", "ID", F.rtrim("NAME").alias("n"), "NOTE")
        q = seen.writeStream.foreachBatch(lambda df, i: batches.append(sorted(tuple(r) for r in df.collect()))).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    run()
    db.execute_many("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", None) for i in range(20, 25)])
    db.execute("DELETE FROM t WHERE ID = 22")
    run()
    run()
    assert [len(b) for b in batches if b] == [20, 4]
    assert [x for b in batches for x in b] == [(i + 1, i, f"n{i}", f"note {i}" if i < 20 else None) for i in range(25) if i != 22]
