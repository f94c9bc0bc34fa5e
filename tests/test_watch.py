"""Notes as a stream: one row for a burst of changes, none twice after a restart."""

import time

from epistema.sources import notes

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_a_burst_gives_one_row_and_a_restart_no_second(spark, tmp_path):
    folder, changes, out, check = (tmp_path / x for x in ("notes", "changes", "out", "check"))
    folder.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def start():
        looks = notes.watch(spark, f"file:{folder}", f"file:{changes}", f"file:{check}/looks", "500 milliseconds")
        changes.mkdir(exist_ok=True)
        rows = notes.settled(spark.readStream.schema(notes.CHANGES + ", look long").parquet(f"file:{changes}"), 3000)
        told = rows.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"file:{out}")).option("checkpointLocation", f"file:{check}/told").trigger(processingTime="500 milliseconds").start()
        return looks, told

    def stop(queries):
        for q in queries:
            q.stop()

    def seen():
        return sorted((r.path, r.content) for r in spark.read.schema(notes.CHANGES).parquet(f"file:{out}").collect()) if out.exists() else []

    def wait(n, seconds=60):
        end = time.time() + seconds
        while len(seen()) < n and time.time() < end:
            time.sleep(0.5)
        return seen()

    try:
        queries = start()
        for i in range(4):  # each change within the quiet time of the one before
            (folder / "a.md").write_text(f"state {i}")
            (folder / "skip.txt").write_text("no note")
            time.sleep(0.3)
        (folder / "b.md").write_text("other")
        assert wait(2) == [("a.md", "state 3"), ("b.md", "other")]
        (folder / "c.md").write_text("before the stop")
        end = time.time() + 60  # until it was seen, but before it is quiet
        while time.time() < end and not spark.read.schema(notes.CHANGES).parquet(f"file:{changes}").filter("path = 'c.md'").count():
            time.sleep(0.2)
        stop(queries)
        queries = start()
        assert wait(3)[-1] == ("c.md", "before the stop")
        time.sleep(6)
        assert len(seen()) == 3
        (folder / "a.md").write_text("state 4")
        assert ("a.md", "state 4") in wait(4) and len(seen()) == 4
        stop(queries)
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", before)
