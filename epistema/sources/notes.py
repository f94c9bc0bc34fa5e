"""Notes of a directory, once or as a stream, and their synchronisation with a ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from epistema.functions.scalars import content_hash
from epistema.operators import relational as rel
from epistema.plans.storage import exists

#: Names that are no notes, wherever they lie, and those that are none at the top.
SKIPPED = r"(?i)^(?:TEMPLATE\..*|config\.toml)$"
TOP_SKIPPED = ("Chat.md", "Later.md")
BINARY = "path string, modificationTime timestamp, length long, content binary"


def _kept(df: DataFrame, folder: str) -> DataFrame:
    root = folder.rstrip("/")
    root = root if ":" in root else f"file:{root}"
    relative = F.regexp_replace(F.regexp_replace("path", r"^(\w+:)/+", "$1/"), "^" + root.replace("///", "/").replace(".", r"\.") + "/", "")
    df = df.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"), F.unix_millis("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return df.filter(F.lower("path").rlike(r"\.(?:md|html)$") & ~name.rlike(SKIPPED) & ~F.col("path").rlike(r"(?:^|/)(?:_assets|\.[^/]+)/") & ~name.startswith(".") & ~F.col("path").isin(*TOP_SKIPPED))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and modification time of the notes below a folder, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return _kept(files, folder).orderBy("path")


CHANGES = "path string, modified long, content string"


def watch(spark: SparkSession, folder: str, changes: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Looks through a folder again and again and appends notes that are new or modified to <changes>, a folder of Parquet.

    A file source would see each path once only. A look compares with the last change of each path, and writes below its own number, so one
    that is run again after a failure replaces what it wrote. ``settled`` reads what comes.
    """

    def look(ticks: DataFrame, number: int) -> None:
        now = scan(spark, folder).select("path", "modified", "content")
        if exists(spark, changes):
            known = spark.read.schema(CHANGES + ", look long").parquet(changes).filter(F.col("look") != number).groupBy("path").agg(F.max("modified").alias("__last"))
            now = now.join(known, "path", "left").filter("__last is null or modified > __last").drop("__last")
        now.write.mode("overwrite").parquet(f"{changes}/look={number}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class _Quiet(StatefulProcessor):
    """Keeps the last state of a path, and gives it once nothing has come for the quiet time."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "modified bigint, content string, told bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        modified, content, told = self.last.get() if self.last.exists() else (-1, None, -1)
        waits = False
        for pdf in rows:
            row = pdf.sort_values("modified").iloc[-1]
            if int(row.modified) > told:  # else it was told before
                waits = True
                if int(row.modified) >= modified:
                    modified, content = int(row.modified), None if row.content is None else str(row.content)
        if waits:
            self.last.update((modified, content, told))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame(columns=["path", "modified", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        modified, content, _ = self.last.get()
        self.last.update((modified, None, modified))
        yield pd.DataFrame({"path": [key[0]], "modified": [modified], "content": [content]})

    def close(self) -> None:
        pass


def settled(changes: DataFrame, quiet_ms: int = 2000) -> DataFrame:
    """Of a stream of changes (path, modified, content), each path's last state once nothing has changed there for the quiet time.

    A burst of changes gives one row. What waits is state, by path, in RocksDB, and of a path that was told its time stays: a restart from the checkpoint goes
    on waiting and tells nothing twice. Needs ``spark.sql.streaming.stateStore.providerClass`` of RocksDB and a trigger by processing time, as timers
    go off between batches.
    """
    rows = changes.select("path", "modified", "content")
    return rows.groupBy("path").transformWithStateInPandas(_Quiet(quiet_ms), CHANGES, "update", "processingTime")


def sync(files: DataFrame, events: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes to ingest (new or modified, with their text), and a count of each state."""
    hashed = files.withColumn("hash", content_hash(F.col("content")))
    states = rel.classify(hashed.select("path", "hash"), events, hashes)
    return hashed.join(states.filter("state <> 'unchanged'").select("path", "state"), "path"), states.groupBy("state").agg(F.count("*").alias("n"))


def memories(spark: SparkSession, url: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """Rows of another store's table ``memories`` over JDBC, in order of creation."""
    return spark.read.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "memories").load().orderBy("created_at")
