"""The append-only ledger: inserts that repeat safely, lookups, export, import, snapshots, key-value settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistema.functions.scalars import content_hash, content_id
from epistema.operators import relational as rel


def insert_content(held: DataFrame, new: DataFrame) -> DataFrame:
    """Episodes (space_id, content) to append: those whose content the space lacks, once each, numbered on."""
    new = new.withColumn("content_hash", content_hash(F.col("content"))).dropDuplicates(["space_id", "content_hash"])
    fresh = new.join(held.select("space_id", "content_hash"), ["space_id", "content_hash"], "left_anti")
    return rel.numbered(fresh, held, "space_id", ["content_hash"]).withColumn("id", content_id("episode", F.col("space_id"), F.col("content_hash")))


def insert_events(held: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of events (space_id, source_id, occurrence_id, content_hash): insert, no-op, or conflict with what is held."""
    key = ["space_id", "source_id", "occurrence_id"]
    old = held.select(*key, F.col("content_hash").alias("__old"))
    outcome = F.when(F.col("__old").isNull(), "insert").when(F.col("__old") == F.col("content_hash"), "noop").otherwise("conflict")
    return new.join(old, key, "left").withColumn("outcome", outcome).drop("__old")


def stored_id(held: DataFrame, new: DataFrame) -> DataFrame:
    """The id under which content is stored, for content that comes again."""
    new = new.withColumn("content_hash", content_hash(F.col("content")))
    return new.join(held.select("space_id", "content_hash", "id"), ["space_id", "content_hash"], "left")


def lookup(df: DataFrame, **values) -> DataFrame:
    """The row with these values."""
    for name, value in values.items():
        df = df.filter(F.col(name) == value)
    return df.limit(1)


def export(tables: dict[str, DataFrame]) -> DataFrame:
    """A line of JSON for every row of every table; binary values as hexadecimal."""
    lines = []
    for name, df in sorted(tables.items()):
        columns = [F.concat(F.lit("hex:"), F.lower(F.hex(c))).alias(c) if kind == "binary" else F.col(c) for c, kind in sorted(df.dtypes)]
        lines.append(df.select(F.to_json(F.struct(F.struct(*columns).alias("row"), F.lit(name).alias("table")), {"ignoreNullFields": "false"}).alias("value")))
    return reduce(DataFrame.unionByName, lines)


def load(lines: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables from exported lines, by their schemas."""
    out = {}
    for name, schema in schemas.items():
        kinds = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
        text = ", ".join(f"{c} {'string' if k == 'binary' else k}" for c, k in kinds)
        rows = lines.filter(F.get_json_object("value", "$.table") == name).select(F.from_json(F.get_json_object("value", "$.row"), text).alias("r")).select("r.*")
        out[name] = rows.select(*(F.unhex(F.regexp_replace(c, "^hex:", "")).alias(c) if k == "binary" else F.col(c) for c, k in kinds))
    return out


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: rows, and a hash of them that does not depend on their order.

    Rows are hashed, and the hashes summed in two independent parts, so nothing is sorted or gathered.
    """
    out = []
    for name, df in sorted(tables.items()):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        part = lambda a, row=row: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(20,0)"))
        out.append(df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.sha2(F.concat_ws(":", part(1).cast("string"), part(13).cast("string"), part(25).cast("string")), 256).alias("hash")))
    return reduce(DataFrame.unionByName, out)


def settings_set(meta: DataFrame, key: str, value: str) -> DataFrame:
    return meta.filter(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def settings_get(meta: DataFrame, key: str) -> str | None:
    row = meta.filter(F.col("key") == key).first()
    return row.value if row else None


def ensure_version(spark: SparkSession, meta: DataFrame, version: int) -> DataFrame:
    """Settings with the schema's version; a newer one is an error."""
    held = settings_get(meta, "schema_version")
    if held is not None and int(held) > version:
        raise ValueError(f"schema version {held} is newer than {version}")
    return settings_set(meta, "schema_version", str(version))
