"""Filters, joins, aggregates, windows, order and set operations over ledger tables."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# filters


def valid_at(t: Column | int, start: str = "valid_from", end: str = "valid_to") -> Column:
    t = t if isinstance(t, Column) else F.lit(t)
    return (F.col(start) <= t) & (F.col(end) >= t)


def valid_within(a: int, b: int, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= b) & (F.col(end) >= a)


def confident(floor: float, column: str = "confidence") -> Column:
    return F.col(column) >= floor


def trusted(exclude: list[str], column: str = "trust") -> Column:
    return ~F.col(column).isin(*exclude) if exclude else F.lit(True)


def allowed(names: list[str] | None = None, deny: bool = False, column: str = "predicate") -> Column:
    """All (None), only the names, or all but the names."""
    if names is None:
        return F.lit(True)
    found = F.col(column).isin(*names) if names else F.lit(False)
    return ~found if deny else found


def authorised(rows: DataFrame, scopes: DataFrame, capability: str, now: int) -> DataFrame:
    """Rows of spaces for which a scope (space_id, caps, expires_at, predicates) grants the capability now; its predicates, if any, limit them."""
    good = scopes.filter(F.array_contains("caps", capability) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    good = good.select(F.col("space_id").alias("__space"), F.col("predicates").alias("__predicates"))
    on = (F.col("space_id") == F.col("__space")) & (F.col("__predicates").isNull() | F.array_contains("__predicates", F.col("predicate")))
    return rows.join(good, on, "left_semi")


# joins


def classify(files: DataFrame, events: DataFrame, hashes: DataFrame) -> DataFrame:
    """New, unchanged or modified, for files (path, hash): by the latest event of the path, else by hashes seen for it before."""
    latest = events.groupBy("path").agg(F.max_by("hash", "seq").alias("__event"))
    seen = hashes.groupBy("path").agg(F.collect_set("hash").alias("__hashes"))
    out = files.join(latest, "path", "left").join(seen, "path", "left")
    known = F.when(F.col("__event").isNotNull(), F.col("__event") == F.col("hash")).when(F.col("__hashes").isNotNull(), F.array_contains("__hashes", F.col("hash")))
    return out.select("path", "hash", F.when(known.isNull(), "new").when(known, "unchanged").otherwise("modified").alias("state"))


def as_of(rows: DataFrame, policies: DataFrame, key: str, at: str, start: str = "effective_from") -> DataFrame:
    """Rows with the policy in force at their time: the latest start up to it whose end, if any, is later.

    Both sides are ordered together within a key, so a row costs one window step however many policies a key has.
    """
    columns = rows.columns
    left = rows.select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__row"), F.struct(*columns).alias("__left"), F.lit(None).cast("struct<trust:string,effective_from:bigint,effective_to:bigint>").alias("__p"))
    right = policies.select(F.col(key).alias("__k"), F.col(start).alias("__t"), F.lit(0).alias("__row"), F.lit(None).cast(left.schema["__left"].dataType).alias("__left"), F.struct(F.col("trust"), F.col(start).cast("bigint").alias("effective_from"), F.col("effective_to").cast("bigint").alias("effective_to")).alias("__p"))
    order = Window.partitionBy("__k").orderBy("__t", "__row", "__p.effective_to").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("__p", F.last("__p", ignorenulls=True).over(order)).filter("__row = 1")
    inside = F.col("__p.effective_to").isNull() | (F.col("__p.effective_to") > F.col("__t"))
    return met.select("__left.*", F.when(inside, F.col("__p.trust")).alias("policy_trust"))


def support_pairs(assertions: DataFrame) -> DataFrame:
    """Pairs of episodes that support one statement: a self join on the statement, lower id first."""
    one = assertions.select("statement_id", "episode_id").distinct()
    a, b = one.alias("a"), one.alias("b")
    return a.join(b, (F.col("a.statement_id") == F.col("b.statement_id")) & (F.col("a.episode_id") < F.col("b.episode_id"))).select(F.col("a.episode_id").alias("u"), F.col("b.episode_id").alias("v")).distinct()


def support_links(assertions: DataFrame) -> DataFrame:
    """Links with the same components as ``support_pairs``, one for each episode of a statement instead of a pair: to its least episode."""
    said = assertions.select("statement_id", "episode_id").filter("statement_id is not null and episode_id is not null").repartition("statement_id")  # one exchange serves both sides
    least = said.groupBy("statement_id").agg(F.min("episode_id").alias("v"))
    return said.join(least, "statement_id").filter("episode_id <> v").select(F.col("episode_id").alias("u"), "v").distinct()


def touching(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Statements whose subject or object is among the entities: two semi joins, not one on a disjunction."""
    ids = entities.select(F.col("entity_id").alias("__e")).distinct()
    return statements.join(ids, F.col("subject_id") == F.col("__e"), "left_semi").unionByName(statements.join(ids, F.col("object") == F.col("__e"), "left_semi")).distinct()


def only_supported_by(assertions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Statements with no assertion outside the episodes."""
    ids = episodes.select("episode_id").distinct()
    inside = assertions.join(ids, "episode_id", "left_semi").select("statement_id").distinct()
    outside = assertions.join(ids, "episode_id", "left_anti").select("statement_id").distinct()
    return inside.join(outside, "statement_id", "left_anti")


# windows


def latest(df: DataFrame, keys: list[str], order: str, tie: str | None = None) -> DataFrame:
    """The last row of each key."""
    by = F.struct(order, *([tie] if tie else []))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__r")).select(*keys, "__r.*")


def numbered(new: DataFrame, held: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows with a sequence number that goes on from the highest of the key."""
    base = held.groupBy(key).agg(F.max("seq").alias("__base"))
    return new.join(base, key, "left").withColumn("seq", (F.coalesce("__base", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy(*order))).cast("long")).drop("__base")


def predecessors(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Every row with the value of the one before it in its key."""
    return df.withColumn("predecessor", F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def occurrence_ids(rows: DataFrame, source: str, key: str, order: str, content: str) -> DataFrame:
    """Rows with ``predecessor`` and ``occurrence_id``, the hash of source, key, the id of the row before it in its key, and content.

    Rows are range-partitioned by key and order, so a key with many rows spans several partitions. Such a key is chained part by part: a round takes
    the next part of every key, with the last id of the part before, so rounds are as many as partitions that one key spans, one for most.
    A task hashes its rows as they come, in order, and holds one id.
    """
    from epistema.plans.storage import settled

    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = rows.repartitionByRange(parts, key, order).sortWithinPartitions(key, order).withColumn("__place", F.monotonically_increasing_id())
    placed = settled(placed.withColumn("__part", F.shiftrightunsigned("__place", 33)))
    runs = placed.select(key, "__part").distinct().withColumn("__round", F.row_number().over(Window.partitionBy(key).orderBy("__part")))
    runs = settled(runs)
    rounds = runs.agg(F.max("__round")).first()[0] or 0
    kinds = dict(rows.dtypes)
    names = f"__place long, predecessor string, occurrence_id string, __key {kinds[key]}"

    def chain(batches):
        at, last = object(), None
        for pdf in batches:
            out = []
            for k, text, hashed, before in zip(pdf["__key"], pdf["__text"], pdf["__content"], pdf["__before"], strict=True):
                if k != at:
                    at, last = k, before
                ident = hashlib.sha256(f"{source}|{text}|{last or ''}|{hashed}".encode()).hexdigest()
                out.append((last, ident))
                last = ident
            yield pd.DataFrame({"__place": pdf["__place"], "predecessor": [a for a, _ in out], "occurrence_id": [b for _, b in out], "__key": pdf["__key"]})

    found, carry = [], spark.createDataFrame([], f"__key {kinds[key]}, __before string")
    for r in range(1, rounds + 1):
        own = placed.join(runs.filter(F.col("__round") == r).select(key, "__part"), [key, "__part"])
        own = own.select("__place", F.col(key).alias("__key"), F.col(key).cast("string").alias("__text"), F.col(content).cast("string").alias("__content")).join(carry, "__key", "left")
        done = settled(own.repartition("__key").sortWithinPartitions("__key", "__place").mapInPandas(chain, names))
        carry = done.groupBy("__key").agg(F.max_by("occurrence_id", "__place").alias("__before"))
        found.append(done.drop("__key"))
    if not found:
        return rows.withColumn("predecessor", F.lit(None).cast("string")).withColumn("occurrence_id", F.lit(None).cast("string"))
    return placed.join(reduce(DataFrame.unionByName, found), "__place").drop("__place", "__part")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


ORIGINS = {"user_declared": 0, "extracted": 1}


def best_surface(keys: DataFrame) -> DataFrame:
    """Surface of each entity: declared before extracted before others, then by name."""
    rank = F.coalesce(*(F.when(F.col("origin") == o, n) for o, n in ORIGINS.items()), F.lit(2))
    return keys.groupBy("entity_id").agg(F.min_by("surface", F.struct(rank, "surface")).alias("surface"))


# sets


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a that b lacks, and of b that a lacks."""
    return a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``before`` that ``after`` has fewer times, with how many (n) are missing: exceptAll with a row for those that are equal."""
    signed = before.withColumn("__n", F.lit(1)).unionByName(after.withColumn("__n", F.lit(-1)))
    return signed.groupBy(*before.columns).agg(F.sum("__n").alias("n")).filter("n > 0")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; two empty ones have none."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)
