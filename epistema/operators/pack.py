"""Contexts under a token budget, lifecycle, pages, jobs and access."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistema.functions.scalars import salience, tokens

LAYERS = ("profile", "beliefs", "neighborhood", "summaries", "episodes")


def reserves(budget: int) -> dict[str, int]:
    """Tokens kept for each layer."""
    budget = max(1, budget)
    out = {"profile": max(budget // 15, 50), "pinned": budget // 20, "beliefs": budget // 3, "neighborhood": budget // 8, "summaries": budget // 10}
    return out | {"episodes": max(0, budget - sum(out.values()))}


def filled(lines: DataFrame, budget: Column | int, keys: list[str], order: list[str], text: str = "line") -> DataFrame:
    """Lines of each key up to the first that would pass the budget, which ends the layer."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("tokens", tokens(F.col(text))).withColumn("used", F.sum("tokens").over(run))
    return out.filter(F.col("used") <= budget)


def packed(lines: DataFrame, budget: int, expand_top: int = 5) -> DataFrame:
    """Layers of each context (context_id, layer, position, line): reserves in turn, what a layer leaves goes on to the next.

    A context's lines are limited by retrieval, so they meet in one task; contexts are apart.
    """
    kept = reserves(budget)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, left, spare = [], budget, kept["pinned"]
        for layer in LAYERS:
            own = pdf[pdf.layer == layer].sort_values("position")
            ceiling, used = kept[layer] + spare, 0
            if layer in ("profile", "episodes"):
                ceiling = left
            for n, line in enumerate(own.line):
                if layer == "episodes" and n >= expand_top:
                    line = line[:120] + "…"
                size = max(1, len(line) // 4)
                if used + size > min(left, ceiling):
                    break
                used += size
                rows.append((pdf.context_id.iloc[0], layer, n, line, size))
                if layer == "profile" and used >= kept["profile"] and used >= left // 2:
                    break
            left -= used
            spare = max(0, ceiling - used) if layer not in ("profile", "episodes") else spare
        return pd.DataFrame(rows, columns=["context_id", "layer", "position", "line", "tokens"])

    kind = dict(lines.dtypes)["context_id"]
    return lines.groupBy("context_id").applyInPandas(run, f"context_id {kind}, layer string, position long, line string, tokens long")


def usable_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.filter((F.size("sources") > 0) & (F.col("confidence") > 0))


# lifecycle


def decay(assertions: DataFrame, now: int, day: int) -> DataFrame:
    """Last activity and salience of subjects."""
    last = assertions.groupBy("subject_id").agg(F.max("recorded_at").alias("last_activity"))
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_activity")) / float(day))
    return last.withColumn("salience", F.round(salience(age), 6))


def compacted(episodes: DataFrame, before: int) -> DataFrame:
    """Episodes with a mark on those older than a time; Parquet compresses them, so content stays."""
    return episodes.withColumn("compacted", F.col("ingested_at") < before)


def pending(clusters: DataFrame, done: DataFrame) -> DataFrame:
    """Clusters (cluster_id, members) whose set of members was not summarised yet."""
    from epistema.functions.scalars import set_hash

    return clusters.withColumn("member_hash", set_hash(F.col("members").cast("array<string>"))).join(done.select("member_hash"), "member_hash", "left_anti")


def summaries(clusters: DataFrame, episodes: DataFrame, sentences: int = 2) -> DataFrame:
    """An extract of each cluster (cluster_id, members): first sentences of its episodes, with what they were taken from."""
    each = clusters.select("cluster_id", F.explode("members").alias("episode_id")).join(episodes.select("episode_id", "content"), "episode_id")
    lead = F.array_join(F.slice(F.split("content", r"(?<=[.!?。])\s+"), 1, sentences), " ")
    return each.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("episode_id", lead.alias("lead")))).alias("parts")).select("cluster_id", F.array_join(F.transform("parts", lambda p: p["lead"]), "\n").alias("text"), F.transform("parts", lambda p: p["episode_id"]).alias("sources"))


# pages


def entity_brief(beliefs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """A page for each subject: its lines in order of predicate and start, with counts of doubtful ones."""
    named = beliefs.join(surfaces.select(F.col("entity_id").alias("subject_id"), "surface"), "subject_id", "left")
    line = F.concat_ws(" ", F.col("predicate"), F.col("object"), F.concat(F.lit("("), F.col("status"), F.lit(")")))
    return named.groupBy("subject_id").agg(
        F.first(F.coalesce("surface", "subject_id")).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("predicate", "valid_from", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"),
        F.count("*").alias("n_beliefs"),
        F.sum(F.when(F.col("status") == "contradicted", 1).otherwise(0)).alias("n_contradicted"),
        F.sum(F.when(F.col("distinct_episodes") == 1, 1).otherwise(0)).alias("n_single"),
    )


def top_entities(statements: DataFrame, k: int) -> DataFrame:
    """Entities with most distinct predicates as subject or object."""
    sides = statements.select(F.col("subject_id").alias("entity_id"), "predicate").unionByName(statements.select(F.col("object").alias("entity_id"), "predicate"))
    return sides.groupBy("entity_id").agg(F.countDistinct("predicate").alias("n_predicates")).orderBy(F.desc("n_predicates"), "entity_id").limit(k)


def topic(surfaces: DataFrame, word: str, k: int) -> DataFrame:
    """Entities with a surface that holds the word, each by its first one."""
    found = surfaces.filter(F.contains(F.lower("surface"), F.lit(word.lower()))).groupBy("entity_id").agg(F.min("surface").alias("surface"))
    return found.orderBy("surface", "entity_id").limit(k)


# jobs and access

STAGES = {("queued", "ok"): "extracted", ("extracted", "ok"): "validated", ("validated", "ok"): "projected", ("projected", "ok"): "done", ("queued", "fail"): "queued", ("extracted", "fail"): "queued", ("validated", "fail"): "quarantined", ("projected", "fail"): "validated"}


def step(stage: str, outcome: str) -> str:
    return STAGES.get((stage, outcome), stage)


def enqueue(jobs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Jobs (job_id, state, attempts, created_at, lease_until) with new ones that are not there yet."""
    fresh = new.select("job_id").distinct().join(jobs, "job_id", "left_anti")
    return jobs.unionByName(fresh.select("job_id", F.lit("queued").alias("state"), F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("created_at"), F.lit(None).cast("long").alias("lease_until")))


def claim(jobs: DataFrame, k: int, now: int, lease: int) -> DataFrame:
    """Jobs with the k oldest queued ones leased."""
    first = jobs.filter("state = 'queued'").orderBy("created_at", "job_id").limit(k).select("job_id", F.lit(True).alias("__mine"))
    out = jobs.join(F.broadcast(first), "job_id", "left")  # k rows
    return out.select("job_id", F.when(F.col("__mine"), "leased").otherwise(F.col("state")).alias("state"), (F.col("attempts") + F.when(F.col("__mine"), 1).otherwise(0)).alias("attempts"), "created_at", F.when(F.col("__mine"), F.lit(now + lease)).otherwise(F.col("lease_until")).alias("lease_until"))


def finish(jobs: DataFrame, ids: list, ok: bool, most: int = 3) -> DataFrame:
    """Leased jobs completed, or failed and queued again until they were tried ``most`` times."""
    mine = F.col("job_id").isin(*ids) & (F.col("state") == "leased")
    new = F.lit("done") if ok else F.when(F.col("attempts") >= most, "failed").otherwise("queued")
    return jobs.withColumn("state", F.when(mine, new).otherwise(F.col("state"))).withColumn("lease_until", F.when(mine, None).otherwise(F.col("lease_until")))


def reclaim(jobs: DataFrame, now: int) -> DataFrame:
    late = (F.col("state") == "leased") & (F.col("lease_until") < now)
    return jobs.withColumn("state", F.when(late, "queued").otherwise(F.col("state"))).withColumn("lease_until", F.when(late, None).otherwise(F.col("lease_until")))


def issue(tokens_: DataFrame, name: str, secret: str, caps: list[str], space: str, expires: int | None) -> DataFrame:
    """Access tokens with one more; only the secret's hash is kept."""
    row = tokens_.sparkSession.createDataFrame([(name, secret, caps, space, expires)], "name string, secret string, caps array<string>, space_id string, expires_at long")
    return tokens_.unionByName(row.select("name", F.sha2("secret", 256).alias("secret_hash"), "caps", "space_id", "expires_at", F.lit(False).alias("revoked")))


def verify(tokens_: DataFrame, secret: str, now: int) -> DataFrame:
    good = (F.col("secret_hash") == F.sha2(F.lit(secret), 256)) & ~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return tokens_.filter(good).select("name", "caps", "space_id")


def revoke(tokens_: DataFrame, name: str) -> DataFrame:
    return tokens_.withColumn("revoked", F.col("revoked") | (F.col("name") == name))
