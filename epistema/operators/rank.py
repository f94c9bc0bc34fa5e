"""Rank fusion, filters with reasons, reranking, and accounting for what was dropped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIORITY = {"statement": 0, "episode": 1, "entity": 2, "chunk": 3, "community": 4}


def channel_ranks(hits: DataFrame, keep: int | None = None) -> DataFrame:
    """Hits (query, channel, kind, id, score) with their rank from 0 in the channel; ``keep`` of them."""
    order = Window.partitionBy("query", "channel").orderBy(F.desc("score"), "kind", "id")
    out = hits.withColumn("rank", F.row_number().over(order) - 1)
    return out.filter(F.col("rank") < keep) if keep is not None else out


def rrf(ranked: DataFrame, k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: query, kind, id, fused."""
    return ranked.groupBy("query", "kind", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 6).alias("fused"), F.count("*").alias("n_channels"))


def rrf_compatible(ranked: DataFrame, k: float = 60.0) -> DataFrame:
    """The variant that sees a candidate's own scores only: it depends on the number of its hits."""
    hits = ranked.groupBy("query", "kind", "id").agg(F.count("*").alias("n_channels"))
    fused = F.aggregate(F.sequence(F.lit(1), F.col("n_channels")), F.lit(0.0), lambda s, i: s + 1.0 / (k + i))
    return hits.withColumn("fused", F.round(fused, 6))


def weighted(ranked: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of a candidate's scores, scaled between its least and largest; equal weights if none are given."""
    one = ranked.groupBy("query", "kind", "id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n_channels"))
    w = F.lit(None).cast("double")
    for name, x in (weights or {}).items():
        w = F.when(F.col("channel") == name, x).otherwise(w)
    rest = 1.0 / sum(weights.values()) if weights and sum(weights.values()) > 0 else None
    w = F.coalesce(w, F.lit(rest) if rest else 1.0 / F.col("n_channels"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(2.220446049250313e-16))
    joined = ranked.join(one, ["query", "kind", "id"])
    return joined.groupBy("query", "kind", "id", "n_channels").agg(F.round(F.sum((F.col("score") - F.col("lo")) / span * w), 6).alias("fused"))


def drop_reason(valid_from: int | None = None, valid_to: int | None = None, known_at: int | None = None, floor: float = 0.0, exclude: list[str] = (), predicates: list[str] | None = None, types: list[str] | None = None) -> Column:
    """The first filter that a candidate's facts fail, in a fixed order; null if none."""
    no = F.lit(False)
    window = ((F.col("valid_from") > valid_to) | (F.col("valid_to") < valid_from)) if valid_from is not None else no
    unknown = ((F.col("recorded_at") > known_at) | (F.coalesce(F.col("retracted_at") <= known_at, no))) if known_at is not None else no
    out = F.when(window, "outside_valid_window").when(unknown, "not_known").when(F.col("confidence") < floor, "below_confidence")
    out = out.when(F.col("trust").isin(*exclude) if exclude else no, "excluded_trust").when(~F.col("predicate").isin(*predicates) if predicates is not None else no, "predicate_filtered")
    return out.when(~F.col("entity_type").isin(*types) if types is not None else no, "type_filtered")


def corroborated(df: DataFrame) -> DataFrame:
    return df.withColumn("fused", F.round(F.col("fused") * (1 + F.log(1.0 + F.col("distinct_episodes"))), 6))


def priority() -> Column:
    out = F.lit(9)
    for kind, n in PRIORITY.items():
        out = F.when(F.col("kind") == kind, n).otherwise(out)
    return out


def final_order(df: DataFrame) -> DataFrame:
    """Position from 0: fused score, kind, then id. A column, so that later sorts can't undo a rerank."""
    order = Window.partitionBy("query").orderBy(F.desc("fused"), priority(), "id")
    return df.withColumn("final_order", F.row_number().over(order) - 1)


def truncated(df: DataFrame, limit: int) -> DataFrame:
    """Rows at or beyond the limit with the reason and their position."""
    return df.withColumn("drop_reason", F.when(F.col("final_order") >= limit, F.concat(F.lit("truncated_at_"), F.col("final_order").cast("string"))))


def mmr(items: DataFrame, vectors: DataFrame, weight: float = 0.7, ceiling: float | None = None) -> DataFrame:
    """Maximal marginal relevance: (query, id, fused) to final_order; greedy, so a query's candidates, which retrieval limits, meet in one task.

    Items above the ceiling of similarity to one taken before come last, never dropped.
    """
    joined = items.join(vectors, "id", "left").select("query", "id", "fused", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fused", "id"], ascending=[False, True]).reset_index(drop=True)
        score = pdf.fused.to_numpy()
        there = [v is not None for v in pdf.embedding]
        unit = [np.asarray(v, float) / (np.linalg.norm(v) or 1.0) if v is not None else None for v in pdf.embedding]
        taken, pool = [0], list(range(1, len(pdf)))
        while pool:
            best, at = -np.inf, None
            for i in pool:
                near = [float(unit[i] @ unit[j]) for j in taken if there[i] and there[j] and len(unit[i]) == len(unit[j])]
                sim = max(0.0, *near) if near else abs(score[taken[-1]] - score[i])
                if ceiling is not None and near and sim > ceiling:
                    continue
                value = weight * score[i] - (1 - weight) * sim
                if value > best:
                    best, at = value, i
            if at is None:
                taken += pool
                break
            taken.append(at)
            pool.remove(at)
        return pd.DataFrame({"query": pdf["query"].iloc[taken].to_numpy(), "id": pdf.id.iloc[taken].to_numpy(), "fused": score[taken], "final_order": np.arange(len(taken))})

    kinds = dict(items.dtypes)
    return joined.groupBy("query").applyInPandas(run, f"query {kinds['query']}, id {kinds['id']}, fused double, final_order long")


def graph_distance(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest in the graph first: nodes (id, depth); what was not reached comes after, by salience."""
    out = df.join(nodes.select("id", "depth"), "id", "left")
    order = Window.partitionBy("query").orderBy(F.coalesce("depth", F.lit(1 << 30)), F.desc("salience"), "id")
    return out.withColumn("final_order", F.row_number().over(order) - 1).drop("depth")


def chain(df: DataFrame, *steps) -> DataFrame:
    for step in steps:
        df = step(df)
    return df


def explain_line() -> Column:
    return F.concat(F.col("kind"), F.lit(":"), F.col("id").cast("string"), F.lit(" fused="), F.format_number("fused", 6), F.lit(" channels="), F.col("n_channels").cast("string"))
