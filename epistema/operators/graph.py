"""Graphs as edge tables (src, dst, predicate): bounded traversal, neighbours, components, communities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from epistema.plans.storage import settled, small


def oriented(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Edges as (at, to, src, dst, predicate) for every direction in which they may be walked."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst", "predicate")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "dst", "predicate")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", predicates: Column | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth first from seeds (node): nodes (node, depth) and scanned edges (src, dst, predicate, depth).

    most: nodes in all; beyond it the ones nearest, then least by name, stay. The edges are written once, both ways, by the
    node they leave; a step joins them with its front alone, which is sent to all if it is small.
    """
    walk = settled(oriented(edges.filter(predicates) if predicates is not None else edges, direction).repartition("at"))
    fronts, scanned = [seeds.select("node").distinct().withColumn("depth", F.lit(0))], []
    for d in range(1, depth + 1):
        met = settled(walk.join(small(fronts[-1].select(F.col("node").alias("at"))), "at").select("src", "dst", "predicate", "to", F.lit(d).alias("depth")))
        scanned.append(met.select("src", "dst", "predicate", "depth"))
        fresh = met.select(F.col("to").alias("node")).distinct()
        for front in fronts:  # as many as steps
            fresh = fresh.join(front, "node", "left_anti")
        fronts.append(settled(fresh.withColumn("depth", F.lit(d))))
    seen = reduce(DataFrame.unionByName, fronts)
    edges_found = reduce(DataFrame.unionByName, scanned).groupBy("src", "dst", "predicate").agg(F.min("depth").alias("depth")) if scanned else walk.select("src", "dst", "predicate", F.lit(0).alias("depth")).limit(0)
    if most is not None:
        # limit by order needs no single task: each partition sends its first rows
        seen = seen.orderBy("depth", "node").limit(most)
    return seen, edges_found


@dataclass
class Walk:
    """nodes (query, node, depth), edges (query, at, to, predicate, statement_id, depth) in the order of ``place`` within a depth, and the queries (query) that their budget ended."""

    nodes: DataFrame
    edges: DataFrame
    truncated: DataFrame


def walks(edges: DataFrame, seeds: DataFrame, depth: int, most: int, direction: str = "both", predicates: Column | None = None) -> Walk:
    """Breadth first from the seeds (query, node) of each query within a budget of nodes, as if nodes were taken one by one: a front in order of names, a node's
    outgoing edges before its incoming ones, each by statement.

    edges: (src, dst, predicate, statement_id). Every edge looked at is given, up to the one whose end would exceed the budget. A new node's place is
    the first edge that reaches it; where a step finds more nodes than are left, the places of the last one allowed and of the next tell
    where the walk stops. They come from ranks that end at the budget, so a step moves no more than its fronts' edges.
    """
    good = edges.filter(predicates) if predicates is not None else edges
    out = good.select(F.col("src").alias("at"), F.col("dst").alias("to"), "predicate", "statement_id", F.lit(0).alias("way"))
    back = good.select(F.col("dst").alias("at"), F.col("src").alias("to"), "predicate", "statement_id", F.lit(1).alias("way"))
    walk = settled({"out": out, "in": back, "both": out.unionByName(back)}[direction].repartition("at"))
    place = F.struct("at", "way", "statement_id", "to", "predicate")
    fronts, scanned, ended = [settled(seeds.select("query", "node").distinct().withColumn("depth", F.lit(0)))], [], []
    seen = fronts[0].groupBy("query").agg(F.count("*").alias("seen"))
    for d in range(1, depth + 1):
        front = fronts[-1].join(seen, "query").withColumn("left", most - F.col("seen"))
        for e in ended:  # as many as steps
            front = front.join(e, "query", "left_anti")
        front = settled(front)
        ended.append(front.filter("left <= 0").select("query").distinct())
        front = front.filter("left > 0")
        if not front.limit(1).count():
            break
        met = settled(walk.join(small(front.select("query", F.col("node").alias("at"), "left")), "at").withColumn("place", place))
        fresh = met.select("query", F.col("to").alias("node"), "place", "left")
        for f in fronts:
            fresh = fresh.join(f, ["query", "node"], "left_anti")
        first = fresh.groupBy("query", "node", "left").agg(F.min("place").alias("place"))
        first = first.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("place"))).filter((F.col("r") <= most + 1) & (F.col("r") <= F.col("left") + 1))
        first = settled(first)
        allowed = F.col("r") <= F.col("left")
        ends = first.groupBy("query", "left").agg(F.max(F.when(allowed, F.col("place"))).alias("last"), F.max(F.when(~allowed, F.col("place"))).alias("stop"), F.sum(allowed.cast("int")).alias("found"))
        ends = front.groupBy("query").agg(F.max("node").alias("end")).join(ends, "query")
        # the last place looked at: where one node more would be too many, that node's edge if the same list leads to it, else the end of the last allowed one's list;
        # where the budget is just spent, the end of that list if nodes of the front are left
        spent = F.col("stop").isNotNull() | ((F.col("found") == F.col("left")) & (F.col("end") > F.col("last.at")))
        ends = settled(ends.withColumn("spent", spent).select("query", "last", "stop", "found", "spent"))
        cut = ends.filter("spent").select("query", "last", "stop")
        own = F.when(F.col("stop.at") == F.col("last.at"), F.col("place") <= F.col("stop")).otherwise(F.col("at") <= F.col("last.at"))
        scanned.append(met.join(cut, "query", "left").filter(F.col("last").isNull() | own).select("query", "at", "to", "predicate", "statement_id", F.lit(d).alias("depth"), "place"))
        ended.append(cut.select("query"))
        fronts.append(settled(first.filter(allowed).select("query", "node", F.lit(d).alias("depth"))))
        seen = settled(seen.join(ends.select("query", "found"), "query", "left").select("query", (F.col("seen") + F.coalesce("found", F.lit(0))).alias("seen")))
    none = walk.limit(0).crossJoin(fronts[0].limit(0).select("query")).select("query", "at", "to", "predicate", "statement_id", F.lit(0).alias("depth"), place.alias("place"))
    return Walk(reduce(DataFrame.unionByName, fronts), reduce(DataFrame.unionByName, scanned, none), reduce(DataFrame.unionByName, ended).distinct() if ended else fronts[0].select("query").limit(0))


def bounded(edges: DataFrame, seeds: DataFrame, depth: int, most: int, direction: str = "both", predicates: Column | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """One walk from seeds (node): nodes, edges, and whether the budget ended it."""
    out = walks(edges, seeds.select(F.lit(0).alias("query"), "node"), depth, most, direction, predicates)
    return out.nodes.drop("query"), out.edges.drop("query"), bool(out.truncated.limit(1).count())


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    return traverse(edges, seeds, depth)[0]


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 8) -> list[str]:
    """Nodes of a shortest path, the least by name where several are; empty if there is none within ``most`` steps.

    The edges are written once and walked both ways; a step joins them with its front alone, which is sent to all if it is small.
    """
    spark = edges.sparkSession
    walk = settled(edges.select("src", "dst"))
    layers = [spark.createDataFrame([(start,)], "node string")]
    seen = layers[0]
    for _ in range(most):
        if layers[-1].filter(F.col("node") == end).limit(1).count():
            break
        front = small(layers[-1].select(F.col("node").alias("at")))
        met = walk.join(front, F.col("src") == F.col("at")).select("at", F.col("dst").alias("node"))
        met = met.unionByName(walk.join(front, F.col("dst") == F.col("at")).select("at", F.col("src").alias("node")))
        step = settled(met.groupBy("node").agg(F.min("at").alias("by")).join(seen, "node", "left_anti"))
        layers.append(step)
        seen = settled(seen.select("node").unionByName(step.select("node")))
    path, node = [end], end
    for layer in reversed(layers[1:]):
        row = layer.filter(F.col("node") == node).first()
        if row is None:
            return []
        node = row.by
        path.append(node)
    return path[::-1] if node == start else []


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Neighbours of a node with direction, once each."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("node"), "predicate", F.lit("out").alias("direction"))
    back = edges.filter(F.col("dst") == node).select(F.col("src").alias("node"), "predicate", F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def components(links: DataFrame, most: int = 40, written: bool = False) -> DataFrame:
    """(id, component) of links (u, v); the least id reachable.

    In a round each node finds the first of itself and its neighbours in an order by hashes, new in each round, and joins the one that this one finds; only nodes
    that were joined stay, with the links between them. Fewer than half of a path's nodes stay on average, and far fewer where nodes have more neighbours, so
    rounds get smaller and their number grows with the logarithm of the nodes; the way back to the nodes that left is as long.
    Ids that aren't whole numbers are numbered in their order first. written: the links are a table, so they are read twice rather than written again.
    """
    kind = links.schema["u"].dataType
    if not isinstance(kind, IntegralType):
        ends = links.filter("u <> v").select("u", "v")
        names = settled(ends.select(F.explode(F.array("u", "v")).alias("name")).distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()))
        numbered = lambda end: names.select(F.col("name").alias(end), F.col("id").alias(f"{end}_at"))
        found = components(ends.join(numbered("u"), "u").join(numbered("v"), "v").select(F.col("u_at").alias("u"), F.col("v_at").alias("v")), most)
        named = names.select(F.col("id").alias("component"), F.col("name").alias("called"))
        return found.join(names, "id").join(named, "component").select(F.col("name").alias("id"), F.col("called").alias("component"))
    edges = links.filter("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = edges if written else settled(edges)
    joined: list[DataFrame] = []
    for r in range(most):
        # a number's place in the round's order, and the place's number: the lower half, which stays, tells what the upper one is crossed with
        place = lambda c, r=r: c.bitwiseXOR(F.shiftleft(F.xxhash64(c.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(r)), 32))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.filter("u is not null").groupBy("u").agg(F.min(place(F.col("v"))).alias("m"))  # both sides below filter alike, so they share its exchange
        first = first.select("u", place(F.least(place(F.col("u")), "m")).alias("m"))
        joined.append(settled(first.join(first.select(F.col("u").alias("m"), F.col("m").alias("to")), "m").select("u", F.col("to").alias("m"))))
        a, b = (joined[-1].select(F.col("u").alias(end), F.col("m").alias(f"{end}_m")) for end in ("u", "v"))
        left = edges.join(a, "u").join(b, "v").filter("u_m <> v_m")
        edges = settled(left.select(F.least("u_m", "v_m").alias("u"), F.greatest("u_m", "v_m").alias("v")).distinct())
        if not edges.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = joined.pop()
    for step in reversed(joined):
        roots = settled(step.join(roots.select(F.col("u").alias("m"), F.col("m").alias("root")), "m", "left").select("u", F.coalesce("root", "m").alias("m")))
    least = roots.groupBy("m").agg(F.min("u").alias("least"))
    return roots.join(least, "m").select(F.col("u").cast(kind).alias("id"), F.col("least").cast(kind).alias("component"))


def weights(beliefs: DataFrame) -> DataFrame:
    """Mean confidence between entities: (src, dst, weight)."""
    return beliefs.groupBy(F.col("subject_id").alias("src"), F.col("object").alias("dst")).agg(F.round(F.avg("confidence"), 6).alias("weight"))


def communities(weighted: DataFrame, rounds: int = 10, ordered: bool = True) -> DataFrame:
    """Labels by weighted propagation: (node, label); a label is the name of the node it came from.

    In a round nodes vote in the order of their names, each seeing the new labels of lesser neighbours and the old ones of
    greater; votes count in both directions, ties go to the least label, nodes without neighbours keep theirs. Such a round has one
    outcome, whatever the order of work: it is found by voting again for nodes with a lesser neighbour whose label changed, until none does.
    So a round takes as many joins as changes need to spread along ascending names, not one for each node.
    ordered=False: all nodes see old labels only, and a node's own label has its neighbours' mean weight.
    """
    both = weighted.select("src", "dst", "weight").unionByName(weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    if not ordered:
        return _synchronous(both, rounds)
    # numbers in the order of names stand for them, as names cost more to move, sort and compare
    names = settled(both.select(F.col("src").alias("name")).distinct().orderBy("name").withColumn("node", F.monotonically_increasing_id()))
    numbered = lambda end: names.select(F.col("name").alias(end), F.col("node").alias(f"{end}_at"))
    merged = weighted.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(numbered("src"), "src").join(numbered("dst"), "dst")
    merged = settled(merged.select(F.col("src_at").alias("src"), F.col("dst_at").alias("dst"), "weight"))
    both = merged.unionByName(merged.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    walk = settled(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))).repartition("dst").persist()  # of use for all rounds; lost parts are read again
    labels = settled(names.select("node", F.col("node").alias("label")))
    # of those that vote again: in a round, the ones above a node whose label changed; at first, the ones below a node that the last round changed
    beside = lambda moved, which: walk.join(small(moved.select(F.col("node").alias("dst"))), "dst").filter(which).select(F.col("src").alias("node")).distinct()
    voters: DataFrame | None = None
    for _ in range(rounds):
        old = new = labels
        while True:
            seen = old.join(new.withColumnRenamed("label", "new"), "node").select(F.col("node").alias("dst"), "label", "new")
            edges = walk if voters is None else walk.join(small(voters.withColumnRenamed("node", "src")), "src", "left_semi")
            votes = edges.join(seen, "dst").select("src", F.when(F.col("dst") < F.col("src"), F.col("new")).otherwise(F.col("label")).alias("label"), "weight")
            tally = votes.groupBy("src", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
            voted = tally.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("voted"))
            changed = settled(voted.join(new, "node").filter("voted <> label").select("node", F.col("voted").alias("label")))
            if not changed.limit(1).count():
                break
            new = settled(new.join(small(changed.select("node", F.col("label").alias("to"))), "node", "left").select("node", F.coalesce("to", "label").alias("label")))
            voters = beside(changed, "src > dst")
        labels = new
        moved = settled(new.join(old.withColumnRenamed("label", "was"), "node").filter("label <> was").select("node"))
        if not moved.limit(1).count():
            break
        voters = settled(beside(moved, "src < dst"))
    walk.unpersist()
    named = names.select(F.col("node").alias("label"), F.col("name").alias("called"))
    return labels.join(names, "node").join(named, "label").select(F.col("name").alias("node"), F.col("called").alias("label"))


def _synchronous(both: DataFrame, rounds: int) -> DataFrame:
    walk = settled(both.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    own = walk.groupBy("src").agg(F.avg("weight").alias("weight"))
    labels = walk.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = walk.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label", "weight")
        votes = votes.unionByName(own.join(labels, F.col("src") == F.col("node")).select("node", "label", "weight"))
        tally = votes.groupBy("node", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        new = settled(tally.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")))
        if not new.join(labels, ["node", "label"], "left_anti").limit(1).count():
            return new
        labels = new
    return labels


def members(labels: DataFrame) -> DataFrame:
    """Communities of two or more: label, size, members."""
    return labels.groupBy("label").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).filter("size >= 2")


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Position from 0 within each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
