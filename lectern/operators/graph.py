"""Citation graphs: building, ranking, closures, chains and cycles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

# How much a relation counts, in the live and in the older edition.
RELATIONS_V3 = {"foundation": 1.25, "extends": 1.1, "validates": 1.0, "contradicts": 1.0, "background": 0.55}
RELATIONS_V1 = {**RELATIONS_V3, "related": 0.85}


def _weights(relation, table: Mapping[str, float], default: float):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), relation), F.lit(default))


def ranked_edges_v3(edges: DataFrame, weights: Mapping[str, float] = RELATIONS_V3) -> DataFrame:
    """(source, target, w): similarity and unknown relations and weights of 0 or less go."""
    return edges.where("relation <> 'similarity'").withColumn("w", _weights(F.col("relation"), weights, 0.0)).where("w > 0").select("source", "target", "w")


def ranked_edges_v1(edges: DataFrame, as_of: int) -> DataFrame:
    """(source, target, w): edge weight, relation, self-citation (0.7) and the target year's recency multiplied."""
    age = F.greatest(F.lit(0), as_of - F.coalesce(F.col("year"), F.lit(as_of)))
    w = F.coalesce("weight", F.lit(1.0)) * _weights(F.coalesce("relation", F.lit("validates")), RELATIONS_V1, 1.0) * F.when(F.col("self_citation"), 0.7).otherwise(1.0) * (0.7 + 0.3 * F.exp(-age / 8))
    return edges.select("source", "target", w.alias("w"))


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 150, tolerance: float = 1e-9, rescale: bool = False, every: int = 5) -> DataFrame:
    """(id, rank). ``nodes``: id and p, the personalisation (uniform if it has no positive value); ``edges``: source,
    target, w > 0. Rank of nodes without edges goes back to the personalisation. Stops at ``iterations`` or when the
    sum of changes is under ``tolerance`` (0: never); lineage is cut every ``every`` rounds."""
    positive = nodes.select("id", F.greatest(F.lit(0.0), F.coalesce("p", F.lit(0.0))).alias("p")).dropDuplicates(["id"])
    total, n = positive.agg(F.sum("p"), F.count(F.lit(1))).first()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    base = durable(positive.select("id", (F.col("p") / total if total else F.lit(1.0 / n)).alias("p")), "rank-nodes")
    known = edges.join(base.select(F.col("id").alias("source")), "source", "left_semi").join(base.select(F.col("id").alias("target")), "target", "left_semi")
    known = durable(known.groupBy("source", "target").agg(F.sum("w").alias("w")), "rank-edges")  # rounds go over pairs, not edges
    out = known.groupBy("source").agg(F.sum("w").alias("out"))
    shares = durable(known.join(out, "source").select("source", "target", (F.col("w") / F.col("out")).alias("share")), "rank-shares")
    has = shares.select(F.col("source").alias("id")).distinct()
    hanging = base.join(has, "id", "left_anti").select("id")
    rank = base.select("id", F.col("p").alias("rank"))
    for i in range(iterations):
        given = shares.join(rank, shares.source == rank.id).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = rank.join(hanging, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        now = base.join(given, "id", "left").crossJoin(F.broadcast(loose)).select("id", ((1 - damping) * F.col("p") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("p"))).alias("rank"))
        if i % every == every - 1 or i == iterations - 1:
            now = durable(now, "rank-round")
            if tolerance:
                before = rank.withColumnRenamed("rank", "was")
                if now.join(before, "id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance:
                    rank = now
                    break
        rank = now
    if rescale:
        whole = rank.agg(F.sum("rank").alias("whole"))
        rank = rank.crossJoin(F.broadcast(whole)).select("id", (F.col("rank") / F.col("whole")).alias("rank"))
    return rank


def graph_edges(saved: DataFrame, automatic: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed saved edges, and automatic ones whose pair isn't saved at all, confirmed or excluded. Saved edges need
    both ends among the nodes."""
    ids = nodes.select("id")
    valid = saved.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    new = automatic.join(valid.select("source", "target"), ["source", "target"], "left_anti")
    return valid.where("not excluded").select("source", "target", "relation", F.lit(True).alias("confirmed")).unionByName(new.select("source", "target", "relation", F.lit(False).alias("confirmed")))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge a direction of (source, target, relation, weight, ord): the largest weight. Only edges that raise it
    count for the relation: the first of them that isn't 'related' names it."""
    before = Window.partitionBy("source", "target").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rising = edges.withColumn("most", F.max("weight").over(before)).where("most IS NULL OR weight > most")
    named = F.min(F.when(F.col("relation") != "related", F.struct("ord", "relation")))
    return rising.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.coalesce(named["relation"], F.lit("related")).alias("relation"))


def closure(start: DataFrame, groups: DataFrame, most: int = 50) -> DataFrame:
    """Members reachable from ``start`` (member) through shared groups (grp, member): a frontier joins until it is empty."""
    seen = durable(start.select("member").distinct(), "closure")
    frontier = seen
    for _ in range(most):
        touched = frontier.join(groups, "member").select("grp").distinct()
        frontier = durable(touched.join(groups, "grp").select("member").distinct().join(seen, "member", "left_anti"), "closure-frontier")
        if frontier.isEmpty():
            return seen
        seen = durable(seen.unionByName(frontier), "closure")
    raise RuntimeError("closure did not settle")


def in_cycles(edges: DataFrame, most: int = 1000) -> DataFrame:
    """Nodes left when nodes without an incoming or without an outgoing edge are peeled off again and again: none if
    the order has no cycle. A round peels a node off each end of a path; what isn't settled after ``most`` rounds raises."""
    left = durable(edges.select("source", "target").distinct(), "cycle-edges")
    n = left.count()
    for _ in range(most):
        inner = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        left = durable(inner, "cycle-edges")
        now = left.count()
        if now == n:
            break
        n = now
    else:
        raise RuntimeError(f"paths are longer than {most} rounds peel off")
    return left.select(F.col("source").alias("id")).unionByName(left.select(F.col("target").alias("id"))).distinct()


def chains(links: DataFrame) -> DataFrame:
    """(head, node, pos) of one-to-one links, from heads that nothing links to; nodes of a cycle have no head and no row.

    Pointers double: after k rounds a node knows the node 2**k links before it, or its head and how far that is, so a
    chain of n nodes takes log2(n) rounds."""
    ends = links.select(F.col("source").alias("node")).unionByName(links.select(F.col("target").alias("node"))).distinct()
    before = links.select(F.col("target").alias("node"), F.col("source").alias("prev"))
    state = durable(ends.join(before, "node", "left").select("node", F.coalesce("prev", "node").alias("at"), F.col("prev").isNotNull().cast("long").alias("pos")), "chain-state")
    heads = durable(state.where("pos = 0").select(F.col("node").alias("head")), "chain-heads")
    for _ in range(state.count().bit_length()):
        if state.join(heads, state["at"] == heads["head"], "left_anti").isEmpty():
            break
        far = state.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("pos").alias("more"))
        state = durable(state.join(far, "at").select("node", F.col("further").alias("at"), (F.col("pos") + F.col("more")).alias("pos")), "chain-state")
    return state.join(heads, state["at"] == heads["head"]).select("head", "node", F.col("pos").cast("int").alias("pos"))
