"""Connected components by alternating large-star and small-star steps, all in shuffled tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable

ROWS_A_TASK = 500_000


def forest(src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the given ones connect."""
    names, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root = list(range(len(names)))
    out = []
    half = len(src)
    for a, b in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        x, y = a, b
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(names[x]), int(names[y])))
    return out


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of node's component. ``links``: src, dst (longs, not null); nodes without
    a link aren't named; repeated links and those of a node to itself change nothing; no link, no row. Each round is
    written to the shared folder, and the tables of the round before are removed; two sums of a round reach the driver."""
    edges = durable(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "component-links")
    # few links go in one task: a round must not write hundreds of files. More are left to the shuffles as they are, so
    # that the join keeps the parts into which it split a hub.
    few = edges.count() <= ROWS_A_TASK

    def kept(df: DataFrame, name: str) -> DataFrame:
        return durable(df.coalesce(1) if few else df, name)

    before = None
    for _ in range(max_rounds):
        links = edges.coalesce(1) if few else edges
        # large star: link every larger neighbour of a node to the smallest node around
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "component-least")  # so that the join can split a hub
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "component-large")
        # small star: link a node and its smaller neighbours to the smallest of them
        lowest = kept(large.groupBy("u").agg(F.min("v").alias("m")), "component-least")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = kept(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "component-round")
        discard(edges, least, large, lowest)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
