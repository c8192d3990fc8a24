"""Connected components of links.

Up to LOCAL links, a table of bounded size, are joined in one task; more by alternating
large and small stars over the whole cluster. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LOCAL = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: each larger neighbour moves to the least neighbour; small: each smaller one does."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for f in frames:
        for x, y in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    yield pd.DataFrame({"node": list(parent), "component": [root(x) for x in parent]})


def components(links: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """node, component (the least node reachable) for every node that has a link to another. links: a written table, as it is read several times."""
    links = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b"))
    if links.count() <= local:
        kind = links.schema["a"].dataType.simpleString()
        return links.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}")
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "components")
    mark = _mark(edges)
    while True:
        edges = stage(_star(_star(edges, True), False), "components")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and hardly else."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1_000_003)).collect()[0])
