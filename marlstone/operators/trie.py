"""Operators on node tables: reachability, pruned differences and their net form.

Both walks go level by level over all roots at once; equal subtrees are pruned. They see
hashes alone, and children only of inner nodes; each level is written to the shared folder,
so plans stay short and lost executors cost a level. Contents are joined once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import children, is_inner
from ..staging import stage

#: A level of so many rows is broadcast to find its nodes, so that the table of nodes is not shuffled.
FEW = 50_000


def first_of_shards(copies: DataFrame, order: str = "shard_ord") -> DataFrame:
    """One row per hash: the copy of the first shard whose value could be decoded (content not null)."""
    whole = copies.where("content is not null")
    return whole.groupBy("hash").agg(F.min_by(F.struct("node_type", "content", order), order).alias("x")).select("hash", "x.node_type", "x.content", f"x.{order}")


def distinct_nodes(*tables: DataFrame) -> DataFrame:
    """Union with one row per hash."""
    out = tables[0].select("hash", "node_type", "content")
    for t in tables[1:]:
        out = out.unionByName(t.select("hash", "node_type", "content"))
    return out.dropDuplicates(["hash"])


def _edges(nodes: DataFrame) -> DataFrame:
    """hash, kids (16, null where there is none) of the inner nodes, one row per hash."""
    inner = nodes.where(is_inner(F.col("node_type"))).select("hash", children(F.col("node_type"), F.col("content")).alias("kids"))
    return stage(inner.dropDuplicates(["hash"]), "edges")


def _not_found(hash_: str, missing: Column, otherwise: str, kind: str) -> Column:
    return F.when(missing, F.raise_error(F.concat(F.lit("node not found: "), F.lower(F.hex(hash_)))).cast(kind)).otherwise(F.col(otherwise))


def reachable(nodes: DataFrame, roots: DataFrame, groups: list[str], tolerate_missing: bool = False, leaves: bool = False) -> DataFrame:
    """groups, hash, node_type, content, level: all nodes under each group's root, or its leaves alone; a missing one raises unless tolerated.

    nodes: hashes may repeat, with the same content; read twice. A hash refers to none above it,
    so a level is deduplicated by itself; one that hangs in several depths keeps its least level.
    """
    edges = _edges(nodes)
    frontier = stage(roots.select(*groups, F.col("root").alias("hash")).where("hash is not null and hash <> unhex(repeat('00', 32))").distinct(), "reachable")
    whole, level = None, 0
    while (n := frontier.count()) or whole is None:
        own = frontier.withColumn("level", F.lit(level))
        whole, level = own if whole is None else whole.unionByName(own), level + 1
        met = edges.join(F.broadcast(frontier) if n <= FEW else frontier, "hash")
        frontier = stage(met.select(*groups, F.explode(F.filter("kids", lambda h: h.isNotNull())).alias("hash")).distinct(), "reachable")
    # Dealt by hash, as the nodes are: neither grouping is dealt again.
    met = whole.repartition("hash").groupBy(*groups, "hash").agg(F.min("level").alias("level"))
    held = nodes.withColumn("content", F.when(is_inner(F.col("node_type")), F.lit(bytearray())).otherwise(F.col("content"))) if leaves else nodes
    found = met.join(distinct_nodes(held), "hash", "left")
    found = found.where("content is not null") if tolerate_missing else found.withColumn("content", _not_found("hash", F.col("content").isNull(), "content", "binary"))
    if leaves:  # what is missing has no type, and raises as it is written
        found = found.where(F.coalesce(~is_inner(F.col("node_type")), F.lit(True)))
    return stage(found.select(*groups, "hash", "node_type", "content", "level"), "reached")


def transactions(nodes: DataFrame, roots: DataFrame, groups: list[str]) -> DataFrame:
    """groups, tx_hash, tx_blob, meta_blob of the leaves under each group's transaction root."""
    from ..functions.expr import tx_leaf_read

    leaves = reachable(nodes, roots, groups, leaves=True)
    return leaves.select(*groups, tx_leaf_read(F.col("content")).alias("t")).select(*groups, "t.tx_hash", "t.tx_blob", "t.meta_blob")


def _walk(nodes: DataFrame, pairs: DataFrame, groups: list[str]) -> DataFrame:
    """groups, op, hash of both sides of each pair of nodes that is met; rows may repeat."""
    edges = _edges(nodes)
    zero = F.unhex(F.lit("00" * 32))
    none = F.array_repeat(F.lit(None).cast("binary"), 16)
    # A side that isn't there is looked up by a key that no node has, one for each row: nulls would all go to one task.
    nothing = lambda h, other: F.coalesce(h, F.concat(F.lit(bytearray(1)), other))
    frontier = stage(pairs.select(*groups, F.nullif("old", zero).alias("old"), F.nullif("new", zero).alias("new")).where("not (old <=> new)"), "diff")
    whole = None
    while (n := frontier.count()) or whole is None:
        whole = frontier if whole is None else whole.unionByName(frontier)
        held = edges
        if n <= FEW:
            wanted = frontier.select(F.explode(F.array("old", "new")).alias("hash")).where("hash is not null").distinct()
            held = edges.join(F.broadcast(wanted), "hash", "left_semi")
        both = frontier.select(*groups, nothing(F.col("old"), F.col("new")).alias("__a"), nothing(F.col("new"), F.col("old")).alias("__b"))
        both = both.join(held.select(F.col("hash").alias("__a"), F.col("kids").alias("o")), "__a", "left").join(held.select(F.col("hash").alias("__b"), F.col("kids").alias("n")), "__b", "left")
        kids = F.arrays_zip(F.coalesce("o", none).alias("old"), F.coalesce("n", none).alias("new"))
        slots = both.where("o is not null or n is not null").select(*groups, F.explode(F.filter(kids, lambda x: ~x["old"].eqNullSafe(x["new"]))).alias("s"))
        frontier = stage(slots.select(*groups, F.col("s.old").alias("old"), F.col("s.new").alias("new")).distinct(), "diff")
    side = lambda op, h: F.struct(F.lit(op).alias("op"), F.col(h).alias("hash"))
    return whole.select(*groups, F.explode(F.array(side("add", "new"), side("del", "old"))).alias("s")).select(*groups, "s.*").where("hash is not null")


def _with_nodes(delta: DataFrame, nodes: DataFrame, groups: list[str]) -> DataFrame:
    """delta (groups, op, hash) with node_type and content. What is added must be there; what is deleted may be gone."""
    found = delta.join(distinct_nodes(nodes), "hash", "left")
    found = found.withColumn("content", _not_found("hash", F.col("content").isNull() & (F.col("op") == "add"), "content", "binary"))
    return stage(found.select(*groups, "op", "hash", "node_type", "content"), "delta")


def raw_diff(nodes: DataFrame, pairs: DataFrame, groups: list[str]) -> DataFrame:
    """groups, op, hash, node_type, content. pairs: groups, old, new (null: no tree). Slots are walked together; equal hashes end the walk.

    nodes: hashes may repeat, with the same content; read twice. A hash may come out both
    added and deleted, where a leaf moved to another depth; see net().
    """
    return _with_nodes(_walk(nodes, pairs, groups).repartition("hash").distinct(), nodes, groups)


def net(delta: DataFrame, groups: list[str]) -> DataFrame:
    """delta without the hashes that a group both adds and deletes: the difference of the two sets. One row per group and hash."""
    rest = [c for c in delta.columns if c not in (*groups, "hash", "op")]
    each = delta.groupBy(*groups, "hash").agg(F.min("op").alias("op"), F.max("op").alias("other"), *([F.first(F.struct(*rest)).alias("x")] if rest else []))
    return each.where("op = other").select(*groups, "op", "hash", *[f"x.{c}" for c in rest])


def diff(nodes: DataFrame, pairs: DataFrame, groups: list[str]) -> DataFrame:
    return _with_nodes(net(_walk(nodes, pairs, groups).repartition("hash"), groups), nodes, groups)


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The contract of a difference: rows of new not in old as add, of old not in new as del."""
    added = new.join(old.select(*keys).distinct(), keys, "left_anti").withColumn("op", F.lit("add"))
    return added.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti").withColumn("op", F.lit("del")))
