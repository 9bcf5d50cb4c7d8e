"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.session import cut, discard


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours v, from rows (u, v)."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v): component is the smallest node reachable.

    Each round joins every edge to the minimum of an end's neighbourhood, so a node with
    very many edges is one key of a join, which Spark splits, and never a collected list.
    The number of rounds grows with the logarithm of the longest chain. Edges with a null
    end and loops are left out; an empty table gives an empty table.
    """
    edges = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    state = _state(edges)
    while state[0]:  # until a round changes nothing
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = _nearest(down)
        small = down.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small.where("u <> v"), "edges", 2 * state[0])
        discard(edges)
        edges, last = after, state
        state = _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written table edges(u, v) without nulls and loops, each node joined to its smallest neighbour: (node, component) of what that joins, and the edges (u, v) between those, once each.

    That takes a row per node. Edges are named one end before the other, and repeats go away
    in between, so a table of many more edges than nodes is sent about once.
    """
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    near = cut(edges.select(ends.alias("e")).groupBy("e.u").agg(F.min("e.v").alias("v")), "near")
    joined = cut(connected_components(near), "joined")
    one, other = (joined.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("u", "v"))
    between = edges.join(one, "u").select("_u", "v").distinct().join(other, "v").where("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct()
    discard(near)
    return joined, between


def widened(joined: DataFrame, wider: DataFrame) -> DataFrame:
    """(node, component) of contracted() edges: joined, by the components of the edges in between."""
    wider = wider.select(F.col("node").alias("component"), F.col("component").alias("_wider"))
    return joined.join(wider, "component", "left").select("node", F.coalesce("_wider", "component").alias("component"))


def contracted_components(edges: DataFrame) -> DataFrame:
    """connected_components() of a written table without nulls and loops: its rounds run over rows in proportion to nodes."""
    joined, between = contracted(edges)
    return widened(joined, connected_components(between))
