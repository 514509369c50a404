"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import forget, materialize

#: Edges that a task contracts at once.
LOCAL_EDGES = 200_000


def contracted(edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars, of nodes and their least one: each node takes the least of its neighbours' and its label's label until none falls."""
    u, v = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def stars() -> pa.RecordBatch:
        u, v = contracted(held)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        rows += len(b)
        if rows >= LOCAL_EDGES:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Returns ``(node, root)`` for every node that an edge ``(u, v)`` of longs touches; ``root`` is the least node.

    First each task turns up to ``LOCAL_EDGES`` of its edges into stars of their own components, which leaves few to be shuffled; where all
    edges fit that number, that is the result. Then alternates large-star and small-star steps until the edges are a forest of stars. Each step is a
    minimum per node, combined before the shuffle, and a join with it, so no neighbour list is ever held;
    a hub's rows are split by the adaptive skew join. Each round's edges go to the shared folder.
    Self-loops and repeated edges are ignored; an empty list gives no rows.
    """
    given = materialize(edges.where("u <> v").select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")).distinct(), "given")
    few = given.count() <= LOCAL_EDGES
    edges = materialize((given.coalesce(1) if few else given).mapInArrow(_contract, "u bigint, v bigint"), "edges")
    forget(given)
    before = None if few else _state(edges)
    while not few:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialize(small.union(least).distinct(), "edges")
        after = _state(edges)
        forget(old)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
