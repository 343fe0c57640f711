"""Connected components by contraction, and groups of sorted rows streamed in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node.

    Each round points every node at its smallest neighbour, follows the pointers twice
    and contracts the edges, so a round at least halves the nodes that still have edges.
    Minima are taken before the shuffle; a node with very many edges is split by AQE in
    the joins.
    """
    e = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                    "cc-edges")
    where = materialize(e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                        .withColumn("component", F.col("node")), "cc-map")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        to = materialize(to, "cc-to")
        for _ in range(2):
            up = to.select(F.col("x").alias("__x"), F.col("p").alias("__p"))
            to = to.join(up, F.col("p") == F.col("__x")).select("x", F.col("__p").alias("p"))
        to = materialize(to, "cc-to")
        left, right = to.toDF("a", "pa"), to.toDF("b", "pb")
        e = materialize(e.join(left, "a").join(right, "b").filter("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        where = materialize(where.join(to, F.col("component") == F.col("x"), "left")
                            .select("node", F.coalesce("p", "component").alias("component")), "cc-map")
    # A pointer may stop short of the smallest node of its tree; the last contraction cannot.
    return where


def groups(batches, keys: list[str]):
    """Tables of the rows of equal ``keys`` (long columns, no nulls) from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy() for k in keys])
        cut = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:]):
            key = tuple(cols[:, lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each in a square boolean matrix of links."""
    root = np.arange(len(linked))
    links = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(links, root[None, :], len(root)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new
