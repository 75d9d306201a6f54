"""Connected components of a link table, as a loop of joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored

# Links that a task contracts at a time.
CONTRACTED = 1 << 18


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for all nodes in links.

    Alternates large-star and small-star steps, which end in stars around the
    roots in about log(n)**2 rounds at most. Each round is written to the shared
    folder. A node's neighbours are only ever reduced to their minimum. What one task
    reads is contracted by itself, a bounded number of links at a time, which
    saves rounds.

    Null nodes and links of a node with itself are left out; repeated links count once.
    """
    edges = links.select(
        F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
    )
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v")
    edges = stored(_contracted(_contracted(edges).distinct()), "links")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m")
        large = large.where("u <> m").distinct()
        least = large.groupBy("u").agg(F.min("m").alias("root"))
        small = large.join(least, "u").select(F.col("m").alias("u"), "root").where("u <> root")
        edges = least.select("u", F.col("root").alias("v")).unionByName(
            small.select("u", F.col("root").alias("v"))
        )
        edges = stored(_contracted(edges.distinct()), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _contracted(edges: DataFrame) -> DataFrame:
    """Links of the same components, from each node to the smallest that its batch reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("u", "v")]))
            size += batch.num_rows
            if size >= CONTRACTED:
                yield _stars(np.concatenate(held, axis=1))
                held, size = [], 0
        if size:
            yield _stars(np.concatenate(held, axis=1))

    return edges.mapInArrow(run, "u long, v long")


def _stars(edges: np.ndarray) -> pa.RecordBatch:
    nodes, place = np.unique(edges, return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in zip(*place.reshape(2, -1).tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        # Nodes are in order, so the smaller place is the smaller node.
        root[max(a, b)] = min(a, b)
    for i, at in enumerate(root):
        root[i] = root[at]
    root = np.array(root, np.int64)
    own = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"]
    )


def _state(edges: DataFrame) -> tuple:
    """Equal for equal tables (one row of sums)."""
    sums = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(sums)
