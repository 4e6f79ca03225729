"""Connected components of a link table, by joins and aggregations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import dropped, stored


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (u, v) as stars around the smallest node of each component: fewer rows, same components."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_pydict({"u": u, "v": v})


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v: longs) but the roots; root: the smallest node of the component.

    Alternates the large-star and small-star steps until nothing changes.  Each step is one minimum by node and one
    join, so a node with very many links is an aggregation with partial sums and a join that Spark can split.
    Links of a node to itself and repeated links change nothing; no links, no rows.
    """
    kept = links.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = stored(kept.mapInArrow(_forest, "u long, v long").distinct(), "links")  # v < u
    before = None
    while True:
        # large star: neighbours above a node go to the smallest of all its neighbours
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        under = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(under, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(under.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(small, "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges)
        edges = new
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
