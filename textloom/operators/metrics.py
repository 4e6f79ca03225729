"""Graph metrics: degree, closeness, betweenness, PageRank, eigenvector, components, communities, density, paths."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import ConceptGraph


def density(g: ConceptGraph) -> DataFrame:
    n, m = g.nodes.agg(F.count("*").alias("n")), g.edges.where("src <> dst").agg(F.count("*").alias("m"))
    pairs = F.col("n") * (F.col("n") - 1)
    return n.join(m).select(F.when(F.col("n") > 1, F.col("m") * (1.0 if g.directed else 2.0) / pairs).otherwise(0.0).alias("density"))


def degree_centrality(g: ConceptGraph) -> DataFrame:
    """(id, score): degree over the number of other nodes."""
    n = F.broadcast(g.nodes.agg((F.count("*") - 1).alias("others")))  # one row
    return g.degrees().join(n).select("id", F.when(F.col("others") > 0, F.col("degree") / F.col("others")).otherwise(0.0).alias("score"))


def _both_ways(g: ConceptGraph) -> DataFrame:
    e = g.edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    ways = F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e if g.directed else e.select(F.inline(ways))  # the edges are made once


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read again: computed once, and lineage ends here."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pagerank(g: ConceptGraph, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(id, score) by weighted power iteration; rank of nodes without links out is spread evenly."""
    edges = _both_ways(g)
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = stored(g.nodes.select("id").join(out.select(F.col("src").alias("id"), F.lit(True).alias("links")), "id", "left"))
    n = nodes.count()
    ranks = nodes.withColumn("score", F.lit(1.0 / n if n else 0.0))
    for i in range(rounds):
        lost = ranks.where("links is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        sent = share.join(ranks.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = nodes.join(sent, "id", "left").join(F.broadcast(lost)).select("id", "links", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        new = stored(new)
        moved = new.join(ranks.select("id", F.col("score").alias("old")), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        ranks = new
        if moved < n * tolerance:
            break
    return ranks.select("id", "score")


def eigenvector(g: ConceptGraph, tolerance: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """(id, score) of unit length, by power iteration on A + I."""
    edges = stored(_both_ways(g).select("src", "dst"))
    n = g.nodes.count()
    x = stored(g.nodes.select("id", F.lit(1.0 / n if n else 0.0).alias("score")))
    for _ in range(rounds):
        sent = edges.join(x.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("got"))
        raw = x.join(sent, "id", "left").select("id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("old"))
        norm = F.broadcast(raw.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm")))
        new = stored(raw.join(norm).select("id", (F.col("score") / F.col("norm")).alias("score"), "old"))
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        x = new.select("id", "score")
        if moved < n * tolerance:
            break
    return x


#: Above so many edges the adjacency is not shipped to tasks.
ADJACENCY_EDGES = 2_000_000


def _adjacency(g: ConceptGraph, reverse: bool = False) -> tuple[list[str], dict[str, list[str]]]:
    if g.edges.count() > ADJACENCY_EDGES:
        raise ValueError(f"a graph of more than {ADJACENCY_EDGES} edges: use degree or PageRank centrality")
    edges = _both_ways(g).select("src", "dst").distinct().collect()  # checked above
    out: dict[str, list[str]] = defaultdict(list)
    for r in edges:
        a, b = (r.dst, r.src) if reverse else (r.src, r.dst)
        out[a].append(b)
    return sorted(r.id for r in g.nodes.select("id").collect()), {k: sorted(v) for k, v in out.items()}


def _levels(source: str, near: dict[str, list[str]]) -> tuple[list[str], dict[str, int], dict[str, float], dict[str, list[str]]]:
    """Breadth-first: visiting order, distance, number of shortest paths, predecessors."""
    order, dist, paths, before, queue = [], {source: 0}, defaultdict(float, {source: 1.0}), defaultdict(list), deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near.get(v, ()):
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    return order, dist, paths, before


def betweenness(g: ConceptGraph, normalized: bool = True) -> DataFrame:
    """(id, score): shares of shortest paths, one source a row of work (Brandes 2001), sources spread over tasks."""
    spark = g.nodes.sparkSession
    names, near = _adjacency(g)
    shared, n = spark.sparkContext.broadcast(near), len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: dict[str, float] = defaultdict(float)
            for source in pdf["id"]:
                order, _, paths, before = _levels(source, shared.value)
                part: dict[str, float] = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != source:
                        total[w] += part[w]
            yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    scale = 1.0 if g.directed else 0.5
    if normalized:
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = g.nodes.select("id").mapInPandas(run, "id string, part double").groupBy("id").agg(F.sum("part").alias("part"))
    return g.nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("score"))


def closeness(g: ConceptGraph) -> DataFrame:
    """(id, score): reached others over their distances, scaled by the share of nodes reached; by distances inwards when directed."""
    names, near = _adjacency(g, reverse=g.directed)
    shared, n = g.nodes.sparkSession.sparkContext.broadcast(near), len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = []
            for source in pdf["id"]:
                dist = _levels(source, shared.value)[1]
                far = sum(dist.values())
                scores.append((len(dist) - 1) / far * ((len(dist) - 1) / (n - 1)) if far and n > 1 else 0.0)
            yield pd.DataFrame({"id": pdf["id"], "score": scores})

    return g.nodes.select("id").mapInPandas(run, "id string, score double")


def centrality(g: ConceptGraph, method: str = "betweenness") -> DataFrame:
    ways = {"betweenness": betweenness, "degree": degree_centrality, "closeness": closeness, "eigenvector": eigenvector, "pagerank": pagerank}
    if method not in ways:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(ways)}")
    return ways[method](g)


def components(g: ConceptGraph) -> DataFrame:
    """(id, component): the smallest id that links reach, whatever their direction; labels halve their distance to it each round."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = stored(g.edges.where("src <> dst").select(F.inline(ways)).distinct())
    labels = stored(g.nodes.select("id", F.col("id").alias("component")))
    while True:
        low = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("low"))
        near = labels.join(low, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("c"), F.col("component").alias("old"))
        jump = near.select(F.col("id").alias("c"), F.col("c").alias("far"))
        new = stored(near.join(jump, "c").select("id", F.least("c", "far").alias("component"), "old"))
        if new.where("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def shortest_path(g: ConceptGraph, source: str, target: str) -> list[str]:
    """The nodes of a shortest path, the first by names; ValueError if there is none.  One join a step over the frontier."""
    edges = stored(_both_ways(g).select("src", "dst").distinct())
    seen = g.nodes.where(F.col("id") == source).select("id", F.array("id").alias("path"))
    if seen.isEmpty() or g.nodes.where(F.col("id") == target).isEmpty():
        raise ValueError("no such node")
    frontier = seen
    while True:
        hit = frontier.where(F.col("id") == target).first()
        if hit:
            return list(hit.path)
        step = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = stored(step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            raise ValueError(f"no path from {source} to {target}")
        seen = stored(seen.unionByName(frontier))


def communities(g: ConceptGraph, method: str = "greedy") -> DataFrame:
    """(id, community), numbered by falling size: greedy modularity (Clauset, Newman, Moore 2004) or label propagation."""
    undirected = ConceptGraph(g.nodes, g.edges, False)
    if method == "label_propagation":
        return _numbered(components(undirected).sparkSession, _propagated(undirected))
    if method not in ("greedy", "louvain"):
        raise ValueError(f"unknown method {method!r}: greedy, louvain or label_propagation")
    if g.edges.count() > ADJACENCY_EDGES:
        raise ValueError(f"a graph of more than {ADJACENCY_EDGES} edges: use label_propagation")
    weights: dict[str, dict[str, float]] = {r.id: {} for r in g.nodes.select("id").collect()}  # checked above
    for r in g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w")).collect():
        weights[r.a][r.b] = weights[r.b][r.a] = r.w
    total = sum(sum(x.values()) for x in weights.values())
    member = {v: {v} for v in weights}
    degree = {v: sum(x.values()) for v, x in weights.items()}
    while total:
        gains = [(2 * (w / total - degree[a] * degree[b] / total**2), a, b) for a, x in weights.items() for b, w in x.items() if a < b]
        best = max(gains, key=lambda x: (x[0], -sum(map(ord, x[1])), x[1]), default=(0.0, "", ""))
        if best[0] <= 1e-12:
            break
        _, a, b = best
        for c, w in weights.pop(b).items():
            del weights[c][b]
            if c != a:
                weights[a][c] = weights[c][a] = weights[a].get(c, 0.0) + w
        degree[a] += degree.pop(b)
        member[a] |= member.pop(b)
    return _numbered(g.nodes.sparkSession, {v: min(m) for m in member.values() for v in m})


def _propagated(g: ConceptGraph, rounds: int = 20) -> dict[str, str] | DataFrame:
    edges = stored(_both_ways(g))
    labels = stored(g.nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("new"))
        new = stored(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("old")))
        labels, done = new.select("id", "label"), new.where("label <> old").isEmpty()
        if done:
            break
    return labels


def _numbered(spark, found) -> DataFrame:
    if isinstance(found, dict):
        found = spark.createDataFrame(list(found.items()), "id string, label string")
    from pyspark.sql import Window

    sizes = found.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    number = sizes.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("community"))
    return found.join(number, "label").select("id", "community")


def modularity(g: ConceptGraph, found: DataFrame) -> float:
    e = g.edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w"))
    m = e.agg(F.sum("w")).first()[0] or 0.0
    if not m:
        return 0.0
    c = found.select("id", "community")
    inside = e.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    ends = e.select("src", "w").union(e.select("dst", "w")).toDF("id", "w").join(c, "id").groupBy("community").agg(F.sum("w").alias("d"))
    return inside / m - ends.agg(F.sum((F.col("d") / (2 * m)) * (F.col("d") / (2 * m)))).first()[0]


def assign_communities(g: ConceptGraph, found: DataFrame, name: str = "community") -> DataFrame:
    return g.nodes.join(found.select("id", F.col("community").alias(name)), "id", "left")
