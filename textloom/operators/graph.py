"""Concept graphs: two tables and a direction.  Nodes (id, label, frequency, pos, definition), edges (src, dst, weight, relation_type, evidence)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "id string, label string, frequency long, pos string, definition string"
EDGE = "src string, dst string, weight double, relation_type string, evidence array<string>"


@dataclass(frozen=True)
class ConceptGraph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    def with_nodes(self, more: DataFrame) -> ConceptGraph:
        """Nodes added; one that is there already keeps what the new row leaves null."""
        both = self.nodes.withColumn("k", F.lit(0)).unionByName(_shaped_nodes(more).withColumn("k", F.lit(1)))
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
        return ConceptGraph(both.groupBy("id").agg(*[last(c) for c in ("label", "frequency", "pos", "definition")]), self.edges, self.directed)

    def with_edges(self, more: DataFrame) -> ConceptGraph:
        """Edges added, their ends as nodes too; of a pair that is there already the new row stands."""
        both = _canonical(self.edges, self.directed).withColumn("k", F.lit(0)).unionByName(_canonical(_shaped_edges(more), self.directed).withColumn("k", F.lit(1)))
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
        edges = both.groupBy("src", "dst").agg(*[last(c) for c in ("weight", "relation_type", "evidence")])
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(self.nodes, "id", "left_anti")
        return ConceptGraph(self.nodes.unionByName(_shaped_nodes(ends)), edges, self.directed)

    def without_nodes(self, ids: list[str]) -> ConceptGraph:
        return ConceptGraph(self.nodes.where(~F.col("id").isin(ids)), self.edges.where(~F.col("src").isin(ids) & ~F.col("dst").isin(ids)), self.directed)

    def without_edge(self, src: str, dst: str) -> ConceptGraph:
        hit = (F.col("src") == src) & (F.col("dst") == dst)
        if not self.directed:
            hit = hit | ((F.col("src") == dst) & (F.col("dst") == src))
        return ConceptGraph(self.nodes, self.edges.where(~hit), self.directed)

    def neighbors(self, node: str) -> DataFrame:
        out = self.edges.where(F.col("src") == node).select(F.col("dst").alias("id"))
        return out if self.directed else out.union(self.edges.where(F.col("dst") == node).select("src")).distinct()

    def degrees(self) -> DataFrame:
        """(id, degree); a loop counts 2."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(ends, "id", "left").na.fill(0, ["degree"])


def _shaped_nodes(df: DataFrame) -> DataFrame:
    kinds = dict(x.split() for x in NODE.split(", "))
    return df.select(*[F.coalesce("label", "id").alias("label") if c == "label" and "label" in df.columns else F.col("id").alias("label") if c == "label" else F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


def _shaped_edges(df: DataFrame) -> DataFrame:
    kinds = dict(x.split() for x in EDGE.split(", "))
    return df.select(*[F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


def _canonical(edges: DataFrame, directed: bool) -> DataFrame:
    return edges if directed else edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def graph(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> ConceptGraph:
    return ConceptGraph(_shaped_nodes(nodes), _canonical(_shaped_edges(edges), directed), directed)


def from_matrix(matrix: DataFrame, threshold: float = 0.0, directed: bool = False) -> ConceptGraph:
    """All terms as nodes; an edge where the score reaches ``threshold``."""
    kept = matrix.where((F.col("score") >= threshold) & ((F.col("t1") != F.col("t2")) if directed else (F.col("t1") < F.col("t2"))))
    nodes = matrix.select(F.col("t1").alias("id")).union(matrix.select("t2")).distinct()
    return graph(nodes, kept.select(F.col("t1").alias("src"), F.col("t2").alias("dst"), F.col("score").alias("weight"), F.lit("cooccurrence").alias("relation_type")), directed)


def from_relations(relations: DataFrame, terms: DataFrame | None = None, include_evidence: bool = True) -> ConceptGraph:
    """Directed; ends lower-cased; a pair's weight counts its evidence; of several types the last by name stands."""
    lower = relations.select(F.lower("source").alias("src"), F.lower("target").alias("dst"), "relation_type", "n", "evidence")
    if terms is not None:
        for end in ("src", "dst"):
            lower = lower.join(terms.select(F.lower("term").alias(end)).distinct(), end, "left_semi")
    evidence = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("relation_type", "evidence"))), lambda x: x["evidence"]))
    edges = lower.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight"), F.max("relation_type").alias("relation_type"), (evidence if include_evidence else F.lit(None).cast("array<string>")).alias("evidence"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph(nodes, edges, True)


def from_terms(terms: DataFrame) -> ConceptGraph:
    """Nodes only, of (term, ...)."""
    nodes = terms.withColumnRenamed("term", "id")
    return graph(nodes, terms.sparkSession.createDataFrame([], EDGE))


def isolated(g: ConceptGraph) -> DataFrame:
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return g.nodes.join(ends, "id", "left_anti")


def connect_isolated(g: ConceptGraph, matrix: DataFrame, min_degree: int = 1) -> ConceptGraph:
    """Each node below ``min_degree`` is tied to its strongest partner among the others; ties by name."""
    degrees = g.degrees()
    weak, anchors = degrees.where(F.col("degree") < min_degree).select(F.col("id").alias("t1")), degrees.where(F.col("degree") >= min_degree).select(F.col("id").alias("t2"))
    scores = matrix.where("score > 0").join(weak, "t1", "left_semi").join(anchors, "t2", "left_semi")
    best = scores.groupBy("t1").agg(F.min_by("t2", F.struct(-F.col("score"), F.col("t2"))).alias("dst"), F.max("score").alias("weight"))
    return g.with_edges(best.select(F.col("t1").alias("src"), "dst", "weight", F.lit("cooccurrence").alias("relation_type")))


def consolidated(g: ConceptGraph) -> ConceptGraph:
    """Nodes of one label become the first by id; weights add up, evidence is joined, loops that arise go."""
    first = g.nodes.groupBy("label").agg(F.min("id").alias("to"))
    moved = g.nodes.join(first, "label").select("id", "to")
    edges = g.edges.join(moved.toDF("src", "s"), "src").join(moved.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight", "relation_type", "evidence").where("src <> dst")
    edges = _canonical(edges, g.directed).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.max("relation_type").alias("relation_type"), F.array_sort(F.flatten(F.collect_list("evidence"))).alias("evidence"))
    return ConceptGraph(g.nodes.join(first.select(F.col("to").alias("id")), "id", "left_semi"), edges, g.directed)


def merged(a: ConceptGraph, b: ConceptGraph) -> ConceptGraph:
    if a.directed != b.directed:
        raise ValueError("both graphs must be directed, or neither")
    return a.with_nodes(b.nodes).with_edges(b.edges)


def prune_edges(g: ConceptGraph, min_weight: float) -> ConceptGraph:
    return ConceptGraph(g.nodes, g.edges.where(F.coalesce("weight", F.lit(0.0)) >= min_weight), g.directed)


def _induced(g: ConceptGraph, ids: DataFrame) -> ConceptGraph:
    edges = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return ConceptGraph(g.nodes.join(ids, "id", "left_semi"), edges.select(*g.edges.columns), g.directed)


def prune_nodes(g: ConceptGraph, min_degree: int) -> ConceptGraph:
    return _induced(g, g.degrees().where(F.col("degree") >= min_degree).select("id"))


def subgraph(g: ConceptGraph, terms: DataFrame) -> ConceptGraph:
    return _induced(g, terms.select(F.col("term").alias("id")).distinct())


def of_types(g: ConceptGraph, kinds: list[str]) -> ConceptGraph:
    return ConceptGraph(g.nodes, g.edges.where(F.col("relation_type").isin(kinds)), g.directed)
