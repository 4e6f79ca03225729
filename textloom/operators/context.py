"""What surrounds a term: significant co-occurring terms and its grammatical relations, scored together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import relations as grammatical
from textloom.operators import search
from textloom.operators.metrics import stored


def contextual_relations(sents: DataFrame, toks: DataFrame, term: str, threshold: float = 0.1, top_n: int | None = None, with_relations: bool = True, max_evidence: int = 100) -> DataFrame:
    """(source, relation_type, target, score, n, evidence): co-occurrence by average significance; grammatical relations by their target's, else 0.5.

    ``n`` counts all sentences, ``evidence`` has the first ``max_evidence`` in text order."""
    sents = sents.where(search.contains(term))
    found = stored(search.significant_terms(sents, toks, term, threshold))
    order = Window.partitionBy("term").orderBy("doc_id", "sent_index")
    first = lambda df: df.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_evidence)
    shown = first(first(found).drop("k").join(sents, ["doc_id", "sent_index"]))  # sentences join what is shown, not all that is found
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"])
    shown = shown.groupBy("term").agg(evidence.alias("evidence"))
    together = search.aggregate_significant(found).join(shown, "term").withColumnRenamed("term", "target")
    out = together.select(F.lit(term).alias("source"), F.lit("cooccurrence").alias("relation_type"), "target", "score", "n", "evidence")
    if with_relations:
        lines = grammatical.coded(sents)
        known = search.aggregate_significant(found).select(F.col("term").alias("key"), F.col("score").alias("known"))
        rel = grammatical.relations(lines, term, max_evidence=max_evidence).join(known, F.lower("target") == F.col("key"), "left")
        out = out.unionByName(rel.select("source", "relation_type", "target", F.coalesce("known", F.lit(0.5)).alias("score"), "n", "evidence"))
    return out if top_n is None else out.orderBy(F.desc("score"), "relation_type", "source", "target").limit(top_n)


def as_graph_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst, relation_type, weight, evidence_count)."""
    nodes = found.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes, found.select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation_type", F.col("score").alias("weight"), F.size("evidence").alias("evidence_count"))


def grouped_by_structure(found: DataFrame, locations: DataFrame, level: str = "chapter") -> DataFrame:
    """(path, n): rows (doc_id, sent_index) counted by where they stand; ``unstructured`` where nothing is known."""
    names = ["chapter", "section", "subsection"]
    path = F.concat_ws(" / ", *[f"{n}_title" for n in names[: names.index(level) + 1]])
    joined = found.join(locations, ["doc_id", "sent_index"], "left")
    return joined.groupBy(F.when(path == "", "unstructured").otherwise(path).alias("path")).agg(F.count("*").alias("n"))
