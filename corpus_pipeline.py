"""A training-corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, common, fm_decontam, ngram_join, quality_gbdt, toxicity_knn
from textloom.llm.queries import fold, split_pattern, table, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each row by its own text; a null text is an empty one.  Without labels of both kinds every
    document has the same score, and all stay or all go."""
    trees = quality_gbdt.fit(docs, table(spark, sf_dir, "labels"), "quality", fold(5) != 0)
    return quality_gbdt.accepted(docs, trees)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of their nearest labelled examples do not call toxic, each row by its own text.  Null and empty texts have no
    neighbour and the score of no votes; without labels of both kinds every document has the same score."""
    index = toxicity_knn.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold(4) != 2)
    return toxicity_knn.accepted(docs, index)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links connect: the one with the smallest id, once.

    Of several rows of that id the one with the smallest text stays (null first, then by the other columns as JSON).  Documents without words are linked
    with nothing and stay; so do rows without an id."""
    first = ngram_join.linked_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(F.lit(0), *others))))
    place = "".join(sorted(docs.columns)) + "_row"  # a name that no column has
    kept = docs.join(first, "doc_id", "left_semi").withColumn(place, row).where(F.col(place) == 1).select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the passages found are cut out.  Null and empty texts stay as they are; an empty benchmark changes nothing."""
    return fm_decontam.cleaned_documents(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and of the decoded bytes; a null text is an empty one, repeated rows are encoded each."""
    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern()
    return bpe_codec.round_trip(docs, ranks, pattern)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: The classifiers' stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
