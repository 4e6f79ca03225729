"""Curated term lists: tables (term, lemma, pos, definition, notes, examples) with one row a term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "term string, lemma string, pos string, definition string, notes string, examples array<string>"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def shaped(df: DataFrame) -> DataFrame:
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    return df.select(*[F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


def add(terms: DataFrame, more: DataFrame) -> DataFrame:
    """Both lists; ValueError if a term is in both or twice in the new one."""
    again = more.groupBy("term").count().where("count > 1").select("term").union(more.join(terms, "term", "left_semi").select("term")).limit(5).collect()
    if again:
        raise ValueError("already listed: " + ", ".join(r.term for r in again))
    return terms.unionByName(shaped(more))


def remove(terms: DataFrame, term: str) -> DataFrame:
    _known(terms, term)
    return terms.where(F.col("term") != term)


def update(terms: DataFrame, term: str, **values) -> DataFrame:
    unknown = set(values) - set(FIELDS[1:])
    if unknown:
        raise ValueError("no such field: " + ", ".join(sorted(unknown)))
    _known(terms, term)
    return terms.withColumns({c: F.when(F.col("term") == term, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def _known(terms: DataFrame, term: str) -> None:
    if terms.where(F.col("term") == term).isEmpty():
        raise KeyError(term)


def get(terms: DataFrame, term: str):
    return terms.where(F.col("term") == term).first()


def merge(terms: DataFrame, other: DataFrame, overwrite: bool = False) -> DataFrame:
    """All terms of both; where both have one, the first list's row stands unless ``overwrite``."""
    first, second = (other, terms) if overwrite else (terms, other)
    return first.unionByName(second.join(first.select("term"), "term", "left_anti").select(*second.columns))


def filter_by_pos(terms: DataFrame, pos_tags: list[str]) -> DataFrame:
    return terms.where(F.col("pos").isin(pos_tags))


def statistics(terms: DataFrame) -> DataFrame:
    """(pos, n, with_lemma, with_definition, with_notes, with_examples) by part of speech, null for none given."""
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != "")).alias(f"with_{c}")
    return terms.groupBy("pos").agg(F.count("*").alias("n"), has("lemma"), has("definition"), has("notes"), F.count_if(F.size("examples") > 0).alias("with_examples"))
