"""The hybrid scorer: five signals of a term's weight in a corpus, normalised and added."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.words import STOPWORDS
from textloom.operators import definitions, keyness, search
from textloom.operators.frequency import occurrences

WEIGHTS = {"ratio": 1.0, "tfidf": 1.0, "neologism": 0.5, "definitional": 0.3, "capitalized": 0.2}


def signals(sents: DataFrame, toks: DataFrame, reference: DataFrame, dictionary: DataFrame, use_lemmas: bool = True, min_author_freq: int = 3, counts: DataFrame | None = None) -> DataFrame:
    """(term, n, ratio, tfidf, neologism, definitional, capitalized), raw, of every frequent term; ``toks``: tokens or types; ``counts``: definition counts made before."""
    author = keyness.author_terms(toks, use_lemmas).where(F.col("n") >= min_author_freq)
    size = F.broadcast(toks.agg(occurrences(toks).alias("a")).join(reference.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("r"))))  # one row
    known = dictionary.select(F.lower("term").alias("key")).distinct().withColumn("known", F.lit(True))
    counts = definition_counts(sents) if counts is None else counts
    defined = counts.select("term", F.col("n").cast("double").alias("definitional"))
    capital = keyness.capitalized_in(sents, min_author_freq).select("term", F.lit(1.0).alias("capitalized"))
    joined = author.join(reference.select("term", "count"), "term", "left").join(known, F.lower("term") == F.col("key"), "left").join(defined, "term", "left").join(capital, "term", "left").join(size)
    there, absent = F.coalesce(F.nullif("count", F.lit(0)), F.lit(0.5)), F.coalesce("count", F.lit(0)) == 0
    new = (F.col("spelled") >= min_author_freq) & ~F.lower("term").isin(STOPWORDS) & F.col("known").isNull() & ~F.col("proper")
    return joined.select(
        "term", "n", ((F.col("n") / F.col("a")) / (there / F.col("r"))).alias("ratio"), F.when(absent, F.col("n") / F.col("a") * F.ln(F.lit(2.0))).otherwise(0.0).alias("tfidf"),
        F.when(new, 1.0).otherwise(0.0).alias("neologism"), F.coalesce("definitional", F.lit(0.0)).alias("definitional"), F.coalesce("capitalized", F.lit(0.0)).alias("capitalized"),
    )


def scored(found: DataFrame, definitional_max: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``signals`` with each part normalised by its maximum, ``total`` and ``raw_total``; maxima cover all terms.

    ``definitional_max``: one row (top), the largest definition count of any term, frequent or not.
    """
    w = WEIGHTS | (weights or {})
    tops = F.broadcast(found.agg(F.max("ratio").alias("top_ratio"), F.max("tfidf").alias("top_tfidf")))  # one row
    joined = found.join(tops).join(F.broadcast(definitional_max))
    safe = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    parts = {
        "ratio": F.col("ratio") / safe("top_ratio"), "tfidf": F.col("tfidf") / safe("top_tfidf"), "neologism": F.col("neologism"),
        "definitional": F.col("definitional") / safe("top"), "capitalized": F.col("capitalized"),
    }
    named = joined.select("term", "n", sum(w[k] * F.col(k) for k in parts).alias("raw_total"), *[(w[k] * v).alias(k) for k, v in parts.items()])
    return named.withColumn("total", sum(F.col(k) for k in parts))


def definition_counts(sents: DataFrame) -> DataFrame:
    return definitions.definition_counts(definitions.definitional_contexts(sents))


def definition_maximum(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.max("n"), F.lit(1)).cast("double").alias("top"))


def score_all(sents: DataFrame, toks: DataFrame, reference: DataFrame, dictionary: DataFrame, use_lemmas: bool = True, min_author_freq: int = 3, min_score: float = 0.0, top_n: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    # a row a defined term and a row a frequent term; read for the maxima and for the scores
    counts = definition_counts(sents).persist(StorageLevel.MEMORY_AND_DISK)
    found = signals(sents, toks, reference, dictionary, use_lemmas, min_author_freq, counts).persist(StorageLevel.MEMORY_AND_DISK)
    out = scored(found, definition_maximum(counts), weights)
    out = out.where(keyness.is_valid_term(F.col("term")) & (F.col("total") >= min_score))
    return out if top_n is None else out.orderBy(F.desc("total"), "term").limit(top_n)


def high_confidence(scores: DataFrame, min_signals: int = 3, min_score: float = 1.0) -> DataFrame:
    present = (F.col("ratio") > 0.1).cast("int") + (F.col("tfidf") > 0.1).cast("int")
    for c in ("neologism", "definitional", "capitalized"):
        present = present + (F.col(c) > 0).cast("int")
    return scores.withColumn("signals", present).where((F.col("signals") >= min_signals) & (F.col("total") >= min_score))


def modal_pos(toks: DataFrame) -> DataFrame:
    """(term, pos): each lower-cased token's most frequent tag, of equals the first by name."""
    counts = toks.groupBy(F.lower("token").alias("term"), "pos").agg(occurrences(toks).alias("c"))
    return counts.groupBy("term").agg(F.min_by("pos", F.struct(-F.col("c"), F.col("pos"))).alias("pos"))


def example_sentences(sents: DataFrame, terms: list[str], max_examples: int = 3) -> DataFrame:
    """(term, doc_id, sent_index, sentence): each term's first sentences."""
    return search.first_hits(search.find_any(sents, terms), max_examples).drop("k")
