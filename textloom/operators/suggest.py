"""Term entries suggested by a corpus: the best terms of a signal or of the hybrid score, with tag, notes and first examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import definitions, keyness, scorer, search
from textloom.operators.terms import shaped

METHODS = ("ratio", "tfidf", "neologism", "definitional")


def examples_of(sents: DataFrame, chosen: DataFrame, max_examples: int = 3) -> DataFrame:
    """(term, examples): each chosen term's first sentences in text order, a bounded number whatever the corpus.

    ``chosen`` (term) is a top-n list, so it is broadcast; each sentence is tested for its terms once."""
    low = F.lower("sentence")
    hits = sents.join(F.broadcast(chosen.select("term")), low.contains(F.lower("term")))  # n terms at most
    first = search.first_hits(hits, max_examples)
    return first.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.trim("sentence").alias("s")))), lambda x: x["s"]).alias("examples"))


def entries(chosen: DataFrame, sents: DataFrame, toks: DataFrame, use_lemmas: bool = True, max_examples: int = 3) -> DataFrame:
    """Term entries for ``chosen`` (term, notes): no definition, which is for people to write."""
    kept = chosen.select("term", "notes")
    tags = scorer.modal_pos(toks.join(F.broadcast(kept.select(F.lower("term").alias("key")).distinct()), F.lower("token") == F.col("key"), "left_semi")).withColumnRenamed("term", "key")
    shown = kept.join(examples_of(sents, kept, max_examples), "term", "left").join(tags, F.lower("term") == F.col("key"), "left")
    lemma = F.col("term") if use_lemmas else F.lit(None).cast("string")
    return shaped(shown.select("term", lemma.alias("lemma"), "pos", "notes", F.coalesce("examples", F.array().cast("array<string>")).alias("examples")))


def from_scores(scores: DataFrame, sents: DataFrame, toks: DataFrame, min_score: float = 2.0, top_n: int = 50, max_examples: int = 3, use_lemmas: bool = True) -> DataFrame:
    """Entries of the best ``top_n`` terms of the hybrid score (term, total) that reach ``min_score``."""
    best = scores.orderBy(F.desc("total"), "term").limit(top_n).where(F.col("total") >= min_score)
    return entries(best.select("term", F.format_string("Score: %.2f", "total").alias("notes")), sents, toks, use_lemmas, max_examples)


def by_method(sents: DataFrame, toks: DataFrame, reference: DataFrame, method: str = "ratio", top_n: int = 50, max_examples: int = 3, dictionary: DataFrame | None = None) -> DataFrame:
    """Entries of the best ``top_n`` terms by one signal: ratio, tfidf, neologism (any of its signals, by name) or definitional (defined twice or more, by name)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    if method == "ratio":
        best = keyness.top_terms(keyness.compare(toks, reference), "ratio", top_n)
    elif method == "tfidf":
        best = keyness.top_terms(keyness.tfidf_vs_reference(toks, reference), "score", top_n)
    elif method == "neologism":
        best = keyness.neologism_signals(toks, reference, reference if dictionary is None else dictionary).orderBy("term").limit(top_n)
    else:
        best = definitions.highly_defined(definitions.definitional_contexts(sents)).orderBy("term").limit(top_n)
    return entries(best.select("term", F.lit(f"Method: {method}").alias("notes")), sents, toks, max_examples=max_examples)
