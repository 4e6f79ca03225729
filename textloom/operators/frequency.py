"""Counts of terms and TF-IDF over a token table (doc_id, ..., token, pos, lemma).

Counts over a whole corpus also take ``annotate.types``, whose rows stand for ``n`` tokens each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_of(use_lemmas: bool, lowercase: bool = True) -> Column:
    c = F.col("lemma") if use_lemmas else F.col("token")
    return F.lower(c) if lowercase else c


def occurrences(toks: DataFrame) -> Column:
    """The number of tokens: rows, or what ``n`` says that they stand for."""
    return F.sum("n") if "n" in toks.columns else F.count("*")


def word_frequencies(toks: DataFrame, use_lemmas: bool = False, lowercase: bool = True) -> DataFrame:
    """(doc_id, term, n)."""
    return toks.groupBy("doc_id", term_of(use_lemmas, lowercase).alias("term")).agg(F.count("*").alias("n"))


def pos_filtered_frequencies(toks: DataFrame, pos_tags: list[str], use_lemmas: bool = False, lowercase: bool = True) -> DataFrame:
    return word_frequencies(toks.where(F.col("pos").isin(pos_tags)), use_lemmas, lowercase)


def corpus_frequencies(toks: DataFrame, use_lemmas: bool = False, lowercase: bool = True) -> DataFrame:
    """(term, n)."""
    return toks.groupBy(term_of(use_lemmas, lowercase).alias("term")).agg(occurrences(toks).alias("n"))


def document_frequencies(toks: DataFrame, use_lemmas: bool = False, lowercase: bool = True) -> DataFrame:
    """(term, df)."""
    return word_frequencies(toks, use_lemmas, lowercase).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(toks: DataFrame, use_lemmas: bool = False, lowercase: bool = True) -> DataFrame:
    return toks.select(term_of(use_lemmas, lowercase).alias("term")).distinct()


def tf(toks: DataFrame, use_lemmas: bool = False) -> DataFrame:
    """(doc_id, term, n, tf)."""
    counts = word_frequencies(toks, use_lemmas)
    return counts.withColumn("tf", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")))


def idf(toks: DataFrame, n_docs: int, use_lemmas: bool = False) -> DataFrame:
    """(term, df, idf): ln(documents / df), unsmoothed."""
    return document_frequencies(toks, use_lemmas).withColumn("idf", F.ln(F.lit(float(n_docs)) / F.col("df")))


def tfidf(toks: DataFrame, n_docs: int, use_lemmas: bool = False) -> DataFrame:
    """(doc_id, term, tf, idf, tfidf)."""
    return tf(toks, use_lemmas).join(idf(toks, n_docs, use_lemmas), "term").select("doc_id", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def corpus_tfidf(toks: DataFrame, n_docs: int, use_lemmas: bool = False, min_score: float = 0.0) -> DataFrame:
    """(term, score): each term's largest TF-IDF of any document."""
    # a term has one idf, so its largest TF-IDF is where its tf is largest: the join is by term, after the aggregation
    top = tf(toks, use_lemmas).groupBy("term").agg(F.max("tf").alias("tf"), F.count("*").alias("df"))
    return top.select("term", (F.col("tf") * F.ln(F.lit(float(n_docs)) / F.col("df"))).alias("score")).where(F.col("score") >= min_score)


def document_tfidf(toks: DataFrame, n_docs: int, doc_id, use_lemmas: bool = False) -> DataFrame:
    one = tf(toks.where(F.col("doc_id") == doc_id), use_lemmas)
    return one.join(idf(toks, n_docs, use_lemmas), "term").select("term", (F.col("tf") * F.col("idf")).alias("score"))
