"""Annotate a stream of documents and keep running counts.

Annotation is stateless, so the batch functions apply as they are; counts keep one state row a term, or a term and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import annotate
from textloom.operators.frequency import term_of

DOCUMENT = "doc_id string, text string, ts timestamp"


def read_documents(spark: SparkSession, path: str, format: str = "json", schema: str = DOCUMENT, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_a_trigger).load(path)


def stream_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ts, sent_index, tok_index, token, pos, lemma) of a stream (or table) of documents."""
    sents = docs.select("doc_id", "ts", F.posexplode(annotate.sentences_of(F.col("text"))).alias("sent_index", "sentence")).where(F.trim("sentence") != "")
    split = sents.select("doc_id", "ts", "sent_index", F.posexplode(annotate.words_of(F.col("sentence"))).alias("tok_index", "token"))
    return split.withColumn("pos", annotate.tag_of(F.col("token"), F.col("tok_index"))).withColumn("lemma", annotate.lemma_of(F.col("token"), F.col("pos")))


def running_counts(tokens: DataFrame, use_lemmas: bool = True) -> DataFrame:
    return tokens.groupBy(term_of(use_lemmas).alias("term")).agg(F.count("*").alias("n"))


def windowed_counts(tokens: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", use_lemmas: bool = True) -> DataFrame:
    """(start, term, n) by event time; rows later than ``lateness`` are dropped with their window's state."""
    timed = tokens.withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window).alias("w"), term_of(use_lemmas).alias("term")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "term", "n")
