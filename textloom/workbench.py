"""From a folder of texts to stored annotations, ranked terms, concordances and graphs: one call a step, each step's result a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import annotate, clean
from textloom.operators import cooccurrence, graph, keyness, metrics, scorer, search, suggest
from textloom.sources import files, sinks

WRITERS = {"d3": sinks.write_d3_json, "json": sinks.write_node_link_json, "graphml": sinks.write_graphml, "gexf": sinks.write_gexf, "dot": sinks.write_dot, "csv": sinks.write_graph_csv, "html": sinks.write_html}


class Workbench:
    """Corpora and what is found in them, under one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.store = spark, files.ArtifactStore(spark, base)

    def ingest(self, path: str, corpus: str, pattern: str = "*.txt", recursive: bool = False, clean_ocr: bool = False) -> None:
        """Read a file or folder, annotate it and store its documents, sentences and tokens.  PDF files are read if ``pattern`` ends in ``.pdf``."""
        docs = files.read_pdfs(self.spark, path, recursive) if pattern.endswith(".pdf") else files.read_texts(self.spark, path, pattern, recursive)
        if clean_ocr:
            docs = docs.withColumn("text", clean.clean_text(F.col("text")))
        self.store.save("corpora", f"{corpus}/documents", docs)
        sents = annotate.sentences(self._table(corpus, "documents"))
        self.store.save("corpora", f"{corpus}/sentences", sents)
        self.store.save("corpora", f"{corpus}/tokens", annotate.tokens(self._table(corpus, "sentences")))

    def _table(self, corpus: str, name: str) -> DataFrame:
        return self.store.load("corpora", f"{corpus}/{name}")

    def rarities(self, corpus: str, background: str, terms: str, method: str = "hybrid", top_n: int = 50, min_score: float = 0.0) -> DataFrame:
        """Store and return the entries of a corpus' best terms against a background corpus: ``hybrid`` or a method of ``suggest``."""
        sents, toks = self._table(corpus, "sentences"), self._table(corpus, "tokens")
        reference = keyness.reference_corpus(self._table(background, "tokens"))
        if method == "hybrid":
            found = suggest.from_scores(scorer.score_all(sents, toks, reference, reference), sents, toks, min_score, top_n)
        else:
            found = suggest.by_method(sents, toks, reference, method, top_n)
        self.store.save("terms", terms, found)
        return self.store.load("terms", terms)

    def search(self, corpus: str, term: str, width: int = 50) -> DataFrame:
        """(line): the concordance of a term in text order."""
        return search.format_lines(search.concordance(self._table(corpus, "sentences"), term, width).orderBy("doc_id", "sent_index", "at"), width)

    def graph(self, corpus: str, terms: str, name: str, method: str = "count", threshold: float = 1.0) -> graph.ConceptGraph:
        """Store and return the graph of a stored list's terms that occur together."""
        listed = [r.term for r in self.store.load("terms", terms).select("term").distinct().orderBy("term").collect()]  # a curated list
        made = graph.from_matrix(cooccurrence.matrix(self._table(corpus, "sentences"), listed, method), threshold)
        self.store.save_graph(name, made)
        return self.store.load_graph(name)

    def analyze(self, name: str, method: str = "degree") -> DataFrame:
        return metrics.centrality(self.store.load_graph(name), method)

    def export(self, name: str, path: str, format: str = "json") -> None:
        if format not in WRITERS:
            raise ValueError(f"unknown format {format!r}: one of {', '.join(sorted(WRITERS))}")
        WRITERS[format](self.store.load_graph(name), path)
