"""Readers: text files and directories, term lists, graphs, stored artefacts, PDF where a library is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import graph as graphs
from textloom.operators import terms as term_lists


def _named(files: DataFrame) -> DataFrame:
    """``metadata``: source_path, filename and title (the name without its ending)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pairs = F.create_map(F.lit("source_path"), F.col("path"), F.lit("filename"), name, F.lit("title"), F.regexp_replace(name, r"\.[^.]*$", ""))
    return files.withColumn("metadata", pairs)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(doc_id, doc_idx, text, encoding, metadata): one row a file, UTF-8 or else Latin-1 as a whole; ``doc_idx`` follows the paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = files.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"), F.when(utf8.isNull(), "latin-1").otherwise("utf-8").alias("encoding"))
    index = F.row_number().over(Window.orderBy("path")) - 1  # over file names; the texts are read once
    order = files.select("path").withColumn("doc_idx", index)
    return _named(text.join(order, "path")).select(F.col("path").alias("doc_id"), "doc_idx", "text", "encoding", "metadata")


def read_pdfs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """As ``read_texts`` for PDF files: pages that are not empty, with a blank line between; ImportError without pypdf."""
    import pypdf  # noqa: F401

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for pdf in batches:
            texts = ["\n\n".join(t for p in pypdf.PdfReader(io.BytesIO(raw)).pages if (t := p.extract_text() or "").strip()) for raw in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return _named(files.select("path", "content").mapInPandas(run, "path string, text string")).withColumnRenamed("path", "doc_id")


def read_terms_txt(spark: SparkSession, path: str, delimiter: str = "\n") -> DataFrame:
    lines = spark.read.option("lineSep", delimiter).text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct()
    return term_lists.shaped(lines)


def read_terms_csv(spark: SparkSession, path: str, term_column: str = "term") -> DataFrame:
    rows = spark.read.option("header", True).csv(path).withColumnRenamed(term_column, "term")
    rows = rows.withColumn("term", F.trim("term")).where("term <> ''").dropDuplicates(["term"])
    if "examples" in rows.columns:
        rows = rows.withColumn("examples", F.transform(F.split("examples", ";"), F.trim))
    return term_lists.shaped(rows)


def read_terms_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of entries, or an object with the entries under ``terms``; ValueError where a term comes twice."""
    rows = spark.read.option("multiLine", True).json(path)
    if "terms" in rows.columns and "term" not in rows.columns:
        rows = rows.select(F.explode("terms").alias("t")).select("t.*")
    rows = term_lists.shaped(rows)
    if twice := rows.groupBy("term").count().where("count > 1").limit(5).collect():
        raise ValueError("listed twice: " + ", ".join(r.term for r in twice))
    return rows


def read_terms(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    readers = {"json": read_terms_json, "txt": read_terms_txt, "csv": read_terms_csv}
    if format not in readers:
        raise ValueError(f"unknown format {format!r}: one of {', '.join(readers)}")
    return readers[format](spark, path)


def read_graph_json(spark: SparkSession, path: str, directed: bool = False) -> graphs.ConceptGraph:
    """Node-link JSON: nodes with id and label, links (or edges) with source and target."""
    whole = spark.read.option("multiLine", True).json(path)
    links = "links" if "links" in whole.columns else "edges"
    nodes = whole.select(F.explode("nodes").alias("n")).select("n.*")
    edges = whole.select(F.explode(links).alias("e")).select("e.*").withColumnsRenamed({"source": "src", "target": "dst", "label": "relation_type"})
    return graphs.graph(nodes, edges, directed)


class ArtifactStore:
    """Corpora, term lists, graphs and analyses as tables under one folder."""

    def __init__(self, spark: SparkSession, base: str, format: str = "parquet"):
        self.spark, self.base, self.format = spark, base.rstrip("/"), format

    def save(self, kind: str, name: str, df: DataFrame, allow_empty: bool = False) -> str:
        from textloom.sources.sinks import EmptyOutputError

        if not allow_empty and df.isEmpty():
            raise EmptyOutputError(f"{kind} {name}: nothing to save")
        path = f"{self.base}/{kind}/{name}"
        df.write.mode("overwrite").format(self.format).save(path)
        return path

    def load(self, kind: str, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.format(self.format)
        return (reader.schema(schema) if schema else reader).load(f"{self.base}/{kind}/{name}")

    def save_graph(self, name: str, g: graphs.ConceptGraph) -> None:
        self.save("graphs", f"{name}/nodes", g.nodes)
        self.save("graphs", f"{name}/edges", g.edges.withColumn("directed", F.lit(g.directed)), allow_empty=True)

    def load_graph(self, name: str) -> graphs.ConceptGraph:
        edges = self.load("graphs", f"{name}/edges")
        first = edges.select("directed").first()
        return graphs.ConceptGraph(self.load("graphs", f"{name}/nodes"), edges.drop("directed"), bool(first and first.directed))
