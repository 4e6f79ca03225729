"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of whole texts are computed for a batch at once on its byte buffer.  Trees of one depth are grown by level
from binned histograms with the logistic loss, then flattened into three arrays; a batch goes down all trees at once.

Training uses a bounded sample (``TRAIN_ROWS`` labelled rows, in the order of a hash of their ids); scoring covers every row.
Defined cases: null or empty text: scored like any text, by all-zero statistics.  Null labels are left out; of
several labels for one id the largest counts.  No labels or one class only: every score is the share of label 1 (0.5 without
labels).  Repeated rows get equal scores; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACED_WORD, byte_class, documents_of, prepare, text_chunks, word_hashes, words_of

#: Bytes of texts taken at once: bounds the arrays of a worker.
CHUNK_BYTES = 1 << 20
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAF_ROWS = 80, 4, 64, 0.15, 1.0, 10
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = byte_class("A-Z"), byte_class("a-z"), byte_class("0-9")
_HIGH, _LINE = byte_class(r"\x80-\xff"), byte_class(r"\n")
_PUNCT = byte_class(r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e")
_RARE = _PUNCT & ~byte_class(r".,;:?!'\x22()-")
_BANG, _BAR = byte_class("!"), byte_class("|")
_CLASSES = (_UPPER, _LOWER, _DIGIT, _HIGH, _LINE, _PUNCT, _RARE, _BANG, _BAR)

STATISTICS = (
    "bytes", "words", "lines", "upper", "lower", "digit", "high", "line_share", "punct", "rare", "bang", "bar", "word_length", "longest_word",
    "distinct_words", "distinct_pairs", "repeat_share", "repeat_run", "upper_words", "upper_run", "punct_words", "punct_run", "inner_words", "inner_run",
    "rare_words", "rare_run", "no_letter_words", "no_letter_run", "words_a_line", "longest_line", "distinct_lines", "short_words",
)


def _runs(flag: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags by document and the longest run of them inside one."""
    total = np.bincount(doc[flag], minlength=n).astype(np.float64)
    best = np.zeros(n)
    if len(flag):
        at = np.arange(len(flag))
        start = np.ones(len(flag), bool)
        start[1:] = doc[1:] != doc[:-1]
        reset = np.maximum.accumulate(np.where(~flag, at + 1, np.where(start, at, 0)))
        np.maximum.at(best, doc, np.where(flag, at - reset + 1, 0))
    return total, best


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    if not len(key):
        return np.zeros(n)
    both = np.sort((doc.astype(np.uint64) << np.uint64(48)) ^ (key >> np.uint64(16)))  # a document's keys stand together
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    return np.bincount((both[new] >> np.uint64(48)).astype(np.int64), minlength=n).astype(np.float64)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of the buffer (fewer than 65,536 texts a call)."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    starts, ends, doc = words_of(buf, off, SPACED_WORD)
    lens = (ends - starts).astype(np.float64)
    sums = {}
    for name, table in zip(("upper", "lower", "digit", "high", "line", "punct", "rare", "bang", "bar"), _CLASSES, strict=True):
        c = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=c[1:])
        sums[name] = c
    share = lambda name: (sums[name][off[1:]] - sums[name][off[:-1]]) / np.maximum(size, 1)
    inside = lambda name: sums[name][ends] - sums[name][starts]
    words = np.bincount(doc, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    hashes = word_hashes(buf, starts, ends)
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    pair = np.zeros(len(doc), np.uint64)
    pair[1:] = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
    upper, letters, punct = inside("upper"), inside("upper") + inside("lower") + inside("high"), inside("punct")
    last = np.zeros(len(doc), np.int64)
    if len(doc):
        last = _PUNCT[buf[ends - 1]].astype(np.int64)
    flags = (same, (upper >= 2) & (inside("lower") == 0), punct >= 2, punct - last > 0, inside("rare") > 0, letters == 0)
    l_start, l_end, l_doc = words_of(buf, off, ~_LINE)
    lines = np.bincount(l_doc, minlength=n).astype(np.float64)
    longest_line, longest_word = np.zeros(n), np.zeros(n)
    np.maximum.at(longest_line, l_doc, (l_end - l_start).astype(np.float64))
    np.maximum.at(longest_word, doc, lens)
    counted = []
    for flag in flags:
        total, best = _runs(flag, doc, n)
        counted += [total / some, best]
    columns = [
        size, words, lines, share("upper"), share("lower"), share("digit"), share("high"), share("line"), share("punct"), share("rare"), share("bang"), share("bar"),
        np.bincount(doc, lens, n) / some, longest_word, _distinct(hashes, doc, n) / some, _distinct(pair, doc, n) / some, *counted,
        words / np.maximum(lines, 1), longest_line, _distinct(word_hashes(buf, l_start, l_end), l_doc, n) / np.maximum(lines, 1), np.bincount(doc[lens <= 3], minlength=n) / some,
    ]
    return np.column_stack(columns)


@dataclass
class Trees:
    """``feature`` and ``cut``: (trees, inner nodes) in heap order; ``leaf``: (trees, leaves); ``base``: the first log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(self.feature) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        raw = self.base + self.leaf[tree, node - self.feature.shape[1]].sum(axis=1) if len(self.feature) else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not len(y) or not 0 < share < 1:
        return empty
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.int64)
    limit = np.full((width, BINS), np.inf)
    for f, e in enumerate(edges):
        limit[f, : len(e)] = e
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), empty.base)
    raw, cell = np.full(n, out.base), np.arange(width) * BINS + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            at = (node[:, None] * (width * BINS) + cell).ravel()
            sums = [np.bincount(at, np.repeat(w, width), k * width * BINS).reshape(k, width, BINS).cumsum(axis=2) for w in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = sums, [s[:, :1, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(cl < LEAF_ROWS) | (ct - cl < LEAF_ROWS) | ~np.isfinite(limit)[None]] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            useful = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            out.feature[t, first : first + k] = f
            out.cut[t, first : first + k] = np.where(useful, limit[f, b], np.inf)
            node = 2 * node + (x[np.arange(n), f[node]] > out.cut[t, first + node])
        out.leaf[t] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
        raw += out.leaf[t, node]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows that ``allowed`` (over doc_id) admits, taken in the order of a hash; of several
    labels of an id the largest counts, of several texts the smallest."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.coalesce(allowed, F.lit(False)))
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most `limit` rows


def fit(df: DataFrame, labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on a bounded sample of the rows of ``labels`` (doc_id, ``label``) that ``allowed`` admits."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_chunks(batch, CHUNK_BYTES):
                rows = statistics(buf, off)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[i:j], "label": batch.column("label")[i:j], "x": pa.array([r.tobytes() for r in rows], pa.binary())})

    docs = documents_of(df, id_col, text_col)
    found = training_rows(docs, labels, label, allowed, limit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = found.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, label int, x binary").toArrow()
    rows = rows.sort_by([("x", "ascending"), ("label", "ascending")])  # independent of partitions
    x = np.array([np.frombuffer(v) for v in rows.column("x").to_pylist()]).reshape(-1, len(STATISTICS))
    y = np.array(rows.column("label").to_pylist(), np.float64)
    return fit_trees(x, y)


def score(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(trees)  # a few hundred KB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_chunks(batch, CHUNK_BYTES):
                s = shared.value.scores(statistics(buf, off))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[i:j], "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    docs = documents_of(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def accepted(df: DataFrame, trees: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text scores at least ``threshold``; one pass, no join."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_chunks(batch, CHUNK_BYTES, text_col):
                yield batch.slice(i, j - i).filter(pa.array(shared.value.scores(statistics(buf, off)) >= threshold))

    return df.mapInArrow(run, df.schema)
