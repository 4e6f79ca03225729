"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens at places that no vocabulary piece spans (before a run of spaces, at a line
end), so the count of a text is the sum of the counts of its pre-tokens.  Tier one is a broadcast table of
the corpus's frequent pre-tokens and their lengths; tier two is a bounded cache in each Python worker, filled
by encoding what is in neither.  No pre-token is ever shuffled: the table comes from one packed summary row per
task (Misra-Gries counts over every text), merged in two levels.

Defined cases: null or empty text: 0 tokens.  Repeated rows are counted each.  Literal U+2581 counts as the
library takes it (a space).  A vocabulary whose pieces span spaces gets whole texts as pre-tokens.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import documents_of, prepare

#: Entries of the broadcast table, of a task's summary while it counts, and of a worker's cache; all only affect speed.
FREQUENT = 1 << 14
SUMMARY = 1 << 17
CACHE = 1 << 18
#: Longer pre-tokens are encoded but not kept.
KEEP_CHARS = 64
_UNIT = re.compile(r" *[^ \n]+|\n[^ \n]*| +")


def units(text: str) -> list[str]:
    """Pre-tokens: `` *word`` (one space stands for the library's own prefix), ``\\nword`` or a run of spaces alone."""
    if not text:
        return []
    s = " " + text.replace("▁", " ")
    if "  " in s or s[-1] == " " or " \n" in s:
        return [u if u[0] == "\n" or not u.strip(" ") else u[1:] for u in _UNIT.findall(s)]
    return s.replace("\n", " \n").split(" ")[1:]


#: Summaries that a task, or the driver, merges.
FAN = 32
#: Texts that show whether a model's normaliser leaves texts as they are.
PROBES = ("a", "  two  spaces ", "line\nend", "\ttab", "ﬁ Å É ｆｕｌｌ", "é e\u0301", "\u00a0\u3000x", "\u200bzero\ufeff", "UPPER lower")


class PieceLengths:
    """Token counts of pre-tokens by a sentencepiece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # a model that changes, trims or joins spaces, or whose pieces cross them, takes whole texts
        plain = all(self.model.normalize(t) == "▁" + t.replace(" ", "▁") for t in PROBES)
        self.local = plain and "▁" in pieces and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def split(self, text: str) -> list[str]:
        return units(text) if self.local else [text] * bool(text)

    def lengths(self, wanted: list[str]) -> list[int]:
        if not self.local:
            return [len(x) for x in self.model.encode(wanted, num_threads=1)]
        # the library adds a prefix mark: it is one of a run of spaces, and no part of a unit that starts a line
        found = self.model.encode([u if u.strip(" ") else u[1:] for u in wanted], num_threads=1)
        return [1 if u == " " else len(ids) - (u[0] == "\n") for u, ids in zip(wanted, found, strict=True)]


def _pruned(counts: Counter, keep: int) -> Counter:
    """The Misra-Gries step: subtract the (keep + 1)-th largest count, drop what reaches zero."""
    if len(counts) <= keep:
        return counts
    cut = sorted(counts.values(), reverse=True)[keep]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent_pretokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = FREQUENT) -> dict[str, int]:
    """The table {pre-token: tokens} of about ``size`` pre-tokens that are most frequent over all texts."""
    docs = documents_of(df, id_col, text_col).select("text")

    def pack(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"summary": pa.array([pickle.dumps(counts.most_common(size))], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, counts = PieceLengths(model_path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(lengths.split(text))
                if len(counts) > 2 * SUMMARY:
                    counts = _pruned(counts, SUMMARY)
        yield pack(Counter({k: v for k, v in counts.items() if len(k) <= KEEP_CHARS}))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                for unit, n in pickle.loads(packed):
                    counts[unit] += n
                counts = _pruned(counts, SUMMARY)
        if counts:
            yield pack(counts)

    merged, n = docs.mapInArrow(count, "summary binary"), docs.rdd.getNumPartitions()
    while n > FAN:  # a tree: whatever the input, a task merges about FAN summaries
        n = -(-n // FAN)
        merged = merged.repartition(n).mapInArrow(merge, "summary binary")
    total: Counter = Counter()
    for row in merged.toLocalIterator():  # at most FAN rows of at most `size` entries
        for unit, n in pickle.loads(row.summary):
            total[unit] += n
    top = [u for u, _ in total.most_common(size)]
    return dict(zip(top, PieceLengths(model_path).lengths(top), strict=True)) if top else {}


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_pretokens, n_missed) of every text; ``n_missed``: distinct pre-tokens that had to be encoded."""
    spark = prepare(df.sparkSession)
    if table is None:
        table = frequent_pretokens(df, model_path, id_col, text_col)
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, frequent = PieceLengths(model_path), shared.value
        known = dict(frequent)
        for batch in batches:
            n_bytes, n_tokens, n_units, n_missed = [], [], [], []
            for text in batch.column(1).to_pylist():
                parts = lengths.split(text)
                missed = list(set(parts).difference(known))
                if missed:
                    if len(known) > CACHE:
                        known = dict(frequent)
                        missed = list(set(parts).difference(known))
                    known.update(zip(missed, lengths.lengths(missed), strict=True))
                n_tokens.append(sum(map(known.__getitem__, parts)))
                for unit in missed:
                    if len(unit) > KEEP_CHARS:
                        del known[unit]
                n_bytes.append(len(text.encode()))
                n_units.append(len(parts))
                n_missed.append(len(missed))
            columns = {"n_bytes": n_bytes, "n_tokens": n_tokens, "n_pretokens": n_units, "n_missed": n_missed}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{k: pa.array(v, pa.int64()) for k, v in columns.items()}})

    docs = documents_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, n_pretokens long, n_missed long")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
