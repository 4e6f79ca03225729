"""Benchmark decontamination by an FM-index for each shard of the training texts.

A shard's words become symbols: each word of the phrases its own, every other word a separator.  Runs of phrase words shorter
than the shortest phrase cannot hold an occurrence and are left out; the rest is the indexed text.  Its suffixes are sorted by
prefix doubling; the index keeps the last column as a wavelet matrix with rank blocks, the count table, and the suffix
positions of every 32nd symbol and of run starts.  All phrases are searched backwards at once, occurrences are located by
walking to the nearest sampled position, and their spans are merged for each document.

Phrases are broadcast in blocks of at most ``BLOCK_WORDS`` words; a larger phrase set takes one pass over the shards for each block.

Defined cases: null or empty text: no words, no hits.  Null or wordless items: no windows.  Items with equal windows all count.
Repeated rows are judged each; extra columns are ignored; empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ALNUM_WORD, documents_of, prepare, text_chunks, word_hashes, words_of

WINDOW = 13
SAMPLE = 32
SHARD_WORDS, SHARD_BYTES = 1 << 20, 24 << 20
BLOCK_WORDS = 1 << 19
_U = np.uint64


class BitRanks:
    """Bits with the number of ones before each 64th."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(_U)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(_U) & _U(1)).astype(bool)


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit level after the other, for many queries at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, BitRanks, int]] = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, BitRanks(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = self.mapped(np.arange(size), np.zeros(size, np.int64))

    def mapped(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times c occurs in [0, i)."""
        return self.mapped(c, i) - self.first[c]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.first[c]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; separators (0) come first and differ from each other, so runs end the comparison."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text.astype(np.int64) + int(zeros.sum()))
    h = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-h] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        s = key[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == n - 1 or h >= n:
            return order


class FMIndex:
    """Count and locate phrases in a text of symbols 1 to ``size`` - 1; 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, size: int):
        order = suffix_order(text)
        last = text[order - 1]
        self.ranks = WaveletMatrix(last, size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        kept = (order % SAMPLE == 0) | (last == 0)
        self.marked, self.sampled = BitRanks(kept), order[kept]
        self.n = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [start, end) of the suffixes that begin with each phrase (phrases: one a row, equal lengths)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for c in phrases.T[::-1]:
            c = c[live]
            a = self.smaller[c] + self.ranks.rank(c, lo[live])
            b = self.smaller[c] + self.ranks.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        lo[gone] = hi[gone] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled one, all rows at once."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            found = self.marked.get(rows[left])
            hit = left[found]
            out[hit] = self.sampled[self.marked.rank(rows[hit])] + steps[hit]
            left = left[~found]
            c, r = self.ranks.symbol_and_rank(rows[left])
            rows[left] = self.smaller[c] + r
            steps[left] += 1
        return out


@dataclass
class Phrases:
    """Windows of one block of items: words by sorted hash, windows by length, and whose they are."""

    words: np.ndarray
    windows: list[np.ndarray]  # a matrix of symbols for each length
    first_of: list[int]  # number of the first window of each matrix
    owner_at: np.ndarray  # window -> slice of owners
    owners: np.ndarray  # item numbers
    items: list[str]

    @property
    def shortest(self) -> int:
        return min(m.shape[1] for m in self.windows)


def phrases_of(rows: list[tuple[str, str]], window: int = WINDOW) -> Phrases | None:
    """The distinct windows of (item id as text, text) rows."""
    column = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())})
    found: dict[int, list[tuple[np.ndarray, int]]] = {}  # by length: windows of an item
    hashes = []
    for i, _, buf, off in text_chunks(column, limit=0):
        starts, ends, _ = words_of(buf, off, ALNUM_WORD)
        hashes.append((i, word_hashes(buf, starts, ends)))
    words = np.unique(np.concatenate([h for _, h in hashes])) if hashes else np.empty(0, _U)
    for i, h in hashes:
        if len(h):
            k = min(window, len(h))
            s = (np.searchsorted(words, h) + 1).astype(np.int32)
            found.setdefault(k, []).append((np.lib.stride_tricks.sliding_window_view(s, k), i))
    if not found:
        return None
    windows, first_of, owner_at, owners, n = [], [], [0], [], 0
    for k in sorted(found):
        rows_of = [len(w) for w, _ in found[k]]
        matrix, which = np.unique(np.concatenate([w for w, _ in found[k]]), axis=0, return_inverse=True)
        item = np.repeat([i for _, i in found[k]], rows_of)
        own = np.unique(np.column_stack([which.ravel(), item]), axis=0)
        windows.append(matrix)
        first_of.append(n)
        owners.append(own[:, 1])
        owner_at.extend((owner_at[-1] + np.cumsum(np.bincount(own[:, 0], minlength=len(matrix)))).tolist())
        n += len(matrix)
    return Phrases(words, windows, first_of, np.array(owner_at), np.concatenate(owners), [r[0] for r in rows])


class Shard:
    """Texts gathered until they are worth an index; then what occurs where."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.low = np.zeros(1 << 16, bool)
        self.low[(phrases.words & _U(0xFFFF)).astype(np.int64)] = True
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n_words: list[np.ndarray] = []
        self.rows = self.symbols = self.bytes = 0

    def add(self, buf: np.ndarray, off: np.ndarray) -> None:
        starts, ends, doc = words_of(buf, off, ALNUM_WORD)
        n = len(off) - 1
        count = np.bincount(doc, minlength=n)
        self.n_words.append(count)
        h = word_hashes(buf, starts, ends)
        at = np.flatnonzero(self.low[(h & _U(0xFFFF)).astype(np.int64)])
        words = self.phrases.words
        s = np.minimum(np.searchsorted(words, h[at]), len(words) - 1)
        same = words[s] == h[at]
        at, s = at[same], s[same] + 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
        run = np.cumsum(new) - 1
        long = np.bincount(run)[run] >= self.phrases.shortest if len(at) else np.empty(0, bool)
        at, s, new = at[long], s[long], new[long]
        d = doc[at]
        inside = at - (np.cumsum(count) - count)[d]
        self.parts.append((s, new, d + self.rows, inside, starts[at] - off[d], ends[at] - off[d]))
        self.rows += n
        self.symbols += len(at)
        self.bytes += len(buf)

    @property
    def full(self) -> bool:
        return self.symbols >= SHARD_WORDS or self.bytes >= SHARD_BYTES

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indexed position, length, window) of every occurrence; positions into ``self.columns``."""
        s, new, *rest = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.columns = rest
        none = np.empty(0, np.int64)
        if not len(s):
            return none, none, none
        place = np.arange(len(s)) + np.cumsum(new)  # a separator before each run
        text = np.zeros(int(place[-1]) + 2, np.int64)
        text[place] = s
        origin = np.zeros(len(text), np.int64)
        origin[place] = np.arange(len(s))
        index = FMIndex(text, len(self.phrases.words) + 1)
        out = []
        for matrix, first in zip(self.phrases.windows, self.phrases.first_of, strict=True):
            lo, hi = index.search(matrix.astype(np.int64))
            times = hi - lo
            rows = np.arange(int(times.sum())) + np.repeat(lo - np.cumsum(times) + times, times)
            out.append((origin[index.locate(rows)], np.full(len(rows), matrix.shape[1]), np.repeat(np.arange(len(matrix)), times) + first))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def spans(self) -> Iterator[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
        """For each row with hits: merged spans (word start, word end, byte start, byte end) and the items found."""
        at, length, window = self.occurrences()
        if not len(at):
            return
        doc, word, byte_start, byte_end = self.columns
        order = np.lexsort((word[at], doc[at]))
        at, length, window = at[order], length[order], window[order]
        d, w, end = doc[at], word[at], word[at] + length
        key = d * (int(end.max()) + 1)
        reach = np.maximum.accumulate(key + end)
        new = np.ones(len(at), bool)
        new[1:] = (key + w)[1:] > reach[:-1]
        new[1:] |= d[1:] != d[:-1]
        head = np.flatnonzero(new)
        stop = (reach - key)[np.append(head[1:], len(at)) - 1]
        b0, tail = byte_start[at[head]], at[head] + stop - word[at[head]] - 1
        found = np.column_stack([d[head], word[at[head]], stop, b0, byte_end[tail]])
        owners = self.phrases
        pair = np.unique(np.column_stack([d, window]), axis=0)
        cut = np.searchsorted(found[:, 0], pair_docs := np.unique(d))
        cut_end = np.searchsorted(found[:, 0], pair_docs, "right")
        p0, p1 = np.searchsorted(pair[:, 0], pair_docs), np.searchsorted(pair[:, 0], pair_docs, "right")
        for k, row in enumerate(pair_docs.tolist()):
            items = {int(i) for x in pair[p0[k] : p1[k], 1] for i in owners.owners[owners.owner_at[x] : owners.owner_at[x + 1]]}
            yield row, [tuple(int(v) for v in r[1:]) for r in found[cut[k] : cut_end[k]]], [owners.items[i] for i in items]


_SPAN = pa.struct([("word_start", pa.int64()), ("word_end", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])
_SPAN_DDL = "array<struct<word_start: long, word_end: long, byte_start: long, byte_end: long>>"


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


def phrase_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The items in blocks of bounded size, one at a time on the driver."""
    rows, size = [], 0
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    for r in items.orderBy("i", "t").toLocalIterator():
        rows.append((r.i, r.t))
        size += len(r.t) // 2 + 1
        if size >= block_words:
            if block := phrases_of(rows, window):
                yield block
            rows, size = [], 0
    if rows and (block := phrases_of(rows, window)):
        yield block


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, [text and ``keep`` columns,] n_words, spans, items) of every text; ``keep``: columns that go along, with the text if any."""
    spark = prepare(df.sparkSession)
    kept = [c for c in keep if c != "doc_id"]
    docs = documents_of(df, id_col, text_col) if not kept else df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in kept if c != text_col])
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "n_words long", f"spans {_SPAN_DDL}", "items array<string>"])
    out = docs.select("*", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(_SPAN_DDL).alias("spans"), F.lit(None).cast("array<string>").alias("items"))

    def against(out: DataFrame, block: Phrases | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value or Phrases(np.zeros(1, _U), [np.ones((0, WINDOW), np.int64)], [0], np.zeros(1, np.int64), np.empty(0, np.int64), [])
            shard, waiting = Shard(phrases), []

            def flush() -> Iterator[pa.RecordBatch]:
                found = {row: x for row, *x in shard.spans()}
                counts, row = np.concatenate(shard.n_words), 0
                for b in waiting:
                    n = b.num_rows
                    spans = [[tuple(s.values()) for s in x or ()] for x in b.column(b.num_columns - 2).to_pylist()]
                    items = [list(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
                    for i in [i for i in range(n) if row + i in found]:
                        spans[i] = merged(spans[i] + found[row + i][0])
                        items[i] = sorted({*items[i], *found[row + i][1]})
                    spans = pa.array([[dict(zip(_SPAN.names, s, strict=True)) for s in x] for x in spans], pa.list_(_SPAN))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(counts[row : row + n].astype(np.int64)), spans, pa.array(items, pa.list_(pa.string()))], b.schema.names)
                    row += n

            for batch in batches:
                for i, j, buf, off in text_chunks(batch):
                    shard.add(buf, off)
                    waiting.append(batch.slice(i, j - i))
                    if shard.full:
                        yield from flush()
                        shard, waiting = Shard(phrases), []
            if waiting:
                yield from flush()

        return out.mapInArrow(run, ddl)

    searched = False
    for block in phrase_blocks(benchmark, item_col, item_text_col, window):
        out, searched = against(out, block), True
    out = out if searched else against(out, None)
    return out if rest or kept else out.drop("text")


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["word_end"] - s["word_start"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def text_without(text: Column, spans: Column) -> Column:
    """``text`` without the bytes of ``spans``, which stand in order; an expression, so that no second Python worker is needed."""
    raw = F.encode(text, "UTF-8")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))
    step = lambda x, s: F.struct(s["byte_end"].alias("at"), F.concat(x["out"], F.substring(raw, (x["at"] + 1).cast("int"), (s["byte_start"] - x["at"]).cast("int"))).alias("out"))
    rest = lambda x: F.concat(x["out"], F.substring(raw, (x["at"] + 1).cast("int"), F.octet_length(raw)))
    return F.decode(F.aggregate(spans, first, step, rest), "UTF-8")


def cleaned_documents(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` (doc_id, text, ...) that are not contaminated; in those the spans found are cut out and ``n_chars``, if there, is set anew.

    Other columns, whatever their names, go along untouched.  Null and empty texts stay; an empty table gives an empty result."""
    others = [c for c in df.columns if c not in ("doc_id", "text")]
    packed = df.select("doc_id", "text", F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("others"))
    found = find_leaks(packed, benchmark, keep=("text", "others"))
    clean = found.where(~is_contaminated(hit_words(F.col("spans")), F.col("n_words")))
    out = clean.select("doc_id", F.when(F.size("spans") > 0, text_without(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"), "others", (F.size("spans") > 0).alias("shorter"))
    whole = lambda c: F.col("others")[c]
    anew = lambda c: F.when(F.col("shorter"), F.char_length("text").cast(df.schema[c].dataType)).otherwise(whole(c)) if c == "n_chars" else whole(c)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else anew(c).alias(c) for c in df.columns])


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
