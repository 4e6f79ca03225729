"""Toxicity by nearest labelled examples under exact TF-IDF cosine, on a block-max inverted index.

Terms are words and their first 4 and 6 bytes (so that inflected forms share a term).  Every term of the examples is indexed; none is
chosen by label.  A text's vector has (1 + ln tf) * weight(term); the weight is the term's IDF, ln((1 + N) / df), times its residual IDF,
ln(expected df / df) from a Poisson model by document length, no less than 0 and raised by ``FLOOR`` - so that words that
recur inside documents count more than words that happen to meet.  df, collection frequency and lengths are counted over all documents.

Examples stand in blocks of ``BLOCK``.  Terms of short postings are added up exactly; for the ``HEAD`` terms of the longest postings each block
has their maxima, which bound what a block can still gain.  The blocks of the greatest bounds are completed first; others only while their
bound reaches the k-th best cosine, so neighbours are exact.
Votes weigh by squared similarity; a logistic curve fitted on the training texts (each without itself) turns the share of votes into a
calibrated score.  Evidence: the nearest of the neighbours that voted for the prediction.

Training uses a bounded sample (``EXAMPLES`` of each class, in the order of a hash of their ids), one text for each id; scoring covers every row.
Defined cases: null or empty text, or no vocabulary term: no neighbour, the calibrated score of no votes.  Null labels
are left out; of several labels for one id the largest counts, of several texts the smallest.  No labels or one class: every score is the share of label 1
(0.0 without labels).  Equal similarities (to 10 digits): the smaller example number first.  Repeated rows score equally; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ALNUM_WORD, beginning_hashes, documents_of, dropped, prepare, released, stored, text_chunks, words_of

EXAMPLES = 6_000
FLOOR = 0.05
PREFIXES = (4, 6)
NEIGHBOURS, EVIDENCE = 64, 3
#: Terms with block maxima, examples in a block, queries taken at once, blocks completed first: speed only.
HEAD, BLOCK, QUERIES, FIRST = 768, 64, 128, 24
#: Postings that are copied as a whole from this length on: speed only.
SLICE = 128
#: Terms whose corpus counts travel together, and tasks that add up each such range before one task does.
RANGE, SALTS = 1 << 14, 8
#: Bytes of texts taken at once: bounds the arrays of a worker.
CHUNK_BYTES = 1 << 20
THRESHOLD = 0.3
_U = np.uint64


def terms_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term hash) of every word and of its beginnings, unordered."""
    starts, ends, doc = words_of(buf, off, ALNUM_WORD)
    whole, *beginnings = beginning_hashes(buf, starts, ends, PREFIXES)
    hashes, docs = [whole], [doc]
    for k, h in zip(PREFIXES, beginnings, strict=True):
        longer = ends - starts > k
        hashes.append(h ^ (_U(k) << _U(32)))
        docs.append(doc[longer])
    return np.concatenate(docs), np.concatenate(hashes)


#: Bits of a term's hash; the others hold the text's place in a chunk, so that one sort of plain numbers counts a chunk's terms.
KEY_BITS = 52
_KEY = _U((1 << KEY_BITS) - 1)


def counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key of ``KEY_BITS``, times), by document and key; there are no more than 4,096 documents."""
    both = (doc.astype(_U) << _U(KEY_BITS)) | (key >> _U(64 - KEY_BITS))
    both.sort()
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    at = np.flatnonzero(new)
    both, times = both[at], np.diff(np.append(at, len(both)))
    return (both >> _U(KEY_BITS)).astype(np.int64), both & _KEY, times


@dataclass
class Index:
    """Postings of every term ``t``: the examples that have it once, from ``start[t]`` to ``start[t + 1]``, and those that have it again, with its
    frequency there, from ``start_again[t]`` to ``start_again[t + 1]``."""

    vocabulary: np.ndarray  # sorted term hashes
    weight: np.ndarray  # of each term
    start: np.ndarray = None
    example: np.ndarray = None
    start_again: np.ndarray = None
    example_again: np.ndarray = None
    times: np.ndarray = None
    length: np.ndarray = None  # of each example's vector
    label: np.ndarray = None
    ids: list = field(default_factory=list)
    curve: tuple[float, float] = (0.0, 0.0)
    constant: float | None = None

    def vectors(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows (starts, terms, weights) of length one, empty for a text that has no vocabulary term."""
        return self.known(*counted(*terms_of(buf, off)), len(off) - 1)

    def known(self, doc: np.ndarray, key: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "_buckets" not in self.__dict__:
            self._buckets = buckets_of(self.vocabulary)
        term, same = places_of(self.vocabulary, self._buckets, key)
        doc, term, times = doc[same], term[same], times[same]
        weight = (1 + np.log(times)) * self.weight[term]
        size = np.maximum(np.sqrt(np.bincount(doc, weight * weight, n)), 1e-300)
        return np.searchsorted(doc, np.arange(n + 1)), term, weight / size[doc]

    def post(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, label: np.ndarray, ids: list) -> None:
        """Take the rows (doc, term, times), sorted by doc, as examples; those whose strongest long-posted term is the same stand together."""
        n, size = len(ids), len(self.vocabulary)
        most = np.bincount(term, minlength=size)
        length, strongest = np.zeros(n), np.zeros(n, np.int64)
        ends = np.searchsorted(doc, np.arange(n + 1))
        for i in range(0, n, 512):  # a slice of examples at a time
            at = slice(ends[i], ends[min(i + 512, n)])
            d, t = doc[at].astype(np.int64), term[at]
            value = (1 + np.log(times[at])) * self.weight[t]
            length += np.bincount(d, value**2, n)
            common = np.flatnonzero(most[t] >= n / 64)
            best = np.zeros(n)
            np.maximum.at(best, d[common], value[common])
            top = common[value[common] == best[d[common]]][::-1]
            strongest[d[top]] = t[top]
        length = np.maximum(np.sqrt(length), 1e-300)
        order = np.lexsort((np.arange(n), strongest))
        if size >= 1 << 26 or n >= 1 << 18 or int(times.max(initial=0)) >= 1 << 20:
            raise ValueError("more terms, examples or occurrences in a text than an index holds")
        place = np.empty(n, _U)
        place[order] = np.arange(n, dtype=_U)
        both = term.astype(_U)  # term, example, times in one number, sorted where it stands
        both <<= _U(18)
        both |= place[doc]
        both <<= _U(20)
        both |= times.astype(_U)
        both.sort()
        small = lambda x, top: x.astype(np.uint16 if top < 1 << 16 else np.uint32)
        times = small(both & _U((1 << 20) - 1), int(times.max(initial=0)))
        both >>= _U(20)
        both &= _U((1 << 18) - 1)
        example = small(both, n)
        del both
        once, start = times == 1, np.concatenate([[0], np.cumsum(most)])
        self.start = np.concatenate([[0], np.cumsum(once, dtype=np.int32)])[start]
        self.start_again = start - self.start
        self.example, self.example_again, self.times = example[once], example[~once], times[~once]
        self.length, self.label, self.ids = length[order], label[order], [ids[i] for i in order.tolist()]

    def _tables(self) -> tuple[np.ndarray, ...]:
        """(value of each tf, column of each term or -1, blocks x columns x examples of the long-posted terms, their block maxima); made once a process."""
        if "_made" not in self.__dict__:
            value = 1 + np.log(np.maximum(np.arange(int(self.times.max(initial=1)) + 1), 1))
            blocks = -(-max(len(self.ids), 1) // BLOCK)
            top = np.argsort(-np.diff(self.start + self.start_again), kind="stable")[:HEAD]
            column, matrix = np.full(len(self.vocabulary), -1, np.int32), np.zeros((blocks, len(top), BLOCK))
            column[top] = np.arange(len(top))
            for c, t in enumerate(top.tolist()):
                at, again = slice(self.start[t], self.start[t + 1]), slice(self.start_again[t], self.start_again[t + 1])
                for e, v in ((self.example[at].astype(np.int64), value[1]), (self.example_again[again].astype(np.int64), value[self.times[again]])):
                    matrix[e // BLOCK, c, e % BLOCK] = v * self.weight[t] / self.length[e]
            self._made = value, column, matrix, np.ascontiguousarray(matrix.max(axis=2).T)
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_made", "_buckets")}

    def _added(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Add what short-posted terms give to the cosines ``out`` (queries x examples)."""
        value = self._tables()[0]
        once, again = self.start[term + 1] - self.start[term], self.start_again[term + 1] - self.start_again[term]
        cut = np.searchsorted(row, np.arange(len(out) + 1)).tolist()
        for i, j, to in zip(cut[:-1], cut[1:], out, strict=True):
            if i == j:
                continue
            t, w, many = term[i:j], weight[i:j], once[i:j] >= SLICE
            long, few = t[many], t[~many]
            found = [self.example[a:b] for a, b in zip(self.start[long].tolist(), self.start[long + 1].tolist(), strict=True)]
            found.append(self.example.take(runs(self.start[few], once[i:j][~many])))
            at = runs(self.start_again[t], again[i:j])
            found.append(self.example_again.take(at))
            given = np.repeat(np.concatenate([w[many], w[~many], w]), np.concatenate([once[i:j][many], once[i:j][~many], again[i:j]]))
            given[len(given) - len(at) :] *= value.take(self.times.take(at))
            to[:] = np.bincount(np.concatenate(found), given, len(to))
        out[:, : len(self.ids)] /= self.length

    def _batch(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of ``n`` queries with all examples that can be among their best ``k``, 0 for others, and a bound from below on each query's k-th best."""
        _, column, matrix, most = self._tables()
        blocks, at = len(matrix), column[term]
        out = np.zeros((n, blocks * BLOCK))
        self._added(row[at < 0], term[at < 0], (weight * self.weight[term])[at < 0], out)
        head = np.zeros((n, matrix.shape[1]))
        head[row[at >= 0], at[at >= 0]] = weight[at >= 0]
        cut = out.reshape(n, blocks, BLOCK)
        bound = head @ most + cut.max(axis=2) + 1e-9

        def complete(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                q = np.flatnonzero(wanted[:, b])
                cut[q, b] += head[q] @ matrix[b]

        first = np.argpartition(-bound, min(FIRST, blocks) - 1, axis=1)[:, : min(FIRST, blocks)]
        done = np.zeros((n, blocks), bool)
        np.put_along_axis(done, first, True, axis=1)
        complete(done)
        held = np.take_along_axis(cut, first[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(held, max(held.shape[1] - k, 0), axis=1)[:, max(held.shape[1] - k, 0)] if held.shape[1] >= k else np.zeros(n)
        rest = ~done & (bound >= least[:, None])
        complete(rest)
        cut[~(done | rest)] = 0.0
        return out[:, : len(self.ids)], least - 1e-9

    def nearest(self, query: tuple[np.ndarray, np.ndarray, np.ndarray], k: int | None = None, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each sparse query row its ``k`` (NEIGHBOURS) examples of greatest cosine above zero (-1: none left) and their cosines; ``without``: an example to leave out for each."""
        starts, term, weight = query
        k = k or NEIGHBOURS
        n = len(starts) - 1
        ids, sims = np.full((n, k), -1), np.zeros((n, k))
        for i in range(0, n, QUERIES):
            cut = starts[i : i + QUERIES + 1]
            found, least = self._batch(np.repeat(np.arange(len(cut) - 1), np.diff(cut)), term[cut[0] : cut[-1]], weight[cut[0] : cut[-1]], len(cut) - 1, k + 1)
            if without is not None:
                found[np.arange(len(found)), without[i : i + len(found)]] = 0.0
            for r, row in enumerate(found):
                at = np.flatnonzero(row >= least[r]) if least[r] > 0 else np.flatnonzero(row)
                values = np.round(row[at], 10)
                best = np.argsort(-values, kind="stable")[:k]
                best = best[values[best] > 0]
                ids[i + r, : len(best)], sims[i + r, : len(best)] = at[best], values[best]
        return ids, sims

    def votes(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among each row's neighbours, drawn to 0 where they are few or far."""
        w = sims**2
        return (w * np.where(ids >= 0, self.label[ids], 0)).sum(axis=1) / (w.sum(axis=1) + 0.1)

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * votes)))


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of each."""
    ends = np.cumsum(size)
    out = np.repeat(first - ends + size, size)
    out += np.arange(len(out))
    return out


def buckets_of(vocabulary: np.ndarray) -> np.ndarray:
    """Where the terms of each value of the leading bits start; there are more values than terms, which are hashes of ``KEY_BITS``."""
    bits = len(vocabulary).bit_length() + 1
    sizes = np.bincount((vocabulary >> _U(KEY_BITS - bits)).astype(np.int64), minlength=1 << bits)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def places_of(vocabulary: np.ndarray, buckets: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the vocabulary, whether it is there) of each term."""
    if not len(vocabulary):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    bucket = (key >> _U(KEY_BITS + 1 - (len(buckets) - 1).bit_length())).astype(np.int64)
    term = np.minimum(buckets.take(bucket), len(vocabulary) - 1).astype(np.int64)
    same = vocabulary.take(term) == key
    left = np.flatnonzero(~same)
    while len(left):
        left = left[term[left] + 1 < buckets[bucket[left] + 1]]
        term[left] += 1
        same[left] = vocabulary[term[left]] == key[left]
        left = left[~same[left]]
    return term, same


def length_class(n: np.ndarray) -> np.ndarray:
    """Quarters of powers of two."""
    return np.floor(4 * np.log2(n + 1.0)).astype(np.int64)


LENGTHS = 256


def corpus_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, occurrences) of each term of the vocabulary and the number of documents of each length class, over all rows of ``docs`` (text).

    A task adds up the counts of its texts; ranges of the vocabulary are summed apart, each by ``SALTS`` tasks at most and then by one, so the driver gets
    each count once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # terms of the bounded sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        buckets = buckets_of(words)
        df, cf, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(LENGTHS, np.int64)
        for batch in batches:
            for i, j, buf, off in text_chunks(batch, CHUNK_BYTES):
                doc, key, times = counted(*terms_of(buf, off))
                lengths += np.bincount(length_class(np.bincount(doc, times, j - i)), minlength=LENGTHS)
                term, same = places_of(words, buckets, key)
                term, times = term[same], times[same]
                df += np.bincount(term, minlength=len(words))
                np.add.at(cf, term, times) if len(term) < len(words) // 8 else np.add(cf, np.bincount(term, times, len(words)).astype(np.int64), out=cf)
        if not lengths.any():
            return
        salt = int(df.sum() % SALTS)
        parts = [(-1, lengths, lengths)] + [(r // RANGE, df[r : r + RANGE], cf[r : r + RANGE]) for r in range(0, len(words), RANGE)]
        for r, a, b in parts:
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "salt": pa.array([salt], pa.int32()), "df": [a.tobytes()], "cf": [b.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r, a, b in zip(batch.column("range").to_pylist(), batch.column("df").to_pylist(), batch.column("cf").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                if r in sums:
                    sums[r][0] += a
                    sums[r][1] += b
                else:
                    sums[r] = [a.copy(), b.copy()]
        for r, (a, b) in sums.items():
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "df": [a.tobytes()], "cf": [b.tobytes()]})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("text").mapInArrow(count, "range int, salt int, df binary, cf binary")
    sums = packed.repartition(width, "range", "salt").mapInArrow(add, "range int, df binary, cf binary")
    rows = sums.repartition(width, "range").mapInArrow(add, "range int, df binary, cf binary").toArrow()  # a row a range
    shared.destroy()
    df, cf, lengths = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64), np.zeros(LENGTHS, np.int64)
    for r, a, b in zip(*(rows.column(c) for c in ("range", "df", "cf")), strict=True):
        a, b = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
        if r.as_py() < 0:
            lengths += a
        else:
            df[r.as_py() * RANGE :][: len(a)] = a
            cf[r.as_py() * RANGE :][: len(b)] = b
    return df, cf, lengths


def term_weights(df: np.ndarray, cf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """IDF times residual IDF (see the module); ``lengths``: documents of each length class."""
    n, df = lengths.sum(), np.maximum(df, 1)
    middle = 2 ** ((np.arange(len(lengths)) + 0.5) / 4) - 1
    expected, total = np.zeros(len(df)), float((lengths * middle).sum())
    for c in np.flatnonzero(lengths).tolist():
        expected += lengths[c] * -np.expm1(-cf * middle[c] / max(total, 1.0))
    residual = np.log(np.maximum(expected, 1e-9) / df)
    return np.log((1 + n) / df) * (np.maximum(residual, 0) + FLOOR)


def _curve(v: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of ``y`` on ``v``, slightly damped, by Newton's steps."""
    x, beta = np.column_stack([np.ones(len(v)), v]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) + 1e-2 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta -= np.linalg.solve(hess, grad)
    return float(beta[0]), float(beta[1])


def fit(df: DataFrame, labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Index:
    """An index of at most ``examples`` texts of each class, of those that ``allowed`` admits."""
    spark = prepare(df.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.coalesce(allowed, F.lit(False)))
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two classes
    nothing = Index(np.empty(0, _U), np.empty(0), constant=1.0 if sizes.get(1) else 0.0)
    if not sizes.get(0) or not sizes.get(1):
        return nothing
    pick = lambda v: one.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    docs = documents_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_chunks(batch, CHUNK_BYTES):
                d, k, n = counted(*terms_of(buf, off))
                cut = np.searchsorted(d, np.arange(j - i + 1))
                pack = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[i:j], "label": batch.column("label")[i:j], "terms": pack(k, _U), "times": pack(n, np.uint32)})

    chosen = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 * examples short rows
    one_text = docs.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    packed = stored(one_text.mapInArrow(run, f"doc_id {kind}, label int, terms binary, times binary"), "toxic-examples")
    # at most 2 * examples rows
    heads = sorted(packed.select("doc_id", "label", (F.length("terms") / 8).cast("long").alias("size")).collect(), key=lambda r: r.doc_id)
    ids, y, sizes_of = [r.doc_id for r in heads], np.array([float(r.label) for r in heads]), np.array([r.size for r in heads], np.int64)
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        dropped(packed)
        return nothing
    # their terms go straight to their places, one partition at a time
    starts = dict(zip(ids, (np.cumsum(sizes_of) - sizes_of).tolist(), strict=True))
    key, times = np.empty(int(sizes_of.sum()), _U), np.empty(int(sizes_of.sum()), np.uint32)
    for r in packed.select("doc_id", "terms", "times").toLocalIterator():
        at = slice(starts[r.doc_id], starts[r.doc_id] + len(r.terms) // 8)
        key[at], times[at] = np.frombuffer(r.terms, _U), np.frombuffer(r.times, np.uint32)
    vocabulary = np.empty(0, _U)
    for i in range(0, len(key), 1 << 18):
        vocabulary = np.unique(np.concatenate([vocabulary, key[i : i + (1 << 18)]]))
    term = np.empty(len(key), np.int32)
    for i in range(0, len(key), 1 << 18):
        term[i : i + (1 << 18)] = np.searchsorted(vocabulary, key[i : i + (1 << 18)])
    del key, starts, heads
    index = Index(vocabulary, term_weights(*corpus_counts(docs, vocabulary)))
    index.post(np.repeat(np.arange(len(ids), dtype=np.int32), sizes_of), term, times, y, ids)
    del term, times
    released()
    place = {x: i for i, x in enumerate(index.ids)}
    shared = spark.sparkContext.broadcast((index, place))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, place = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(i, QUERIES)
                raw, n = batch.column("terms").to_pylist(), batch.num_rows
                key, times = np.frombuffer(b"".join(raw), _U), np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint32)
                own = np.array([place[x] for x in batch.column("doc_id").to_pylist()], np.int64)
                v = index.votes(*index.nearest(index.known(np.repeat(np.arange(n), [len(x) // 8 for x in raw]), key, times, n), without=own))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "v": pa.array(v)})

    width = spark.sparkContext.defaultParallelism
    own = packed.repartition(width, "doc_id").mapInArrow(voted, f"doc_id {kind}, label int, v double").toArrow().sort_by([("doc_id", "ascending"), ("v", "ascending")])
    dropped(packed)
    shared.destroy()
    y = own.column("label").to_numpy().astype(float)
    index.curve = _curve(own.column("v").to_numpy(), y, np.where(y == 1, sizes[1] / n1, sizes[0] / n0))
    released()
    return index


def score(df: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, votes, evidence) of every whole text; evidence: ids and cosines of the nearest examples that voted for the prediction."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(index)  # bounded by the examples
    docs = documents_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i, j, buf, off in text_chunks(batch, CHUNK_BYTES):
                votes, s, evidence = np.zeros(j - i), np.full(j - i, index.constant), [[] for _ in range(j - i)]
                if index.constant is None:
                    ids, sims = index.nearest(index.vectors(buf, off))
                    votes = index.votes(ids, sims)
                    s = index.score(votes)
                    for r, near in enumerate(np.where(ids >= 0, index.label[ids], -1) == (s >= threshold)[:, None]):
                        at = np.flatnonzero(near)[:EVIDENCE]
                        evidence[r] = [{"doc_id": index.ids[e], "cosine": c, "label": int(index.label[e])} for e, c in zip(ids[r, at].tolist(), sims[r, at].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[i:j], "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32)), "votes": pa.array(votes),
                    "evidence": pa.array(evidence, pa.list_(pa.struct([("doc_id", batch.column(0).type), ("cosine", pa.float64()), ("label", pa.int32())]))),
                })

    return docs.mapInArrow(run, f"doc_id {kind}, score double, predicted int, votes double, evidence array<struct<doc_id: {kind}, cosine: double, label: int>>")


def accepted(df: DataFrame, index: Index, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text scores below ``threshold``; one pass, no join."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i, j, buf, off in text_chunks(batch, CHUNK_BYTES, text_col):
                if index.constant is None:
                    s = index.score(index.votes(*index.nearest(index.vectors(buf, off))))
                else:
                    s = np.full(j - i, index.constant)
                yield batch.slice(i, j - i).filter(pa.array(s < threshold))

    return df.mapInArrow(run, df.schema)
