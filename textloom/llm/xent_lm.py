"""Language-model scoring by cross-entropy difference between a target and a background model.

Both are word bigram models over one vocabulary, matched in order, smoothing and vocabulary, and each counted over every text of its
corpus.  The vocabulary has the words whose share of the tokens is at least ``SHARE`` in both corpora, so that neither model knows a word that
the other lacks, and one symbol for all others.  Interpolation is Witten-Bell down to the uniform
distribution.  Each token of a document has the difference (target loss - background loss) in bits; the score is their mean: below zero a
document reads more like the target.

The table of bigrams grows with the corpora and is stored in partitions.  Texts are taken in chunks of about ``CHUNK`` tokens.  A chunk sends its
distinct bigrams, packed by partition of the table; the task that has a partition adds them up (``fit``) or answers with
their loss differences (``score``).  So the table is never in one place, and tokens are never shuffled.  Only statistics of single words are
broadcast: at most 1 / ``SHARE``.

Defined cases: null or empty text, or no word: no tokens, score 0.  An empty corpus gives the uniform model.  Repeated rows count and score
each.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import ALNUM_WORD, documents_of, dropped, mix, prepare, stored, text_chunks, word_hashes, words_of

SHARE = 2.0**-18
#: Tokens of a chunk, and bigrams of a partition of the table: memory only.
CHUNK, PARTITION = 1 << 21, 1 << 21
#: Bits of a word's number in a bigram.
BITS = 20
_U = np.uint64


def word_counts(df: DataFrame, among: np.ndarray | None = None, text_col: str = "text") -> DataFrame:
    """(word hash, n) over every text, of all words or those ``among`` (sorted); a null word has the number of all tokens."""
    spark = prepare(df.sparkSession)
    shared = None if among is None else spark.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = 0, [], 0

        def out() -> pa.RecordBatch:
            keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_pydict({"word": keys.view(np.int64), "n": np.bincount(at, counts).astype(np.int64)})

        for batch in batches:
            for _, _, buf, off in text_chunks(batch):
                w = word_hashes(buf, *words_of(buf, off, ALNUM_WORD)[:2])
                total += len(w)
                if shared is not None:
                    place, known = places_of(shared.value, w)
                    w = shared.value[place[known]] if len(shared.value) else w[:0]
                held.append(np.unique(w, return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 22:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
        yield pa.RecordBatch.from_pydict({"word": pa.nulls(1, pa.int64()), "n": pa.array([total], pa.int64())})

    return df.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def places_of(vocabulary: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted vocabulary, whether it is there) of each word hash."""
    if not len(vocabulary):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    place = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
    return place, vocabulary[place] == key


def shared_vocabulary(target: DataFrame, background: DataFrame, share: float = SHARE, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(sorted hashes of the words whose share is at least ``share`` in both corpora, number of all tokens)."""
    among, tokens = None, 0
    for corpus in (target, background):
        counts = stored(word_counts(corpus, among, text_col), "lm-words")
        total = counts.where("word is null").agg(F.max("n")).first()[0] or 0
        words = counts.where("word is not null").where(F.col("n") >= max(share * total, 1)).select("word").toArrow()  # at most 1 / share
        among = np.sort(words.column("word").to_numpy().view(_U))
        tokens += total
        dropped(counts)
    return among, tokens


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each (1, 2, 3, 4 or 8) as the largest needs; the first byte says how many."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 3, 4, 8) if most < 1 << 8 * w or w == 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return squeezed(np.diff(keys, prepend=_U(0)))


def unsqueezed_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data), dtype=_U)


@dataclass
class Model:
    """Both models: statistics of contexts and words (rows: target, background) and the table of bigrams, (part, keys, target, background) packed by partition.

    Number 0 is any unknown word, the last number the start of a text."""

    vocabulary: np.ndarray
    partitions: int
    table: DataFrame | None = None
    count: np.ndarray = None  # of the word as a token
    follows: np.ndarray = None  # of tokens after the word
    kinds: np.ndarray = None  # of different tokens after the word

    def plain(self) -> np.ndarray:
        """P(word) of each model."""
        symbols = self.count.shape[1] - 1  # all but the start
        total, kinds = self.count.sum(axis=1, keepdims=True), (self.count > 0).sum(axis=1, keepdims=True)
        return np.where(total > 0, (self.count + kinds / symbols) / np.maximum(total + kinds, 1), 1 / symbols)

    def losses(self, keys: np.ndarray, seen: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Target loss - background loss, in bits, of each bigram; ``seen``: its counts in both models."""
        before, word, p = (keys >> _U(BITS)).astype(np.int64), (keys & _U((1 << BITS) - 1)).astype(np.int64), []
        for m in (0, 1):
            n, kinds, low = self.follows[m, before], self.kinds[m, before], plain[m, word]
            p.append(np.where(n > 0, (seen[m] + kinds * low) / np.maximum(n + kinds, 1), low))
        return np.log2(p[1] / p[0])

    def __getstate__(self):
        return self.__dict__ | {"table": None}


def bigrams(buf: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each token's bigram with the word or text start before it; number of tokens of each text)."""
    starts, ends, doc = words_of(buf, off, ALNUM_WORD)
    place, known = places_of(vocabulary, word_hashes(buf, starts, ends))
    number = np.where(known, place + 1, 0).astype(_U)
    before = np.empty(len(number), _U)
    before[1:] = number[:-1]
    before[:1] = before[1:][doc[1:] != doc[:-1]] = len(vocabulary) + 1
    return before << _U(BITS) | number, np.bincount(doc, minlength=len(off) - 1)


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(first column, tokens of each text, bigrams) of about ``CHUNK`` tokens, whole texts."""
    ids, tokens, grams, size = [], [], [], 0
    for batch in batches:
        for i, j, buf, off in text_chunks(batch):
            g, t = bigrams(buf, off, vocabulary)
            ids += batch.column(0)[i:j].to_pylist()
            tokens.append(t)
            grams.append(g)
            size += len(g)
            if size >= CHUNK:
                yield ids, np.concatenate(tokens), np.concatenate(grams)
                ids, tokens, grams, size = [], [], [], 0
    if ids:
        yield ids, np.concatenate(tokens), np.concatenate(grams)


def _dealt(keys: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted keys by partition and key, where each partition starts)."""
    part = (mix(keys) % _U(partitions)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(partitions + 1))


def _counted(df: DataFrame, which: int, vocabulary, partitions: int, text_col: str) -> DataFrame:
    """(part, model, keys, counts): the distinct bigrams of chunks of the texts, packed by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, grams in _chunks(batches, vocabulary.value):
            keys, counts = np.unique(grams, return_counts=True)
            order, ends = _dealt(keys, partitions)
            rows = [(p, order[ends[p] : ends[p + 1]]) for p in range(partitions) if ends[p] < ends[p + 1]]
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for p, _ in part], pa.int32()), "model": pa.array([which] * len(part), pa.int32()),
                    "keys": pa.array([squeezed_keys(keys[at]) for _, at in part], pa.binary()), "counts": pa.array([squeezed(counts[at]) for _, at in part], pa.binary()),
                })

    texts = df.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.mapInArrow(run, "part int, model int, keys binary, counts binary")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each partition, of rows sorted by part."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now:
                if held:
                    yield now, held
                now, held = row["part"], []
            held.append(row)
    if held:
        yield now, held


def fit(target: DataFrame, background: DataFrame, text_col: str = "text", share: float = SHARE) -> Model:
    """Both models; their table of bigrams is stored in the shared folder."""
    spark = prepare(target.sparkSession)
    vocabulary, tokens = shared_vocabulary(target, background, share, text_col)
    if len(vocabulary) >= (1 << BITS) - 2:
        raise ValueError(f"share must leave fewer than 2^{BITS} words")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(vocabulary, max(width, tokens // PARTITION))
    shared = spark.sparkContext.broadcast(vocabulary)
    size = len(vocabulary) + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = np.zeros((6, size), np.int64)
        for part, rows in _parts(batches):
            held = [unsqueezed_keys(r["keys"]) for r in rows]
            counts = np.concatenate([unsqueezed(r["counts"]) for r in rows]).astype(np.int64)
            which = np.repeat([r["model"] for r in rows], [len(k) for k in held])
            keys, at = np.unique(np.concatenate(held), return_inverse=True)
            seen = [np.bincount(at[which == m], counts[which == m], len(keys)).astype(np.int64) for m in (0, 1)]
            before, word = (keys >> _U(BITS)).astype(np.int64), (keys & _U((1 << BITS) - 1)).astype(np.int64)
            for m in (0, 1):
                stats[m] += np.bincount(word, seen[m], size).astype(np.int64)
                stats[2 + m] += np.bincount(before, seen[m], size).astype(np.int64)
                stats[4 + m] += np.bincount(before[seen[m] > 0], minlength=size)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": [squeezed_keys(keys)], "target": [squeezed(seen[0])], "background": [squeezed(seen[1])], "number": pa.nulls(1, pa.int32()), "stats": pa.nulls(1, pa.list_(pa.int64()))})
        at = np.flatnonzero(stats.any(axis=0))
        for i in range(0, len(at), 1 << 14):
            here, none = at[i : i + (1 << 14)], pa.nulls(len(at[i : i + (1 << 14)]), pa.binary())
            yield pa.RecordBatch.from_pydict({"part": pa.nulls(len(here), pa.int32()), "keys": none, "target": none, "background": none, "number": here.astype(np.int32), "stats": pa.array(stats[:, here].T.tolist(), pa.list_(pa.int64()))})

    packed = _counted(target, 0, shared, model.partitions, text_col).union(_counted(background, 1, shared, model.partitions, text_col))
    rows = packed.repartition(width, "part").sortWithinPartitions("part").mapInArrow(add, "part int, keys binary, target binary, background binary, number int, stats array<long>")
    made = stored(rows, "lm-table")
    model.table = made.where("part is not null").select("part", "keys", "target", "background")
    sums = made.where("part is null").groupBy("number").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(6)]).toArrow()  # a row a word at most
    stats = np.zeros((6, size), np.int64)
    for i in range(6):
        stats[i, sums.column("number").to_numpy()] = sums.column(f"s{i}").to_numpy()
    model.count, model.follows, model.kinds = stats[:2], stats[2:4], stats[4:]
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_losses: bool = False) -> DataFrame:
    """(doc_id, n_tokens, loss_difference[, losses]) of every whole text; ``losses``: of each token in order.  The result is stored."""
    spark = prepare(df.sparkSession)
    shared, partitions = spark.sparkContext.broadcast(model), model.partitions
    docs = documents_of(df, id_col, text_col)
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (ids, tokens, grams) in enumerate(_chunks(batches, shared.value.vocabulary)):
            keys, place = np.unique(grams, return_inverse=True)
            order, ends = _dealt(keys, partitions)
            where = np.empty(len(order), np.int64)
            where[order] = np.arange(len(order))
            parts = [p for p in range(partitions) if ends[p] < ends[p + 1]]
            rows = len(parts) + 1
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([task << 32 | n] * rows, pa.int64()), "part": pa.array([None, *parts], pa.int32()),
                "keys": pa.array([None, *(squeezed_keys(keys[order[ends[p] : ends[p + 1]]]) for p in parts)], pa.binary()),
                "ids": pa.array([ids] + [None] * len(parts), pa.list_(id_type)), "tokens": pa.array([squeezed(tokens)] + [None] * len(parts), pa.binary()),
                "places": pa.array([squeezed(where[place])] + [None] * len(parts), pa.binary()),
            })

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = shared.value.plain()
        for part, rows in _parts(batches):
            known, seen = np.empty(0, _U), np.empty((2, 0), np.int64)
            for r in rows:  # the table's row comes first
                if r["chunk"] is None:
                    known, seen = unsqueezed_keys(r["keys"]), np.stack([unsqueezed(r[m]).astype(np.int64) for m in ("target", "background")])
                    continue
                keys = unsqueezed_keys(r["keys"])
                at, same = places_of(known, keys)
                counts = np.where(same, seen[:, at], 0) if len(known) else np.zeros((2, len(keys)), np.int64)
                losses = shared.value.losses(keys, counts, plain).astype("<f4")
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([r["chunk"]], pa.int64()), "part": pa.array([part], pa.int32()), "losses": [losses.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            head = held[0]  # the chunk's own row comes first, its answers follow by part
            losses = np.concatenate([np.frombuffer(r["losses"], "<f4") for r in held[1:]] or [np.empty(0, "<f4")]).astype(np.float64)
            each, tokens = losses[unsqueezed(head["places"]).astype(np.int64)], unsqueezed(head["tokens"]).astype(np.int64)
            ends = np.cumsum(tokens)
            total = np.concatenate([[0.0], np.cumsum(each)])
            mean = np.round((total[ends] - total[ends - tokens]) / np.maximum(tokens, 1), 6) + 0.0
            made = {"doc_id": pa.array(head["ids"], id_type), "n_tokens": tokens, "loss_difference": mean}
            if keep_losses:
                made["losses"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(each))
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != now:
                    if held:
                        yield out()
                    now, held = row["chunk"], []
                held.append(row)
        if held:
            yield out()

    chunks = stored(docs.mapInArrow(ask, f"chunk long, part int, keys binary, ids array<{kind}>, tokens binary, places binary"), "lm-chunks")
    none = F.lit(None).cast("binary")
    table = model.table.select(F.lit(None).cast("long").alias("chunk"), "part", "keys", "target", "background")
    asked = table.union(chunks.where("part is not null").select("chunk", "part", "keys", none, none))
    answers = asked.repartition(width, "part").sortWithinPartitions("part", "chunk").mapInArrow(answer, "chunk long, part int, losses binary")
    heads = chunks.where("part is null").select("chunk", "part", none.alias("losses"), "ids", "tokens", "places")
    both = heads.union(answers.select("chunk", "part", "losses", F.lit(None).cast(f"array<{kind}>"), none, none))
    made = both.repartition(width, "chunk").sortWithinPartitions("chunk", "part")
    out = stored(made.mapInArrow(add, f"doc_id {kind}, n_tokens long, loss_difference double" + ", losses array<double>" * keep_losses), "lm-scores")
    dropped(chunks)
    return out
