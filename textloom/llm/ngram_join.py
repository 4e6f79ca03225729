"""Similarity join of documents by the Jaccard similarity of their word shingles, exact, with token-combination prefixes.

1. Sets.  A text is the set of 64-bit hashes of its shingles.  Equal sets form a class (a *node*, named by 64 bits of a
   digest); all further work is on classes, so copies cost nothing.
2. Order.  A bounded table holds the shingles that shards of the corpus share most; they are the frequent class and come
   last in the global order, all others are rare.  The table is only a hint: any order gives the same result.
3. Prefixes.  Two sets with J >= t share all but e = n - ceil(t n) of each one's shingles.  A prefix is extended
   until destroying all its signatures would take more than e lost shingles: a rare shingle is a signature by
   itself and counts 1; frequent ones fall into sub-classes, every pair inside a sub-class is a signature, and p of them count
   p - 1.  The number of sub-classes follows the size of the set, so sets sign under the schemes of their own size
   bucket and of the next: sets that can link differ by one bucket at most.
4. Clusters.  Sets of one signature whose sizes and parity sketches allow a link are joined to clusters: bits that differ bound the symmetric
   difference from below, so a pair they rule out cannot link.  Only pairs whose clusters still differ are compared, and a task puts out a forest,
   so rows follow the sets and not their pairs.  The smallest signature of each set comes first and leaves little to the
   others.  Signatures of frequent shingles are dealt out with a salt; where their parts end in several clusters, the
   sets outside the largest meet every part.
5. Verify.  All links lie inside clusters.  A cluster's sets, as sorted hashes, are dealt into blocks, and each pair of blocks is a cell that
   compares all its pairs of fitting size exactly and puts out a count for each set and a forest of its links.  Sets that share no rare signature
   share frequent shingles at most, which bounds what they can have in common.

A link of a document is another document whose set is alike enough; exact copies link.  Documents are counted by id and set, rows without an id each.

Defined cases: null or empty text, or no word: size 0, linked with nothing.  Fewer words than a shingle: the whole sequence is the one
shingle.  Rows that repeat an id belong to one document: its texts share a component, and each row has its own text's size and
links.  Ids may be of any type that has an order.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import SPACED_WORD, documents_of, dropped, mix, prepare, stored, text_chunks, word_hashes, words_of
from textloom.llm.components import components, stars

WORDS = 5
PERCENT = 80
#: Shards in which shared shingles are counted, how many sets must share one there, and the size of the table: speed only.
SHARD_SHINGLES, SHARED, TABLE = 4 << 20, 2, 1 << 19
FREQUENT = 8
#: Fewest bits of a set's parity sketch; it has at least as many bits as the set has shingles, a power of two.
SKETCH = 512
SUBCLASS = 25
SALT_ROWS = 4096
#: Groups of so many classes at most are compared all at once: speed only.
SMALL = 32
#: Sets and shingles of a block of a cluster, and shingles that a task gathers before it compares clusters: memory only.
BLOCK_SETS, BLOCK_SHINGLES, GATHERED = 1024, 1 << 21, 1 << 21
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_SHORT = np.arange(WORDS, dtype=_U) * _GOLD


def _multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U) * _GOLD) | _U(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    starts, ends, doc = words_of(buf, off, SPACED_WORD)
    w = word_hashes(buf, starts, ends)
    c = _multipliers(k)
    n = len(off) - 1
    cut = np.searchsorted(doc, np.arange(n + 1))
    m = max(len(w) - k + 1, 0)
    whole = np.zeros(m, _U)
    for i in range(k):
        whole += w[i : i + m] * c[i]
    whole = mix(whole)
    out = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if j - i >= k:
            s = np.sort(whole[i : j - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif j > i:
            out.append(mix((w[i:j] * c[: j - i]).sum(keepdims=True) + _SHORT[j - i]))
        else:
            out.append(np.empty(0, _U))
    return out


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_of(s: np.ndarray) -> bytes:
    """For each residue whether an odd number of shingles has it."""
    bits = max(SKETCH, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


class Sketches:
    """Sketches of many sets, compared at the size of the smaller of two: the halves of a sketch, one over the other, are the sketch of half as many bits."""

    def __init__(self, raw: list[bytes]):
        self.kind = np.array([(8 * len(x) // SKETCH).bit_length() - 1 for x in raw])
        self.rows, self.place = {}, {}
        for c in np.unique(self.kind).tolist():
            own, above = np.flatnonzero(self.kind == c), np.flatnonzero(self.kind == c + 1)
            m = np.frombuffer(b"".join(raw[i] for i in own), _U).reshape(len(own), -1)
            if len(above):
                wide = np.frombuffer(b"".join(raw[i] for i in above), _U).reshape(len(above), 2, -1)
                m = np.concatenate([m, wide[:, 0] ^ wide[:, 1]])
            self.place[c] = np.full(len(raw), -1)
            self.place[c][np.concatenate([own, above])] = np.arange(len(m))
            self.rows[c] = m

    def differences(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """No more than the shingles that only one of the sets ``x`` and ``y`` has; their sizes differ by less than a factor of two."""
        out, kind = np.zeros(len(y), np.int64), np.minimum(self.kind[x], self.kind[y])
        for c in np.unique(kind).tolist():
            m, at = self.rows[c], np.flatnonzero(kind == c)
            a, b = self.place[c][x[at]], self.place[c][y[at]]
            step = max(1, (1 << 19) // m.shape[1])
            for i in range(0, len(at), step):
                out[at[i : i + step]] = np.bitwise_count(m[a[i : i + step]] ^ m[b[i : i + step]]).sum(axis=1, dtype=np.int64)
        return out


def _survey(batches: Iterator[pa.RecordBatch], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, node) of every document, and rows (null, times, shingle) of what a shard's different sets share."""
    held, size, nodes = [], 0, set()

    def shared() -> pa.RecordBatch:
        s = np.sort(np.concatenate(held)) if held else np.empty(0, _U)
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        times = np.diff(np.append(at, len(s)))
        many = times >= SHARED
        key = s[at][many].view(np.int64)
        return pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(key), ids), "n": times[many].astype(np.int64), "node": key, "shared": np.ones(len(key), bool), "sketch": pa.nulls(len(key), pa.binary())})

    for batch in batches:
        for i, j, buf, off in text_chunks(batch):
            sets = shingle_sets(buf, off)
            found = [node_of(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0)[i:j], "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(found, pa.int64()),
                "shared": pa.array(np.zeros(j - i, bool)), "sketch": pa.array([sketch_of(s) for s in sets], pa.binary()),
            })
            for node, s in zip(found, sets, strict=True):
                if node not in nodes:
                    nodes.add(node)
                    held.append(s)
                    size += len(s)
            if size > SHARD_SHINGLES:
                yield shared()
                held, size, nodes = [], 0, set()
    yield shared()


def errors_allowed(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles a set may lose in a link."""
    return n + (-percent * n // 100)


def bucket_of(n: int, percent: int = PERCENT) -> int:
    """Sizes grow by 100 / percent from bucket to bucket, so sets that can link are at most one bucket apart."""
    return math.floor(math.log(n) / math.log(100 / percent))


def schemes_of(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(bucket, sub-classes) of the two schemes of a set of n shingles."""
    b = bucket_of(n, percent)
    return [(x, max(1, int((100 / percent) ** x / SUBCLASS))) for x in (b, b + 1)]


class Signer:
    """Signatures of a set, given the table of frequent shingles (sorted hashes, their counts)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, percent: int = PERCENT, salt_rows: int = SALT_ROWS):
        self.keys, self.counts, self.percent, self.salt_rows = keys, counts, percent, salt_rows
        order = np.lexsort((keys, counts))
        self.rank = np.empty(len(keys), np.int64)
        self.rank[order] = np.arange(len(keys))

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signatures, salts, most): a salt above 1 says over how many parts a signature's group is dealt; ``most``: how many
        shingles the set can share with another that has none of its rare signatures - all, for a rare signature itself."""
        n = len(s)
        need = errors_allowed(n, self.percent) + 1
        if n < 2:  # links with equal sets only
            return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
            known = self.keys[at] == s
        else:
            at, known = np.zeros(n, np.int64), np.zeros(n, bool)
        rare = s[~known][:need]
        signs, salts = [rare], [np.ones(len(rare), np.int64)]
        if len(rare) < need:
            at = at[known]
            at = at[np.argsort(self.rank[at])]
            for bucket, parts in schemes_of(n, self.percent):
                sub = (mix(self.keys[at] + _U(bucket)) % _U(parts)).astype(np.int64)
                order = np.argsort(sub, kind="stable")
                first = np.ones(len(order), bool)
                first[1:] = sub[order][1:] != sub[order][:-1]
                starts = np.zeros(len(at), bool)
                starts[order] = first
                enough = np.flatnonzero(len(rare) + np.cumsum(~starts) >= need)
                end = int(enough[0]) + 1 if len(enough) else len(at)
                for part in np.split(at[order[order < end]], np.flatnonzero(np.diff(sub[order[order < end]])) + 1):
                    x, y = np.triu_indices(len(part), 1)
                    a, b = part[x], part[y]
                    signs.append(mix(self.keys[a] * _GOLD + mix(self.keys[b] + _U(bucket + 1))))
                    salts.append(1 + np.minimum(self.counts[a], self.counts[b]) // self.salt_rows)
        signs = np.concatenate(signs)
        most = np.full(len(signs), int(known.sum()))
        most[: len(rare)] = n
        return signs, np.concatenate(salts), most


def _starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    held = list(batches)
    table = pa.Table.from_batches(held) if held else []
    return {c: table.column(c).to_numpy() for c in table.column_names} if len(table) else {}


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the signatures that different sets share, or may share with those of other salts."""
    rows = _gathered(batches)
    if not rows:
        return
    order = np.lexsort((rows["node"], rows["n"], rows["salt"], rows["sign"]))
    rows = {c: v[order] for c, v in rows.items()}
    sign, salt, node = rows["sign"], rows["salt"], rows["node"]
    keep = np.ones(len(sign), bool)
    keep[1:] = (sign[1:] != sign[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
    rows = {c: v[keep] for c, v in rows.items()}
    sign = rows["sign"]
    at = _starts_of(sign, rows["salt"])
    lens = np.diff(np.append(at, len(sign)))
    wanted = np.flatnonzero(np.repeat(lens > 1, lens) | (rows["salts"] > 1))
    for i in range(0, len(wanted), 1 << 16):
        w = wanted[i : i + (1 << 16)]
        yield pa.RecordBatch.from_pydict({c: rows[c][w] for c in ("sign", "node", "n", "most", "salt", "salts")})


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of signatures (and salts) whose sets are not all in one cluster yet."""
    rows = _gathered(batches)
    if not rows:
        return
    order = np.lexsort((rows["salt"], rows["sign"]))
    rows = {c: v[order] for c, v in rows.items()}
    at = _starts_of(rows["sign"], rows["salt"])
    lens = np.diff(np.append(at, len(order)))
    wanted = np.flatnonzero(np.repeat(np.minimum.reduceat(rows["root"], at) < np.maximum.reduceat(rows["root"], at), lens))
    for i in range(0, len(wanted), 1 << 16):
        w = wanted[i : i + (1 << 16)]
        yield pa.RecordBatch.from_pydict({c: v[w] for c, v in rows.items()})


def _clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of pairs (u, v) that sizes, ``most`` and sketches allow to link, within each signature and salt, between clusters (root) that differ."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if not table or not len(table):
        return
    rows = {c: table.column(c).to_numpy() for c in ("sign", "salt", "node", "n", "most", "root")}
    order = np.lexsort((rows["node"], rows["n"], rows["salt"], rows["sign"]))
    sign, salt, node, n, most, root = (v[order] for v in rows.values())
    n, most = n.astype(np.int64), most.astype(np.int64)
    raw = table.column("sketch").to_pylist()
    drawn = Sketches([raw[i] for i in order.tolist()])
    del raw, held, table, rows
    group = np.zeros(len(sign), np.int64)
    starts = _starts_of(sign, salt)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    ends = np.append(starts, len(sign))
    found, size = [np.empty((2, 0), np.int64)], 0

    def out() -> pa.RecordBatch:
        u, v = stars(*np.concatenate(found, axis=1))
        return pa.RecordBatch.from_pydict({"u": u, "v": v})

    def able(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        """Which of the rows ``y``, each at least as large as its ``x``, can link with it: overlap o >= PERCENT (a + b) / (100 + PERCENT), and o <= most of either."""
        both = n[x] + n[y]
        fit = (n[y] * PERCENT <= n[x] * 100) & (np.minimum(most[x], most[y]) * (100 + PERCENT) >= PERCENT * both)
        at = np.flatnonzero(fit)
        x = np.full(len(at), x) if np.isscalar(x) else x[at]
        return at[drawn.differences(x, y[at]) * (100 + PERCENT) <= both[at] * (100 - PERCENT)]

    def add(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal found, size
        found.append(np.stack([u, v]))
        size += len(u)
        if size > 1 << 19:
            found = [np.stack(stars(*np.concatenate(found, axis=1)))]
            size = found[0].shape[1]
            if size > 1 << 18:
                yield out()
                found, size = [np.empty((2, 0), np.int64)], 0

    lens = np.diff(ends)
    small = np.repeat(lens <= SMALL, lens)
    for d in range(1, SMALL):  # all small groups at once, by distance in the order
        near = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & (root[d:] != root[:-d]))
        for i in range(0, len(near), 1 << 16):
            x = near[i : i + (1 << 16)]
            x = x[able(x, x + d)]
            yield from add(root[x], root[x + d])
    seen = set()
    for g in np.flatnonzero(lens > SMALL).tolist():
        i, j = int(ends[g]), int(ends[g + 1])
        name = hashlib.blake2b(node[i:j].tobytes() + most[i:j].tobytes(), digest_size=16).digest()
        if name in seen:  # the same sets under another signature
            continue
        seen.add(name)
        label = root[i:j].copy()
        roots, times = np.unique(label, return_counts=True)
        main = roots[times.argmax()]  # the largest cluster so far: its sets need the others only
        others, joined = np.flatnonzero(label != main), []
        for x in range(j - i - 1):
            if not len(others):
                break
            last = x + 1 + int(np.searchsorted(n[i + x + 1 : j], n[i + x] * 100 // PERCENT, "right"))
            if label[x] == main:
                y = others[np.searchsorted(others, x, "right") : np.searchsorted(others, last)]
            else:
                y = np.arange(x + 1, last)
                y = y[label[y] != label[x]]
            y = y[able(i + x, i + y)] if len(y) else y
            if len(y):
                met = np.unique(label[y])
                joined.append(np.stack([np.full(len(met), label[x]), met]))
                to = main if label[x] == main or (met == main).any() else label[x]
                label[np.isin(label, np.append(met, label[x]))] = to
                others = np.flatnonzero(label != main)
        for u, v in joined:
            yield from add(u, v)
    yield out()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of texts (node, text): the sorted hashes; a row whose text is not the node's (an id may stand for several texts) gives none.  A null node stands for any."""
    for batch in batches:
        asked = batch.column(0).to_pylist()
        for i, j, buf, off in text_chunks(batch):
            out = [(m, x) for x, want in zip(shingle_sets(buf, off), asked[i:j], strict=True) if (m := node_of(x)) == want or want is None]
            yield pa.RecordBatch.from_pydict({"node": pa.array([m for m, _ in out], pa.int64()), "shingles": pa.array([x.tobytes() for _, x in out], pa.binary())})


def _links_of_cell(side: np.ndarray, sets: list[np.ndarray], cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the pairs of a cell that link: any two rows, or, if ``cross``, one of side 0 and one of side 1."""
    n = np.array([len(x) for x in sets])
    order = np.lexsort((n, side))
    sets, n = [sets[i] for i in order.tolist()], n[order]
    cut = int((side == 0).sum())
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    mark, out = np.zeros(int(flat.max()) + 1, bool), [np.empty((2, 0), np.int64)]
    for x in range(cut if cross else len(sets) - 1):
        first, last = (cut, len(sets)) if cross else (x + 1, len(sets))
        first += int(np.searchsorted(n[first:last], -(-n[x] * PERCENT // 100), "left"))
        last = first + int(np.searchsorted(n[first:last], n[x] * 100 // PERCENT, "right"))
        if first >= last:
            continue
        own = flat[at[x] : at[x + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[flat[at[first] : at[last]]], at[first:last] - at[first], dtype=np.int64)
        mark[own] = False
        y = np.flatnonzero((100 * both >= PERCENT * (n[x] + n[first:last] - both)) & (both > 0)) + first
        if len(y):
            out.append(np.stack([np.full(len(y), x), y]))
    x, y = np.concatenate(out, axis=1)
    return order[x], order[y]


def _verified(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (root, i, j, side, node, copies, shingles) sorted by cell (root, i, j): (u, v, null) for a forest of a cell's links, or for each if ``pairs``, and
    (u, null, k): k documents of the cell link with the set u."""
    held: list[tuple] = []
    size = 0

    def cells() -> Iterator[pa.RecordBatch]:
        u, v, who, k = [], [], [], []
        first = 0
        for end in range(1, len(held) + 1):
            if end < len(held) and held[end][:3] == held[first][:3]:
                continue
            rows = list({r[4]: r for r in held[first:end]}.values())  # a set may come more than once
            first = end
            if len(rows) < 2:
                continue
            x, y = _links_of_cell(np.array([r[3] for r in rows]), [np.frombuffer(r[6], _U) for r in rows], rows[0][1] != rows[0][2])
            if not len(x):
                continue
            node, copies = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            count = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
            at = np.flatnonzero(count)
            who.append(node[at])
            k.append(count[at].astype(np.int64))
            a, b = (node[x], node[y]) if pairs else stars(node[x], node[y])
            u.append(a)
            v.append(b)
        if u:
            u, v, who, k = (np.concatenate(c) for c in (u, v, who, k))
            yield pa.RecordBatch.from_pydict({"u": np.concatenate([u, who]), "v": pa.array(np.concatenate([v, who]), mask=np.arange(len(u) + len(who)) >= len(u)), "k": pa.array(np.concatenate([u * 0, k]), mask=np.arange(len(u) + len(who)) < len(u))})

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > GATHERED and row[:3] != held[-1][:3]:
                yield from cells()
                held, size = [], 0
            held.append(row)
            size += len(row[6]) // 8
    yield from cells()


def _clusters(groups: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, root) of every set that signatures put into a cluster with another."""
    merge = lambda rows: stored(rows.repartition(width, "sign", "salt").select("sign", "salt", "node", "n", "most", "root", "sketch").mapInArrow(_clustered, "u long, v long"), "join-forest")
    sketches = nodes.select("node", "sketch")  # they go along with few rows, so that few pairs leave a task
    placed = lambda rows, roots: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    first = groups.groupBy("node", "n").agg(F.min(F.struct("sign", "salt", "most")).alias("s")).select("node", "n", "s.*", F.col("node").alias("root"))
    forest = merge(first.join(sketches, "node"))
    roots = stored(components(forest), "join-roots")
    dropped(forest)
    rest = placed(groups.select("sign", "salt", "node", "n", "most"), roots).repartition(width, "sign", "salt")
    rest = stored(rest.select("sign", "salt", "node", "n", "most", "root").mapInArrow(_mixed, "sign long, salt int, node long, n int, most int, root long"), "join-mixed")
    forest = merge(rest.join(sketches, "node"))
    roots, used = _joined(roots, forest), roots
    dropped(used)
    dropped(rest)
    dealt = groups.where("salts > 1")
    if not dealt.isEmpty():
        found = stored(placed(dealt, roots), "join-dealt")
        main = found.groupBy("sign", "root").agg(F.count("*").alias("m")).groupBy("sign").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
        split = found.join(main, "sign").withColumn("salt", F.explode(F.when(F.col("root") == F.col("main"), F.array("salt")).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))))
        forest = merge(split.drop("main", "kinds").join(sketches, "node"))
        roots, used = _joined(roots, forest), roots
        dropped(used)
        dropped(found)
    return roots


def _joined(roots: DataFrame, forest: DataFrame) -> DataFrame:
    """The clusters ``roots`` after links (u, v) between roots."""
    more = stored(components(forest), "join-roots").toDF("root", "top")
    moved = roots.join(more, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = stored(moved.union(more), "join-roots")
    dropped(more)
    dropped(forest)
    return out


def _join(df: DataFrame, id_col: str, text_col: str, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survey, class names, links): the survey has (doc_id, n, node) of every row, names have (node, doc_id) with the smallest id of each class, links what ``_verified`` gives."""
    spark = prepare(df.sparkSession)
    docs = documents_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids, salt_rows = to_arrow_type(docs.schema["doc_id"].dataType), SALT_ROWS
    survey = stored(docs.mapInArrow(lambda b: _survey(b, ids), f"doc_id {kind}, n long, node long, shared boolean, sketch binary"), "join-survey")
    members = survey.where("not shared").select("doc_id", "n", "node")
    frequent = survey.where("shared").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = frequent.orderBy(F.desc("n"), "node").limit(TABLE).toArrow()  # a table of bounded size; what it lacks counts as rare
    keys = top.column("node").to_numpy().view(_U)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], top.column("n").to_numpy()[order]))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(*shared.value, salt_rows=salt_rows), set()
        for batch in batches:
            for i, j, buf, off in text_chunks(batch):
                signs, salts, mosts, nodes, sizes, lens = [], [], [], [], [], []
                for s in shingle_sets(buf, off):
                    node = node_of(s)
                    if node in seen or len(s) < 2:
                        continue
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add(node)
                    x, salt, most = signer(s)
                    signs.append(x)
                    salts.append(salt)
                    mosts.append(most)
                    nodes.append(node)
                    sizes.append(len(s))
                    lens.append(len(x))
                if not signs:
                    continue
                signs, node, salt = np.concatenate(signs), np.repeat(np.array(nodes, np.int64), lens), np.concatenate(salts)
                part = (mix(node.view(_U) ^ signs) % salt.astype(_U)).astype(np.int32)  # other sets meet under another signature
                yield pa.RecordBatch.from_pydict({"sign": signs.view(np.int64), "node": node, "n": np.repeat(np.array(sizes, np.int32), lens), "most": np.concatenate(mosts).astype(np.int32), "salt": part, "salts": salt.astype(np.int32)})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = docs.mapInArrow(sign, "sign long, node long, n int, most int, salt int, salts int")
    groups = stored(signed.repartition(width, "sign", "salt").mapInArrow(_grouped, "sign long, node long, n int, most int, salt int, salts int"), "join-groups")
    names = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), (F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("copies"))
    sketched = survey.where("not shared and n > 0").select("node", "n", "sketch")
    nodes = stored(groups.select("node").distinct().join(sketched, "node").groupBy("node", "n").agg(F.first("sketch").alias("sketch")), "join-nodes")
    roots = _clusters(groups, nodes, width)
    # blocks of each cluster, so that a cell's sets fit into memory
    inside = roots.union(roots.select("root", "root").distinct()).distinct().join(nodes.select("node", "n"), "node")
    sizes = inside.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = stored(inside.join(sizes, "root").join(names, "node").select("node", "root", "blocks", "copies", "doc_id"), "join-wanted")
    for used in (groups, nodes, roots):
        dropped(used)
    named = docs.join(wanted.where("doc_id is not null").select("doc_id", "node"), "doc_id").dropDuplicates(["doc_id", "node", "text"]).select("node", "text")
    # a class whose rows all lack an id is read by its node instead
    bare = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(_sets, "node long, shingles binary")
    bare = bare.join(wanted.where("doc_id is null").select("node"), "node", "left_semi").dropDuplicates(["node"])
    held = named.mapInArrow(_sets, "node long, shingles binary").union(bare).join(wanted.select("node", "root", "blocks", "copies"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = held.withColumn("b", mine).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("root", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), (F.col("b") > F.col("c")).cast("int").alias("side"), "node", "copies", "shingles")
    links = stored(cells.repartition(width, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lambda b: _verified(b, pairs), "u long, v long, k long"), "join-links")
    dropped(wanted)
    return survey, names, links


def linked_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, other_id): every link between different sets once, each set named by the smallest id that has it."""
    survey, names, links = _join(df, id_col, text_col, pairs=True)
    side = lambda x, to: names.select(F.col("node").alias(x), F.col("doc_id").alias(to))
    both = links.where("v is not null").join(side("u", "a"), "u").join(side("v", "b"), "v")
    out = stored(both.select(F.least("a", "b").alias("doc_id"), F.greatest("a", "b").alias("other_id")), "join-pairs")
    for used in (survey, links):
        dropped(used)
    return out


def linked_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): the size of each document's set, the smallest id that links reach, and how many documents it links with."""
    survey, names, links = _join(df, id_col, text_col)
    members = survey.where("not shared").select("doc_id", "n", "node")
    # an id that has several texts holds them together
    same = members.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w")
    bridges = members.where("n > 0").join(same.select("doc_id", "v"), "doc_id").select(F.col("node").alias("u"), "v")
    linked = components(links.where("v is not null").select("u", "v").union(bridges))
    reach = names.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = reach.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    other = links.where("k is not null").groupBy(F.col("u").alias("node")).agg(F.sum("k").alias("others"))
    counted = reach.join(least, "root").join(other, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    none = F.lit(0).cast("long")
    alone = members.where("n = 0").select("doc_id", none.alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("n_links"))
    full = members.where("n > 0").join(counted, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    out = stored(full.union(alone), "join-documents")
    for used in (survey, links):
        dropped(used)
    return out
