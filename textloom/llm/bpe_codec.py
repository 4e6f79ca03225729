"""Byte-level BPE encoding and decoding by a local rank file, with the tiktoken library.

Long texts are cut first at places where the pattern always ends a match whatever stands around: between a
character that is not white space and one that is, and between a letter and a digit or mark (``SAFE``).  No alternative of the pattern goes on over such a
place or looks behind it, so the pieces encode to the same ids as the whole.  Decoding joins the
raw bytes of the ids and never goes through a lossy string.

Defined cases: null or empty text: no ids, empty bytes.  Special strings inside texts are ordinary text.
Repeated rows are encoded each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import documents_of, prepare

#: Characters of a piece, about; a piece is longer only where the text has no safe boundary.
PIECE_CHARS = 1 << 15
#: White space as the pattern counts it, and letters and marks that every version of Unicode agrees on.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _MARK = "a-zA-Z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "0-9!-/:-@\\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
# Python's \\S leaves out all that the pattern's \\s has
SAFE = re.compile(f"(?<=\\S)(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_MARK}])")


def load_encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(encoding, text: str) -> np.ndarray:
    if len(text) <= PIECE_CHARS:
        return np.array(encoding.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(encoding.encode_ordinary(p), "<u4") for p in pieces(text)])


def encode_texts(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_path, pattern)
        for batch in batches:
            ids = [encode(encoding, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
            })

    docs = documents_of(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, decoded]) of (doc_id, n_tokens, ids): raw bytes, no string in between."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_path, pattern)
        for batch in batches:
            ids = batch.column(2).to_pylist()
            raw = [encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids]
            out = {
                "doc_id": batch.column(0),
                "n_tokens": batch.column(1),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
            }
            if keep_bytes:
                out["decoded"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded binary" * keep_bytes
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, schema)


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded from its ids, as ``decode_ids(encode_texts(...))`` in one
    pass of one worker a task; ids leave no task."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_path, pattern)
        for batch in batches:
            n, ids, raw = [], [], []
            for text in batch.column(1).to_pylist():
                x = encode(encoding, text)
                n.append(len(x))
                ids.append(hashlib.sha256(x.tobytes()).hexdigest())
                raw.append(hashlib.sha256(encoding.decode_bytes(x.tolist())).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(raw, pa.string())})

    docs = documents_of(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
