"""MPEG audio columns: write payloads as a layer III stream, read any MPEG audio stream back.

Writing: an ID3v2 tag, a frame with a Xing variable-bitrate table, then one MPEG-2 layer III frame (576
samples, mono, 16 kHz, CRC-protected) for every 576 payload bytes.  A frame decodes to silence; the payload
travels in its ancillary data, one byte a sample.  The bitrate varies with the bytes, so the stream is a true
variable-bitrate one.

Reading: tags are parsed and skipped; from the first header on, frames are walked by their lengths, so bytes
255 in a payload are never taken for a sync word; after damage the reader scans for the next header that a
second one confirms.  Duration is exact: samples and rate are kept as integers.  Every frame's offset is stored.

Defined cases: null or empty text: one frame of bytes 255.  Null or unreadable media: no frames, empty payload.
Repeated rows are stored each, equal bytes for equal texts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import documents_of, prepare

UNIT = 576

# Fixed values of the format: kbit/s by bitrate index, Hz by rate index, samples of a frame.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t.astype(np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's CRC-16 of each row of bytes, all rows at once."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ column]
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mono: bool

    @property
    def family(self) -> tuple[int, int]:
        return (1 if self.version == 3 else 2, self.layer)

    @property
    def samples(self) -> int:
        return SAMPLES[self.family]

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side_info(self) -> int:
        """Bytes between header (and CRC) and main data; layer III only."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def packed(self) -> bytes:
        bits = KBPS[self.family].index(self.kbps) << 12 | RATES[self.version].index(self.rate) << 10 | self.padding << 9
        return struct.pack(">I", 0x7FF << 21 | self.version << 19 | (4 - self.layer) << 17 | (not self.protected) << 16 | bits | (3 if self.mono else 0) << 6)


_known: dict[bytes, Header | None] = {}


def parse_header(raw: bytes) -> Header | None:
    """None for what is no header: no sync, reserved values, free or bad bitrate."""
    if len(raw) < 4 or raw[0] != 255 or raw[1] < 224:
        return None
    if raw not in _known:
        if len(_known) > 1 << 16:
            _known.clear()
        v = struct.unpack(">I", raw)[0]
        version, layer, kbps, rate = v >> 19 & 3, 4 - (v >> 17 & 3), v >> 12 & 15, v >> 10 & 3
        good = version != 1 and layer != 4 and 0 < kbps < 15 and rate < 3 and v & 3 != 2
        _known[raw] = Header(version, layer, not v >> 16 & 1, KBPS[1 if version == 3 else 2, layer][kbps], RATES[version][rate], v >> 9 & 1, v >> 6 & 3 == 3) if good else None
    return _known[raw]


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    xing: dict[str, int] | None = None
    toc: bytes = b""
    steps: list[int] = field(default_factory=list)
    skipped: int = 0
    resyncs: int = 0
    crc_checked: int = 0
    crc_bad: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """The end of the tag at ``at``; its text frames go to ``tags``."""
    size, major = _syncsafe(data[at + 6 : at + 10]), data[at + 3]
    p, end = at + 10, min(len(data), at + 10 + size)
    while p + 10 <= end and data[p : p + 1].isalpha():
        name, n = data[p : p + 4].decode("latin-1"), _syncsafe(data[p + 4 : p + 8]) if major >= 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        if name[0] == "T" and 0 < n <= end - p - 10:
            tags[name] = data[p + 11 : p + 10 + n].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[p + 10], "latin-1"), "replace").rstrip("\0")
        p += 10 + n
    return at + 10 + size + 10 * (data[at + 5] >> 4 & 1)


def _confirmed(data: bytes, at: int) -> Header | None:
    """The header at ``at`` if the next frame's header agrees with it, or the stream ends there."""
    h = parse_header(data[at : at + 4])
    if not h or at + h.length > len(data):
        return None
    after = at + h.length
    if after == len(data) or data[after : after + 3] in (b"TAG", b"ID3"):
        return h
    n = parse_header(data[after : after + 4])
    return h if n and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate) else None


def read_stream(data: bytes | None) -> Stream:
    out, at, synced = Stream(), 0, False
    data = data or b""
    while at + 4 <= len(data):
        if data[at : at + 3] == b"ID3" and at + 10 <= len(data):
            at = _id3v2(data, at, out.tags)
            continue
        if data[at : at + 3] == b"TAG" and len(data) - at == 128:
            out.tags.setdefault("TIT2", data[at + 3 : at + 33].decode("latin-1").rstrip("\0 "))
            at += 128
            break
        h = parse_header(data[at : at + 4]) if synced else _confirmed(data, at)
        if h and at + h.length <= len(data):
            out.offsets.append(at)
            out.headers.append(h)
            synced = True
            at += h.length
            continue
        out.resyncs += synced
        synced, was = False, at
        at += 1
        while (at := data.find(b"\xff", at)) >= 0 and not _confirmed(data, at):
            at += 1
        at = len(data) if at < 0 else at
        out.skipped += at - was
    _read_table(data, out)
    _verify(data, out)
    return out


def _read_table(data: bytes, out: Stream) -> None:
    """A Xing, Info or VBRI table in the first frame; that frame then holds no audio.  A Xing table's seek bytes go to ``toc``, a VBRI table's to ``steps``."""
    if not out.headers or out.headers[0].layer != 3:
        return
    h, p = out.headers[0], out.offsets[0] + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= out.offsets[0] + h.length:
        size, frames, n, scale, width = struct.unpack(">IIHHH", data[p + 10 : p + 24])
        out.xing = {"frames": frames, "bytes": size}
        raw = data[p + 26 : min(p + 26 + n * width, out.offsets[0] + h.length)]
        out.steps = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw) - width + 1, width)] if 0 < width <= 4 else []
        out.offsets, out.headers = out.offsets[1:], out.headers[1:]
        return
    p = next((q for q in (out.offsets[0] + 4 + h.side_info + 2 * h.protected, out.offsets[0] + 4 + h.side_info) if data[q : q + 4] in (b"Xing", b"Info")), -1)
    if p < 0:
        return
    flags, q = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
    out.xing = {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out.xing[name] = int.from_bytes(data[q : q + 4], "big")
            q += 4
    if flags & 4:
        out.toc = data[q : q + 100]
    out.offsets, out.headers = out.offsets[1:], out.headers[1:]


#: Fixed values of the format: bits of a layer II allocation field, as (bits, sub-bands) from the lowest on.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "lsf": ((4, 4), (3, 7), (2, 19)),
}


def _allocation(h: Header) -> list[int]:
    """Bits of the allocation field of each sub-band."""
    if h.layer == 1:
        return [4] * 32
    if h.version != 3:
        name = "lsf"
    else:
        each = h.kbps if h.mono else h.kbps // 2  # a channel's share
        low = each <= 48
        name = ("d" if h.rate == 32000 else "c") if low else "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, times in ALLOCATION[name] for _ in range(times)]


def _checksum(data: bytes, at: int, h: Header) -> int:
    """The CRC of a frame of layer I or II: the last two bytes of the header, the allocation and, in layer II, which scale factors follow."""
    fields = _allocation(h)
    v = int.from_bytes(data[at : at + 4], "big")
    bound = len(fields) if v >> 6 & 3 != 1 else min(len(fields), 4 * (v >> 4 & 3) + 4)  # above it, joint stereo shares fields
    channels = 1 if h.mono else 2
    size = 8 * h.length
    bits = int.from_bytes(data[at + 6 : at + h.length], "big")
    read = lambda p, n: bits >> (size - 48 - p - n) & ((1 << n) - 1)
    p = used = 0
    for sub, n in enumerate(fields):
        for _ in range(channels if sub < bound else 1):
            used += (read(p, n) > 0) * (1 if sub < bound else channels)
            p += n
    p += 2 * used if h.layer == 2 else 0
    crc, message = 0xFFFF, (v & 0xFFFF) << p | read(0, p)
    for i in range(15 + p, -1, -1):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ message >> i) & 1 else crc << 1) & 0xFFFF
    return crc


def _verify(data: bytes, out: Stream) -> None:
    spans: dict[int, list[int]] = {}
    for at, h in zip(out.offsets, out.headers, strict=True):
        if h.protected and h.layer == 3:
            spans.setdefault(h.side_info, []).append(at)
        elif h.protected:
            out.crc_checked += 1
            out.crc_bad += _checksum(data, at, h) != int.from_bytes(data[at + 4 : at + 6], "big")
    buf = np.frombuffer(data, np.uint8)
    for side, found in spans.items():
        at = np.array(found)[:, None]
        rows = buf[np.concatenate([at + np.arange(2, 4), at + np.arange(6, 6 + side)], axis=1)]
        stored = buf[at[:, 0] + 4].astype(np.uint16) << np.uint16(8) | buf[at[:, 0] + 5]
        out.crc_checked += len(found)
        out.crc_bad += int((crc16(rows) != stored).sum())


_PLAIN = tuple(Header(2, 3, True, kbps, 16000, 0, True) for kbps in (144, 160))
_HEAD = 4 + 2 + _PLAIN[0].side_info


def _silent(header: Header) -> bytes:
    """Header, CRC and side information of a frame that decodes to silence."""
    raw, side = header.packed(), bytes(header.side_info)
    return raw + int(crc16(np.frombuffer(raw[2:] + side, np.uint8)[None, :])[0]).to_bytes(2, "big") + side


_OPENING = tuple(np.frombuffer(_silent(h), np.uint8) for h in _PLAIN)


def pad(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % UNIT if payload else UNIT)


def write_stream(payload: bytes) -> bytes:
    """``payload`` (padded by the caller to a multiple of 576 bytes) as a variable-bitrate stream; equal bytes, equal stream."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    wide = (units.mean(axis=1) >= 100).astype(np.int64)
    lens = np.array([h.length for h in _PLAIN])[wide]
    ends = np.cumsum(lens)
    frames = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - lens
    for kind in (0, 1):
        at = starts[wide == kind][:, None]
        frames[at + np.arange(_HEAD)] = _OPENING[kind]
        frames[at + _HEAD + np.arange(UNIT)] = units[wide == kind]
    text = str(len(units) * UNIT * 1000 // _PLAIN[0].rate).encode()  # milliseconds
    frame = b"TLEN" + struct.pack(">IH", len(text) + 1, 0) + b"\0" + text
    tag = b"ID3\x03\0\0" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame
    table = _PLAIN[0].length
    whole = table + len(frames)
    seek = np.minimum(255, (table + np.append(starts, 0)[np.arange(100) * len(units) // 100]) * 256 // whole).astype(np.uint8)
    body = _OPENING[0].tobytes() + b"Xing" + struct.pack(">III", 7, len(units), whole) + seek.tobytes()
    return tag + body.ljust(table, b"\0") + frames.tobytes()


def read_payload(data: bytes, stream: Stream) -> bytes:
    """What ``write_stream`` stored: the first 576 ancillary bytes of each frame."""
    if not stream.offsets:
        return b""
    at = np.array(stream.offsets)[:, None] + _HEAD + np.arange(UNIT)
    return np.frombuffer(data, np.uint8)[np.minimum(at, len(data) - 1)].tobytes()


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as an MPEG audio stream."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len(x) for x in raw], pa.int64()),
                "media": pa.array([write_stream(pad(x)) for x in raw], pa.binary()),
            })

    docs = documents_of(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def probe_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", with_offsets: bool = True) -> DataFrame:
    """One row per media value: exact duration (samples, rate), frames, seek offsets, checks, and the payload's digests."""
    prepare(df.sparkSession)
    kept = [c for c in ("n_bytes",) if c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                data = data or b""
                s = read_stream(data)
                payload = read_payload(data, s)
                kbps = [h.kbps for h in s.headers]
                seconds = f"{s.samples * 10**6 // s.rate / 10**6:.6f}" if s.rate else "0"
                rows.append({
                    "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
                    "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
                    "feature": f"frames={len(kbps)};samples={s.samples};rate={s.rate};seconds={seconds};kbps={min(kbps, default=0)}-{max(kbps, default=0)}"
                    f";table={(s.xing or {}).get('frames', -1)}/{(s.xing or {}).get('bytes', -1)};toc={zlib.crc32(s.toc):08x};seek={zlib.crc32(np.array(s.offsets, '<i8').tobytes()):08x}"
                    f";crc={s.crc_checked - s.crc_bad}/{s.crc_checked};resync={s.resyncs};skipped={s.skipped}",
                    "n_frames": len(kbps), "n_samples": s.samples, "sample_rate": s.rate, "crc_bad": s.crc_bad, "skipped": s.skipped, "seek_offsets": s.offsets if with_offsets else [],
                })
            out = pa.RecordBatch.from_pylist(rows, schema=_PROBED)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in kept], *out.columns], ["doc_id", *kept, *_PROBED.names])

    kind = df.schema[id_col].dataType.simpleString()
    columns = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in kept], *[f"{f.name} {_DDL[str(f.type)]}" for f in _PROBED]])
    return df.selectExpr(f"`{id_col}` as doc_id", *kept, f"`{media_col}` as media").mapInArrow(run, columns)


_PROBED = pa.schema([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("sample_rate", pa.int64()), ("crc_bad", pa.int64()), ("skipped", pa.int64()), ("seek_offsets", pa.list_(pa.int64())),
])
_DDL = {"int64": "long", "string": "string", "list<item: int64>": "array<long>"}
