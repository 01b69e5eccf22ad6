"""MPEG audio columns: MPEG-1 Layer III streams that carry a payload losslessly.

A stream is an ID3v2.3 tag, a Xing frame (frame and byte counts, 100-point seek table), and frames
at 48 kHz mono. Each frame has a CRC-16, 17 bytes of silent side information, and its main data
area holds 1 to 4 payload units of 192 bytes as ancillary data; the bit rate follows the number of
units, so the stream is of variable bit rate. The reader resynchronises on headers, checks the
CRCs, and returns exact durations (1152 samples a frame) and the byte offset of every frame. A header counts
only if its frame ends the data or meets another header of the same version, layer and sample rate (what
follows is then read in the same way), or a trailing tag; the frame count of the table of a variable bit rate, Xing, Info or VBRI, is
held against the frames found. Only Layer III of MPEG-1 is read: frames of other versions and layers
are skipped as bytes that belong to no frame.

Defined results: a null text is the empty text, whose payload is one unit of blanks. Equal texts give
equal bytes, since nothing but the text enters. Repeated rows are stored alike, an empty table gives
an empty result, and columns beside `doc_id` and `text` are not read. Texts of any length are whole.
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
from pyspark.sql import functions as F

from streetweave.llm.common import prepare

UNIT = 192
SIDE = 17
SAMPLES = 1152
# Fixed values of the MPEG-1 Layer III format: kbit/s by header index, Hz by header index.
KBPS = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES = [44100, 48000, 32000]
#: Header index of the bit rate that holds so many units: 240, 480, 672 and 960 bytes at 48 kHz.
RATE_OF_UNITS = {1: 6, 2: 10, 3: 12, 4: 14}


def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, first value 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def frame_length(index: int, rate: int, padding: int) -> int:
    return 144 * KBPS[index] * 1000 // rate + padding


def _head(index: int) -> bytes:
    """Header with protection, CRC and silent side information at 48 kHz mono."""
    header = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(SIDE)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


_HEADS = {u: _head(i) for u, i in RATE_OF_UNITS.items()}
_LENGTHS = {u: frame_length(i, 48000, 0) for u, i in RATE_OF_UNITS.items()}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(values: dict[str, str]) -> bytes:
    """ID3v2.3 tag of TXXX text frames."""
    body = b""
    for k, v in values.items():
        text = b"\x00" + k.encode("latin-1") + b"\x00" + v.encode("latin-1")
        body += b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    return b"ID3\x03\x00\x00" + _syncsafe(len(body)) + body


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream that holds `payload`, a positive multiple of 192 bytes, of which n_bytes are the text's."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    units = len(payload) // UNIT
    frames, sizes, at = [], [], 0
    while units:
        u = min(4, units)
        room = _LENGTHS[u]
        body = _HEADS[u] + payload[at : at + u * UNIT]
        frames.append(body + bytes(room - len(body)))
        sizes.append(room)
        at, units = at + u * UNIT, units - u
    first = _LENGTHS[4]
    total = first + sum(sizes)
    starts = np.concatenate([[first], first + np.cumsum(sizes)[:-1]])
    marks = starts[np.arange(100) * len(sizes) // 100]
    toc = np.minimum(255, marks * 256 // total).astype(np.uint8).tobytes()
    xing = _HEADS[4] + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tag = _tag({"n_bytes": str(n_bytes), "units": str(len(payload) // UNIT)})
    return tag + xing + bytes(first - len(xing)) + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    crc_errors: int = 0
    skipped: int = 0
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    rates: dict[int, int] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _header(data: bytes, at: int) -> tuple[int, int, int, bool, int] | None:
    """(length, kbit/s, Hz, protected, side bytes) of a Layer III header at `at`, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    b2, b3 = data[at + 2], data[at + 3]
    index, rate = b2 >> 4, b2 >> 2 & 3
    if not 0 < index < 15 or rate == 3:
        return None
    return frame_length(index, RATES[rate], b2 >> 1 & 1), KBPS[index], RATES[rate], not data[at + 1] & 1, SIDE if b3 >> 6 == 3 else 32


def _follows(data: bytes, at: int, rate: int) -> bool:
    """Whether the data end at `at`, or a header of that sample rate or a trailing tag is there."""
    h = _header(data, at)
    return at == len(data) or data[at : at + 3] == b"TAG" or (h is not None and h[2] == rate)


def _checked(data: bytes, at: int, h: tuple[int, int, int, bool, int]) -> bool:
    """Whether the frame has a checksum, and it holds."""
    body = at + 6 + h[4]
    return h[3] and crc16(data[at + 2 : at + 4] + data[at + 6 : body]) == data[at + 4] << 8 | data[at + 5]


def _read_tag(data: bytes, out: Stream) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = 0
    for b in data[6:10]:
        size = size << 7 | b & 0x7F
    at, end = 10, min(len(data), 10 + size)
    while at + 10 <= end and data[at] != 0:
        n = struct.unpack(">I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] == b"TXXX":
            key, _, value = data[at + 11 : min(end, at + 10 + n)].partition(b"\x00")
            out.tags[key.decode("latin-1")] = value.decode("latin-1")
        at += 10 + n
    return end


def decode(data: bytes) -> Stream:
    """Parse a stream. Bytes that belong to no frame are skipped up to the next header that holds: one whose frame ends the data, or
    is followed by another header of its sample rate. So the last frame before other bytes holds only if its checksum does."""
    out, heads = Stream(), {}
    at, first, parts = _read_tag(data, out), True, []
    while at < len(data):
        h = _header(data, at)
        if h is None or at + h[0] > len(data) or not (_follows(data, at + h[0], h[2]) or _checked(data, at, h)):
            nxt = data.find(b"\xff", at + 1)
            nxt = len(data) if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        length, kbps, rate, protected, side = h
        body = at + 4 + 2 * protected + side
        if protected:
            seen = data[at + 2 : at + 4] + data[at + 6 : body]
            if seen not in heads:
                heads[seen] = crc16(seen)
            out.crc_errors += heads[seen] != data[at + 4] << 8 | data[at + 5]
        if first and data[body : body + 4] in (b"Xing", b"Info"):
            flags, p = struct.unpack(">I", data[body + 4 : body + 8])[0], body + 8
            if flags & 1:
                out.vbr_frames, p = struct.unpack(">I", data[p : p + 4])[0], p + 4
            if flags & 2:
                out.vbr_bytes, p = struct.unpack(">I", data[p : p + 4])[0], p + 4
            if flags & 4:
                out.toc = data[p : p + 100]
        elif first and data[at + 36 : at + 40] == b"VBRI":
            # Fixed offset of the format: 32 bytes behind the header, whatever the channels.
            out.vbr_bytes, out.vbr_frames = struct.unpack(">II", data[at + 46 : at + 54])
        else:
            out.offsets.append(at)
            out.samples += SAMPLES
            out.rate = rate
            out.rates[kbps] = out.rates.get(kbps, 0) + 1
            parts.append(data[body : body + (at + length - body) // UNIT * UNIT])
        first, at = False, at + length
    units = int(out.tags.get("units", 0))
    out.payload = b"".join(parts)[: units * UNIT] if units else b"".join(parts)
    return out


def pad(text: bytes) -> bytes:
    """`text` with blanks up to a positive multiple of 192 bytes."""
    return text + b" " * (UNIT - len(text) if not text else -len(text) % UNIT)


def describe(s: Stream) -> str:
    rates = "+".join(f"{k}x{n}" for k, n in sorted(s.rates.items()))
    seek = zlib.crc32(np.array(s.offsets, dtype="<i8").tobytes())
    return f"mpeg1-l3 {s.rate}Hz mono frames={len(s.offsets)} samples={s.samples} seconds={s.seconds:.6f} kbps={rates} xing={s.vbr_frames} crc_errors={s.crc_errors} skipped={s.skipped} seek_crc={seek:08x}"


SCHEMA = "doc_id long, media binary, n_bytes long, payload_bytes long, seconds double, frame_offsets array<long>, crc_errors long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_mpeg(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Store every text of `docs` (doc_id, text) as MPEG audio, read it back and describe it.

    keep: names of the columns wanted, all of SCHEMA when empty; the media bytes themselves are only
    sent back if they are among them."""
    spark = docs.sparkSession
    prepare(spark)
    fields = [f for f in _fields() if not keep or f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                media = encode(pad(raw), len(raw))
                s = decode(media)
                if s.crc_errors or s.skipped or s.vbr_frames != len(s.offsets):
                    raise ValueError(f"a stored stream does not read back: {describe(s)}")
                rows.append(
                    {
                        "doc_id": doc_id,
                        "media": media,
                        "n_bytes": int(s.tags["n_bytes"]),
                        "payload_bytes": len(s.payload),
                        "seconds": s.seconds,
                        "frame_offsets": s.offsets,
                        "crc_errors": s.crc_errors,
                        "payload_sha256": hashlib.sha256(s.payload).hexdigest(),
                        "tail_crc32": zlib.crc32(s.payload[-16:]),
                        "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(),
                        "feature": describe(s),
                    }
                )
                if len(rows) >= 64:
                    yield _batch(rows, fields)
                    rows = []
            if rows:
                yield _batch(rows, fields)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [f.name for f in fields]
    return rows.mapInArrow(run, ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in names))


def _fields() -> list[pa.Field]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return [pa.field(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))]


def _batch(rows: list[dict], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields], schema=pa.schema(fields))
