"""Media columns: AVI motion-JPEG files, their RIFF index, intra frames and shots.

``read_clips`` parses RIFF structure and index of any AVI whose frames are baseline JPEG, decodes every intra frame,
compares the luma histograms of neighbours and cuts where a difference stands out from those just before it
(adaptive threshold); each shot is a timed clip. ``write_bytes`` stores a payload of bytes losslessly in such a file,
one 8-bit sample a byte, and ``read_bytes`` gets it back from the index and the decoded frames.

Scale: one pass in an Arrow stage, no shuffle; memory follows the largest single file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import BLOCKS, decode, encode_plane

FPS, ROWS, BINS = 25, 64, 16
#: A cut: a histogram difference (0 to 1) of at least this, and past mean + 3 deviations of the last WINDOW ones.
LEAST_CUT, DEVIATIONS, WINDOW = 0.1, 3.0, 8


class Avi(NamedTuple):
    width: int
    height: int
    frame_us: int
    frames: list[bytes]
    payload: int | None  # bytes of payload, where the file says so


class Clip(NamedTuple):
    first: int
    last: int
    start_ms: int
    end_ms: int
    mean: float


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def write_bytes(payload: bytes) -> bytes:
    """An AVI file whose samples are the payload, a positive multiple of 64 bytes."""
    plane = np.frombuffer(payload, np.uint8).reshape(-1, BLOCKS)
    rows = min(ROWS, len(plane))
    frames = []
    for at in range(0, len(plane), rows):
        part = plane[at : at + rows]
        if len(part) < rows:
            part = np.concatenate([part, np.zeros((rows - len(part), BLOCKS), np.uint8)])
        frames.append(encode_plane(part))
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    width, height, most = 8 * BLOCKS, 8 * rows, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl + chunk(b"plen", struct.pack("<Q", len(payload))))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames))
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(n, end - at - 8)
        at += 8 + n + n % 2


def read_avi(data: bytes) -> Avi:
    """Header and frames, as the index lists them; without an index, in the order of the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = frame_us = movi = movi_end = 0
    payload, index = None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        for name, at, n in _chunks(data, *todo.pop()):
            if name == b"LIST" and data[at : at + 4] == b"movi":
                movi, movi_end = at, at + n
            elif name == b"LIST":
                todo.append((at + 4, at + n))
            elif name == b"avih":
                frame_us, width, height = struct.unpack_from("<I", data, at)[0], *struct.unpack_from("<II", data, at + 32)
            elif name == b"plen":
                payload = struct.unpack_from("<Q", data, at)[0]
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, at + i) for i in range(0, n - 15, 16)]
    video = lambda name: name[2:] in (b"dc", b"db")
    if index is None:
        return Avi(width, height, frame_us, [data[at : at + n] for name, at, n in _chunks(data, movi + 4, movi_end) if video(name)], payload)
    listed = [x for x in index if video(x[0])]
    # offsets count from the list's name or from the start of the file
    base = movi if listed and data[movi + listed[0][2] : movi + listed[0][2] + 4] == listed[0][0] else 0
    return Avi(width, height, frame_us, [data[base + o + 8 : base + o + 8 + n] for _, _, o, n in listed], payload)


def read_bytes(avi: Avi) -> bytes:
    """The payload, from the decoded samples."""
    return b"".join(decode(f).blocks.tobytes() for f in avi.frames)[: avi.payload]


def histograms(avi: Avi) -> tuple[np.ndarray, np.ndarray, list]:
    """Each frame's luma histogram (shares of BINS bins), mean and decoded frame."""
    out, means, frames = [], [], []
    for f in avi.frames:
        frame = decode(f)
        y = frame.luma if frame.blocks is None else frame.blocks
        n = np.bincount(y.ravel(), minlength=256)
        out.append(n.reshape(BINS, -1).sum(1) / y.size)
        means.append(float(n @ np.arange(256)) / y.size)
        frames.append(frame)
    return np.array(out).reshape(-1, BINS), np.array(means), frames


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts = []
    for i, d in enumerate(diff):
        before = diff[max(0, i - WINDOW) : i]
        usual = before.mean() + DEVIATIONS * before.std() if len(before) else 0.0
        if d >= LEAST_CUT and d > usual:
            cuts.append(i + 1)
    return list(zip([0, *cuts], [c - 1 for c in [*cuts, len(hist)]], strict=True))


def clips(avi: Avi, hist: np.ndarray, means: np.ndarray) -> list[Clip]:
    us = avi.frame_us or 1_000_000 // FPS
    return [Clip(a, b, a * us // 1000, (b + 1) * us // 1000, float(means[a : b + 1].mean())) for a, b in shots(hist)]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            text = text or b""
            media = write_bytes(padded(text))
            avi = read_avi(media)
            hist, means, frames = histograms(avi)
            payload = b"".join(f.blocks.tobytes() for f in frames)[: avi.payload]
            found = clips(avi, hist, means)
            feature = f"{avi.width}x{avi.height};frames={len(avi.frames)};clips=" + ",".join(f"{c.start_ms}-{c.end_ms}:{c.mean:.3f}" for c in found)
            rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(found)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])


def _named(df: DataFrame, doc_id: str) -> DataFrame:
    return df.withColumnRenamed("id", doc_id)


def text_media(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: what storing the text as media and reading it back gives.

    doc_id, n_bytes (of the text), payload_bytes (padded), payload_sha256 (read back), tail_crc32 (last 64 bytes read
    back), media_bytes, media_sha256 (the stored file), feature (size, frames and clips), clips. Null counts as empty,
    whose payload is 64 zero bytes. Equal texts give equal values, repeated rows equal rows. Other columns are
    ignored, whatever their names.
    """
    own = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    return _named(own.mapInArrow(_stored, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips long"), doc_id)


def text_to_media(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``media``, the AVI file (binary) that holds the text's bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [write_bytes(padded(t or b"")) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["id", "media"])

    own = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return _named(own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, media binary"), doc_id)


def media_clips(files: DataFrame, file_id: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each shot of each file: file_id, clip, first_frame, last_frame, start_ms, end_ms, mean_luma, error.

    A null, empty or unreadable file gives one row with ``error`` set and the rest null; a file without frames none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                try:
                    avi = read_avi(data or b"")
                    hist, means, _ = histograms(avi)
                    own = [(k, *c, None) for k, c in enumerate(clips(avi, hist, means))]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    own = [(None, None, None, None, None, None, str(e) or type(e).__name__)]
                ids += [i] * len(own)
                rows += own
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["id", "clip", "first_frame", "last_frame", "start_ms", "end_ms", "mean_luma", "error"])

    own = files.select(F.col(file_id).alias("id"), F.col(media).alias("m"))
    return _named(own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, clip long, first_frame long, last_frame long, start_ms long, end_ms long, mean_luma double, error string"), file_id)
