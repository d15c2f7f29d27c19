"""Operator 1: media columns as progressive JPEG.

A payload becomes the coefficients of a 4:2:0 image: a byte is a coefficient, 64
of them a block, blocks first of the luma plane, then of both chroma planes.
Coefficients are what JPEG keeps without loss, so they are the format's unit
here. They are stored by progressive scans that split the spectrum (DC, 1-5,
6-63, plane by plane) and approximate each part successively; reading accumulates
the scans, gives the bytes back, transforms the coefficients, upsamples chroma
and gives the full-resolution RGB tensor, which is stored beside the digests.

Scale: map-only; a row depends on itself alone. Texts are worked on in groups of
``GROUP_BYTES``, so numpy calls are shared by some hundred texts; a longer text is a
group of its own, held whole, with some thirty times its size while it is worked on.

Edge cases: null and empty texts are a payload of 64 zero bytes; repeated rows
and equal texts give equal media and features; ids are passed through as they
are; an empty table gives an empty result. Images of other
writers are read as well, with an empty payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terralith.llm import jpeg_many
from terralith.llm.common import text_bytes

UNIT = jpeg_many.UNIT
#: Payload of the texts that are worked on at once.
GROUP_BYTES = 256 << 10


def padded(text: bytes) -> bytes:
    """The payload: zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def groups(values: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of some values that have about ``GROUP_BYTES``."""
    run, held = [], 0
    for value in values:
        run.append(value)
        held += len(value)
        if held >= GROUP_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def feature(rgb: np.ndarray) -> str:
    """Size, mean colour, an average hash of the brightness on 8 x 8 fields, and a checksum of the tensor."""
    h, w, _ = rgb.shape
    light = rgb.sum(axis=2, dtype=np.int64)
    rows, cols = (np.arange(8) * h // 8, np.arange(8) * w // 8)
    fields = np.add.reduceat(np.add.reduceat(light, rows, axis=0), cols, axis=1)
    bits = np.packbits((fields * 64 > fields.sum()).ravel()).tobytes().hex()
    mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (h * w)
    return f"{w}x{h};rgb={mean[0]},{mean[1]},{mean[2]};hash={bits};crc={zlib.crc32(rgb):08x}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for texts in groups(b.column("body").to_pylist()):
            sizes = pa.array([len(t) for t in texts], pa.int64())
            media = pa.array(jpeg_many.encode([padded(t) for t in texts]), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), sizes, media], names=["doc_id", "n_bytes", "media"])
            at += len(texts)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a progressive JPEG) of every text."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(_encode, f"doc_id {kind}, n_bytes long, media binary")


_FOUND = pa.schema(
    [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    + [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]
)


def _read_back(stored: bytes, image: jpeg_many.Decoded) -> tuple:
    payload, rgb = image
    return (
        *(len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:])),
        *(len(stored), hashlib.sha256(stored).hexdigest(), feature(rgb)),
        *(rgb.shape[0], rgb.shape[1], rgb.tobytes()),
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for stored in groups(b.column("media").to_pylist()):
            rows = [_read_back(*pair) for pair in zip(stored, jpeg_many.decode(stored))]
            found = [pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)]
            passed = [b.column(k).slice(at, len(stored)) for k in ("doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*passed, *found], names=["doc_id", "n_bytes", *_FOUND.names])
            at += len(stored)


def from_media(media: DataFrame) -> DataFrame:
    """What the stored media hold: payload digests, feature, and the RGB tensor (height x width x 3 bytes)."""
    kind = dict(media.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, schema)


def digest(docs: DataFrame) -> DataFrame:
    """What op1 returns, with the tensor."""
    return from_media(to_media(docs))
