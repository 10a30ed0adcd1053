"""Media columns: payload bytes kept in progressive JPEG files, read back from their coefficients and as RGB tensors.

The format's unit is a DCT coefficient: each payload byte is one coefficient, 64 bytes one block, six blocks a unit of
4:2:0 sampling. Files are read scan by scan into coefficient arrays, which give the payload again without loss and,
through the inverse transform and chroma upsampling, the picture's full-resolution RGB tensor.

Every row stands alone: no shuffle. Rows are handled in slices of a few MB of payload; the working arrays of a picture take
about 60 bytes for each byte of its payload, so a text of 10 MB takes 600 MB of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jpeg import Picture, encode
from .sizing import free_names, replace_columns

BLOCK = 64
#: Units in a row of the picture, and the most rows a JPEG file can have.
_COLUMNS, _MOST_ROWS = 64, 65535 // 16
#: Byte <-> coefficient: magnitudes 2 to 129, so that a halved coefficient is never zero.
_TO_COEFFICIENT = np.array([v - 129 if v < 128 else v - 126 for v in range(256)], np.int16)
_TO_BYTE = np.zeros(260, np.uint8)
_TO_BYTE[_TO_COEFFICIENT + 130] = np.arange(256)
#: Rows of Arrow data handled at once, in bytes of payload.
_SLICE_BYTES = 4 << 20


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def to_jpeg(payload: bytes) -> bytes:
    blocks = len(payload) // BLOCK
    units = -(-blocks // 6)
    rows = -(-units // max(_COLUMNS, -(-units // _MOST_ROWS)))
    cols = -(-units // rows)
    values = np.full((6 * rows * cols, BLOCK), _TO_COEFFICIENT[0], np.int16)
    values[:blocks] = _TO_COEFFICIENT[np.frombuffer(payload, np.uint8)].reshape(-1, BLOCK)
    n = rows * cols
    planes = [values[: 4 * n].reshape(2 * rows, 2 * cols, 64), values[4 * n : 5 * n].reshape(rows, cols, 64), values[5 * n :].reshape(rows, cols, 64)]
    return encode(planes, b"%d" % len(payload))


def from_jpeg(file: bytes) -> tuple[bytes, np.ndarray]:
    """The payload, and the RGB tensor (height, width, 3)."""
    picture = Picture(file)
    values = np.concatenate([p.reshape(-1) for p in picture.planes])[: int(picture.note)]
    return _TO_BYTE[values + 130].tobytes(), picture.rgb()


def _encode_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch, text):
            files = pa.array([to_jpeg(padded(x or b"")) for x in part.column(text).cast(pa.binary()).to_pylist()], pa.binary())
            names = [n for i, n in enumerate(part.schema.names) if i != text]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != text], files], names=[*names, "media"])


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of a few MB each (one row at least)."""
    rows = max(1, int(batch.num_rows * _SLICE_BYTES / max(1, batch.column(column).nbytes)))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _decode_batches(batches: Iterator[pa.RecordBatch], media: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch, media):
            payloads, tensors, heights, widths, features = [], [], [], [], []
            for file in part.column(media).to_pylist():
                payload, rgb = from_jpeg(file) if file is not None else (None, None)
                payloads.append(payload)
                tensors.append(None if rgb is None else rgb.tobytes())
                heights.append(None if rgb is None else rgb.shape[0])
                widths.append(None if rgb is None else rgb.shape[1])
                features.append(None if rgb is None else _feature(rgb))
            new = [pa.array(payloads, pa.binary()), pa.array(tensors, pa.binary()), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.array(features, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "payload", "rgb", "height", "width", "feature"])


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs with, for its text, a column `media`: the JPEG file of its UTF-8 bytes, zero-padded to a
    positive multiple of 64. Null reads as empty text (one zero block). Equal texts give equal files. An input column
    named media is replaced; an empty table stays empty."""
    kept = [c for c in replace_columns(docs, "media").columns if c != text_col]
    (text,) = free_names(docs, "text")
    rows = docs.select(*kept, F.col(text_col).alias(text))
    at = len(kept)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("media", T.BinaryType())])
    return rows.mapInArrow(lambda batches: _encode_batches(batches, at), schema)


def load(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Every row of media with payload, rgb (height x width x 3 bytes), height, width, and feature: the size, the average
    hash of the picture's 8 x 8 thumbnail and its mean colour. A null file gives nulls; a broken one raises. Input
    columns with those names are replaced."""
    rows = replace_columns(media, "payload", "rgb", "height", "width", "feature")
    at = rows.columns.index(media_col)
    schema = T.StructType(list(rows.schema.fields)).add("payload", "binary").add("rgb", "binary").add("height", "integer").add("width", "integer").add("feature", "string")
    return rows.mapInArrow(lambda batches: _decode_batches(batches, at), schema)


def thumbnail(rgb: np.ndarray) -> np.ndarray:
    """The picture's 8 x 8 mean colours (its sides are multiples of 16)."""
    h, w, _ = rgb.shape
    sums = rgb.reshape(8, h // 8, 8, w // 8, 3).sum(axis=(1, 3), dtype=np.int64)
    return (sums // (h * w // 64)).astype(np.uint8)


def average_hash(small: np.ndarray) -> str:
    """Which of the 64 parts of a thumbnail are lighter than all of it, as 16 hexadecimal digits."""
    light = small.astype(np.int64) @ np.array([299, 587, 114])
    return np.packbits(light.reshape(-1) * 64 > light.sum()).tobytes().hex()


def _feature(rgb: np.ndarray) -> str:
    small = thumbnail(rgb)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{average_hash(small)}:{small.reshape(64, 3).mean(axis=0).round().astype(np.uint8).tobytes().hex()}"
