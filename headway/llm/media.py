"""Media columns: Netpbm and BMP images to numpy arrays, area-resized tiles as NPY, and difference hashes.

``decode`` reads plain and raw PBM, PGM and PPM (8-bit samples) and uncompressed BMP of 8, 24 and 32 bits. ``resize`` takes
the exact mean of each target cell from the image's integral (summed-area table), with partial pixels at cell edges
weighted by area. A difference hash compares neighbours of a 9 x 8 grey tile. ``describe`` works row by row inside the tasks,
and ``tiles_written`` keeps its NPY tiles as a table of one file's bytes per row.

For documents, ``store`` writes a text's bytes losslessly as the samples of a raw PGM image of 576 columns. The images and
their NPY tiles are written as a table in the shared folder; digests and features come from what is read back.

Defined results: a null text counts as empty; an empty one is one row of samples of 255; images that cannot be read (also
those without pixels, with samples above their maximum, or with fewer bytes than their header asks for) give null columns
with the reason in ``error``; rows that repeat are treated alike; an empty table gives an empty result; columns besides the
id and the content are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from headway.llm.common import written

UNIT, FILL, TAIL = 576, 255, 32
TILE = 32


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header after its magic, comments skipped, and where the samples begin."""
    numbers, at = [], 2
    token = re.compile(rb"(?:\s|#[^\n]*\n)*(\d{1,9})(?!\d)")
    for _ in range(fields):
        m = token.match(data, at)
        if not m:
            raise ValueError("header")
        numbers.append(int(m[1]))
        at = m.end()
    if not all(numbers):
        raise ValueError("no pixels")
    if numbers[0] * numbers[1] > 8 * len(data):
        raise ValueError("fewer bytes than pixels")
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples as (height, width) or (height, width, 3) of uint8; bits come as 0 (black) and 255."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (width, height), at = _header(data, 2)
        if kind == b"P1":
            digits = re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*\n", b"", data[at - 1 :]))
            bits = np.frombuffer(digits, np.uint8)[: width * height].reshape(height, width) - ord("0")
        else:
            row = (width + 7) // 8
            bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)
    depth = {b"P2": 1, b"P3": 3, b"P5": 1, b"P6": 3}.get(kind)
    if depth is None:
        raise ValueError("kind")
    (width, height, most), at = _header(data, 3)
    if not 0 < most < 256:
        raise ValueError("depth")
    n = width * height * depth
    if kind in (b"P2", b"P3"):
        flat = np.array([int(x[:4]) for x in re.sub(rb"#[^\n]*\n", b"\n", data[at - 1 :]).split()[:n]], np.int64)
    else:
        flat = np.frombuffer(data, np.uint8, n, at)
    if len(flat) and not 0 <= flat.min() <= flat.max() <= most:
        raise ValueError("sample above the maximum")
    flat = (flat.astype(np.uint32) * 255 // most).astype(np.uint8) if most != 255 else flat.astype(np.uint8)
    return flat.reshape((height, width) if depth == 1 else (height, width, 3))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP, its rows from the top, colours as red, green, blue."""
    start, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height = struct.unpack_from("<ii", data, 18)
    bits, packed = struct.unpack_from("<H", data, 28)[0], struct.unpack_from("<I", data, 30)[0]
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("bmp")
    if width * abs(height) > len(data):
        raise ValueError("fewer bytes than pixels")
    row = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)[:, 2::-1]
        grey = np.arange(len(colours))[:, None] == colours
        return rows.copy() if grey.all() else colours[rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey image as 8-bit BMP with a grey palette."""
    height, width = image.shape
    row = (width + 3) // 4 * 4
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    body = np.zeros((height, row), np.uint8)
    body[:, :width] = image[::-1]
    head = struct.pack("<2sIHHI", b"BM", 54 + 1024 + body.size, 0, 0, 54 + 1024)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 0, 0, 256, 256) + palette.tobytes() + body.tobytes()


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * n / parts
    whole = np.minimum(at.astype(np.int64), n)
    return whole, at - whole


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a grey image by its integral, read between pixels by linear interpolation; rounded to uint8."""
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    rows, down = _edges(image.shape[0], height)
    below = np.minimum(rows + 1, image.shape[0])
    lines = sums[rows] + (sums[below] - sums[rows]) * down[:, None]
    columns, along = _edges(image.shape[1], width)
    beside = np.minimum(columns + 1, image.shape[1])
    corners = lines[:, columns] + (lines[:, beside] - lines[:, columns]) * along[None, :]
    cells = np.diff(np.diff(corners, axis=0), axis=1)
    area = image.shape[0] / height * (image.shape[1] / width)
    return np.clip(np.floor(cells / area + 0.5), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: whether a cell of the 8 x 9 tile is brighter than its left neighbour; as 16 hex digits."""
    small = resize(image, 8, 9).astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def describe(images: DataFrame, key: str, content: str, tile: int = TILE) -> DataFrame:
    """Of each image: height, width, its grey NPY tile, difference hash, and why it could not be read."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for data in batch.column(1).to_pylist():
                try:
                    image = grey(decode(data or b""))
                    row = (*image.shape, npy(resize(image, tile, tile)), difference_hash(image), None)
                except (ValueError, OverflowError, struct.error, IndexError) as why:
                    row = (None, None, None, None, str(why) or "unreadable")
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "height", "width", "tile", "feature", "error"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, content).mapInArrow(of, f"{key} {kind}, height int, width int, tile binary, feature string, error string")


def tiles_written(images: DataFrame, key: str, content: str, tile: int = TILE) -> DataFrame:
    """``describe``, its tiles written as a table in the shared folder."""
    return written(describe(images, key, content, tile), "tiles", "zstd")


def tile_array(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def store(text: str | None) -> tuple[int, bytes]:
    """The text's size in bytes, and its padded bytes as a raw PGM image."""
    data = (text or "").encode()
    padded = data + bytes([FILL]) * (-len(data) % UNIT if data else UNIT)
    return len(data), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, UNIT))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            sizes, images = zip(*(store(text.as_py()) for text in part.column(1)), strict=True)
            tiles = [npy(resize(decode(image), TILE, TILE)) for image in images]
            arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary()), pa.array(tiles, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "media", "tile"])


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", "tile_mean")
KINDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, tile_mean double"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in NAMES]
        for stored, tile in zip(batch.column("media"), batch.column("tile"), strict=True):
            data, small = stored.as_py(), tile.as_py()
            image = decode(data)
            payload = image.tobytes()
            row = (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(),
                difference_hash(image), hashlib.sha256(small).hexdigest(), float(tile_array(small).mean()),
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c) for c in out)], names=["doc_id", "n_bytes", *NAMES])


def stored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the text's image and its NPY tile, as the table that was written."""
    return written(docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary, tile binary"), "media", "zstd")


def document_media(docs: DataFrame) -> DataFrame:
    """Digests and features of every text's image and tile, read back from where they are stored."""
    return stored_documents(docs).mapInArrow(_features, f"doc_id long, n_bytes long, {KINDS}")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
