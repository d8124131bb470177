"""Media columns: Netpbm and BMP files decoded to arrays, area-resized by integral images, kept as NPY tiles.

`decode` reads P1 to P6, samples of up to 16 bits as 8 bits, and uncompressed BMP of 8, 24 and 32 bits. `area_resize` averages
the exact area that each output pixel covers, from a two-dimensional prefix sum. `tiles` adds to a table of files their
size, the tile as an NPY file and a difference hash of the tile.

Nulls: a null or unreadable file, or one without pixels, gives null in every derived column, and its row stays. Repeated rows give repeated
rows; an empty table gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: An image row of the byte payloads: 64 pixels of three samples.
WIDTH, CHANNELS = 64, 3
UNIT = WIDTH * CHANNELS
TILE = (8, 9)
SPACES = b" \t\n\x0b\x0c\r"


def _header(data: bytes, numbers: int) -> tuple[list[int], int]:
    """The numbers behind the magic of a Netpbm file, with `#` comments skipped, and where the raster begins."""
    found, at = [], 2
    while len(found) < numbers:
        while data[at : at + 1] in SPACES or data[at : at + 1] == b"#":
            if at >= len(data):
                raise ValueError("header ends early")
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def _check(data: bytes, width: int, height: int) -> None:
    """No image is empty, and none has more pixels than its file has bits."""
    if width < 1 or height < 1 or width * height > 8 * len(data):
        raise ValueError("size and data do not agree")


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - ord("0")
    sizes, at = _header(data, 2 if kind in (1, 4) else 3)
    width, height = sizes[:2]
    top = sizes[2] if len(sizes) > 2 else 1
    if not 0 < top < 1 << 16:
        raise ValueError("more than 16 bits a sample")
    _check(data, width, height)
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    if kind == 1:
        bits = [c - 48 for c in data[at - 1 :] if c in b"01"]
        return ((1 - np.array(bits[: height * width], np.uint8)) * 255).reshape(shape)
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, height * -(-width // 8), at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    count = int(np.prod(shape))
    raw = np.array(data[at:].split()[:count], np.int64) if kind in (2, 3) else np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at)
    if len(raw) < count:
        raise ValueError("too few samples")
    return (raw if top == 255 else raw.astype(np.int64) * 255 // top).astype(np.uint8).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    at, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("compressed, or not 8, 24 or 32 bits")
    _check(data, width, abs(height))
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
    rows = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if height > 0:  # the last row comes first
        rows = rows[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, at - 14 - head, 14 + head).reshape(-1, 4)
        rows = palette[rows[:, :, 0]]
    return rows[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP file, (height, width) or (height, width, 3), 8 bits."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_ppm(samples: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    height, width = samples.shape[:2]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sI4xIIiiHHIIiiII", b"BM", 54 + rows.size, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def grey(samples: np.ndarray) -> np.ndarray:
    return samples.astype(np.int64) if samples.ndim == 2 else samples.sum(axis=2, dtype=np.int64) // samples.shape[2]


def _weights(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Output edges in units of 1 / `out` pixel: whole pixels before each edge, and what is left over."""
    return np.divmod(np.arange(out + 1, dtype=np.int64) * size, out)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of each output pixel, rounded down, in whole numbers: the prefix sum at a fractional edge is linear between its neighbours."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    for axis, out in ((0, height), (1, width)):
        whole, part = _weights(total.shape[axis] - 1, out)
        lower = np.take(total, whole, axis)
        upper = np.take(total, np.minimum(whole + 1, total.shape[axis] - 1), axis)
        part = part.reshape((-1, 1) if axis == 0 else (1, -1))
        total = np.diff(lower * (out - part) + upper * part, axis=axis)
    # both passes scaled the sums by the output size; an output pixel covers rows * columns of these units
    return (total // (image.shape[0] * image.shape[1])).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> int:
    """One bit per horizontal neighbour pair of the tile, set where brightness rises, row by row."""
    bits = (tile[:, 1:] > tile[:, :-1]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


TILE_FIELDS = "height int, width int, tile binary, feature string"


def tile_of(data: bytes, shape: tuple[int, int] = TILE) -> tuple[np.ndarray, bytes, str]:
    """The decoded samples, their tile as NPY and its difference hash in hex."""
    samples = decode(data)
    tile = area_resize(grey(samples), *shape)
    digits = -(-shape[0] * (shape[1] - 1) // 8) * 2
    return samples, npy(tile), format(difference_hash(tile), f"0{digits}x")


def tiles(files: DataFrame, key: str, media: str, shape: tuple[int, int] = TILE) -> DataFrame:
    """`key` of every row of `files` with height, width, tile and feature of the file in column `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                try:
                    samples, tile, feature = tile_of(data, shape)
                    found.append((samples.shape[0], samples.shape[1], tile, feature))
                except (TypeError, ValueError, struct.error, IndexError):
                    found.append((None,) * 4)
            columns = list(zip(*found)) or [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.string())))], names=[key, "height", "width", "tile", "feature"])

    return files.select(key, media).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, {TILE_FIELDS}")


def payload(data: bytes) -> bytes:
    """`data` padded with spaces to a positive multiple of one image row."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [(x or "").encode() for x in batch.column("text").to_pylist()]
        files = [encode_ppm(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH, CHANNELS)) for x in data]
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column("media").to_pylist():
            samples, tile, feature = tile_of(data)
            raw = samples.tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, samples.shape[0], tile))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=DIGEST_NAMES)


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, height int, tile binary"
)
DIGEST_NAMES = [x.split()[0] for x in DIGEST.split(", ")]


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each whole text as a binary PPM file, written to the shared folder.

    A null text is stored as the empty one, which is one row of spaces.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return materialise(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def op2_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as PPM, read back, decoded, hashed and reduced to a tile with its difference hash."""
    return text_media(table(spark, sf_dir, "documents")).mapInArrow(_digest, DIGEST)
