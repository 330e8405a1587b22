"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, stored as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.durable import durable
from .arrays import chunks

TILE = 32
WIDTH = 64


def encode_pgm(pixels: np.ndarray) -> bytes:
    """8-bit grey samples, rows x columns, as binary Netpbm (P5)."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    """8-bit colour samples, rows x columns x 3, as binary Netpbm (P6)."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey (rows x columns, with a grey palette) or colour (x 3) samples as an uncompressed BMP."""
    rows, columns = pixels.shape[:2]
    colour = pixels.ndim == 3
    stride = -(-columns * (3 if colour else 1) // 4) * 4
    body = np.zeros((rows, stride), np.uint8)
    flat = pixels[::-1, :, ::-1].reshape(rows, -1) if colour else pixels[::-1]
    body[:, : flat.shape[1]] = flat
    palette = b"" if colour else bytes(x for i in range(256) for x in (i, i, i, 0))
    start = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", start + body.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 24 if colour else 8, 0, body.size, 2835, 2835, 0 if colour else 256, 0) + palette + body.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as arrays, rows x columns (x 3 for colour), scaled so that white is 255, or 65535 where samples have 16 bits. Bitmaps come as 0 (black) and 255."""
    kind, at, numbers = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not Netpbm")
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*0*(\d{1,9})(?!\d)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    columns, rows, most = (*numbers, 1)[:3]
    colour = kind in (b"P3", b"P6")
    shape = (rows, columns, 3) if colour else (rows, columns)
    size = int(np.prod(shape))
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array(re.findall(rb"[01]" if kind == b"P1" else rb"\d+", body)[:size], dtype=np.int64)
    elif kind == b"P4":
        wide = -(-columns // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, rows * wide, at + 1).reshape(rows, wide), axis=1)
        values = bits[:, :columns].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", size, at + 1)
    if len(values) < size:
        raise ValueError("truncated Netpbm")
    out = values.reshape(shape)
    if kind in (b"P1", b"P4"):
        return ((1 - out) * 255).astype(np.uint8)
    white = 255 if most < 256 else 65535
    if not 0 < most < 65536 or out.size and out.max() > most:
        raise ValueError("broken Netpbm samples")
    if most != white:
        out = (out.astype(np.int64) * white * 2 + most) // (2 * most)
    return out.astype(np.uint8 if most < 256 else np.uint16)


def _masked(pixels: np.ndarray, masks: list[int]) -> np.ndarray:
    """The bits of each mask, scaled to 255."""
    out = []
    for m in masks:
        low = (m & -m).bit_length() - 1 if m else 0
        most = m >> low
        value = (pixels & m) >> low
        out.append((value * 510 + most) // (2 * most) if most else np.zeros_like(value))
    return np.stack(out, axis=2).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits a pixel, with or without bit masks, as rows x columns x 3; grey palettes give rows x columns."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, = struct.unpack_from("<I", data, 10)
    head, = struct.unpack_from("<I", data, 14)
    if head == 12:  # the oldest header: 16-bit sizes, palette entries of three bytes
        (columns, rows, _, depth), packing = struct.unpack_from("<HHHH", data, 18), 0
    else:
        columns, rows, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32) or packing == 3 and depth not in (16, 32) or columns < 0:
        raise ValueError("unsupported BMP")
    down, rows = rows < 0, abs(rows)
    stride = -(-columns * depth // 32) * 4
    body = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    body = body if down else body[::-1]
    if depth == 16 or packing == 3:
        pixels = body[:, : columns * depth // 8].copy().view("<u2" if depth == 16 else "<u4").astype(np.int64)
        masks = list(struct.unpack_from("<III", data, 54)) if packing == 3 else [0x7C00, 0x03E0, 0x001F]
        return _masked(pixels, masks)
    if depth >= 24:
        step = depth // 8
        return body[:, : columns * step].reshape(rows, columns, step)[:, :, 2::-1].copy()
    index = body if depth == 8 else np.unpackbits(body, axis=1) if depth == 1 else np.stack((body >> 4, body & 15), axis=2).reshape(rows, -1)
    used, size = (0, 3) if head == 12 else (struct.unpack_from("<I", data, 46)[0], 4)
    palette = np.frombuffer(data, np.uint8, size * (used or 1 << depth), 14 + head).reshape(-1, size)[:, 2::-1]
    if index[:, :columns].size and index[:, :columns].max() >= len(palette):
        raise ValueError("broken BMP palette")
    grey = (palette == palette[:, :1]).all()
    return (palette[:, 0] if grey else palette)[index[:, :columns]]


def decode(data: bytes) -> np.ndarray:
    """Netpbm or BMP; whatever is broken in them, numbers out of every range too, is a ValueError."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (OverflowError, struct.error) as e:
        raise ValueError(f"broken image: {e}") from e


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of each cell of a rows x columns grid, from the integral image, read between samples where cells cut pixels."""
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(np.float64)
    if not grey.size:
        return np.zeros((rows, columns))
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(axis=0).cumsum(axis=1)

    def between(a: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.minimum(at.astype(np.int64), len(a) - 2)
        part = (at - low)[:, None]
        return a[low] * (1 - part) + a[low + 1] * part

    ys, xs = np.linspace(0, grey.shape[0], rows + 1), np.linspace(0, grey.shape[1], columns + 1)
    cells = between(between(total, ys).T, xs).T
    area = (grey.shape[0] / rows) * (grey.shape[1] / columns)
    return (cells[1:, 1:] - cells[:-1, 1:] - cells[1:, :-1] + cells[:-1, :-1]) / area


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: of an 8 x 9 resize, whether each cell is darker than its right neighbour."""
    small = area_resize(pixels, 8, 9).round(6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """An NPY file of 8-bit grey samples; 16-bit ones are scaled down."""
    out = io.BytesIO()
    if pixels.dtype == np.uint16:
        pixels = pixels / 257.0
    np.lib.format.write_array(out, np.clip(area_resize(pixels, side, side).round(), 0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


def describe(images: DataFrame, column: str = "image", side: int = TILE) -> DataFrame:
    """All columns with ``height``, ``width``, ``tile`` (NPY bytes), ``dhash`` and ``media_error`` for a binary image column.

    Null and broken images have nulls there, and the error says why. Columns of these names are replaced.
    """
    source = images.drop("height", "width", "tile", "dhash", "media_error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column):
            out = []
            for data in batch.column(column).to_pylist():
                try:
                    if data is None:
                        raise ValueError("null")
                    p = decode(data)
                    out.append((*p.shape[:2], npy_tile(p, side), difference_hash(p), None))
                except ValueError as e:
                    out.append((None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            added = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            names = ["height", "width", "tile", "dhash", "media_error"]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | dict(zip(names, added, strict=True)))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{names}, height int, width int, tile binary, dhash string, media_error string")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // WIDTH)) * WIDTH
    return len(raw), raw.ljust(size, b"\0")


def encode(payload: bytes) -> bytes:
    """A grey image 64 wide of the payload: BMP where its crc32 is odd, Netpbm otherwise, so that equal payloads have equal images."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_bmp(pixels) if zlib.crc32(payload) % 2 else encode_pgm(pixels)


STORED = "doc_id long, n_bytes long, media binary, tile binary"
READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, height int, width int, tile_sha256 string, tile_mean double, media_format string"
)


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media, tile)``: each whole text's bytes, padded with 0 to a multiple of 64, as a grey Netpbm or BMP image 64 wide, and its NPY tile.

    Null texts count as empty and have one row of zeros, as empty ones have. The table is written to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sizes, media, tiles = [], [], []
            for text in batch.column("text").to_pylist():
                n, payload = payload_of(text)
                sizes.append(n)
                pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
                media.append(encode(payload))
                tiles.append(npy_tile(pixels))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "tile"])

    return durable(docs.select("doc_id", "text").mapInArrow(run, STORED), compression="zstd")


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored images and tiles hold: the payload's and the image's own digests, difference hash, and the tile's digest and mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            out = []
            for data, tile in zip(batch.column("media").to_pylist(), batch.column("tile").to_pylist(), strict=True):
                pixels = decode(data)
                payload = pixels.tobytes()
                out.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(),
                    difference_hash(pixels), *pixels.shape, hashlib.sha256(tile).hexdigest(), float(np.load(io.BytesIO(tile)).mean()),
                    "bmp" if data[:2] == b"BM" else "pgm",
                ))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            added = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *added], names)

    return stored.mapInArrow(run, READ)
