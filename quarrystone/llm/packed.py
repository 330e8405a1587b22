"""Whole arrays as one binary value: byte planes, compressed."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

U = np.uint64
#: Keys from here on are hashes of words outside a code book; smaller ones are codes.
RARE = U(1 << 63)
_compressor, _decompressor = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as the planes of their used bytes."""
    values = np.ascontiguousarray(values, dtype=U)
    used = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :used].T)
    return struct.pack("<IB", len(values), used) + _compressor.compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<IB", data)
    planes = np.frombuffer(_decompressor.decompress(data[5:]), np.uint8).reshape(used, n)
    width = 1 << (used - 1).bit_length()
    out = np.zeros((n, width), np.uint8) if used < width else np.empty((n, width), np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.view(f"<u{width}").ravel().astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Codes as numbers, hashes in full."""
    rare = keys >= RARE
    codes = pack(np.where(rare, U(0), keys))
    return struct.pack("<I", len(codes)) + codes + keys[rare].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    size, = struct.unpack_from("<I", data)
    out = unpack(data[4 : 4 + size]).view(U)
    out[out == 0] = np.frombuffer(data[4 + size :], U)
    return out


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def parts_of(data: bytes) -> list[bytes]:
    n, = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{n}I", data, 4)
    at, out = 4 + 4 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out
