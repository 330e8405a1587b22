import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from quarrystone.llm import media


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 64), (9, 13, 3), (4, 2, 3)])
def test_encoded_images_decode_to_the_same_samples(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    for data in (media.encode_bmp(pixels), (media.encode_ppm if pixels.ndim == 3 else media.encode_pgm)(pixels)):
        assert np.array_equal(media.decode(data), pixels)


def test_netpbm_variants():
    assert media.decode(b"P1 # bits\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P2\n# c\n2 2 255\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P3 1 1 255 9 8 7").tolist() == [[[9, 8, 7]]]
    assert media.decode(b"P5 1 2 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256], [2]]
    for broken in (b"", b"P7 1 1", b"P5\n9 9\n255\nxx", b"P5\nx"):
        with pytest.raises(ValueError):
            media.decode(broken)


WIDE = struct.pack("<IiiHHIIiiII", 40, 2**31 - 1, -(2**31), 1, 32, 0, 0, 0, 0, 0, 0)
HUGE = [b"P2 1 1 255 99999999999999999999999", b"P5 99999999999999999999 1 255 x", b"P5 999999999 999999999 255\nx", b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + WIDE]


@pytest.mark.parametrize("data", HUGE)
def test_numbers_out_of_range_are_broken_images(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_leading_zeros_in_headers():
    assert media.decode(b"P2 0000000000001 1 255 7").tolist() == [[7]]


def test_samples_are_scaled_to_white():
    assert media.decode(b"P2 3 1 15 0 7 15").tolist() == [[0, 119, 255]]
    assert media.decode(b"P2 2 1 1023 0 1023").tolist() == [[0, 65535]]
    wide = np.full((4, 4), 40000, np.uint16)
    assert np.load(io.BytesIO(media.npy_tile(wide))).max() == 156
    with pytest.raises(ValueError):
        media.decode(b"P2 1 1 15 16")


def test_bmp_masks_and_old_headers():
    info = struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 16, 3, 0, 0, 0, 0, 0)
    masks = struct.pack("<III", 0xF800, 0x07E0, 0x001F)
    data = b"BM" + struct.pack("<IHHI", 0, 0, 0, 66) + info + masks + struct.pack("<HH", 0xF800, 0x07FF)
    assert media.decode(data).tolist() == [[[255, 0, 0], [0, 255, 255]]]
    plain = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 16, 0, 0, 0, 0, 0, 0) + struct.pack("<HH", 0x7C00, 0x001F)
    assert media.decode(plain).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    old = b"BM" + struct.pack("<IHHI", 0, 0, 0, 32) + struct.pack("<IHHHH", 12, 2, 1, 1, 1) + bytes([0, 0, 0, 10, 20, 30]) + bytes([0b01000000, 0, 0, 0])
    assert media.decode(old).tolist() == [[[0, 0, 0], [30, 20, 10]]]


@pytest.mark.parametrize(("rows", "columns"), [(1, 1), (3, 4), (8, 9), (40, 50)])
def test_area_resize_is_the_mean_of_covered_area(rows, columns):
    a = np.random.default_rng(2).integers(0, 256, (12, 10)).astype(float)
    fine = np.kron(a, np.ones((rows, columns)))  # every cell now has whole samples
    want = fine.reshape(rows, fine.shape[0] // rows, columns, fine.shape[1] // columns).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(a, rows, columns), want)


def test_tiles_and_hashes():
    a = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    assert media.difference_hash(a) == "f" * 16 and media.difference_hash(a[:, ::-1]) == "0" * 16
    tile = np.load(io.BytesIO(media.npy_tile(a)))
    assert tile.shape == (media.TILE, media.TILE) and tile.dtype == np.uint8


def test_stored_texts_come_back(spark):
    texts = [None, "", "a", "x" * 64, "x" * 65, "é漢" * 5000, "\0\n", "x" * 64]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.store(docs).collect()}
    out = {r["doc_id"]: r for r in media.read_back(media.store(docs)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert r["media_format"] == ("bmp" if zlib.crc32(payload) % 2 else "pgm") and stored[i][:2] == (b"BM" if r["media_format"] == "bmp" else b"P5")
        assert media.decode(stored[i]).tobytes() == payload
    assert {r["media_format"] for r in out.values()} == {"bmp", "pgm"}
    assert out[3].asDict() | {"doc_id": 0} == out[7].asDict() | {"doc_id": 0}
    assert out[0].asDict() == out[1].asDict() | {"doc_id": 0}


def test_describe_marks_broken_images(spark):
    good = media.encode_bmp(np.zeros((5, 6, 3), np.uint8))
    images = spark.createDataFrame([(1, good, "w"), (2, None, "w"), (3, b"junk", "w"), (3, b"junk", "w")], "id int, image binary, width string")
    out = {r["id"]: r for r in media.describe(images).collect()}
    assert (out[1]["height"], out[1]["width"], out[1]["media_error"]) == (5, 6, None)
    assert out[2]["media_error"] == "null" and out[3]["tile"] is None and out[3]["media_error"]
    broken = spark.createDataFrame([(i, x) for i, x in enumerate(HUGE)], "id int, image binary")
    assert all(r["height"] is None and r["tile"] is None and r["media_error"] for r in media.describe(broken).collect())
    assert media.describe(images.limit(0)).count() == 0
    assert media.read_back(media.store(spark.createDataFrame([], "doc_id int, text string"))).count() == 0
