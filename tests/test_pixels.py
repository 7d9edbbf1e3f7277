from __future__ import annotations

import colorsys

import numpy as np
import pytest

from shotweave.functions import pixels

W, H = 40, 36


def picture(seed):
    return np.random.default_rng(seed).integers(0, 256, (H, W, 3), dtype=np.uint8)


def test_frames_of_files(spark, tmp_path):
    (tmp_path / "a.rgb").write_bytes(picture(0).tobytes() + picture(1).tobytes() + b"rest")
    (tmp_path / "b.rgb").write_bytes(b"short")
    rows = pixels.split_frames(spark.read.format("binaryFile").load(str(tmp_path)), W, H).orderBy("frame").collect()
    assert [bytes(r.data) for r in rows] == [picture(0).tobytes(), picture(1).tobytes()]


def test_frame_stats(spark):
    flat = np.full((H, W, 3), 128, np.uint8)
    df = spark.createDataFrame([(0, bytearray(picture(0).tobytes())), (1, bytearray(flat.tobytes())), (2, None), (3, bytearray(b"x"))], "frame long, data binary")
    got = {r.frame: r for r in pixels.frame_stats(df, W, H, ["frame"]).collect()}
    assert got[1].sharpness == pytest.approx(0, abs=1e-12) and got[1].brightness == pytest.approx(128 / 255)
    assert got[0].sharpness > 100 and sum(got[0].color) == pytest.approx(1)
    assert (got[2].phash, got[2].brightness, got[3].color) == (None, 0.5, None)
    want = np.zeros((8, 4, 4))
    for r, g, b in picture(0).reshape(-1, 3) / 255:
        h, s, v = colorsys.rgb_to_hsv(r, g, b)
        want[min(7, int(h * 8)), min(3, int(s * 4)), min(3, int(v * 4))] += 1
    assert got[0].color == pytest.approx((want / W / H).ravel().tolist(), abs=3 / W / H)


def test_hash_is_stable_under_light():
    a = pixels.grey(picture(3))
    near, far = pixels.perceptual_hash(a * 0.9 + 5), pixels.perceptual_hash(pixels.grey(picture(4)))
    own = pixels.perceptual_hash(a)
    assert ((own ^ near) & (1 << 64) - 1).bit_count() <= 2 < 10 < ((own ^ far) & (1 << 64) - 1).bit_count()


def test_small_parts():
    assert pixels.area_weights(6, 3).tolist() == [[0.5, 0.5, 0, 0, 0, 0], [0, 0, 0.5, 0.5, 0, 0], [0, 0, 0, 0, 0.5, 0.5]]
    assert pixels.area_weights(5, 2).sum(1) == pytest.approx([1, 1])
    c = pixels.cosines(8)
    assert c @ c.T == pytest.approx(np.eye(8), abs=1e-12)


def test_structural_similarity(spark):
    rows = [(0, bytearray(picture(0).tobytes()), bytearray(picture(0).tobytes())), (1, bytearray(picture(0).tobytes()), bytearray(picture(1).tobytes()))]
    got = {r.pair: r.ssim for r in pixels.frame_similarity(spark.createDataFrame(rows, "pair long, a binary, b binary"), W, H, ["pair"]).collect()}
    assert got[0] == pytest.approx(1) and got[1] < 0.2
