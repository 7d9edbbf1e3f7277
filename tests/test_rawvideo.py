"""Frames of uncompressed files against the bytes that were written."""

from __future__ import annotations

import random

import pytest

from shotweave.sources import rawvideo


def written(path, width, height, n, chroma="420jpeg", seed=0):
    rng = random.Random(seed)
    sizes = {"420jpeg": 2 * ((width + 1) // 2) * ((height + 1) // 2), "444": 2 * width * height, "mono": 0, "422": 2 * ((width + 1) // 2) * height}
    frames = [(rng.randbytes(width * height), rng.randbytes(sizes[chroma])) for _ in range(n)]
    path.write_bytes(f"YUV4MPEG2 W{width} H{height} F30000:1001 Ip A1:1 C{chroma}\n".encode() + b"".join(b"FRAME\n" + a + b for a, b in frames))
    return frames


def test_frames_are_rows_in_ranges(spark, tmp_path):
    want = {}
    for name, width, height, n, chroma in (("a", 7, 5, 23, "420jpeg"), ("b", 4, 4, 9, "mono"), ("c", 3, 2, 5, "444"), ("d", 5, 2, 3, "422"), ("none", 2, 2, 0, "mono")):
        for k, (luma, rest) in enumerate(written(tmp_path / f"{name}.y4m", width, height, n, chroma)):
            want[name, k] = (round(k * 1001 / 30000, 9), width, height, luma, rest)
    (tmp_path / "d.y4m").write_bytes((tmp_path / "d.y4m").read_bytes() + b"FRAME\ncut off")
    (tmp_path / "other.txt").write_text("not a video")
    df = rawvideo.frames(spark, str(tmp_path), part_bytes=200)
    assert df.rdd.getNumPartitions() > 8
    assert {(r.video, r.frame): (round(r.seconds, 9), r.width, r.height, bytes(r.luma), bytes(r.chroma)) for r in df.collect()} == want
    assert sorted((r.video, r.frame) for r in df.where("frame >= 3 AND frame < 7 AND video <> 'b'").select("video", "frame").collect()) == sorted(k for k in want if 3 <= k[1] < 7 and k[0] != "b")
    assert df.where("frame IN (2, 8)").count() == sum(k[1] in (2, 8) for k in want) and df.where("frame = 100").count() == 0


def test_only_the_frames_asked_for_are_touched(spark, tmp_path):
    frames = written(tmp_path / "v.y4m", 16, 8, 60)
    raw = bytearray((tmp_path / "v.y4m").read_bytes())
    shape = rawvideo.layout(str(tmp_path / "v.y4m"))
    for k in [*range(10), *range(21, 60)]:  # whoever reads these frames fails
        at = shape.begin + k * shape.stride
        raw[at : at + 6] = b"BROKEN"
    (tmp_path / "v.y4m").write_bytes(bytes(raw))
    some = rawvideo.frames(spark, str(tmp_path / "v.y4m"), 10, 21, 3 * shape.stride)
    assert some.rdd.getNumPartitions() == 4
    assert {r.frame: bytes(r.luma) for r in some.collect()} == {k: frames[k][0] for k in range(10, 21)}
    df = rawvideo.frames(spark, str(tmp_path / "v.y4m"))
    with pytest.raises(Exception, match="isn't where it should be"):
        df.collect()


def test_other_files_are_refused(tmp_path):
    for text in (b"RIFF....", b"", b"YUV4MPEG2 W3 F25:1\n", b"YUV4MPEG2 W3 H2 F25:0\n", b"YUV4MPEG2 W3 H2 Cxyz\n", b"YUV4MPEG2 W3 H2"):
        (tmp_path / "x.y4m").write_bytes(text)
        with pytest.raises(ValueError):
            rawvideo.layout(str(tmp_path / "x.y4m"))
