"""Frames of uncompressed video files (YUV4MPEG2) as rows, read in ranges."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of frames in a partition, about.
PART = 64 << 20
MAGIC = b"YUV4MPEG2"
# How many samples both colour planes have for each of the luma plane, by the header's name of the layout.
CHROMA = {"420": 0.5, "420jpeg": 0.5, "420mpeg2": 0.5, "420paldv": 0.5, "422": 1.0, "444": 2.0, "mono": 0.0}
#: Frames have this before them, and nothing else where all are of one size.
FRAME = b"FRAME\n"


@dataclass(frozen=True)
class Layout:
    """What a file's header tells: where its frames begin, their size and rate."""

    width: int
    height: int
    rate: float
    begin: int
    luma: int
    chroma: int

    @property
    def stride(self) -> int:
        return len(FRAME) + self.luma + self.chroma


def layout(path: str) -> Layout:
    """The layout of a file by its first line; ValueError for another format."""
    with open(path, "rb") as f:
        head = f.readline(4096)
    words = head.decode("ascii", "replace").split()
    if not words or words[0].encode() != MAGIC or not head.endswith(b"\n"):
        raise ValueError(f"{path}: no uncompressed video")
    told = {w[0]: w[1:] for w in words[1:]}
    try:
        width, height = int(told["W"]), int(told["H"])
        over, under = (told.get("F") or "25:1").split(":")
        share = CHROMA[told.get("C", "420")]
        rate = int(over) / int(under)
    except (KeyError, ValueError, ZeroDivisionError) as e:
        raise ValueError(f"{path}: a header without size, rate or a known layout") from e
    if share == 0.5:
        chroma = 2 * -(-width // 2) * -(-height // 2)
    else:
        chroma = 2 * -(-width // 2) * height if share == 1.0 else int(share * width * height)
    return Layout(width, height, rate, len(head), width * height, chroma)


@dataclass
class Range(InputPartition):
    """Frames ``first`` to ``end`` of a file."""

    path: str
    first: int
    end: int


class RawVideo(DataSource):
    """Option ``path``: a file or a folder of ``.y4m`` files that all tasks can open. Option ``partbytes``: bytes of a partition. Options ``first`` and ``end``:
    frames from ``first`` on and before ``end`` only. A frame that a file's end cuts off isn't one."""

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return "video string, frame long, seconds double, width int, height int, luma binary, chroma binary"

    def reader(self, schema) -> RawVideoReader:
        return RawVideoReader(self.options)


class RawVideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("partbytes", PART))
        self.first, self.end = int(options.get("first", 0)), int(options.get("end", 1 << 62))

    def partitions(self) -> list[Range]:
        files = sorted(Path(self.path).glob("*.y4m")) if os.path.isdir(self.path) else [Path(self.path)]
        out = []
        for file in files:
            shape = layout(str(file))
            n = (file.stat().st_size - shape.begin) // shape.stride
            step = max(1, self.part // shape.stride)
            first, end = max(0, self.first), min(n, self.end)
            out += [Range(str(file), at, min(end, at + step)) for at in range(first, end, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.first >= part.end:
            return
        shape, video = layout(part.path), Path(part.path).stem
        with open(part.path, "rb") as f:
            f.seek(shape.begin + part.first * shape.stride)
            for frame in range(part.first, part.end):
                if f.read(len(FRAME)) != FRAME:
                    raise ValueError(f"{part.path}: frame {frame} has parameters of its own or isn't where it should be")
                yield video, frame, frame / shape.rate, shape.width, shape.height, f.read(shape.luma), f.read(shape.chroma)


def frames(spark: SparkSession, path: str, first: int = 0, end: int | None = None, part_bytes: int = PART) -> DataFrame:
    """Frames ``first`` to ``end`` of the files of ``path``; only their bytes are read.

    The range is an option of the reader. Spark 4.1 can push filters to readers in Python, but then keeps what they left for all
    uses of one DataFrame, the unfiltered ones too; so they aren't taken here."""
    spark.dataSource.register(RawVideo)
    reader = spark.read.format("rawvideo").option("partbytes", part_bytes).option("first", first)
    return (reader if end is None else reader.option("end", end)).load(path)
