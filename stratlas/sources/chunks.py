"""Chunked volumes: folders of raw chunks at several scales, described by one ``info`` file.

A chunk's name says which box of voxels it holds (``x0-x1_y0-y1_z0-z1``), so a box
of interest is cut from the list of files before any content is read, and chunks
that aren't there are background.  Each chunk is decoded in a task of its own.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
Box = tuple[tuple[int, int, int], tuple[int, int, int]]
_NAME = r"^(\d+)-(\d+)_(\d+)-(\d+)_(\d+)-(\d+)"


@dataclass(frozen=True)
class Scale:
    key: str
    #: Nanometres of a voxel's sides.
    resolution: tuple[float, float, float]
    size: tuple[int, int, int]
    data_type: str
    encoding: str

    @property
    def bytes(self) -> int:
        return int(np.prod(self.size)) * np.dtype(self.data_type).itemsize


def read_info(spark: SparkSession, folder: str) -> list[Scale]:
    """The scales of a volume, the finest first; the file is one small JSON object."""
    info = json.loads(spark.read.text(f"{folder}/info", wholetext=True).first()[0])
    return [Scale(s["key"], tuple(s["resolution"]), tuple(s["size"]), info["data_type"], s["encoding"]) for s in info["scales"]]


def select_scale(scales: list[Scale], resolution_mm: float | None = None, max_bytes: int = 200 << 20) -> Scale:
    """The coarsest scale that resolves the wish (the finest without one), or the next coarser one that fits into ``max_bytes``."""
    wished = 0
    if resolution_mm is not None and resolution_mm >= 0:
        fine = [i for i, s in enumerate(scales) if all(r / 1e6 <= resolution_mm for r in s.resolution)]
        if not fine:
            raise ValueError(f"no scale resolves {resolution_mm} mm")
        wished = max(fine)
    fits = [s for s in scales[wished:] if s.bytes <= max_bytes]
    if not fits:
        raise ValueError(f"no scale fits into {max_bytes} bytes")
    return fits[0]


def _decoder(kind: str, box: Box | None):
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for low, shape, raw in zip(f["low"], f["shape"], f["content"], strict=True):
                if raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                data = np.frombuffer(raw, np.dtype(kind).newbyteorder("<"), int(np.prod(shape))).reshape(tuple(shape), order="F")
                at = np.array(np.nonzero(data))
                values, at = data[tuple(at)].astype(float), at + np.array(low)[:, None]
                if box:
                    inside = ((at >= np.array(box[0])[:, None]) & (at < np.array(box[1])[:, None])).all(0)
                    values, at = values[inside], at[:, inside]
                yield pd.DataFrame({**dict(zip(XYZ, at, strict=True)), "value": values})

    return decode


def read_voxels(spark: SparkSession, folder: str, scale: Scale, box: Box | None = None) -> DataFrame:
    """Nonzero voxels (x, y, z, value) of a scale within a box (low <= place < high); only chunks that meet the box are opened."""
    if scale.encoding != "raw":
        raise ValueError(f"chunks are {scale.encoding}; raw ones are read")
    name = F.col("_metadata.file_name")
    number = lambda i: F.regexp_extract(name, _NAME, i).cast("int")
    files = spark.read.format("binaryFile").load(f"{folder}/{scale.key}").filter(name.rlike(_NAME))
    for i, (low, high) in enumerate(zip(*box, strict=True) if box else ()):
        files = files.filter((number(2 * i + 1) < high) & (number(2 * i + 2) > low))
    low = F.array(*[number(2 * i + 1) for i in range(3)])
    shape = F.array(*[number(2 * i + 2) - number(2 * i + 1) for i in range(3)])
    return files.select(low.alias("low"), shape.alias("shape"), "content").mapInPandas(_decoder(scale.data_type, box), "x int, y int, z int, value double")
