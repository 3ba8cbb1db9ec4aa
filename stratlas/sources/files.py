"""Files by extension: tables, archives, images and arrays, read where they lie by Spark's readers.

Binary payloads are decoded in tasks from ``binaryFile`` rows; nothing is opened
by path outside Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOXELS = "path string, x int, y int, z int, t int, value double"


def search(spark: SparkSession, folder: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """(path, name, length) of files below a folder, by suffix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def in_folder(files: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    return files.filter(F.col("name").startswith(prefix) & F.col("name").endswith(suffix))


def binary(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path).select("path", "content")


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        for path, content in zip(f["path"], f["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield pd.DataFrame({"archive": [path], "path": [info.filename], "content": [z.read(info)]})


def members(archives: DataFrame, suffix: str = "") -> DataFrame:
    """(archive, path, content) of the files in zip archives."""
    return archives.select("path", "content").mapInPandas(_unzip, "archive string, path string, content binary").filter(F.col("path").endswith(suffix))


def only_member(archives: DataFrame, suffix: str) -> DataFrame:
    """The one file of each archive with a suffix; an error where there is none or more."""
    found = members(archives, suffix).groupBy("archive").agg(F.count("*").alias("n"), F.first("path").alias("path"), F.first("content").alias("content"))
    found = archives.select(F.col("path").alias("archive")).join(found, "archive", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    checked = F.when(F.col("n") == 1, F.col("content")).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(f" files end with {suffix} in "), F.col("archive"))))
    return found.select("archive", "path", checked.alias("content"))


def read_nifti(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Array and 4x4 affine of a NIfTI-1 file, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    shape = struct.unpack(order + "8h", raw[40:56])
    kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}[struct.unpack(order + "h", raw[70:72])[0]]
    offset, slope, shift = (struct.unpack(order + "f", raw[a : a + 4])[0] for a in (108, 112, 116))
    dims = shape[1 : 1 + shape[0]]
    data = np.frombuffer(raw, np.dtype(order + kind), int(np.prod(dims)), int(offset)).reshape(dims, order="F")
    if slope not in (0.0, 1.0) or shift:
        data = data * (slope or 1.0) + shift
    if struct.unpack(order + "h", raw[254:256])[0] > 0:
        affine = np.vstack([np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4), [0, 0, 0, 1]])
    else:
        affine = np.diag([*struct.unpack(order + "8f", raw[76:108])[1:4], 1.0])
    return data, affine


def write_nifti(data: np.ndarray, affine: np.ndarray) -> bytes:
    """A NIfTI-1 file of an array of doubles."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<hh", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0), *[1] * 4)
    struct.pack_into("<fff", head, 108, 352, 1, 0)
    struct.pack_into("<h", head, 254, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(data, "<f8").tobytes(order="F")


def _nonzero(decode):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for path, content in zip(f["path"], f["content"], strict=True):
                data = decode(content)
                data = data.reshape(data.shape + (1,) * (4 - data.ndim))
                for t in range(data.shape[3]):
                    at = np.nonzero(data[..., t])
                    yield pd.DataFrame({"path": path, "x": at[0], "y": at[1], "z": at[2], "t": t, "value": data[..., t][at].astype(float)})

    return rows


def voxels(images: DataFrame) -> DataFrame:
    """Nonzero voxels of NIfTI files (path, content)."""
    return images.select("path", "content").mapInPandas(_nonzero(lambda raw: read_nifti(raw)[0]), VOXELS)


def array_voxels(arrays: DataFrame) -> DataFrame:
    """Nonzero elements of numpy array files."""
    return arrays.select("path", "content").mapInPandas(_nonzero(lambda raw: np.load(io.BytesIO(raw), allow_pickle=False)), VOXELS)


def reader_of(path: str):
    """How a file is read, by extension; a ``.gz`` at the end is looked through."""
    bare = path.lower().removesuffix(".gz")
    kinds = {".csv": table, ".tsv": tsv, ".txt": spaced, ".json": lambda s, p: s.read.option("multiLine", True).json(p), ".parquet": lambda s, p: s.read.parquet(p), ".nii": lambda s, p: voxels(binary(s, p)), ".npy": lambda s, p: array_voxels(binary(s, p)), ".zip": lambda s, p: members(binary(s, p))}
    for suffix, reader in kinds.items():
        if bare.endswith(suffix):
            return reader
    raise ValueError(f"no reader for {path}")


def table(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(header=True, inferSchema=True, **options).csv(path)


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated; rows without any value are dropped."""
    return table(spark, path, sep="\t").na.drop("all")


def spaced(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(sep=" ", inferSchema=True).csv(path)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell segmentations: a header after two extra characters, then numbers between spaces; layer and label are integers."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).filter(F.trim("value") != "")
    head = lines.filter(F.col("value").startswith("#") | ~F.substring(F.trim("value"), 1, 1).rlike(r"[-\d.]"))
    names = F.filter(F.split(F.substr(F.col("value"), F.lit(3)), " +"), lambda w: w != "")
    heads = head.select("path", names.alias("names"))
    data = lines.join(head.select("path", "value"), ["path", "value"], "left_anti").select("path", F.split(F.trim("value"), " +").alias("v"))
    at = lambda name: F.try_element_at("v", F.array_position("names", F.lit(name)).cast("int")).cast("double")
    return data.join(heads, "path").select("path", at("x").alias("x"), at("y").alias("y"), at("layer").cast("int").alias("layer"), at("label").cast("int").alias("label"))


def affines(images: DataFrame) -> DataFrame:
    """(path, affine) of NIfTI files, the matrix row by row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"path": f["path"], "affine": [read_nifti(raw)[1].astype(float).ravel() for raw in f["content"]]})

    return images.select("path", "content").mapInPandas(rows, "path string, affine array<double>")


def sqlite(databases: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of one table of SQLite files (path, content), columns by the schema's names; a file is read in one task, a few rows at a time."""
    columns = [f.split()[0] for f in schema.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for raw in f["content"]:
                with contextlib.closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(raw)
                    cursor = db.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f' FROM "{name}"')
                    while some := cursor.fetchmany(10_000):
                        yield pd.DataFrame(some, columns=columns)

    return databases.select("content").mapInPandas(rows, schema)


def files_of(spark: SparkSession, spec: dict) -> DataFrame:
    """(path, content) of the files that a repository's spec names: a folder, or the members of an archive."""
    kind = spec["@type"].rsplit("/", 1)[-1]
    if kind == "localfolder":
        return binary(spark, spec["folder"])
    if kind == "zippedfile":
        return members(binary(spark, spec["url"])).select("path", "content")
    raise ValueError(f"no connector for {spec['@type']}")


def read_sparse(spark: SparkSession, base: str) -> DataFrame:
    """Voxels of a sparse map stored as ``volume`` rows of x, y, z, value, one folder per map."""
    return spark.read.parquet(base)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines (id, value) of text files, numbered from 0 through all files by path, whatever splits they are read in.

    A split's lines have rising ids, so each is the lines of the splits before it
    (by file and offset; one row a split) and its place in its own.
    """
    m = F.col("_metadata")
    row = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("start"), row.alias("row"))
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(splits), ["file", "start"]).select((F.col("row") + F.col("shift")).alias("id"), "value")


def sparse_text(spark: SparkSession, probs: str, coords: DataFrame) -> DataFrame:
    """Voxels from lines of ``volume prob volume prob ...`` (one line per coordinate id) and (id, x, y, z) rows."""
    lines = numbered(spark, probs).select("id", F.split(F.trim("value"), " +").alias("v"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda i: F.struct(F.get("v", 2 * i).cast("int").alias("volume"), F.get("v", 2 * i + 1).cast("double").alias("value"))))
    return lines.filter(F.size("v") > 1).withColumn("p", pair).select("id", "p.volume", "p.value").join(coords, "id").drop("id")
