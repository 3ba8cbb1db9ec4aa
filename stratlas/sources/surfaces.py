"""Surfaces, surface labels and streamlines: decoders from file bytes to rows."""

from __future__ import annotations

import base64
import gzip
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame

VERTICES = "path string, vid int, x double, y double, z double"
FACES = "path string, fid int, v0 int, v1 int, v2 int"
LABELS = "path string, vid int, label int"
ANNOTATION = "path string, vid int, label int, name string"
TRACKS = "path string, track int, idx int, x double, y double, z double"

_KINDS = {"NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_UINT8": "u1"}


def read_gifti(raw: bytes) -> list[tuple[str, np.ndarray]]:
    """(intent, array) of each data array of a GIfTI file."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    out = []
    for a in ElementTree.fromstring(raw).iter("DataArray"):
        text = (a.findtext("Data") or "").strip()
        shape = [int(a.get(f"Dim{i}")) for i in range(int(a.get("Dimensionality", "1")))]
        kind = ("<" if a.get("Endian", "LittleEndian") == "LittleEndian" else ">") + _KINDS[a.get("DataType")]
        if a.get("Encoding") == "ASCII":
            data = np.array(text.split(), dtype=float).astype(kind)
        else:
            got = base64.b64decode(text)
            data = np.frombuffer(zlib.decompress(got) if a.get("Encoding") == "GZipBase64Binary" else got, kind)
        out.append((a.get("Intent", ""), data.reshape(shape, order="F" if a.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C")))
    return out


def read_annotation(raw: bytes) -> tuple[np.ndarray, list[str]]:
    """Table index of each vertex (-1 for none) and the names of the table, of a surface annotation."""
    n = struct.unpack(">i", raw[:4])[0]
    pairs = np.frombuffer(raw, ">i4", 2 * n, 4).reshape(n, 2)
    at = 4 + 8 * n
    colour = np.zeros(n, np.int64)
    colour[pairs[:, 0]] = pairs[:, 1]
    names, codes = [], []

    def take() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">i", raw[at - 4 : at])[0]

    def text() -> str:
        nonlocal at
        size = take()
        at += size
        return raw[at - size : at].rstrip(b"\0").decode()

    if at < len(raw) and take():
        # A positive number of entries is the older form, without entry numbers; else it is minus the form's version.
        entries = take()
        numbered = entries < 0
        entries = take() if numbered else entries
        text()
        for i in range(take() if numbered else entries):
            slot = take() if numbered else i
            names += [""] * (slot + 1 - len(names))
            codes += [-1] * (slot + 1 - len(codes))
            names[slot] = text()
            r, g, b, _ = take(), take(), take(), take()
            codes[slot] = r + (g << 8) + (b << 16)
    index = {c: i for i, c in enumerate(codes)}
    return np.array([index.get(int(c), -1) for c in colour], np.int32), names


def read_tracks(raw: bytes) -> list[np.ndarray]:
    """Streamlines (points x 3) of a track file of little- or big-endian floats."""
    head = dict(line.split(": ", 1) for line in raw[: raw.index(b"END")].decode(errors="replace").splitlines() if ": " in line)
    kind = {"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}[head["datatype"]]
    data = np.frombuffer(raw, kind, offset=int(head["file"].split()[-1]))
    points = data[: len(data) // 3 * 3].reshape(-1, 3).astype(float)
    ends = np.flatnonzero(~np.isfinite(points).all(1))
    return [t for t in (p[np.isfinite(p).all(1)] for p in np.split(points, ends)) if len(t)]


def _each(decode):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for path, content in zip(f["path"], f["content"], strict=True):
                for part in decode(bytes(content)):
                    yield part.assign(path=path)[["path", *part.columns]]

    return rows


def _arrays(raw: bytes, intent: str):
    return (a for i, a in read_gifti(raw) if i == f"NIFTI_INTENT_{intent}")


def vertices(files: DataFrame) -> DataFrame:
    """Vertex rows of surface files (path, content)."""
    return files.select("path", "content").mapInPandas(_each(lambda raw: (pd.DataFrame({"vid": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]}) for a in _arrays(raw, "POINTSET"))), VERTICES)


def faces(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_each(lambda raw: (pd.DataFrame({"fid": np.arange(len(a)), "v0": a[:, 0], "v1": a[:, 1], "v2": a[:, 2]}) for a in _arrays(raw, "TRIANGLE"))), FACES)


def labels(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_each(lambda raw: (pd.DataFrame({"vid": np.arange(a.size), "label": a.ravel()}) for a in _arrays(raw, "LABEL"))), LABELS)


def annotation(files: DataFrame) -> DataFrame:
    """Vertex labels and names of annotation files; -1 and no name for background."""

    def one(raw: bytes):
        index, names = read_annotation(raw)
        yield pd.DataFrame({"vid": np.arange(len(index)), "label": index, "name": [names[i] if i >= 0 else None for i in index]})

    return files.select("path", "content").mapInPandas(_each(one), ANNOTATION)


def tracks(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_each(lambda raw: (pd.DataFrame({"track": k, "idx": np.arange(len(t)), "x": t[:, 0], "y": t[:, 1], "z": t[:, 2]}) for k, t in enumerate(read_tracks(raw)))), TRACKS)
