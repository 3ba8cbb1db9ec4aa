"""Where results go: tables, partitioned elements, voxel stores, and archives that a person opens."""

from __future__ import annotations

import io
import zipfile

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlas.operators.voxels import with_blocks

#: Rows of a table that go into one archive member; larger tables are written as folders.
ARCHIVE_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_matrix(conn: DataFrame, path: str, regions: list[str]) -> None:
    """A connectivity matrix as a square table."""
    write_csv(conn.groupBy("src").pivot("dst", regions).agg(F.first("value")).orderBy("src"), path)


def write_elements(df: DataFrame, element: str, path: str) -> None:
    """One folder per element of a compound."""
    df.repartition(element).write.mode("overwrite").option("header", True).partitionBy(element).csv(path)


def write_voxels(voxels: DataFrame, path: str) -> None:
    """A voxel store partitioned by map and block, so a box reads only its blocks."""
    with_blocks(voxels).repartition("map_id", "bx", "by", "bz").sortWithinPartitions("x", "y", "z").write.mode("overwrite").partitionBy("map_id", "bx", "by", "bz").parquet(path)


def archive(name: str, readme: str, tables: dict[str, DataFrame]) -> bytes:
    """A zip with a README and each table as CSV; refuses tables of more than ``ARCHIVE_ROWS`` rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("README.md", f"# {name}\n\n{readme}\n")
        for title, df in tables.items():
            rows: pd.DataFrame = df.limit(ARCHIVE_ROWS + 1).toPandas()
            if len(rows) > ARCHIVE_ROWS:
                raise ValueError(f"{title} has more than {ARCHIVE_ROWS} rows; write it as a folder")
            z.writestr(f"{title}.csv", rows.to_csv(index=False))
    return out.getvalue()
