"""Parquet by Arrow on the driver, for appends and tails of a few facts.

A Spark job costs more than such a file takes to write or read. Stores that Arrow can't
open, and larger batches, go through Spark.
"""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq

_TEXTS = pa.map_(pa.string(), pa.string())
SCHEMA = pa.schema([
    ("batch_id", pa.string()), ("ordinal", pa.int64()), ("fact_id", pa.string()), ("type", pa.string()), ("subject", pa.string()),
    ("payload", pa.struct([("data", pa.binary()), ("format", pa.string()), ("schema_ref", pa.string())])), ("metadata", _TEXTS), ("tags", _TEXTS),
])


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path)
    return pafs.FileSystem.from_uri(path)


def can_open(path: str) -> bool:
    try:
        open_path(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The Parquet files in a folder."""
    fs, root = open_path(path)
    return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))


def write_batch(path: str, rows: list[dict]) -> None:
    fs, root = open_path(path)
    fs.create_dir(root, recursive=True)
    pq.write_table(pa.Table.from_pylist(rows, SCHEMA), f"{root}/part-00000.parquet", filesystem=fs)


def read_batch(path: str, columns: list[str]) -> list[dict]:
    fs, found = files(path)
    return [r for f in found for r in pq.read_table(f, filesystem=fs, columns=columns).to_pylist(maps_as_pydicts="lossy")]


def sorted_table(path: str) -> ds.Dataset:
    """A written table whose row groups a look-up of its sort key can skip."""
    fs, found = files(path)
    return ds.dataset(found, filesystem=fs, format="parquet")


def holds(table: ds.Dataset, column: str, value: str) -> bool:
    return table.head(1, filter=pc.field(column) == value, columns=[column]).num_rows > 0
