"""Writing many files at once, from the executors, once per content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.text import hash_suffix, sanitize_filename


def safe_name(files: DataFrame, filename: str = "filename", sha: str = "sha256") -> DataFrame:
    """``files`` with ``name``: safe, and with the whole hash of the content in it, so that no two contents share a name."""
    name = sanitize_filename(F.col(filename), "attachment")
    return files.withColumn("name", F.concat(F.col(sha), F.lit("-"), hash_suffix(name, F.lit(""))))


def write_files(files: DataFrame, folder: str, name: str = "name", data: str = "data") -> DataFrame:
    """Write the bytes of each row under its name into ``folder``, which all executors share; returns the rows with ``saved_path`` in place of the bytes.

    A file is written beside its place and then moved there, so that a task that is lost or runs twice leaves whole files
    only; writing the same name again puts the same content there. Rows without bytes are left out. The result writes when it
    is used: use it once, by writing the ledger.
    """
    kept = [c for c in files.columns if c not in (data, "saved_path")]
    schema = T.StructType([files.schema[c] for c in kept] + [T.StructField("saved_path", T.StringType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            paths = []
            for n, body in zip(b.column(name).to_pylist(), b.column(data).to_pylist()):
                beside = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(body)
                store.move(beside, f"{root}/{n}")
                paths.append(f"{folder}/{n}")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(paths, pa.string())], names=[*kept, "saved_path"])

    return files.filter(F.col(data).isNotNull() & F.col(name).isNotNull()).select(*kept, data).mapInArrow(write, schema)
