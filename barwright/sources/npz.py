"""NPZ files as a data source: one reader a file (a fold), one file a writing task, committed together.

Register it once, ``spark.dataSource.register(NpzSource)``, then
``spark.read.format("npz").schema(...).load(folder)`` and
``frame.write.format("npz").mode("append").save(folder)``. The folder is one that all
executors see. Arrays of one length are columns, two-dimensional ones columns of arrays,
single values repeat in every row; the column ``position`` counts a file's rows where a
file has no such array. Files are written aside and moved when all tasks are done; a
failed job leaves nothing behind, and a failed task's file is written anew.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, StructType

ROWS = 8192  # of one batch
#: Numpy types of Spark's.
KINDS = {"int": np.int32, "bigint": np.int64, "smallint": np.int16, "tinyint": np.int8, "double": np.float64, "float": np.float32, "boolean": np.bool_}


def _kind(spark_type) -> type:
    name = (spark_type.elementType if isinstance(spark_type, ArrayType) else spark_type).simpleString()
    if name not in KINDS:
        raise ValueError(f"npz files have no {name} columns")
    return KINDS[name]


@dataclass
class NpzFile(InputPartition):
    path: str


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str) -> None:
        self.schema, self.folder = schema, folder

    def partitions(self) -> list[InputPartition]:
        return [NpzFile(p) for p in sorted(glob.glob(os.path.join(self.folder, "*.npz")))]

    def read(self, partition: NpzFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        if not isinstance(partition, NpzFile):  # no files
            return
        with np.load(partition.path, allow_pickle=False) as held:
            found = {n: held[n] for n in held.files if n in self.schema.names}
        n = max((len(a) for a in found.values() if a.ndim), default=1 if found else 0)
        if bad := [k for k, a in found.items() if a.ndim and len(a) != n]:
            raise ValueError(f"{partition.path}: {bad} have other lengths than {n}")
        for lo in range(0, n, ROWS):
            size, cols = min(ROWS, n - lo), []
            for f in kinds:
                a = found.get(f.name)
                if a is None:
                    cols.append(pa.array(np.arange(lo, lo + size), f.type) if f.name == "position" else pa.nulls(size, f.type))
                elif a.ndim == 2:
                    flat = pa.array(a[lo : lo + size].reshape(-1)).cast(f.type.value_type)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * a.shape[1], pa.int32()), flat).cast(f.type))
                else:
                    cols.append(pa.array(np.full(size, a) if a.ndim == 0 else a[lo : lo + size]).cast(f.type))
            yield pa.RecordBatch.from_arrays(cols, schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    staging: str


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, folder: str, overwrite: bool) -> None:
        self.schema, self.folder, self.overwrite = schema, folder, overwrite
        self.staging = os.path.join(folder, f"_staging-{uuid.uuid4().hex}")
        for f in schema:
            _kind(f.dataType)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None, self.staging)
        table, arrays = pa.Table.from_batches(batches), {}
        for f in self.schema:
            column, kind = table.column(f.name).combine_chunks(), _kind(f.dataType)
            if column.null_count and not np.issubdtype(kind, np.floating):
                raise ValueError(f"{f.name} has nulls, which npz files cannot hold")
            if isinstance(f.dataType, ArrayType):
                sizes = {len(v) for v in column if v.is_valid}
                if len(sizes) != 1 or column.null_count:
                    raise ValueError(f"{f.name} has arrays of several lengths")
                arrays[f.name] = np.array(column.to_pylist(), kind)
            else:
                arrays[f.name] = column.to_numpy(zero_copy_only=False).astype(kind)
        os.makedirs(self.staging, exist_ok=True)
        path = os.path.join(self.staging, f"part-{uuid.uuid4().hex}.npz")  # another attempt has a file of its own
        np.savez_compressed(path, **arrays)
        return Written(path, self.staging)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for old in glob.glob(os.path.join(self.folder, "*.npz")):
                os.remove(old)
        for m in messages:  # files of attempts that did not count stay aside and go
            if m is not None and m.path:
                os.replace(m.path, os.path.join(self.folder, os.path.basename(m.path)))
        self._clear(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(messages)

    def _clear(self, messages: list[WriterCommitMessage | None]) -> None:
        for path in {self.staging, *(m.staging for m in messages if m is not None)}:
            shutil.rmtree(path, ignore_errors=True)


class NpzSource(DataSource):
    """The ``npz`` format."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("give a schema: an npz file's arrays are not known before it is read")

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpzWriter(schema, self.options["path"], overwrite)
