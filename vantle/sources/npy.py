"""A data source for .npy matrices: rows of (row_index, embedding), read in ranges of rows by seeking, and written in place.

Writing makes a folder of embeddings.npy, completed.npy (which rows are there) and, with a column scale, scales.npy. Tasks
write their rows at the rows' places in files that nobody sees yet; the commit adds headers and renames the folder.
Repeated attempts write the same bytes to the same places, and an aborted write leaves nothing.
"""

from __future__ import annotations

import ast
import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS = 65_536
#: Bytes before a written matrix's first value.
HEADER = 128


def header(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and place of the first value."""
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"{path} is no .npy file")
        major, _ = f.read(2)
        size = struct.unpack("<H" if major == 1 else "<I", f.read(2 if major == 1 else 4))[0]
        found = ast.literal_eval(f.read(size).decode("latin1"))
        if found["fortran_order"] or len(found["shape"]) != 2:
            raise ValueError(f"{path} is no matrix in row order")
        return np.dtype(found["descr"]), found["shape"], f.tell()


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        n = header(self.path)[1][0]
        return [_Range(at, min(n, at + ROWS)) for at in range(0, n, ROWS)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        kind, (_, width), start = header(self.path)
        with open(self.path, "rb") as f:
            for at in range(partition.first, partition.last, 4096):
                end = min(partition.last, at + 4096)
                f.seek(start + at * width * kind.itemsize)
                values = np.frombuffer(f.read((end - at) * width * kind.itemsize), dtype=kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1, dtype=np.int32) * width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, end)), vectors], names=["row_index", "embedding"])


def header_of(kind: str, shape: tuple[int, ...]) -> bytes:
    """The first bytes of a matrix file, filled to HEADER."""
    text = repr({"descr": np.dtype(kind).str, "fortran_order": False, "shape": shape}).encode()
    size = HEADER - 10
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", size) + text.ljust(size - 1) + b"\n"


class _Writer(DataSourceArrowWriter):
    """Rows (row_index, embedding and, if there is one, scale) of a matrix of so many rows."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.target = os.path.abspath(options["path"].removeprefix("file://"))
        self.rows, self.width, self.kind = int(options["rows"]), int(options["width"]), options.get("dtype", "float32")
        self.overwrite, self.draft = overwrite, f"{self.target}.{uuid.uuid4().hex}"
        if os.path.exists(self.target) and not (overwrite and os.path.isfile(f"{self.target}/embeddings.npy")):
            raise FileExistsError(f"{self.target} exists")
        self.files = {"embeddings": (self.kind, (self.rows, self.width)), "completed": ("bool", (self.rows,))}
        if "scale" in names:
            self.files["scales"] = ("float32", (self.rows,))

    def _put(self, name: str, rows: np.ndarray, values: np.ndarray) -> None:
        """Values of ascending rows at their places, neighbouring rows at once."""
        values = np.ascontiguousarray(values, self.files[name][0])
        size = values.nbytes // max(1, len(rows))
        cuts = np.flatnonzero(np.diff(rows) != 1) + 1
        file = os.open(f"{self.draft}/{name}.npy", os.O_WRONLY | os.O_CREAT)
        try:
            for at, part in zip(np.concatenate(([0], cuts)), np.split(values, cuts)):
                data, place = memoryview(part.tobytes()), HEADER + int(rows[at]) * size
                while data:
                    done = os.pwrite(file, data, place)
                    data, place = data[done:], place + done
        finally:
            os.close(file)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.draft, exist_ok=True)
        for batch in iterator:
            batch = batch.filter(batch.column("embedding").is_valid()).sort_by("row_index")
            if not batch.num_rows:
                continue
            rows, vectors = batch.column("row_index").to_numpy(), batch.column("embedding")
            if rows[0] < 0 or rows[-1] >= self.rows or (vectors.value_lengths().to_numpy() != self.width).any():
                raise ValueError(f"rows aren't of a matrix of {self.rows} x {self.width}")
            self._put("embeddings", rows, vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width))
            self._put("completed", rows, np.ones(len(rows), bool))
            if "scales" in self.files:
                self._put("scales", rows, batch.column("scale").to_numpy(zero_copy_only=False))
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.draft, exist_ok=True)
        for name, (kind, shape) in self.files.items():
            with open(f"{self.draft}/{name}.npy", "r+b" if os.path.exists(f"{self.draft}/{name}.npy") else "w+b") as f:
                f.write(header_of(kind, shape))
                f.truncate(HEADER + int(np.prod(shape)) * np.dtype(kind).itemsize)
                f.flush()
                os.fsync(f.fileno())
        old = f"{self.draft}-old"
        if os.path.exists(self.target):
            if not self.overwrite:
                raise FileExistsError(f"{self.target} exists")
            os.rename(self.target, old)
        os.rename(self.draft, self.target)
        shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.draft, ignore_errors=True)


class NpyDataSource(DataSource):
    """spark.read.format("npy").load(path) of a matrix file, df.write.format("npy").option("rows", n).option("width", d)
    .option("dtype", kind).save(folder); the path must be open to every executor."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_index long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)
