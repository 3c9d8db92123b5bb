"""Matrices of numpy (.npy) as a Spark data source, read in ranges of rows and written in parts.

Files are opened by pyarrow's file systems, so a path may be local, shared or in a
store that pyarrow knows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows of a partition, and rows that a task writes to one file.
ROWS = 65_536
#: Bytes of a file that hold its header at least.
HEAD = 4096
#: What a finished write leaves: the names of its files, in order.
LISTED = "_files.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(raw: bytes) -> tuple[tuple[int, int], np.dtype, int]:
    """(shape, type, place of the first row) of a matrix, from a file's first bytes."""
    stream = io.BytesIO(raw)
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if len(shape) != 2 or fortran or kind.hasobject:
        raise ValueError(f"not a matrix of numbers by rows: {shape}, by columns: {fortran}, {kind}")
    return shape, kind, stream.tell()


def normalised(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays as it is."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


class Range(InputPartition):
    def __init__(self, path: str, first: int, low: int, high: int):
        self.path, self.first, self.low, self.high = path, first, low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, scaled: bool):
        self.path, self.rows, self.scaled = path, rows, scaled

    def partitions(self) -> list[Range]:
        store, path = _opened(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            names = [path]
        elif store.get_file_info(f"{path}/{LISTED}").type == fs.FileType.File:
            names = [f"{path}/{x}" for x in json.loads(store.open_input_stream(f"{path}/{LISTED}").read())]
        else:
            found = store.get_file_info(fs.FileSelector(path))
            names = sorted(f.path for f in found if f.path.endswith(".npy"))
        out, first = [], 0
        for name in names:
            with store.open_input_file(name) as file:
                (n, _), _, _ = header(file.read(HEAD))
            out += [Range(name, first, low, min(n, low + self.rows)) for low in range(0, n, self.rows)]
            first += n
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        with store.open_input_file(partition.path) as file:
            (_, width), kind, start = header(file.read(HEAD))
            file.seek(start + partition.low * width * kind.itemsize)
            raw = file.read((partition.high - partition.low) * width * kind.itemsize)
        x = np.frombuffer(raw, kind).reshape(-1, width).astype(np.float64)
        x = (normalised(x) if self.scaled else x).astype(np.float32)
        at = pa.array(np.arange(len(x), dtype=np.int64) + partition.first + partition.low)
        ends = pa.array(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)) if width else pa.array(np.zeros(len(x) + 1, np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["row", "vector"])


class Written(WriterCommitMessage):
    def __init__(self, part: int, names: list[str]):
        self.part, self.names = part, names


class _Writer(DataSourceArrowWriter):
    """Parts in the order of the partitions. A write counts once its list of files stands; parts of tasks that failed aren't in it."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part, store, path = TaskContext.get().partitionId(), *_opened(self.path)
        store.create_dir(path, recursive=True)
        names, held = [], []

        def save(x: np.ndarray) -> None:
            names.append(f"part-{part:06d}-{len(names):06d}-{uuid.uuid4().hex}.npy")
            body = io.BytesIO()
            np.save(body, x)
            with store.open_output_stream(f"{path}/{names[-1]}") as file:
                file.write(body.getvalue())

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            if batch.num_rows:
                held.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1))
            if sum(map(len, held)) >= self.rows:
                save(np.concatenate(held))
                held = []
        if held:
            save(np.concatenate(held))
        return Written(part, names)

    def commit(self, messages: list[Written]) -> None:
        store, path = _opened(self.path)
        store.create_dir(path, recursive=True)
        names = [n for m in sorted((m for m in messages if m), key=lambda m: m.part) for n in m.names]
        with store.open_output_stream(f"{path}/{LISTED}") as file:
            file.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{path}/{name}")


class Matrix(DataSource):
    """format("npy_matrix"): (row, vector) of a .npy file, a folder of them, or what this format has written.

    Rows are numbered from 0 through all files, in the order of their names or of the
    write. Options: path, rows (of a partition, or of a file that is written), and
    scaled (true: vectors have length 1, and rows of zeros stay zeros). Writing takes
    the column vector, whose vectors have one length and no nulls.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rows", ROWS)), self.options.get("scaled", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("rows", ROWS)))
