"""NumPy matrix files as a Spark data source: ``spark.read.format("npy")`` and
``df.write.format("npy")``.

Reading: ``path`` is a ``.npy`` file, an ``.npz`` file (option ``member``), or a
folder of part files. Every file is cut into ranges of rows of at most
``maxPartitionBytes`` bytes, a partition each, which opens the file at its rows
and streams them; only headers are read to plan. Rows come as (row_id, vec), with
row_id counting through the parts in order. A file that is shorter or longer than
its header says, a matrix of another rank, of objects or in column order is an
error before any row is read. A compressed ``.npz`` member cannot be opened in
the middle: it is one partition, streamed from its start.

Writing: every task writes complete ``.npy`` files of at most ``rowsPerFile``
rows; the driver commits them by writing one manifest that lists them in
partition order (so the row order of the frame). A folder is what its manifest
says: files of failed or repeated tasks are not in it and are deleted where that
is possible. Vectors that are null or of different lengths are an error.

Paths may be local or of any store that Arrow's filesystems know (hdfs, s3, gs);
tasks and driver must reach them alike.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_matrix.json"
PARTITION_BYTES = 64 << 20
ROWS_PER_FILE = 100_000
BATCH_BYTES = 4 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


@dataclass
class Matrix:
    """Where the values of a matrix lie in a file."""
    path: str
    offset: int              # of the first value; of nothing for a compressed member
    rows: int
    dim: int
    dtype: str
    member: str | None = None
    packed: bool = False


def _header(f, size: int, path: str) -> tuple[int, int, np.dtype, int]:
    """(rows, dim, type, header bytes) of an array file of ``size`` bytes."""
    start = f.tell()
    try:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
    except (ValueError, EOFError) as e:
        raise ValueError(f"{path}: not a matrix file ({e})") from e
    if len(shape) not in (1, 2) or fortran and len(shape) == 2 and min(shape) > 1:
        raise ValueError(f"{path}: rows of a matrix are wanted, not shape {shape}{' in column order' if fortran else ''}")
    if dtype.kind not in "fiu":
        raise ValueError(f"{path}: values of type {dtype} are not numbers")
    rows, dim = shape[0], shape[1] if len(shape) == 2 else 1
    head = f.tell() - start
    if size != head + rows * dim * dtype.itemsize:
        raise ValueError(f"{path}: {size} bytes, but {head + rows * dim * dtype.itemsize} by its header")
    return rows, dim, dtype, head


def describe(path: str, member: str | None = None) -> list[Matrix]:
    """The matrices under a path, in row order; reads headers only."""
    fs, at = open_fs(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.Directory:
        manifest = f"{at}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())["files"]
        else:
            names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith(".npy"))
        files = [f"{at}/{n}" for n in names]
    else:
        files = [at]
    out = []
    for p in files:
        with fs.open_input_file(p) as f:
            if p.endswith(".npz"):
                out.append(_member(f, p, member))
            else:
                rows, dim, dtype, head = _header(f, f.size(), p)
                out.append(Matrix(p, head, rows, dim, dtype.str))
    if len({(m.dim, m.dtype) for m in out if m.rows}) > 1:
        raise ValueError(f"{path}: parts of different widths or types")
    return out


def _member(f, path: str, member: str | None) -> Matrix:
    with zipfile.ZipFile(f) as z:
        names = [n.removesuffix(".npy") for n in z.namelist()]
        name = member or (names[0] if len(names) == 1 else None)
        if name not in names:
            raise ValueError(f"{path}: choose one of {names} as member")
        entry = z.getinfo(f"{name}.npy")
        with z.open(entry) as inner:
            rows, dim, dtype, head = _header(inner, entry.file_size, f"{path}:{name}")
        if entry.compress_type != zipfile.ZIP_STORED:
            return Matrix(path, 0, rows, dim, dtype.str, name, True)
    f.seek(entry.header_offset + 26)
    lengths = np.frombuffer(f.read(4), "<u2")
    return Matrix(path, entry.header_offset + 30 + int(lengths.sum()) + head, rows, dim, dtype.str, name)


class Rows(InputPartition):
    def __init__(self, matrix: Matrix, first: int, last: int, row_id: int):
        self.matrix, self.first, self.last, self.row_id = matrix, first, last, row_id


def _value_type(dtype: str) -> tuple[str, pa.DataType]:
    d = np.dtype(dtype)
    if d.kind == "f":
        return ("float", pa.float32()) if d.itemsize <= 4 else ("double", pa.float64())
    return "bigint", pa.int64()


class NpyReader(DataSourceReader):
    def __init__(self, path: str, options):
        self.path, self.member = path, options.get("member")
        self.bytes = int(options.get("maxPartitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        out, row_id = [], 0
        for m in describe(self.path, self.member):
            step = m.rows if m.packed else max(1, self.bytes // max(1, m.dim * np.dtype(m.dtype).itemsize))
            out += [Rows(m, i, min(i + step, m.rows), row_id + i) for i in range(0, m.rows, max(1, step))]
            row_id += m.rows
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:                 # no rows, no ranges
            return
        m, dtype = part.matrix, np.dtype(part.matrix.dtype)
        width = m.dim * dtype.itemsize
        _, arrow = _value_type(m.dtype)
        fs, _ = open_fs(self.path)
        with fs.open_input_file(m.path) as raw:
            if m.packed:
                f = zipfile.ZipFile(raw).open(f"{m.member}.npy")
                _header(f, zipfile.ZipFile(raw).getinfo(f"{m.member}.npy").file_size, m.path)
            else:
                f = raw
                f.seek(m.offset + part.first * width)
            step = max(1, BATCH_BYTES // max(1, width))
            for i in range(part.first, part.last, step):
                n = min(step, part.last - i)
                data = f.read(n * width)
                if len(data) != n * width:
                    raise ValueError(f"{m.path}: ends inside row {i + len(data) // max(1, width)}")
                values = np.frombuffer(data, dtype).astype(arrow.to_pandas_dtype())
                row = part.row_id + i - part.first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m.dim, pa.int32()), pa.array(values, arrow))], names=["row_id", "vec"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]            # name, rows, width


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.column = options.get("column", "vec")
        self.rows, self.dtype = int(options.get("rowsPerFile", ROWS_PER_FILE)), np.dtype(options.get("dtype", "<f4"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        task, files, parts, held, dim = TaskContext.get().partitionId(), [], [], 0, None

        def put(m: np.ndarray) -> None:
            name = f"part-{task:05d}-{len(files):05d}-{uuid.uuid4().hex[:12]}.npy"
            out = io.BytesIO()
            np.lib.format.write_array(out, np.ascontiguousarray(m, self.dtype), version=(1, 0))
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(out.getbuffer())
            files.append((name, len(m), m.shape[1]))

        for batch in batches:
            col = batch.column(batch.schema.get_field_index(self.column))
            if not len(col):
                continue
            if col.null_count:
                raise ValueError("a null vector has no row in a matrix")
            size = np.unique(col.value_lengths().to_numpy())
            dim = int(size[0]) if dim is None else dim
            if len(size) > 1 or size[0] != dim:
                raise ValueError(f"vectors of different lengths: {sorted({dim, *size.tolist()})}")
            parts.append(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim))
            held += len(col)
            while held >= self.rows:
                m = np.concatenate(parts)
                put(m[:self.rows])
                parts, held = [m[self.rows:]], held - self.rows
        if held:
            put(np.concatenate(parts))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]        # in partition order
        widths = {w for _, _, w in files}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"vectors of different lengths: {sorted(widths)}")
        fs, at = open_fs(self.path)
        fs.create_dir(at, recursive=True)
        old, mine = [], {n for n, _, _ in files}
        if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File and not self.overwrite:
            with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
                old = json.loads(f.read())["files"]
        with fs.open_output_stream(f"{at}/{MANIFEST}.new") as f:
            f.write(json.dumps({"files": old + [n for n, _, _ in files], "rows": sum(n for _, n, _ in files)}).encode())
        fs.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        for i in fs.get_file_info(pafs.FileSelector(at)):                      # of failed tasks, or overwritten
            if i.base_name.endswith(".npy") and i.base_name not in mine and i.base_name not in old:
                fs.delete_file(i.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = open_fs(self.path)
        for n in (n for m in messages if m is not None for n, _, _ in m.files):
            if fs.get_file_info(f"{at}/{n}").type == pafs.FileType.File:
                fs.delete_file(f"{at}/{n}")


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        m = next((x for x in describe(self.options["path"], self.options.get("member")) if x.rows), None)
        return f"row_id bigint, vec array<{_value_type(m.dtype)[0] if m else 'float'}>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], self.options, overwrite)


def read_matrix(spark: SparkSession, path: str, member: str | None = None, max_partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(row_id, vec) of a matrix file or folder."""
    spark.dataSource.register(NpyDataSource)
    r = spark.read.format("npy").option("maxPartitionBytes", max_partition_bytes)
    return (r.option("member", member) if member else r).load(path)


def write_matrix(df: DataFrame, path: str, vec: str, order: list[str], rows_per_file: int = ROWS_PER_FILE, dtype: str = "<f4") -> None:
    """The vectors of ``df`` as a matrix whose rows follow ``order``."""
    df.sparkSession.dataSource.register(NpyDataSource)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(f"`{vec}`").cast("array<double>").alias("vec"))
    rows.write.format("npy").mode("overwrite").option("rowsPerFile", rows_per_file).option("dtype", dtype).save(path)
