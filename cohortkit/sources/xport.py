"""SAS transport (version 5) files as a Spark data source, read in parallel.

A file is a header, a list of 140-byte variable descriptions, and fixed-length rows up
to the end.  Fixed lengths make it splittable: the driver reads the header only, each
task decodes its own range of rows into Arrow batches.

    spark.dataSource.register(XportSource)
    spark.read.format("xport").option("columns", "A,B").load("data/2017.xpt")

Options: ``columns`` (names to read, others are never decoded), ``split_bytes`` (bytes
per task), ``encoding`` of text.  Executors need this package (``--py-files``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Fixed values of the file format.
RECORD = 80
LIBRARY = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!"
MEMBER = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!"
NAMESTR = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!"
OBSERVATIONS = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"
NUMERIC = 1
MISSING_MARKS = np.frombuffer(b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ", dtype=np.uint8)

BATCH_ROWS = 65_536


@dataclass(frozen=True)
class Variable:
    name: str
    numeric: bool
    offset: int
    length: int


@dataclass(frozen=True)
class Layout:
    variables: tuple[Variable, ...]
    start: int  # byte of the first row
    row_bytes: int
    rows: int


# Names that Hadoop gives to stores which pyarrow knows under another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _filesystem(path: str) -> tuple[FileSystem, str]:
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def exists(path: str) -> bool:
    fs, inner = _filesystem(path)
    return fs.get_file_info(inner).type == FileType.File


def _number(raw: bytes, start: int, length: int) -> int:
    return int.from_bytes(raw[start : start + length], "big")


def read_layout(path: str) -> Layout:
    """Where the rows are and what is in them, from the header alone."""
    fs, inner = _filesystem(path)
    size = fs.get_file_info(inner).size
    with fs.open_input_file(inner) as f:
        name_bytes, count = 140, 0
        if not f.read(RECORD).startswith(LIBRARY):
            raise ValueError(f"not a SAS transport file: {path}")
        while record := f.read(RECORD):
            if record.startswith(MEMBER):
                name_bytes = int(record[74:78])
            elif record.startswith(NAMESTR):
                count = int(record[54:58])
                break
        if not count:
            raise ValueError(f"not a SAS transport file: {path}")
        names = f.read(-(-count * name_bytes // RECORD) * RECORD)
        if not f.read(RECORD).startswith(OBSERVATIONS):
            raise ValueError(f"no observations found: {path}")
        start = f.tell()
        variables = []
        for i in range(count):
            raw = names[i * name_bytes : (i + 1) * name_bytes]
            variables.append(
                Variable(
                    name=raw[8:16].decode("ascii").strip(),
                    numeric=_number(raw, 0, 2) == NUMERIC,
                    offset=_number(raw, 84, 4),
                    length=_number(raw, 4, 2),
                )
            )
        row_bytes = max(v.offset + v.length for v in variables)
        rows = (size - start) // row_bytes
        # Blanks fill the last record; short rows may fit into the filling.
        tail = min(rows, (RECORD - 1) // row_bytes)
        f.seek(start + (rows - tail) * row_bytes)
        for last in reversed([f.read(row_bytes) for _ in range(tail)]):
            if last.strip(b" "):
                break
            rows -= 1
    return Layout(tuple(variables), start, row_bytes, rows)


def decode_numbers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, is missing) of big-endian base-16 floats, one per row of bytes.

    Such a float is a sign bit, a 7-bit power of 16 (offset 64) and a 56-bit fraction;
    shortened numbers leave out low-order fraction bytes.  A missing value is a mark
    followed by zero bytes.
    """
    whole = np.zeros((len(raw), 8), dtype=np.uint8)
    whole[:, : raw.shape[1]] = raw
    bits = whole.view(">u8")[:, 0].astype(np.uint64)
    fraction = bits & np.uint64((1 << 56) - 1)
    head = whole[:, 0]
    power = 4 * ((head & 0x7F).astype(np.int64) - 64) - 56
    values = np.ldexp(fraction.astype(np.float64), power)
    values = np.where(head & 0x80, -values, values)
    missing = (fraction == 0) & np.isin(head, MISSING_MARKS)
    return values, missing


def decode(
    raw: bytes, layout: Layout, columns: Sequence[Variable], encoding: str
) -> pa.RecordBatch:
    table = np.frombuffer(raw, dtype=np.uint8).reshape(-1, layout.row_bytes)
    arrays = []
    for v in columns:
        cells = np.ascontiguousarray(table[:, v.offset : v.offset + v.length])
        if v.numeric:
            values, missing = decode_numbers(cells)
            arrays.append(pa.array(values, mask=missing))
        else:
            texts = cells.view(f"S{v.length}")[:, 0]
            arrays.append(pa.array([t.decode(encoding).rstrip(" ") for t in texts], pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=[v.name for v in columns])


@dataclass
class Rows(InputPartition):
    first: int
    count: int


class XportReader(DataSourceReader):
    def __init__(self, path: str, names: Sequence[str], split_bytes: int, encoding: str):
        self.path = path
        self.encoding = encoding
        self.layout = read_layout(path)
        by_name = {v.name: v for v in self.layout.variables}
        self.columns = [by_name[n] for n in names]
        self.per_split = max(1, split_bytes // self.layout.row_bytes)

    def partitions(self) -> list[Rows]:
        total, step = self.layout.rows, self.per_split
        return [Rows(at, min(step, total - at)) for at in range(0, max(total, 1), step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, inner = _filesystem(self.path)
        width = self.layout.row_bytes
        with fs.open_input_file(inner) as f:
            f.seek(self.layout.start + partition.first * width)
            left = partition.count
            while left:
                rows = min(left, BATCH_ROWS)
                raw = f.read(rows * width)
                if MEMBER in raw:
                    raise ValueError(f"more than one member in the transport file: {self.path}")
                yield decode(raw, self.layout, self.columns, self.encoding)
                left -= rows


class XportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xport"

    def schema(self) -> StructType:
        variables = read_layout(self.options["path"]).variables
        if "columns" in self.options:
            wanted = {c.strip() for c in self.options["columns"].split(",")}
            variables = [v for v in variables if v.name in wanted]
        return StructType(
            [StructField(v.name, DoubleType() if v.numeric else StringType()) for v in variables]
        )

    def reader(self, schema: StructType) -> XportReader:
        return XportReader(
            self.options["path"],
            schema.names,
            int(self.options.get("split_bytes", 64 << 20)),
            self.options.get("encoding", "latin1"),
        )
