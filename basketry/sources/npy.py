"""Latent matrices in NumPy's ``.npy`` format as a Spark data source (S-3, S-4).

``spark.read.format("npy").option("paths", ...)`` reads two-dimensional
arrays, one file per model: ``(model string, row long, latent array<double>)``,
the model's name being the file's. The header is parsed once, on the driver;
each partition seeks to its own range of rows and reads these alone, so a file
of any size is split. ``df.write.format("npy").mode("append").save(folder)``
writes ``(row, latent)``: tasks leave their rows in a part file each, and the
commit puts the parts of a model together in row order as a stream, so that
NumPy and the study's scripts read the result.

The files lie where driver and executors see them under one path (a shared
mount), as ``.npy`` files must to be opened by NumPy. A part without commit is
deleted when the job is aborted. Values: any real number type, C order; other
headers are an error.
"""

from __future__ import annotations

import ast
import glob
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, \
    WriterCommitMessage

MAGIC = b"\x93NUMPY"          # fixed values of the format: magic string, header alignment
ALIGN = 64
SCHEMA = "model string, row long, latent array<double>"
PARTITION_BYTES = 32 << 20
COPY_BYTES = 8 << 20


@dataclass
class Header:
    dtype: np.dtype
    rows: int
    width: int
    offset: int


def read_header(path: str) -> Header:
    """Type, shape and data offset of a two-dimensional C-order array (one-dimensional: width 1)."""
    with open(path, "rb") as f:
        if f.read(6) != MAGIC:
            raise ValueError(f"{path} is not an .npy file")
        major = f.read(2)[0]
        size, = struct.unpack("<H" if major == 1 else "<I", f.read(2 if major == 1 else 4))
        told = ast.literal_eval(f.read(size).decode("latin1" if major < 3 else "utf-8").strip())
        offset = f.tell()
    shape, dtype = told["shape"], np.dtype(told["descr"])
    if dtype.kind not in "fiu" or len(shape) not in (1, 2) or told["fortran_order"] and len(shape) == 2:
        raise ValueError(f"{path}: only real one- or two-dimensional arrays in C order are read")
    return Header(dtype, shape[0], shape[1] if len(shape) == 2 else 1, offset)


def header_bytes(rows: int, width: int) -> bytes:
    """The header of an array of doubles (format 1.0)."""
    told = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({rows}, {width}), }}"
    pad = -(len(MAGIC) + 4 + len(told) + 1) % ALIGN
    text = (told + " " * pad + "\n").encode("latin1")
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text


@dataclass
class Rows(InputPartition):
    path: str
    model: str
    header: Header
    first: int
    stop: int


class NpyReader(DataSourceReader):
    def __init__(self, options) -> None:
        found = options.get("paths") or options.get("path")
        if not found:
            raise ValueError("name the .npy files by load(path) or option paths (comma-separated, globs allowed)")
        self.files = sorted({f for p in found.split(",") for f in glob.glob(os.path.join(p, "*.npy") if os.path.isdir(p) else p)})
        self.part = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Rows]:
        out = []
        for path in self.files:
            h = read_header(path)
            step = max(1, self.part // max(1, h.width * h.dtype.itemsize))
            name = os.path.basename(path).removesuffix(".npy")
            out += [Rows(path, name, h, lo, min(lo + step, h.rows)) for lo in range(0, h.rows, step)]
        return out or [Rows("", "", Header(np.dtype("<f8"), 0, 1, 0), 0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import pyarrow as pa
        h, at = partition.header, partition.first
        step = max(1, (1 << 20) // max(1, h.width))
        while at < partition.stop:
            n = min(step, partition.stop - at)
            x = np.fromfile(partition.path, h.dtype, n * h.width, offset=h.offset + at * h.width * h.dtype.itemsize)
            if len(x) != n * h.width:
                raise ValueError(f"{partition.path} is shorter than its header says")
            values = pa.array(x.astype("<f8"))
            latent = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width), values)
            yield pa.RecordBatch.from_arrays([pa.array([partition.model] * n, pa.string()),
                                              pa.array(np.arange(at, at + n)), latent], names=["model", "row", "latent"])
            at += n


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int
    width: int
    first: int


class NpyWriter(DataSourceArrowWriter):
    """Rows arrive sorted and range-partitioned by ``row`` (``write_npy``): parts follow one another."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.parts = f"{path}.parts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator) -> Part:
        os.makedirs(self.parts, exist_ok=True)
        part = Part(f"{self.parts}/{uuid.uuid4().hex}", 0, 0, -1)
        with open(part.path, "wb") as f:
            for batch in iterator:
                row, latent = batch.column(batch.schema.get_field_index("row")), batch.column(batch.schema.get_field_index("latent"))
                if not len(row):
                    continue
                widths = {len(v) if v is not None else None for v in latent.to_pylist()}
                if len(widths) != 1 or None in widths or part.width not in (0, *widths):
                    raise ValueError("rows of an array have one width and no nulls")
                ids = row.to_numpy()
                at = part.first + part.rows if part.rows else int(ids[0])
                if (ids != np.arange(at, at + len(ids))).any():
                    raise ValueError("rows are numbered without gaps, in order")
                part.width, part.first = widths.pop(), part.first if part.rows else int(ids[0])
                f.write(latent.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
                part.rows += len(ids)
        return part

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        at = 0
        for m in parts:
            if m.first != at or m.width != parts[0].width:
                self.abort(messages)
                raise ValueError("rows are numbered from 0 without gaps and have one width")
            at += m.rows
        fresh = f"{self.parts}.npy"
        with open(fresh, "wb") as out:
            out.write(header_bytes(at, parts[0].width if parts else 0))
            for m in parts:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out, COPY_BYTES)
        os.replace(fresh, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("npy")`` known to the session."""
    spark.dataSource.register(NpySource)


def read_npy(spark: SparkSession, *paths: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """All rows of several ``.npy`` files (or folders of them), with the file's name as ``model``."""
    register(spark)
    return spark.read.format("npy").option("paths", ",".join(paths)).option("partitionBytes", partition_bytes).load()


def write_npy(latent: DataFrame, path: str, key: str = "user_id", parts: int | None = None) -> None:
    """One model's ``(user_id, latent)`` as one ``.npy`` file, rows by ascending key.

    Row numbers come from a range partitioning: the sizes of the sorted ranges
    (one number a partition) shift each range's own count.
    """
    from ..operators.sequence import row_numbers
    spark = latent.sparkSession
    register(spark)
    numbered = row_numbers(latent.select(key, "latent"), [], [key], "__rn")
    rows = numbered.select((numbered["__rn"] - 1).cast("long").alias("row"), "latent")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "row").sortWithinPartitions("row") \
        .selectExpr("'' AS model", "row", "latent").write.format("npy").mode("append").save(path)
