"""Runs of a BIDS directory as a Spark source: NIfTI-1 files, plain or gzipped.

``register(spark)`` makes the format ``bids`` known. Its rows are chunks of a run
(subject, session, space, vb, tb, frames, values): a block of vertices by a block of
frames, as ``operators.chunks`` takes them. With the option ``scan`` set to
``headers`` its rows are the runs' dimensions, and of each file the header alone is
read. A partition is a run file; equality and ``in`` filters on subject, session and space
choose directories and files before any is opened.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from weftline.operators.chunks import FRAMES, VERTICES

# The layout of a NIfTI-1 header and its number formats, and names in a BIDS path.
HEADER, MAGIC = 348, b"n+1\0"
FORMATS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
NAME = re.compile(r"sub-(?P<subject>[^_/]+)(?:_ses-(?P<session>[^_/]+))?_(?:[^/]*_)?space-(?P<space>[^_/]+)(?:_[^/]*)?_bold\.nii(?:\.gz)?$")

CHUNKS = "subject string, session string, space string, vb int, tb int, frames int, values array<double>"
HEADERS = "subject string, session string, space string, path string, vertices long, frames int, repetition_time double"
#: Bytes of a run that a task holds at once, besides a single longer frame.
HELD = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Run(InputPartition):
    path: str
    subject: str
    session: str | None
    space: str


@dataclass(frozen=True)
class Header:
    vertices: int
    frames: int
    repetition_time: float
    dtype: np.dtype
    offset: int
    slope: float
    intercept: float

    @classmethod
    def parse(cls, raw: bytes, path: str) -> Header:
        order = "<" if raw[:4] == struct.pack("<i", HEADER) else ">"
        if len(raw) < HEADER or struct.unpack(f"{order}i", raw[:4])[0] != HEADER or raw[344:348] != MAGIC:
            raise ValueError(f"{path} is no NIfTI-1 file")
        dim = struct.unpack(f"{order}8h", raw[40:56])
        code = struct.unpack(f"{order}h", raw[70:72])[0]
        if code not in FORMATS:
            raise ValueError(f"{path} has numbers of the unknown format {code}")
        sizes = [max(1, x) for x in dim[1 : 1 + dim[0]]] + [1] * 7
        offset, slope, intercept = struct.unpack(f"{order}3f", raw[108:120])
        return cls(sizes[0] * sizes[1] * sizes[2], sizes[3], struct.unpack(f"{order}f", raw[92:96])[0], np.dtype(order + FORMATS[code]), int(offset), slope, intercept)

    def pack(self) -> bytes:
        out = bytearray(max(HEADER + 4, self.offset))
        # a run of vertices is laid out in the first three dimensions, none of which may exceed 16 bits
        width = next((w for w in range(min(self.vertices, 32767), 0, -1) if self.vertices % w == 0), 1)
        if self.vertices // width > 32767:
            raise ValueError(f"{self.vertices} vertices have no place in a NIfTI-1 header")
        struct.pack_into("<i", out, 0, HEADER)
        struct.pack_into("<8h", out, 40, 4, width, self.vertices // width, 1, self.frames, 1, 1, 1)
        code = next(c for c, f in FORMATS.items() if np.dtype("<" + f) == self.dtype)
        struct.pack_into("<2h", out, 70, code, 8 * self.dtype.itemsize)
        struct.pack_into("<8f", out, 76, 1, 1, 1, 1, self.repetition_time, 1, 1, 1)
        struct.pack_into("<3f", out, 108, self.offset, self.slope, self.intercept)
        out[344:348] = MAGIC
        return bytes(out)


class _Stream:
    """The bytes of a file in turn, unzipped if it is zipped; no more is read than asked for, but for a buffer."""

    def __init__(self, path: str, buffer: int):
        files, at = opened(path)
        self.file, self.buffer, self.rest = files.open_input_stream(at, compression=None), buffer, b""
        self.unzip = zlib.decompressobj(31) if path.endswith(".gz") else None

    def read(self, n: int) -> bytes:
        held, size = [self.rest], len(self.rest)
        while size < n and (raw := self.file.read(self.buffer)):
            held.append(self.unzip.decompress(raw) if self.unzip else raw)
            size += len(held[-1])
        whole = b"".join(held)
        self.rest = whole[n:]
        return whole[:n]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.headers = options["path"].rstrip("/"), options.get("scan") == "headers"
        self.vertices, self.frames = int(options.get("vertices", VERTICES)), int(options.get("frames", FRAMES))
        self.only: dict[str, set[str]] = {}
        if options.get("space"):
            self.only["space"] = {options["space"]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in ("subject", "session", "space"):
                yield f
            else:
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values

    def _may(self, key: str, value: str | None) -> bool:
        return key not in self.only or value in self.only[key]

    def partitions(self) -> Sequence[Run]:
        files, top = opened(self.path)
        scheme = self.path[: -len(top)] if self.path.endswith(top) else ""
        found = []

        def walk(folder: str) -> None:
            for info in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
                kind, _, label = info.base_name.partition("-")
                if info.type == fs.FileType.Directory:
                    if self._may({"sub": "subject", "ses": "session"}.get(kind, ""), label):
                        walk(info.path)
                elif (m := NAME.search(info.path)) and all(self._may(k, v) for k, v in m.groupdict().items()):
                    found.append(Run(scheme + info.path, **m.groupdict()))

        walk(top)
        return found

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # no file is left
            return
        stream = _Stream(run.path, 512 if self.headers else 1 << 20)
        head = Header.parse(stream.read(HEADER), run.path)
        own = [run.subject, run.session, run.space]
        if self.headers:
            yield pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in HEADERS.split(", ")), [*own, run.path, head.vertices, head.frames, head.repetition_time]))], pa.schema([*((c, pa.string()) for c in ("subject", "session", "space", "path")), ("vertices", pa.int64()), ("frames", pa.int32()), ("repetition_time", pa.float64())]))
            return
        stream.read(head.offset - HEADER)
        frame = head.vertices * head.dtype.itemsize
        for tb, first in enumerate(range(0, head.frames, self.frames)):
            n, parts = min(self.frames, head.frames - first), []
            step = max(1, HELD // frame)
            block = np.empty((n, head.vertices), np.float64 if head.dtype.itemsize > 4 else np.float32)
            for at in range(0, n, step):
                some = min(step, n - at)
                raw = stream.read(some * frame)
                if len(raw) < some * frame:
                    raise ValueError(f"{run.path} ends before its last frame")
                block[at : at + some] = np.frombuffer(raw, head.dtype).reshape(some, head.vertices)
            if head.slope and (head.slope, head.intercept) != (1, 0):
                block = block * head.slope + head.intercept
            for vb, v in enumerate(range(0, head.vertices, self.vertices)):
                parts = np.ascontiguousarray(block[:, v : v + self.vertices].T, np.float64).ravel()
                values = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), pa.array(parts))
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string()) for x in own), *(pa.array([x], pa.int32()) for x in (vb, tb, n)), values], names=[f.split()[0] for f in CHUNKS.split(", ")])


class BidsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bids"

    def schema(self) -> str:
        return HEADERS if self.options.get("scan") == "headers" else CHUNKS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BidsSource)


def read_runs(spark: SparkSession, path: str, space: str | None = None, vertices: int = VERTICES, frames: int = FRAMES) -> DataFrame:
    """Chunks of all runs, or of those in one space; filters on subject, session and space skip files."""
    register(spark)
    reader = spark.read.format("bids").option("vertices", vertices).option("frames", frames)
    return (reader.option("space", space) if space else reader).load(path)


def scan_runs(spark: SparkSession, path: str) -> DataFrame:
    """(subject, session, space, path, vertices, frames, repetition_time) of all runs, from their headers."""
    register(spark)
    return spark.read.format("bids").option("scan", "headers").load(path)


def write_runs(bold: DataFrame, path: str, space: str, vertices: int, frames: int, repetition_time: float = 1.0) -> DataFrame:
    """Write (subject, session, vertex, t, value) as a gzipped run per session, 64-bit, NaN where a value is missing; returns (subject, session, path).

    A run is written by one task, a frame at a time, under a passing name; it is there whole or not at all.
    """
    head = Header(vertices, frames, repetition_time, np.dtype("<f8"), HEADER + 4, 1.0, 0.0)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        subject, session = key
        files, top = opened(path.rstrip("/"))
        folder = f"{top}/sub-{subject}/ses-{session}/func"
        name = f"{folder}/sub-{subject}_ses-{session}_task-rest_space-{space}_bold.nii.gz"
        files.create_dir(folder, recursive=True)
        data = np.full((frames, vertices), np.nan)
        data[rows["t"], rows["vertex"]] = rows["value"]
        zipped, passing = zlib.compressobj(6, zlib.DEFLATED, 31), f"{folder}/.{uuid.uuid4().hex}"
        with files.open_output_stream(passing, compression=None) as out:
            out.write(zipped.compress(head.pack()))
            for frame in data:
                out.write(zipped.compress(frame.tobytes()))
            out.write(zipped.flush())
        files.move(passing, name)
        return pd.DataFrame({"subject": [str(subject)], "session": [str(session)], "path": [name]})

    return bold.groupBy("subject", "session").applyInPandas(one, "subject string, session string, path string")
