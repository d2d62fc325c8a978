"""The study's result files: a Spark sink with commit and abort, for CSV, JSON lines and MATLAB files of level 5.

``register(spark)`` makes the format ``study`` known; ``table.write.format("study")
.option("form", "mat").mode("overwrite").save(path)`` writes a file per task. Tasks write under
passing names, which the commit on the driver turns into final ones; a task that fails leaves
nothing, and a write that is aborted leaves what was there before. No rows pass through the driver.
"""

from __future__ import annotations

import csv
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from weftline.sources.nifti import opened

FORMS = ("csv", "json", "mat")
#: Rows of one MATLAB file, whose variables are columns and so are held whole; a task with more writes several.
MAT_ROWS = 1_000_000

# The level 5 format's data types, array classes and header.
MI_INT8, MI_INT32, MI_UINT32, MI_DOUBLE, MI_MATRIX, MI_COMPRESSED, MI_UTF8, MI_UINT16 = 1, 5, 6, 9, 14, 15, 16, 4
MX_CELL, MX_CHAR, MX_DOUBLE = 1, 4, 6
MAT_TEXT = b"MATLAB 5.0 MAT-file, written by weftline"


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(name: str, kind: int, shape: tuple[int, int], body: bytes) -> bytes:
    return _element(MI_MATRIX, _element(MI_UINT32, struct.pack("<II", kind, 0)) + _element(MI_INT32, struct.pack("<ii", *shape)) + _element(MI_INT8, name.encode("ascii")) + body)


def mat_bytes(columns: dict[str, list]) -> bytes:
    """A MATLAB file with a variable for each column: numbers as a column of doubles (null as NaN), texts as a cell array (null as an empty one)."""
    out = [MAT_TEXT.ljust(116), b"\0" * 8, struct.pack("<H", 0x0100), b"IM"]
    for name, values in columns.items():
        shape = (len(values), 1)
        if any(isinstance(v, str) for v in values):
            text = ["" if v is None else str(v) for v in values]
            codes = [np.frombuffer(t.encode("utf-16-le"), np.uint16) for t in text]
            body = b"".join(_matrix("", MX_CHAR, (min(1, len(c)), len(c)), _element(MI_UINT16, c.tobytes())) for c in codes)
            out.append(_matrix(name, MX_CELL, shape, body))
        else:
            out.append(_matrix(name, MX_DOUBLE, shape, _element(MI_DOUBLE, np.array([np.nan if v is None else float(v) for v in values]).tobytes())))
    return b"".join(out)


def _elements(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(raw):
        kind, n = struct.unpack_from("<II", raw, at)
        if kind >> 16:  # a small element, in its tag
            kind, n, at = kind & 0xFFFF, kind >> 16, at - 4
            yield kind, raw[at + 8 : at + 8 + n]
            at += 12
            continue
        data = raw[at + 8 : at + 8 + n]
        at += 8 + n + (0 if kind == MI_COMPRESSED else -n % 8)
        yield from _elements(zlib.decompress(data)) if kind == MI_COMPRESSED else [(kind, data)]


def _value(raw: bytes) -> tuple[str, list | str]:
    parts = list(_elements(raw))
    kind = struct.unpack("<I", parts[0][1][:4])[0] & 0xFF
    name = parts[2][1].decode("ascii")
    if kind == MX_CELL:
        return name, [_value(data)[1] for _, data in parts[3:]]
    if kind == MX_CHAR:
        return name, parts[3][1].decode("utf-8" if parts[3][0] == MI_UTF8 else "utf-16-le") if len(parts) > 3 else ""
    dtype = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}[parts[3][0]]
    return name, np.frombuffer(parts[3][1], dtype).astype(float).tolist()


def parse_mat(raw: bytes) -> dict[str, list]:
    """The columns of a level 5 file of numeric columns and cell arrays of texts."""
    if raw[126:128] != b"IM":
        raise ValueError("not a MATLAB file of level 5 in little-endian order")
    return dict(_value(data) for kind, data in _elements(raw[128:]) if kind == MI_MATRIX)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.form, self.names, self.overwrite = options["path"].rstrip("/"), options.get("form", "csv"), schema.names, overwrite
        if self.form not in FORMS:
            raise ValueError(f"form must be one of {FORMS}")
        self.job = uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        files, top = opened(self.path)
        return files, top, f"{top}/_passing-{self.job}"

    def write(self, rows: Iterator[Row]) -> Part:
        files, _, passing = self._places()
        partition, made = TaskContext.get().partitionId(), []

        def new():
            name = f"{passing}/{partition}-{len(made)}-{uuid.uuid4().hex}"
            made.append(name)
            return files.open_output_stream(name, compression=None)

        try:
            files.create_dir(passing, recursive=True)
            if self.form == "mat":
                held: list[tuple] = []
                for row in rows:
                    held.append(tuple(row))
                    if len(held) == MAT_ROWS:
                        self._mat(new, held)
                        held = []
                if held:
                    self._mat(new, held)
            else:
                out = None
                for row in rows:
                    if out is None:
                        out = new()
                        if self.form == "csv":
                            out.write(self._line(self.names))
                    out.write(self._line(tuple(row)) if self.form == "csv" else (json.dumps(dict(zip(self.names, tuple(row))), default=str) + "\n").encode())
                if out is not None:
                    out.close()
        except BaseException:
            for name in made:
                if files.get_file_info(name).type != fs.FileType.NotFound:
                    files.delete_file(name)
            raise
        return Part(partition, made)

    def _mat(self, new, rows: list[tuple]) -> None:
        with new() as out:
            out.write(mat_bytes({n: [r[k] for r in rows] for k, n in enumerate(self.names)}))

    @staticmethod
    def _line(values) -> bytes:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(["" if v is None else v for v in values])
        return out.getvalue().encode()

    def commit(self, messages: list[Part | None]) -> None:
        files, top, passing = self._places()
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if info.is_file and info.base_name.startswith("part-"):
                    files.delete_file(info.path)
        files.create_dir(top, recursive=True)
        for part in messages:
            for k, name in enumerate(part.files if part else ()):
                files.move(name, f"{top}/part-{part.partition:05d}-{k:03d}-{self.job}.{self.form}")
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, _, passing = self._places()
        if files.get_file_info(passing).type == fs.FileType.Directory:
            files.delete_dir(passing)


class StudySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "study"

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StudySink)


def write_results(table: DataFrame, path: str, form: str) -> None:
    """Write a table as files of one form, in place of earlier ones there."""
    register(table.sparkSession)
    table.write.format("study").option("form", form).mode("overwrite").save(path)


def read_mat(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of MATLAB files, each read by one task; the columns of ``schema`` by name."""
    wanted = T._parse_datatype_string(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                found = pd.DataFrame({n: parse_mat(raw)[n] for n in wanted.names})
                for f in wanted:
                    if isinstance(f.dataType, T.IntegralType):
                        found[f.name] = found[f.name].astype("Int64")
                yield found

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path).select("content").mapInPandas(run, wanted)
