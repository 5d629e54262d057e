"""Folders of point clouds as a Spark data source: ``spark.read.format("pointcloud").load(folder)``.

The driver lists files and their sizes and nothing else. Every task gets a range of bytes of one file and reads that file's header
itself: of binary files it takes the records that begin in its range, of text files the lines that do.
With the option ``box`` a LAS file whose header says that no point of it is inside is not read. The box is an option and
not a pushed condition, since a reader keeps pushed conditions for later queries on the same DataFrame, which may have others.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from silvaspark.sources import points as S

TEXT = ("xyz", "txt", "csv", "asc")
SPLIT = 64 << 20
ROWS = 65536
_LINE = re.compile(rb"^[\s,;]*(%b)[\s,;]+(%b)[\s,;]+(%b)(?:[\s,;].*)?$" % ((S.NUMBER.encode(),) * 3), re.S)


def _ext(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all point clouds below a folder."""
    at, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path)
    info = at.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise S.PointFormatError(f"{path}: not found")
    found = [info] if info.is_file else [f for f in at.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and _ext(f.path) in (*TEXT, "pcd", "ply", "las")]
    lead = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted((lead + f.path, f.size) for f in found)


class PointReader(DataSourceReader):
    def __init__(self, options: dict):
        paths = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.paths, self.split = paths, int(options.get("split", SPLIT))
        box = json.loads(options.get("box", "null")) or [[None, None]] * 3
        self.low, self.high = [[e if v is None else float(v) for v in side] for e, side in ((-math.inf, [b[0] for b in box]), (math.inf, [b[1] for b in box]))]

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(size, a + self.split)) for path in self.paths for p, size in _files(path) for a in range(0, max(size, 1), self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path, begin, end = partition.path, partition.begin, partition.end
        if _ext(path) in TEXT:
            yield from _batches(path, _text(path, 0, begin, end, _first_three))
            return
        if _ext(path) == "las" and not self._may_hold(path):
            return
        lay, kind = S.layout(path)
        if kind == "ranges":
            size = lay.dtype.itemsize
            at = lambda b: min(lay.count, max(0, -(-(b - lay.start) // size)))  # noqa: E731 - the first record from byte b on
            for k in range(at(begin), at(end), ROWS):
                xyz = S._records(path, lay, k, min(ROWS, at(end) - k))
                yield _batch(path, np.arange(k, k + len(xyz)), xyz)
        elif kind == "ascii" and not _more_elements(path):
            yield from _batches(path, _text(path, lay.start, begin, end, _columns(lay)))
        elif begin == 0:  # columns one after another, or records that other elements follow
            xyz = S._whole(path, lay, kind)
            for k in range(0, len(xyz), ROWS):
                yield _batch(path, np.arange(k, k + len(xyz[k : k + ROWS])), xyz[k : k + ROWS])

    def _may_hold(self, path: str) -> bool:
        """Whether the box in a LAS header meets the wanted one; a box that makes no sense tells nothing."""
        with S.open_at(path) as f:
            head = f.read(227)
        if len(head) < 227:
            return True
        step, box = struct.unpack_from("<3d", head, 131), struct.unpack_from("<6d", head, 179)
        for k in range(3):
            most, least, slack = box[2 * k], box[2 * k + 1], abs(step[k])
            if math.isfinite(most) and math.isfinite(least) and least <= most and (most + slack < self.low[k] or least - slack > self.high[k]):
                return False
        return True


class PointCloud(DataSource):
    """Options: ``path`` (a file or a folder) or ``files`` (a JSON list of them), ``split`` (bytes of a task's range), ``box`` (JSON
    [[x0, x1], [y0, y1], [z0, z1]], null for no bound; files that are not in it are left out, points are not).

    Rows are (file, pid, x, y, z): ``pid`` is the number of the record in binary files and the byte where the line begins in
    text files. Lines of text clouds without three leading numbers, blank ones aside, have null coordinates; records with
    coordinates that are not finite are given as they are.
    """

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return S.SCHEMA

    def reader(self, schema) -> PointReader:
        return PointReader(dict(self.options))


def _first_three(line: bytes) -> tuple[float, float, float] | None:
    m = _LINE.match(line)
    return tuple(float(x) for x in m.groups()) if m else None


def _columns(lay: S.Layout):
    """Takes x, y, z out of a line of numbers; a field of several numbers is as many columns."""
    wide = [int(np.prod(lay.dtype[n].shape or (1,))) for n in lay.dtype.names]
    at = [sum(wide[: lay.dtype.names.index(c)]) for c in lay.fields]

    def take(line: bytes) -> tuple[float, float, float]:
        w = line.split()
        return tuple(float(w[k]) for k in at)

    return take


def _more_elements(path: str) -> bool:
    """Whether records of a PLY file are followed by other elements, which look like them."""
    if _ext(path) != "ply":
        return False
    with S.open_at(path) as f:
        n = 0
        for raw in iter(f.readline, b""):
            n += raw.startswith(b"element")
            if raw.split() == [b"end_header"]:
                return n > 1
    return True


def _text(path: str, start: int, begin: int, end: int, take) -> Iterator[tuple[int, tuple | None]]:
    """(byte, coordinates) of the lines that begin in [begin, end) and after the header, which ends at ``start``."""
    with S.open_at(path) as f:
        at = max(begin, start)
        if at > start:
            f.seek(at - 1)
            at = at - 1 + len(f.readline())  # the line that runs into the range is the one before's
        else:
            f.seek(at)
        while at < end:
            raw = f.readline()
            if not raw:
                return
            line = raw.strip()
            if line:
                yield at, take(line)
            at += len(raw)


def _batches(path: str, rows: Iterator[tuple[int, tuple | None]]) -> Iterator[pa.RecordBatch]:
    ids, xyz = [], []
    for k, p in rows:
        ids.append(k)
        xyz.append(p or (None, None, None))
        if len(ids) == ROWS:
            yield _from_rows(path, ids, xyz)
            ids, xyz = [], []
    if ids:
        yield _from_rows(path, ids, xyz)


def _from_rows(path: str, ids: list, xyz: list) -> pa.RecordBatch:
    cols = [pa.array(c, pa.float64()) for c in zip(*xyz, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(ids, pa.int64()), *cols], names=["file", "pid", "x", "y", "z"])


def _batch(path: str, ids: np.ndarray, xyz: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(ids.astype(np.int64)), *[pa.array(np.ascontiguousarray(xyz[:, c])) for c in range(3)]], names=["file", "pid", "x", "y", "z"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(PointCloud)


def read_clouds(spark: SparkSession, *paths: str, split: int = SPLIT, box: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, skipped) of files and folders: finite points (inside ``box``, if there is one, bounds included), and the number of
    other lines and records of each file read that has some."""
    register(spark)
    every = spark.read.format("pointcloud").option("files", json.dumps(list(paths))).option("split", str(split)).option("box", json.dumps(box)).load()
    ok, inside = F.lit(True), F.lit(True)
    for c, (low, high) in zip("xyz", box or [(None, None)] * 3, strict=True):
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
        inside = inside & (F.lit(True) if low is None else F.col(c) >= float(low)) & (F.lit(True) if high is None else F.col(c) <= float(high))
    return every.where(ok & inside), every.where(~ok).groupBy("file").agg(F.count("*").alias("n"))
