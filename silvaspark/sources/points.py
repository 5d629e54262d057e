"""Point-cloud readers: ASCII, PCD, PLY and LAS as DataFrames of (file, pid, x, y, z).

ASCII files are read by Spark's text source. Binary files are split into record ranges: the
header is parsed once per file and every range is a row of a small table, so one large file is
read by many tasks. Files are opened through pyarrow, which knows local and remote file systems.
"""

from __future__ import annotations

import io
import math
import os
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = 1 << 20
SCHEMA = "file string, pid long, x double, y double, z double"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: Least record length of LAS point formats 0 to 10, and the formats a minor version may hold.
LAS_LENGTH = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
LAS_FORMATS = {0: 1, 1: 1, 2: 3, 3: 5, 4: 10}


class PointFormatError(ValueError):
    """A file that is not what its name says, with the reason."""


def open_at(path: str):
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        at, name = fs.FileSystem.from_uri(path)
    else:
        at, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    return io.BufferedReader(at.open_input_file(name))


@dataclass
class Layout:
    """Fixed-size records: numpy dtype, first byte, count, scale and offset of x, y, z."""

    dtype: np.dtype
    start: int
    count: int
    fields: tuple[str, str, str]
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)


def read_ascii(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, skipped): the first three numbers of each line.

    Separators are space, tab, comma and semicolon. Blank lines do not count; comments (# or /),
    lines without three leading finite numbers are counted in ``skipped(file, n)``. ``pid`` is a hash of the row, the
    same whenever and in whatever splits the file is read; equal rows share it.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    sep = r"[\s,;]+"
    parts = [F.regexp_extract("line", rf"^[\s,;]*({NUMBER}){sep}({NUMBER}){sep}({NUMBER})(?:[\s,;].*)?$", k).alias(c) for k, c in enumerate("xyz", 1)]
    got = t.select("file", *parts).select("file", *[F.expr(f"try_cast({c} as double)").alias(c) for c in "xyz"])
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & (F.abs(F.coalesce(F.col(c), F.lit(0.0))) < float("inf"))
    points = got.where(ok).select("file", F.xxhash64("file", "x", "y", "z").alias("pid"), "x", "y", "z")
    return points, got.where(~ok).groupBy("file").agg(F.count("*").alias("n"))


def pcd_layout(f, path: str = "") -> tuple[Layout, str]:
    head: dict[str, list[str]] = {}
    while "DATA" not in head:
        line = f.readline()
        if not line:
            raise PointFormatError(f"{path}: no DATA line")
        words = line.decode("ascii", "replace").split()
        if words and not words[0].startswith("#"):
            head[words[0].upper()] = words[1:]
    try:
        names, sizes, types = head["FIELDS"], [int(x) for x in head["SIZE"]], head["TYPE"]
        counts = [int(x) for x in head.get("COUNT", ["1"] * len(names))]
        n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
        dtype = np.dtype([(f"{name}#{k}" if name in names[:k] else name, PCD_TYPES[t, s], (c,)) if c > 1 else (f"{name}#{k}" if name in names[:k] else name, PCD_TYPES[t, s]) for k, (name, s, t, c) in enumerate(zip(names, sizes, types, counts, strict=True))])
    except (KeyError, ValueError) as e:
        raise PointFormatError(f"{path}: broken header ({e})") from e
    if not {"x", "y", "z"} <= set(names):
        raise PointFormatError(f"{path}: fields x, y, z are missing")
    return Layout(dtype, f.tell(), n, ("x", "y", "z")), head["DATA"][0].lower()


def lzf_decompress(data: bytes, size: int) -> bytes:
    """LZF: literal runs, and copies of earlier output that may overlap themselves."""
    out = bytearray()
    at = 0
    while at < len(data):
        c = data[at]
        at += 1
        if c < 32:
            out += data[at : at + c + 1]
            at += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[at]
            at += 1
        back = len(out) - ((c & 31) << 8 | data[at]) - 1
        at += 1
        if back < 0:
            raise PointFormatError("broken compressed data")
        n += 2
        piece = out[back : back + n]
        # a copy that overlaps its own output repeats what there is
        out += piece if len(piece) == n else (piece * (n // len(piece) + 1))[:n]
    if len(out) != size:
        raise PointFormatError("compressed data of another length")
    return bytes(out)


def ply_layout(f, path: str = "") -> tuple[Layout, str]:
    if f.readline().strip() != b"ply":
        raise PointFormatError(f"{path}: not a PLY file")
    kind, count, props, inside = "", -1, [], False
    while True:
        raw = f.readline()
        if not raw:
            raise PointFormatError(f"{path}: no end of header")
        w = raw.decode("ascii", "replace").split()
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            if w[1] == "vertex":
                inside, count = True, int(w[2])
            else:
                if count < 0:
                    raise PointFormatError(f"{path}: elements before the vertices")
                inside = False
        elif w[0] == "property" and inside:
            if w[1] == "list" or w[1] not in PLY_TYPES:
                raise PointFormatError(f"{path}: property {' '.join(w[1:])}")
            props.append((w[2], PLY_TYPES[w[1]]))
        elif w[0] == "end_header":
            break
    if count < 0 or not {"x", "y", "z"} <= {p for p, _ in props}:
        raise PointFormatError(f"{path}: vertices with x, y, z are missing")
    order = ">" if kind == "binary_big_endian" else "<"
    return Layout(np.dtype([(p, order + t) for p, t in props]), f.tell(), count, ("x", "y", "z")), kind


def las_layout(f, path: str = "") -> Layout:
    """Checks every field of the header that reading depends on."""
    bad = lambda why: PointFormatError(f"{path}: {why}")
    f.seek(0, os.SEEK_END)
    total = f.tell()
    f.seek(0)
    h = f.read(375)
    if len(h) < 227 or h[:4] != b"LASF":
        raise bad("no LAS signature")
    major, minor = h[24], h[25]
    if major != 1 or minor not in LAS_FORMATS:
        raise bad(f"version {major}.{minor} is not supported")
    head, start = struct.unpack_from("<HI", h, 94)
    if head < (375 if minor == 4 else 235 if minor == 3 else 227) or start < head:
        raise bad("header size")
    fmt, length, legacy = h[104], *struct.unpack_from("<HI", h, 105)
    if fmt & 0xC0:
        raise bad("points are compressed (LAZ); decompress the file first")
    if fmt > LAS_FORMATS[minor]:
        raise bad(f"point format {fmt} does not exist in version 1.{minor}")
    if length < LAS_LENGTH[fmt]:
        raise bad(f"record length {length} is too small for format {fmt}")
    count = legacy
    if minor == 4:
        (wide,) = struct.unpack_from("<Q", h, 247)
        if legacy and legacy != wide:
            raise bad("the two point counts differ")
        count = wide
    scale, offset = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    if not all(math.isfinite(x) for x in (*scale, *offset)) or not all(scale):
        raise bad("scale or offset")
    if start + count * length > total:
        raise bad(f"cut off: {count} points need {start + count * length} bytes, there are {total}")
    dtype = np.dtype({"names": ["X", "Y", "Z"], "formats": ["<i4"] * 3, "offsets": [0, 4, 8], "itemsize": length})
    return Layout(dtype, start, count, ("X", "Y", "Z"), scale, offset)


def _records(path: str, lay: Layout, first: int, n: int) -> np.ndarray:
    with open_at(path) as f:
        f.seek(lay.start + first * lay.dtype.itemsize)
        raw = f.read(n * lay.dtype.itemsize)
    if len(raw) < n * lay.dtype.itemsize:
        raise PointFormatError(f"{path}: cut off")
    a = np.frombuffer(raw, lay.dtype, n)
    return np.stack([a[c].astype(np.float64) * s + o for c, s, o in zip(lay.fields, lay.scale, lay.offset, strict=True)], axis=1)


def _text_records(raw: bytes, lay: Layout) -> np.ndarray:
    at = [lay.dtype.names.index(c) for c in lay.fields]
    rows = np.loadtxt(io.BytesIO(raw), ndmin=2, max_rows=lay.count, usecols=at) if lay.count else np.zeros((0, 3))
    return rows.astype(np.float64)


def layout(path: str) -> tuple[Layout, str]:
    """Layout and storage (ranges, ascii, compressed) of a PCD, PLY or LAS file."""
    ext = path.rsplit(".", 1)[-1].lower()
    with open_at(path) as f:
        if ext == "las":
            return las_layout(f, path), "ranges"
        lay, kind = (pcd_layout if ext == "pcd" else ply_layout)(f, path)
    if kind in ("binary", "binary_little_endian", "binary_big_endian"):
        return lay, "ranges"
    if kind == "ascii":
        return lay, "ascii"
    if kind == "binary_compressed":
        return lay, "compressed"
    raise PointFormatError(f"{path}: storage {kind!r}")


def _whole(path: str, lay: Layout, kind: str) -> np.ndarray:
    with open_at(path) as f:
        f.seek(lay.start)
        raw = f.read()
    if kind == "ascii":
        return _text_records(raw, lay)
    packed, size = struct.unpack_from("<II", raw)
    data = lzf_decompress(raw[8 : 8 + packed], size)
    # columns one after another
    out, at = {}, 0
    for name in lay.dtype.names:
        t = lay.dtype[name]
        if name in lay.fields:
            out[name] = np.frombuffer(data, t.base, lay.count, at).astype(np.float64)
        at += t.itemsize * lay.count
    return np.stack([out[c] for c in lay.fields], axis=1)


def read_binary(spark: SparkSession, paths: list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points, skipped) of PCD, PLY and LAS files; points with non-finite coordinates are skipped. A PLY file whose
    points are not as many as its header says is cut off, which is an error; with ``strict`` off text files give the
    points that there are.

    Every range of ``RECORDS`` records is a task; formats without fixed records are one task a file.
    """
    ranges = []
    for p in paths:
        lay, kind = layout(p)
        if kind == "ranges":
            ranges += [(p, k, min(RECORDS, lay.count - k)) for k in range(0, lay.count, RECORDS)]
        elif lay.count:
            ranges.append((p, 0, lay.count))
    if not ranges and paths:
        raise PointFormatError("no points in " + ", ".join(paths))
    plan = spark.createDataFrame(ranges, "file string, first long, n long").repartition(max(1, len(ranges)), "file", "first")

    def read(batches):
        for b in batches:
            for path, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lay, kind = layout(path)
                xyz = _records(path, lay, first, n) if kind == "ranges" else _whole(path, lay, kind)
                if len(xyz) != n and (strict or kind != "ascii"):
                    raise PointFormatError(f"{path}: the header says {n} points, there are {len(xyz)}")
                for k in range(0, len(xyz), 65536):
                    part = xyz[k : k + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(first + k, first + k + len(part))), *[pa.array(np.ascontiguousarray(part[:, c])) for c in range(3)]], names=["file", "pid", "x", "y", "z"])

    every = plan.mapInArrow(read, SCHEMA)
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return every.where(ok), every.where(~ok).groupBy("file").agg(F.count("*").alias("n"))


def read_points(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points, skipped) of one file, by its extension in any case."""
    ext = re.sub(r".*\.", "", path).lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in ("xyz", "txt", "csv", "asc"):
        points, skipped = read_ascii(spark, path)
        if points.isEmpty():
            raise PointFormatError(f"{path}: no points")
        return points, skipped
    if ext in ("pcd", "ply", "las"):
        return read_binary(spark, [path], strict)
    if ext == "laz":
        raise PointFormatError(f"{path}: LAZ is not supported; decompress it to LAS first")
    raise PointFormatError(f"{path}: unknown extension {ext!r}; known: xyz, txt, csv, asc, pcd, ply, las")


def header_check(spark: SparkSession, path: str, points: DataFrame, skipped: DataFrame) -> DataFrame:
    """(file, header, found, matches) of a file whose header says how many points it has; no row for formats that do not."""
    if not re.search(r"\.(pcd|ply|las)$", path, re.I):
        return spark.createDataFrame([], "file string, header long, found long, matches boolean")
    header = layout(path)[0].count
    found = points.agg(F.count("*").alias("a")).crossJoin(skipped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"))).select((F.col("a") + F.col("b")).alias("found"))
    return found.select(F.lit(path).alias("file"), F.lit(header).cast("long").alias("header"), "found", (F.col("found") == header).alias("matches"))


def reference_positions(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of reference stems: two or three leading numbers a line, z null if it is not there."""
    t = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%' and line not like '/%'")
    w = F.filter(F.split("line", r"[\s,;]+"), lambda x: x != "")
    num = [F.expr(f"try_cast(try_element_at(w, {k}) as double)").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))]
    out = t.select(w.alias("w")).select(*num).where("x is not null and y is not null")
    if out.isEmpty():
        raise PointFormatError(f"{path}: no positions")
    return out
