"""Image files: EDF and MetaImage (read, write), PGM (write), on any file system that Spark knows.

These are single-file formats for one image. A file up to ``WHOLE`` bytes is decoded as one
row; a larger one is read as records of a fixed length, split by split. Writing sorts the
values, encodes them on the executors and streams the pieces through the driver in order, one
partition at a time, so that no volume is held there.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tomolith.errors import InvalidArgumentError
from tomolith.plans.descriptor import Grid
from tomolith.plans.vector import Vector

# Names of element types in the two formats.
EDF_TYPES = {"signedbyte": "i1", "unsignedbyte": "u1", "signedshort": "<i2", "unsignedshort": "<u2", "signedinteger": "<i4", "unsignedinteger": "<u4", "float": "<f4", "floatvalue": "<f4", "real": "<f4", "double": "<f8", "doublevalue": "<f8"}
MHD_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "<i2", "MET_USHORT": "<u2", "MET_INT": "<i4", "MET_UINT": "<u4", "MET_FLOAT": "<f4", "MET_DOUBLE": "<f8"}
EDF_BLOCK = 1024
#: Bytes of a file that is read as one row.
WHOLE = 1 << 28


def edf_header(text: str) -> dict[str, str]:
    """Assignments ``name = value;`` between braces; names in lower case, quotes removed."""
    if not text.startswith("{"):
        raise InvalidArgumentError("an EDF header begins with a brace")
    out: dict[str, str] = {}
    part, quote = "", ""
    for ch in text[1:]:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == "}":
            break
        elif ch == ";":
            name, sep, value = part.partition("=")
            if not sep:
                raise InvalidArgumentError("an EDF header consists of assignments")
            value = value.strip()
            out[name.strip().lower()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
            part = ""
            continue
        part += ch
    return out


def _edf_layout(h: dict[str, str]) -> tuple[Grid, str]:
    if "compression" in h and h["compression"].lower() not in ("", "none"):
        raise InvalidArgumentError("compressed EDF files are not supported")
    if h.get("byteorder", "LowByteFirst").lower() != "lowbytefirst" or int(h.get("image", 1)) != 1:
        raise InvalidArgumentError("only the first image, low byte first, is supported")
    shape = []
    while f"dim_{len(shape) + 1}" in h:
        shape.append(int(h[f"dim_{len(shape) + 1}"]))
    kind = h.get("datatype", "").lower()
    if not shape or kind not in EDF_TYPES or "size" not in h:
        raise InvalidArgumentError("the EDF header lacks dimensions, a known datatype or the size")
    grid = Grid(tuple(shape), tuple(map(float, h["spacing"].split())) if "spacing" in h else ())
    if int(h["size"]) != grid.size * np.dtype(EDF_TYPES[kind]).itemsize:
        raise InvalidArgumentError("the size in the header does not fit the dimensions")
    return grid, EDF_TYPES[kind]


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _decoded(spark: SparkSession, path: str, grid: Grid, kind: str, skip: int) -> Vector:
    fs, p = _place(spark, path)
    item, length = np.dtype(kind).itemsize, fs.getFileStatus(p).getLen()
    if length < skip + grid.size * item:
        raise InvalidArgumentError("the file is shorter than its image")
    if length > WHOLE:
        return _records(spark, path, grid, kind, skip, length)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                values = np.frombuffer(content, kind, grid.size, skip)
                for i in range(0, len(values), 1 << 16):
                    part = values[i : i + (1 << 16)].astype(float)
                    yield pd.DataFrame({"idx": np.arange(i, i + len(part)), "val": part})

    return Vector(spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, "idx long, val double"), grid)


def _records(spark: SparkSession, path: str, grid: Grid, kind: str, skip: int, length: int) -> Vector:
    """The file cut into records as long as header and data allow (64 KB at most); Spark splits it between them."""
    item = np.dtype(kind).itemsize
    even = math.gcd(skip, length, 1 << 16)
    if even % item:
        raise InvalidArgumentError("header and elements of a large file must be aligned")

    def cells(record: tuple[bytes, int]) -> list[tuple[int, float]]:
        content, number = record
        first = (number * even - skip) // item
        return [(first + i, float(v)) for i, v in enumerate(np.frombuffer(content, kind)) if 0 <= first + i < grid.size]

    return Vector(spark.createDataFrame(spark.sparkContext.binaryRecords(path, even).zipWithIndex().flatMap(cells), "idx long, val double"), grid)


def _head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    fs, p = _place(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _stream(v: Vector, path: str, head: bytes, encode: Callable[[np.ndarray, np.ndarray], bytes]) -> None:
    """``head``, then ``encode(indices, values)`` of all values in index order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, val = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i in range(0, len(val), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([encode(idx[i : i + (1 << 16)], val[i : i + (1 << 16)])], pa.binary())], ["piece"])

    fs, p = _place(v.spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(head))
        for row in v.df.select("idx", "val").orderBy("idx").mapInArrow(work, "piece binary").toLocalIterator():
            out.write(bytearray(row.piece))
    finally:
        out.close()


def read_edf(spark: SparkSession, path: str) -> Vector:
    raw = _head(spark, path)
    end = raw.find(b"}\n")
    if end < 0:
        raise InvalidArgumentError("the EDF header does not end")
    grid, kind = _edf_layout(edf_header(raw[: end + 1].decode("latin-1")))
    return _decoded(spark, path, grid, kind, end + 2)


def write_edf(v: Vector, path: str, kind: str = "FloatValue") -> None:
    grid = v.desc
    element = EDF_TYPES[kind.lower()]
    lines = ["{", "HeaderID = EH:000001:000000:000000;", "Image = 1;", "ByteOrder = LowByteFirst;", f"DataType = {kind};"]
    lines += [f"Dim_{i + 1} = {n};" for i, n in enumerate(grid.shape)]
    lines += [f"Size = {grid.size * np.dtype(element).itemsize};", "Spacing =" + "".join(f" {s:g}" for s in grid.spacing) + ";"]
    head = "\n".join(lines) + "\n"
    blocks = -(-(len(head) + 3) // EDF_BLOCK)
    _stream(v, path, head.ljust(blocks * EDF_BLOCK - 3).encode("latin-1") + b"\n}\n", lambda _, val: val.astype(element).tobytes())


def mhd_header(text: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition("=") for line in text.splitlines()) if _}


def read_mhd(spark: SparkSession, path: str) -> Vector:
    head = _head(spark, path)
    at = head.lower().find(b"elementdatafile")
    end = head.find(b"\n", at) + 1 or len(head)
    if at < 0:
        raise InvalidArgumentError("a MetaImage header names its data")
    h = mhd_header(head[:end].decode("latin-1"))
    shape = tuple(map(int, h["dimsize"].split()))
    if int(h.get("ndims", len(shape))) != len(shape) or h["elementtype"] not in MHD_TYPES:
        raise InvalidArgumentError("the MetaImage header is not consistent")
    if h.get("elementbyteordermsb", "False").lower() == "true":
        raise InvalidArgumentError("only low byte first is supported")
    grid = Grid(shape, tuple(map(float, h["elementspacing"].split())) if "elementspacing" in h else ())
    name = h["elementdatafile"]
    if name.upper() == "LOCAL":  # the data follow the header
        return _decoded(spark, path, grid, MHD_TYPES[h["elementtype"]], end)
    return _decoded(spark, name if name.startswith("/") or "://" in name else f"{path.rpartition('/')[0] or '.'}/{name}", grid, MHD_TYPES[h["elementtype"]], 0)


def write_mhd(v: Vector, path: str, raw_path: str | None = None, kind: str = "MET_FLOAT") -> None:
    """A header and a raw file, or without a raw path one file with the data behind the header."""
    grid, element = v.desc, MHD_TYPES[kind]
    name = "LOCAL" if raw_path is None else os.path.relpath(raw_path, os.path.dirname(path) or ".")
    lines = [
        f"NDims = {grid.ndim}", "DimSize = " + " ".join(map(str, grid.shape)), "ElementSpacing = " + " ".join(f"{s:g}" for s in grid.spacing),
        f"ElementType = {kind}", "ElementByteOrderMSB = False", f"ElementDataFile = {name}",
    ]
    head = ("\n".join(lines) + "\n").encode("latin-1")
    _stream(v, raw_path or path, b"" if raw_path else head, lambda _, val: val.astype(element).tobytes())
    if raw_path:
        fs, p = _place(v.spark, path)
        out = fs.create(p, True)
        out.write(bytearray(head))
        out.close()


def write_pgm(v: Vector, path: str) -> None:
    """Plain grey map of a 2-D image, values stretched to 0..255 and cut to integers."""
    shape = v.desc.shape
    if len(shape) == 3 and shape[2] == 1:
        shape = shape[:2]
    if len(shape) != 2:
        raise InvalidArgumentError("PGM holds two-dimensional images")
    r = v.reduce(low=F.min("val"), high=F.max("val"))
    span = r["high"] - r["low"]
    factor = 255 / span if span >= 2.0**-23 else 0.0
    grey = v.map(lambda x: F.floor((x - r["low"]) * factor))

    def text(idx: np.ndarray, val: np.ndarray) -> bytes:
        return b"".join(b"%d%s" % (x, b"\n" if i % shape[0] == shape[0] - 1 else b" ") for i, x in zip(idx.tolist(), val.astype(int).tolist(), strict=True))

    _stream(grey, path, f"P2\n{shape[0]} {shape[1]}\n255\n".encode(), text)


def read(spark: SparkSession, path: str) -> Vector:
    kind = os.path.splitext(path)[1].lower()
    if kind == ".edf":
        return read_edf(spark, path)
    if kind in (".mhd", ".mha"):
        return read_mhd(spark, path)
    raise InvalidArgumentError(f"cannot read files of type {kind or 'none'}")


def write(v: Vector, path: str) -> None:
    kind = os.path.splitext(path)[1].lower()
    if kind == ".edf":
        write_edf(v, path)
    elif kind == ".pgm":
        write_pgm(v, path)
    elif kind == ".mhd":
        write_mhd(v, path, path[:-4] + ".raw")
    elif kind == ".mha":
        write_mhd(v, path)
    else:
        raise InvalidArgumentError(f"cannot write files of type {kind or 'none'}")
