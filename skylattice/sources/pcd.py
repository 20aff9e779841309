"""Point cloud files (PCD, binary or LZF-compressed, any fields, x y z as 32-bit floats) as a Spark source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 100_000


def header(blob: bytes) -> tuple[dict[str, list[str]], int]:
    """The header's entries and where the data begin."""
    at, entries = 0, {}
    while True:
        end = blob.find(b"\n", at)
        if end < 0:
            raise ValueError("the header has no DATA line")
        words = blob[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words:
            entries[words[0].upper()] = words[1:]
            if words[0].upper() == "DATA":
                return entries, at


def lzf(data: bytes, size: int) -> bytes:
    """Decompress an LZF block: a control byte below 32 announces that many literals plus one, any other a copy of
    earlier output whose length and distance it and the next bytes hold."""
    out = bytearray()
    source = memoryview(data)
    i = 0
    while i < len(source):
        control = source[i]
        if control < 32:
            out += source[i + 1 : i + control + 2]
            i += control + 2
            continue
        count, i = control >> 5, i + 1
        if count == 7:
            count, i = count + source[i], i + 1
        start = len(out) - (((control & 31) << 8) | source[i]) - 1
        if start < 0:
            raise ValueError("the block refers to what is before its beginning")
        i, count = i + 1, count + 2
        period = bytes(out[start : start + count])
        while len(period) < count:  # the copy may overlap what it writes
            period += period[: count - len(period)]
        out += period
    if len(out) != size:
        raise ValueError("the block has another size than announced")
    return bytes(out)


def xyz(blob: bytes) -> np.ndarray:
    """The points of a file as float64 [n, 3]."""
    h, at = header(blob)
    fields, sizes = h.get("FIELDS", []), [int(v) for v in h.get("SIZE", [])]
    types = h.get("TYPE", ["F"] * len(fields))
    repeats = [int(v) for v in h.get("COUNT", ["1"] * len(fields))]
    n = int(h.get("POINTS", ["0"])[0])
    if n <= 0 or len(sizes) != len(fields):
        raise ValueError("the header has no points or no sizes")
    for c in "xyz":
        if c not in fields or sizes[fields.index(c)] != 4 or types[fields.index(c)].upper() != "F":
            raise ValueError("x, y and z must be 32-bit floats")
    width = [s * r for s, r in zip(sizes, repeats)]
    kind = h["DATA"][0].lower()
    if kind == "binary":
        layout = np.dtype({"names": list("xyz"), "formats": ["<f4"] * 3, "offsets": [sum(width[: fields.index(c)]) for c in "xyz"], "itemsize": sum(width)})
        if len(blob) - at < n * layout.itemsize:
            raise ValueError("the file ends before its last point")
        rows = np.frombuffer(blob, dtype=layout, count=n, offset=at)
        return np.stack([rows[c] for c in "xyz"], axis=1).astype(np.float64)
    if kind == "binary_compressed":
        packed, size = np.frombuffer(blob, dtype="<u4", count=2, offset=at).tolist()
        if len(blob) < at + 8 + packed:
            raise ValueError("the file ends before its block does")
        flat = lzf(blob[at + 8 : at + 8 + packed], size)
        return np.stack([np.frombuffer(flat, dtype="<f4", count=n, offset=n * sum(width[: fields.index(c)])) for c in "xyz"], axis=1).astype(np.float64)
    raise ValueError(f"data of kind {kind} can't be read")


def read_points(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """file, point_id (place in the file), x, y, z of all files below path; with stride, every stride-th point by place.
    One file is one task's input, its points leave in batches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                points = xyz(blob.as_py())
                at = np.arange(0, len(points), stride)
                for lo in range(0, len(at), ROWS):
                    part = at[lo : lo + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), *(pa.array(points[part, i]) for i in range(3))], ["file", "point_id", "x", "y", "z"])

    return files.repartition(F.col("path")).mapInArrow(run, "file string, point_id bigint, x double, y double, z double")
