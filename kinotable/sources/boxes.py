"""The box scan: files become one row for each box, with the payload of the small metadata boxes that later steps decode.

Walking nested, length-delimited records is sequential, so it is the one step over whole files that runs in Python. A file
is one row and at most MAX_BYTES; media payloads are skipped, never copied, and never leave the scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 256 << 20
MAX_BOXES, MAX_FRAGMENTS, MAX_TRAFS, MAX_TRUNS = 100_000, 4096, 1024, 4096
MAX_SAMPLES = MAX_ENTRIES = 1_000_000

#: Boxes that hold boxes, and how many of a type one may hold.
CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "mvex", "moof", "traf"}
_COUNTED = {"": ("moof", MAX_FRAGMENTS), "moof": ("traf", MAX_TRAFS), "traf": ("trun", MAX_TRUNS)}
#: Boxes whose payload is kept.
DECODED = {"tkhd", "hdlr", "mdhd", "stsd", "stsz", "stts", "stco", "co64", "stsc", "ctts", "stss", "trex", "mfhd", "tfhd", "tfdt", "trun"}

SCHEMA = (
    "file string, start bigint, size bigint, header_size int, type string, parent_start bigint, depth int, ordinal int, "
    "trak_start bigint, moof_start bigint, traf_start bigint, payload binary, file_size bigint, violation string"
)
_ARROW = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("header_size", pa.int32()), ("type", pa.string()), ("parent_start", pa.int64()), ("depth", pa.int32()), ("ordinal", pa.int32()),
     ("trak_start", pa.int64()), ("moof_start", pa.int64()), ("traf_start", pa.int64()), ("payload", pa.binary()), ("file_size", pa.int64()), ("violation", pa.string())]
)


class Malformed(ValueError):
    """A structural violation, by its code."""


def children(data: memoryview, start: int, end: int, parent: str = "") -> Iterator[tuple[int, int, int, str]]:
    """(start, size, header size, type) of the boxes in a byte range."""
    counted, most = _COUNTED.get(parent, ("", 0))
    seen = boxes = 0
    while start < end:
        if boxes >= MAX_BOXES:
            raise Malformed("box_count")
        if end - start < 8:
            raise Malformed("box_header_incomplete")
        size, kind, header = int.from_bytes(data[start : start + 4]), bytes(data[start + 4 : start + 8]).decode("ascii", "replace"), 8
        if size == 1:
            if end - start < 16:
                raise Malformed("box_header_incomplete")
            size, header = int.from_bytes(data[start + 8 : start + 16]), 16
            if size >= 1 << 63:
                raise Malformed("box_too_large")
        elif size == 0:
            size = end - start
        if not header <= size <= end - start:
            raise Malformed("box_exceeds_parent")
        boxes, seen = boxes + 1, seen + (kind == counted)
        if seen > most and kind == counted:
            raise Malformed(f"{kind}_count")
        yield start, size, header, kind
        start += size


def _walk(file: str, data: memoryview) -> Iterator[tuple]:
    def inside(start: int, end: int, parent: str, at: int, depth: int, above: dict[str, int]) -> Iterator[tuple]:
        rows = list(children(data, start, end, parent))
        handler = next((bytes(data[s + h + 8 : s + h + 12]) for s, n, h, t in rows if t == "hdlr"), b"")
        for k, (s, n, h, t) in enumerate(rows):
            own = above | ({t: s} if t in ("trak", "moof", "traf") else {})
            payload = bytes(data[s + h : s + n]) if t in DECODED else None
            yield file, s, n, h, t, at, depth, k, own.get("trak"), own.get("moof"), own.get("traf"), payload, len(data), None
            other = t == "minf" and handler not in (b"vide", b"soun")  # of a track that is left alone
            if t in CONTAINERS and not other and (depth or t in ("moov", "moof")):
                yield from inside(s + h, s + n, t, s, depth + 1, own)

    if len(data) > MAX_BYTES:
        yield file, *[None] * 11, len(data), "file_too_large"
        return
    rows: list[tuple] = []
    try:
        for row in inside(0, len(data), "", -1, 0, {}):
            rows.append(row)
    except Malformed as broken:
        rows.append((file, *[None] * 11, len(data), str(broken)))
    yield from rows or [(file, *[None] * 11, len(data), "moov_missing")]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            rows = list(_walk(file, memoryview(content.as_buffer() if content.is_valid else b"")))
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _ARROW, strict=True)], schema=_ARROW)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, content and length of the files at a path, glob or directory, in any store that Spark reads."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), "content", "length")


def scan(found: DataFrame) -> DataFrame:
    """Boxes of files(file, content), partitioned by file; what breaks the structure of a file is a row with a violation."""
    return found.select("file", "content").mapInArrow(_scan, SCHEMA).repartition("file")


def of_type(boxes: DataFrame, kind: str) -> DataFrame:
    """Boxes of one type."""
    return boxes.where(F.col("type") == kind)


def children_of(boxes: DataFrame, parents: DataFrame) -> DataFrame:
    """Boxes that lie directly in one of `parents`."""
    keys = parents.select("file", F.col("start").alias("parent_start")).distinct()
    return boxes.join(keys, ["file", "parent_start"], "left_semi").select(boxes.columns)


def first_of(boxes: DataFrame, kind: str) -> DataFrame:
    """The first box of a type in each parent that has one."""
    own = of_type(boxes, kind)
    return own.groupBy("file", "parent_start").agg(F.min_by(F.struct(*own.columns), "ordinal").alias("b")).select("b.*")


def exactly_one(boxes: DataFrame, parents: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The box of a type in each parent that has just one, and violations(file, code) of the parents that have none or more."""
    own = of_type(boxes, kind).groupBy("file", "parent_start").agg(F.count("*").alias("n"), F.min_by(F.struct(*boxes.columns), "ordinal").alias("b"))
    found = parents.select("file", F.col("start").alias("parent_start")).distinct().join(own, ["file", "parent_start"], "left")
    wrong = found.where("n IS NULL OR n > 1").select("file", F.when(F.col("n").isNull(), f"{kind}_missing").otherwise(f"{kind}_repeated").alias("code")).distinct()
    return found.where("n = 1").select("b.*"), wrong
