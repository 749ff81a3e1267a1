"""Coded video frames as rows, without decoding: (path, gop, frame, kind, offset, payload).

Files are MPEG-4 Part 2 video, where start codes mark frames and a frame's first bits tell its kind; a key frame begins a
group of pictures, and frames before a file's first key frame belong to no group. An index of ranges of groups is made by
tasks that each scan some bytes; the data source then reads any range on its own, one partition a range, and leaves out
ranges that a pushed filter on path or gop rules out. Filters on kind keep payloads of other kinds from being made.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: What all start codes begin with, the code of a frame, and the kinds that its next two bits tell.
START, FRAME = b"\x00\x00\x01", 0xB6
KINDS = ("I", "P", "B", "S")
#: Bytes that one task scans or reads at once; a range ends with a whole group.
RANGE = 32 << 20
SCHEMA = "path string, gop long, frame int, kind string, offset long, payload binary"
INDEX = "path string, first_gop long, gops long, start long, end long"
_CODE = re.compile(re.escape(START) + b"(.)", re.DOTALL)


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def key_frames(data: bytes) -> list[int]:
    """Places of the key frames' start codes; a code needs five bytes."""
    return [m.start() for m in _CODE.finditer(data) if m[1][0] == FRAME and m.end() < len(data) and data[m.end()] >> 6 == 0]


def frames(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each frame; it ends where the next start code of any kind begins."""
    codes = [(m.start(), m[1][0]) for m in _CODE.finditer(data)]
    for (start, code), (end, _) in zip(codes, [*codes[1:], (len(data), 0)]):
        if code == FRAME and start + 4 < len(data):
            yield start, end, KINDS[data[start + 4] >> 6]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            with open(_local(r["path"]), "rb") as f:
                f.seek(r["from"])
                found = [at for at in key_frames(f.read(r["until"] - r["from"] + 4)) if at < r["until"] - r["from"]]
            r |= {"found": len(found), "first": r["from"] + found[0] if found else None}
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("length", pa.int64()), ("from", pa.int64()), ("until", pa.int64()), ("found", pa.int64()), ("first", pa.int64())]))


def index(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Ranges of whole groups (path, first_gop, gops, start, end) of files (path, length), about range_bytes each. Files
    without a key frame have none."""
    from_ = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    parts = files.select("path", "length", from_.alias("from")).withColumn("until", F.least(F.col("from") + range_bytes, "length"))
    tasks = files.sparkSession.sparkContext.defaultParallelism
    scanned = parts.repartition(tasks, "path", "from").mapInArrow(_scan, "path string, length long, from long, until long, found long, first long")
    by = Window.partitionBy("path").orderBy("from")  # one row for each range of a file
    before = F.coalesce(F.sum("found").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = scanned.where("found > 0").select("path", "length", "from", before.alias("first_gop"), F.col("found").alias("gops"), F.col("first").alias("start"))
    return kept.select("path", "first_gop", "gops", "start", F.coalesce(F.lead("start").over(by), "length").alias("end"))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, gops: int, start: int, end: int):
        self.path, self.first, self.gops, self.start, self.end = path, first, gops, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.index = options["index"]
        self.low, self.high = 0, None
        self.paths: set | None = None
        self.kinds: set | None = None

    def _keep(self, name: str, values: Iterable) -> None:
        held = getattr(self, name)
        setattr(self, name, set(values) if held is None else held & set(values))

    def _below(self, high: int) -> None:
        self.high = high if self.high is None else min(self.high, high)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            match f:
                case EqualTo(value=v) | In(value=v) if name in ("path", "kind") and v is not None:
                    self._keep(f"{name}s", v if isinstance(f, In) else [v])
                case EqualTo(value=int(v)) if name == "gop":
                    self.low = max(self.low, v)
                    self._below(v)
                case In(value=v) if name == "gop" and v:
                    self.low = max(self.low, min(v))
                    self._below(max(v))
                    yield f  # what is left out between the ends isn't seen to here
                case GreaterThan(value=int(v)) if name == "gop":
                    self.low = max(self.low, v + 1)
                case GreaterThanOrEqual(value=int(v)) if name == "gop":
                    self.low = max(self.low, v)
                case LessThan(value=int(v)) if name == "gop":
                    self._below(v - 1)
                case LessThanOrEqual(value=int(v)) if name == "gop":
                    self._below(v)
                case _:
                    yield f

    def partitions(self) -> list[InputPartition]:
        """A partition a range; the index has one row for each about RANGE bytes of video."""
        table = ds.dataset(_local(self.index), format="parquet").to_table().to_pylist()
        kept = [r for r in table if r["first_gop"] + r["gops"] > self.low and (self.high is None or r["first_gop"] <= self.high) and (self.paths is None or r["path"] in self.paths)]
        return [_Range(r["path"], r["first_gop"], r["gops"], r["start"], r["end"]) for r in sorted(kept, key=lambda r: (r["path"], r["start"]))] or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.gops:
            return
        with open(_local(partition.path), "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        gop, place = partition.first - 1, 0
        for start, end, kind in frames(data):
            gop, place = (gop + 1, 0) if kind == "I" else (gop, place + 1)
            if self.high is not None and gop > self.high:
                return
            if gop >= self.low and (self.kinds is None or kind in self.kinds):
                yield partition.path, gop, place, kind, partition.start + start, data[start:end]


class CompressedVideo(DataSource):
    """spark.read.format("compressed_video").option("index", folder).load(); paths must be open to every executor."""

    @classmethod
    def name(cls) -> str:
        return "compressed_video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, files: DataFrame, index_folder: str, range_bytes: int = RANGE) -> DataFrame:
    """Frames of files (path, length); the index is written to a folder first, unless it is there."""
    spark.dataSource.register(CompressedVideo)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if not os.path.isdir(_local(index_folder)):
        index(files, range_bytes).write.parquet(index_folder)
    return spark.read.format("compressed_video").option("index", index_folder).load()


def units(rows: DataFrame, kind: str, wanted: int, length: int = 12) -> DataFrame:
    """Frames of a clip's units: its key frames, or of every group so many delta frames, evenly over the group's places."""
    from vantle.functions.frames import delta_positions

    if kind == "I":
        return rows.where("kind = 'I'")
    sizes = rows.groupBy("path", "gop").agg(F.least(F.count("*"), F.lit(length)).alias("length"))
    places = sizes.select("path", "gop", F.explode(delta_positions(F.col("length"), wanted)).alias("frame"))
    return rows.where("kind <> 'I'").join(places, ["path", "gop", "frame"], "left_semi")
