"""Readers of the caption and split formats."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantle.functions.text import extension, parent_url, stem
from vantle.functions.vectors import normalized
from vantle.operators.dataset import claimed_once, first_wins, paragraph, reindexed
from vantle.sources.npy import header, register


EXTENSIONS = (".mp4", ".webm", ".mkv", ".avi", ".mov")


def read_split(spark: SparkSession, path: str, id_column: str = "video_id", caption_column: str = "sentence") -> DataFrame:
    """(row_index, video_id, caption): first occurrence of each id, in file order; the caption column may be absent."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))
    if id_column not in raw.columns:
        raise ValueError(f"{path} has no column {id_column}; there are {raw.columns}")
    caption = F.trim(caption_column) if caption_column in raw.columns else F.lit(None).cast("string")
    rows = raw.select(F.col(id_column).alias("video_id"), caption.alias("caption"), F.monotonically_increasing_id().alias("place"))
    return reindexed(first_wins(rows, "video_id", "place"), "place").select("row_index", "video_id", "caption")


def read_clips_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Six tab-separated fields a line; other lines fail the read."""
    schema = "clip_id string, start_aligned string, end_aligned string, start_extracted string, end_extracted string, sentence string"
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)


def _document(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v"))


def read_caption_json(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, caption) from the sentences of a caption document."""
    return _document(spark, path, "sentences array<struct<video_id:string,caption:string>>").select(F.inline("v.sentences"))


def read_video_json(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, url, parent) from the videos of a caption document; clips of one video share its parent."""
    rows = _document(spark, path, "videos array<struct<video_id:string,url:string>>").select(F.inline("v.videos"))
    return rows.withColumn("parent", parent_url(F.col("url")))


def caption_csv(captions: DataFrame, ids: DataFrame, path: str) -> None:
    """Writes (video_id, sentence) of the captions of ids as CSV with a header."""
    rows = captions.join(ids.select("video_id").distinct(), "video_id", "left_semi").select("video_id", F.col("caption").alias("sentence"))
    rows.write.option("header", True).option("escape", '"').csv(path)


def read_word_lists(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(video_id, caption) of the ids, from a map of ids to captions that are lists of words. Every id must be there.

    Pickled maps are converted to JSON outside: reading a pickle runs what is in it.
    """
    found = _document(spark, path, "map<string,array<array<string>>>").select(F.explode("v").alias("video_id", "all"))
    wanted = ids.select("video_id").join(found, "video_id", "left")
    every = F.when(F.col("all").isNull(), F.raise_error(F.concat(F.lit("no captions of "), "video_id")).cast("array<array<string>>")).otherwise(F.col("all"))
    return wanted.select("video_id", F.posexplode(every).alias("place", "words")).select("video_id", "place", F.array_join("words", " ").alias("caption"))


def read_timed(spark: SparkSession, path: str, ids: DataFrame, clip_seconds: float = 5.0) -> DataFrame:
    """(video_id, description, start_s, end_s) of the ids, from a list of descriptions with the first and last clip that
    each annotator gave; bounds are means over annotators, in seconds."""
    kind = "array<struct<video:string,description:string,times:array<array<double>>>>"
    rows = _document(spark, path, kind).select(F.posexplode("v").alias("place", "x")).select("place", "x.*").withColumnRenamed("video", "video_id")
    mean = lambda k: F.aggregate("times", F.lit(0.0), lambda a, t: a + t[k]) / F.size("times")
    rows = rows.join(ids.select("video_id").distinct(), "video_id", "left_semi")
    return rows.select("video_id", "place", "description", (mean(0) * clip_seconds).alias("start_s"), ((mean(1) + 1) * clip_seconds).alias("end_s"))


def timed_paragraphs(timed: DataFrame, whole_seconds: float = 31.0) -> DataFrame:
    """(video_id, start_s, end_s, paragraph): one clip a video, over all that was annotated."""
    out = paragraph(timed, "video_id", "place", "description", "paragraph")
    return out.select("video_id", F.lit(0.0).alias("start_s"), F.lit(whole_seconds).alias("end_s"), "paragraph")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, duration, paragraph) from a map of ids to durations and sentences."""
    kind = "map<string,struct<duration:double,sentences:array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("video_id", "v"))
    return whole.select("video_id", F.ceil("v.duration").cast("long").alias("duration"), F.array_join("v.sentences", " ").alias("paragraph"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("video_id")).where("video_id <> ''").distinct()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is directly in each folder; folders and files of any file system that Arrow opens."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            store, inner = fs.FileSystem.from_uri(folder if re.match(r"[a-z][a-z0-9+.-]*:", folder) else os.path.abspath(folder))
            scheme = "file:" if store.type_name == "local" else folder[: len(folder) - len(inner)] if folder.endswith(inner) else f"{store.type_name}://"
            found = store.get_file_info(fs.FileSelector(inner))
            columns = [[scheme + f.path for f in found], [f.size or 0 for f in found], [f.type == fs.FileType.Directory for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "folder"])


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, name, stem, extension) of every file below a folder; contents aren't read.

    Tasks list the folders, level by level, so the driver holds no listing: only whether a level has folders of its own.
    """
    level, found = spark.createDataFrame([(folder,)], "path string"), None
    while True:
        here = level.mapInArrow(_listed, "path string, length long, folder boolean").persist()
        files = here.where("not folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = here.where("folder").select("path")
        if level.isEmpty():
            break
        level = level.repartition(spark.sparkContext.defaultParallelism)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", "length", name.alias("name"), stem(name).alias("stem"), extension(name).alias("extension"))


def videos_below(spark: SparkSession, folder: str) -> DataFrame:
    """files_below that are videos, in the order of place, their paths in lower case."""
    return files_below(spark, folder).where(F.col("extension").isin(*EXTENSIONS)).withColumn("place", F.lower("path"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, path, length) of the videos below a folder, the first path of each stem by its lower case."""
    return first_wins(videos_below(spark, folder).select("stem", "path", "length", "place"), "stem", "place").drop("place")


def walked(spark: SparkSession, folder: str, ids: DataFrame, whole_name: bool = False) -> DataFrame:
    """(video_id, path) of the ids for which a file below the folder has that stem or, with whole_name, that name; of
    several files the last path wins."""
    rows = files_below(spark, folder).select(F.col("name" if whole_name else "stem").alias("video_id"), "path")
    return rows.join(ids.select("video_id").distinct(), "video_id", "left_semi").groupBy("video_id").agg(F.max("path").alias("path"))


def resolved(items: DataFrame, folder: str, files: DataFrame | None = None, extensions: tuple[str, ...] = (".mp4", ".webm")) -> DataFrame:
    """items with path: the folder, video_id and the first of the extensions for which files has that path; the first
    extension where none is there, or where no files are given."""
    names = [F.concat(F.lit(folder.rstrip("/") + "/"), "video_id", F.lit(e)) for e in extensions]
    if files is None:
        return items.withColumn("path", names[0])
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    known, out = files.select(plain("path").alias("__known")).distinct(), items
    for k, name in enumerate(names):
        here = known.select(F.col("__known").alias(f"__{k}"))
        out = out.join(here, plain(name) == F.col(f"__{k}"), "left")
    path = F.coalesce(*(F.when(F.col(f"__{k}").isNotNull(), name) for k, name in enumerate(names)), names[0])
    return out.withColumn("path", path).drop(*(f"__{k}" for k in range(len(names))))


def discover_items(spark: SparkSession, folder: str, split: str | None = None, id_column: str = "video_id", limit: int | None = None, caption_column: str = "sentence") -> tuple[DataFrame, DataFrame]:
    """Items (row_index, video_id, path, caption) of the videos below a folder, and missing ids (video_id).

    Without a split these are all videos by path. With one, its ids in its order: an id that ends in a video's extension
    names a file below the folder if there is one; else, and for other ids, the stem counts. A file that two ids name is
    the first one's.
    """
    files = videos_below(spark, folder)
    if split is None:
        items = reindexed(files.select(F.col("stem").alias("video_id"), "path", F.lit(None).cast("string").alias("caption"), "place"), "place", limit)
        return items.select("row_index", "video_id", "path", "caption"), spark.createDataFrame([], "video_id string")
    rows = read_split(spark, split, id_column, caption_column)
    name = F.element_at(F.split("video_id", "/"), -1)
    rows = rows.withColumn("own", F.when(extension(name) == "", name).otherwise(stem(name)))
    direct = F.when(extension(name).isin(*EXTENSIONS), F.col("video_id"))
    root = folder.rstrip("/").removeprefix("file:")
    under = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len('/' + root.lstrip('/')) + 2})")
    named = files.select(under.alias("direct"), F.col("path").alias("named"))
    stems = first_wins(files.select("stem", "path", "place"), "stem", "place").select(F.col("stem").alias("own"), F.col("path").alias("stemmed"))
    found = rows.withColumn("direct", direct).join(named, "direct", "left").join(stems, "own", "left")
    found = found.select("row_index", "own", "video_id", "caption", F.coalesce("named", "stemmed").alias("path"))
    once = claimed_once(found.where("path is not null"), "path", "row_index")
    items = reindexed(once.select(F.col("row_index").alias("place"), F.col("own").alias("video_id"), "path", "caption"), "place", limit)
    return items.select("row_index", "video_id", "path", "caption"), found.where("path is null").select("video_id")


def text_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """(row_index, embedding) of a .npy matrix of text vectors of that dimension, made unit; zero rows stay zero."""
    register(spark)
    shape = header(path)[1]
    if shape[1] != dimension:
        raise ValueError(f"text vectors must have shape (n, {dimension}), not {shape}")
    return spark.read.format("npy").load(path).select("row_index", normalized("embedding").alias("embedding"))
