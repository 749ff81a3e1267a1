"""Builds from a folder of videos: listing, encoding of what is missing, report."""

from __future__ import annotations

import platform
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantle.operators.config import BuildConfig, plain
from vantle.operators.encoders import create_encoder, decode, encode_items
from vantle.operators.store import Store
from vantle.sources.captions import discover_items

#: Items that a build encodes and commits at once.
BATCH_ITEMS = 100_000


def build(
    spark: SparkSession, videos: str, target: str, config: BuildConfig | None = None, split: str | None = None, id_column: str = "video_id", limit: int | None = None,
    overwrite: bool = False, resume: bool = False, strict: bool = False, decode: Callable = decode, progress: Callable[[dict], None] | None = None,
    batch_items: int = BATCH_ITEMS,
) -> dict:
    """The report of a build of target from the videos below a folder, all of them or those that a split names. Batches of
    about batch_items are committed one after the other; progress is called after each."""
    if overwrite and resume:
        raise ValueError("a build is resumed or overwritten, not both")
    config = config or BuildConfig()
    items, missing = discover_items(spark, videos, split, id_column, limit)
    absent = missing.count()
    if items.isEmpty():
        raise ValueError("there are no videos")
    if strict and absent:
        raise FileNotFoundError(f"{absent} videos of the split are missing, such as {[r[0] for r in missing.limit(5).collect()]}")
    began = time.perf_counter()
    encoder = create_encoder(config.encoder)
    loaded = time.perf_counter() - began
    store = Store(spark, target)
    store.initialize(items, plain(config), encoder.dimension, overwrite, resume)
    report = encode_pending(store, store.pending(), config, decode, progress, batch_items)
    host = {"platform": platform.platform(), "python": platform.python_version(), **encoder.describe()}
    return store.finish(missing_from_csv=absent, model_load_seconds=loaded, **report, system=host)


def encode_pending(store: Store, items: DataFrame, config: BuildConfig, decode: Callable, progress: Callable[[dict], None] | None = None, batch_items: int = BATCH_ITEMS) -> dict:
    """Encodes items into the store, batch by batch, and tells what it took. A crash loses the batch it comes in."""
    began, total = time.perf_counter(), items.count()
    rounds = -(-total // batch_items)
    sums = dict.fromkeys(("attempted", "failed_this_run", "frames_this_run", "decode_worker_seconds_sum", "inference_seconds"), 0)
    items = items.withColumn("round", F.pmod(F.col("row_index"), F.lit(max(1, rounds))))
    for k in range(rounds):
        encoded = encode_items(items.where(F.col("round") == k), decode, config).persist()
        store.append(encoded)
        work = encoded.agg(
            F.count("*").alias("attempted"), F.count("error").alias("failed_this_run"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames_this_run"),
            F.coalesce(F.sum("decode_seconds"), F.lit(0.0)).alias("decode_worker_seconds_sum"), F.coalesce(F.sum("inference_seconds"), F.lit(0.0)).alias("inference_seconds"),
        ).first().asDict()
        encoded.unpersist()
        sums = {name: value + work[name] for name, value in sums.items()}
        if progress:
            progress({"batch": k, "batches": rounds, "total": total, **sums, "processing_seconds": time.perf_counter() - began})
    seconds, n = time.perf_counter() - began, sums.pop("attempted")
    rate = lambda x, y: x / y if y else None
    return {
        **sums, "processing_seconds": seconds, "videos_per_second": rate(n, seconds), "frames_per_second_inference": rate(sums["frames_this_run"], sums["inference_seconds"]),
        "projected_processing_seconds": {str(more): seconds / n * more for more in (1000, 2000)} if n else {},
    }
