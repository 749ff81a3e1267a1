"""Incremental builds: a file stream of items, encoded and appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vantle.operators.config import BuildConfig
from vantle.operators.encoders import encode_items
from vantle.operators.store import Store


def build_stream(items: DataFrame, store: Store, decode: Callable, checkpoint: str, config: BuildConfig | None = None, progress: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Encodes a stream of (row_index, video_id, path). Any batch may be replayed: only rows that are missing are added,
    and a manifest is committed behind each batch, of which progress then gets the report."""

    def add(batch: DataFrame, number: int) -> None:
        store.enlist(batch)
        encoded = encode_items(batch, decode, config).persist()
        store.append(encoded)
        report = store.finish(failed_this_run=encoded.where("error is not null").count(), batch=number)
        encoded.unpersist()
        if progress:
            progress(report)

    return items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
