"""Clips pooled on a stream: frames arrive in any order and batch; a clip's vector leaves when its last second has come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "clip string, seconds int, vector array<double>"
STATE = "sums array<double>, seen array<int>, done boolean"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), np.finfo(np.float32).eps)


def pooled_clips(frames: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """(clip, seconds, vector) of a stream of (clip, second, seconds, embedding): one frame vector a second, of which the
    clip has so many (numbered from 0). The vector is that of pooling.mean_pool.

    Seconds that come again count once, also after the clip has left; seconds outside the clip and null vectors count for
    nothing. What is held of a clip is one sum and the numbers of the seconds seen, and of a clip that has left only that
    it has; it goes when nothing came for forget_after_ms, if that is given. Such a stream looks for what to forget for
    ever, so it isn't for a trigger that ends when all input is read.
    """

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sums, seen, done = state.get if state.exists else ([], [], False)
        sums, known, n = np.asarray(sums, float), set(seen), None
        for pdf in batches:
            for second, seconds, vector in zip(pdf["second"], pdf["seconds"], pdf["embedding"]):
                if not done and vector is not None and 0 <= second < seconds and second not in known:
                    own = _unit(np.asarray(vector, float))
                    if len(sums) not in (0, len(own)):
                        raise ValueError("vectors differ in length")
                    sums = own if not len(sums) else sums + own
                    known.add(int(second))
                    n = int(seconds)
        if not done and n is not None and len(known) == n:
            yield pd.DataFrame({"clip": [key[0]], "seconds": [n], "vector": [_unit(sums / n).tolist()]})
            sums, known, done = np.zeros(0), set(), True
        state.update((sums.tolist(), sorted(known), done))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)

    rows = frames.selectExpr("cast(clip as string) clip", "cast(second as int) second", "cast(seconds as int) seconds", "cast(embedding as array<double>) embedding")
    rows = rows.where("clip is not null and second is not null and seconds is not null")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("clip").applyInPandasWithState(add, OUT, STATE, "append", timeout)
