"""Nearest items: single queries natively, query sets through matrix kernels with bounds.

A small query set goes to every executor once, as one matrix. Of a larger one, chunks meet shares of the items, each pair in
a task of its own.
Items are grouped into cells around pivots. A cell's center and radius bound its scores for every query, and pairs of a
query and a cell that can't change the query's result are skipped without their products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vantle.functions.vectors import dot, hamming, pack_bits

#: Vectors in a block, and the bytes of query blocks up to which they are sent to every executor.
BLOCK = 1024
BROADCAST_BYTES = 64 << 20
#: Queries that are sent to every executor, at most; more are dealt.
MOST_SENT = 4 * BLOCK
#: Results that a task holds, at most, and bytes of its queries with their results and of its items, as doubles.
HELD, CHUNK_BYTES, SHARE_BYTES = 4 << 20, 32 << 20, 160 << 20
#: Queries whose scores are computed at once, and the largest product of lengths for which 32-bit floats serve.
AT_ONCE, LARGEST = 512, 1e30


def topk(items: DataFrame, score: Column, k: int, id_column: str = "vec_id") -> DataFrame:
    """The k best rows by score, ties by id, with score and rank from 1; planned as a top-k, without a full sort."""
    if k < 1:
        raise ValueError("k must be at least 1")
    best = items.withColumn("score", score).orderBy(F.desc("score"), id_column).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_column)).cast("long"))


def exact_score(query: list[float], column: str = "embedding") -> Column:
    return dot(column, F.array(*map(F.lit, map(float, query))))


def binary_score(query: list[float], dimension: int, column: str = "embedding") -> Column:
    """Dimension less the Hamming distance of the packed vectors."""
    bits = np.packbits(np.asarray(query) > 0).tolist()
    return (F.lit(dimension) - hamming(pack_bits(column), F.array(*map(F.lit, bits)))).cast("long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix; a null or another length fails."""
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or (n and (sizes != sizes[0]).any()):
        raise ValueError("vectors are null or differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([_matrix(part.column(1)).tobytes()])], names=["ids", "vectors"])


def blocks(vectors: DataFrame) -> DataFrame:
    """(ids, vectors): rows of (id, vector) in matrices of at most BLOCK rows."""
    return vectors.mapInArrow(_blocks, "ids binary, vectors binary")


def vector_bytes(vectors: DataFrame, more: int = 0) -> int:
    """Bytes of (id, vector) as doubles, measured, with so many more values a row."""
    n, width = vectors.agg(F.count("*"), F.max(F.size(vectors.columns[1]))).first()
    return n * 8 * ((width or 0) + 1 + more)


def block_pairs(queries: DataFrame, items: DataFrame, query_bytes: int | None = None) -> DataFrame:
    """Each query block beside each item block: one row for up to BLOCK x BLOCK scores.

    The query side is sent to the executors while its size (measured, unless given) allows. Beyond, query blocks are
    dealt to chunks of that size and item blocks to as many shares, and one equi-join makes every chunk meet every share.
    """
    query_bytes = vector_bytes(queries) if query_bytes is None else query_bytes
    q = blocks(queries).select(F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    i = blocks(items)
    if query_bytes <= BROADCAST_BYTES:
        return i.crossJoin(F.broadcast(q))
    chunks = -(-query_bytes // BROADCAST_BYTES)
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    q = q.withColumn("chunk", F.pmod(F.hash("q_ids"), F.lit(chunks))).withColumn("share", every)
    i = i.withColumn("share", F.pmod(F.hash("ids"), F.lit(chunks))).withColumn("chunk", every)
    return i.join(q, ["chunk", "share"]).drop("chunk", "share")


def _matrices(batch: pa.RecordBatch):
    for block, ids, vectors, q_ids, q_vectors in zip(*(batch.column(n).to_pylist() for n in ("q_block", "ids", "vectors", "q_ids", "q_vectors"))):
        ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
        yield block, ids, np.frombuffer(vectors, np.float64).reshape(len(ids), -1), q_ids, np.frombuffer(q_vectors, np.float64).reshape(len(q_ids), -1)


#: Pivots of a batch of items, at most, and the least items a cell is worth.
PIVOTS, LEAST_CELL = 16, 64
#: What rounding may add to a score or a bound.
SLACK = 1e-8


def _cells(ids: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items by their nearest pivot, BLOCK at most together; pivots are rows at even distances."""
    n = min(PIVOTS, len(ids) // LEAST_CELL)
    if n < 2:
        parts = [np.arange(len(ids))]
    else:
        pivots = items[np.linspace(0, len(ids) - 1, n).astype(int)]
        nearest = np.argmin((pivots**2).sum(axis=1) - 2 * items @ pivots.T, axis=1)
        parts = [np.flatnonzero(nearest == p) for p in range(n)]
    for part in parts:
        for at in range(0, len(part), BLOCK):
            own = part[at : at + BLOCK]
            yield ids[own], items[own]


def _reach(queries: np.ndarray, norms: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each query may have with any of the items."""
    center = items.mean(axis=0)
    middle, radius = queries @ center, norms * np.sqrt(((items - center) ** 2).sum(axis=1).max())
    return middle - radius - SLACK, middle + radius + SLACK


def _few(hits: np.ndarray) -> np.ndarray:
    """Places of what is set where little is: eight are looked at together."""
    hits = hits.ravel()
    whole = len(hits) // 8 * 8
    some = (np.flatnonzero(hits[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.r_[some[hits[some]], whole + np.flatnonzero(hits[whole:])]


def _signs(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, 1.0, -1.0)


class _Kernel:
    """Queries that meet cells of items; counts the pairs that bounds spared. Scores of all pairs are 32-bit products; those
    that rounding leaves open are computed again in double."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray):
        self.ids, self.queries = ids, queries
        self.norms = np.sqrt((queries**2).sum(axis=1))
        with np.errstate(over="ignore"):
            self.single = queries.astype(np.float32)
        self.met = self.skipped = 0

    def meet(self, ids: np.ndarray, items: np.ndarray) -> None:
        low, high = _reach(self.queries, self.norms, items)
        live = np.flatnonzero(self.settle(low, high, len(ids)))
        self.met += len(self.ids) * len(ids)
        self.skipped += (len(self.ids) - len(live)) * len(ids)
        if not len(live):
            return
        length = np.sqrt((items**2).sum(axis=1).max())
        wide = not self.norms.max() * length < LARGEST
        other = items.T if wide else np.ascontiguousarray(items.T, np.float32)
        for at in range(0, len(live), AT_ONCE):
            own = live[at : at + AT_ONCE]
            # no 32-bit product is further off
            slack = SLACK + (0 if wide else (items.shape[1] + 4) * 2.0**-24) * self.norms[own] * length
            self.take(own, ids, items, (self.queries if wide else self.single)[own] @ other, slack)

    def scores(self, own: np.ndarray, items: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of queries own and items at, side by side."""
        out = np.empty(len(own))
        for k in range(0, len(own), 1 << 15):
            part = slice(k, k + (1 << 15))
            out[part] = np.einsum("ij,ij->i", self.queries[own[part]], items[at[part]])
        return np.round(out, 9)

    def distinct(self, items: np.ndarray) -> np.ndarray | None:
        """Which items are needed, of items in the order of their ids; None for all."""

    def finish(self, ids: np.ndarray, items: np.ndarray) -> None:
        """The last step of a task that holds all its items."""


class _Nearest(_Kernel):
    """The k best items of each query. exact: beside the score by signs, that of the vectors themselves."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, signs: bool, exclude_self: bool, exact: bool = False):
        self.own = queries if exact else None
        super().__init__(ids, _signs(queries) if signs else queries)
        self.k, self.signs, self.exclude_self = k, signs, exclude_self
        self.best = np.full((len(ids), k), -np.inf)
        self.held = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def prepared(self, items: np.ndarray) -> np.ndarray:
        return _signs(items) if self.signs else items.astype(np.float64, copy=False)

    def distinct(self, items: np.ndarray) -> np.ndarray:
        """Of equal vectors the first k, and one more for a query that is itself left out: no other is ever among the best."""
        data = np.ascontiguousarray(items).view(np.uint32)
        key = np.zeros(len(data), np.uint64)
        for column in data.T:
            key = _spread(key + column)
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order[1:]] != key[order[:-1]]]
        same = np.flatnonzero(~new)  # what unlike vectors with equal keys hide is kept
        new[same] = (data[order[same]] != data[order[same - 1]]).any(axis=1)
        starts = np.flatnonzero(new)
        return np.sort(order[np.arange(len(order)) - starts[np.cumsum(new) - 1] <= self.k])

    def settle(self, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
        if self.signs:
            high = (high + self.queries.shape[1]) / 2
        return high >= self.best[:, -1]

    def take(self, own: np.ndarray, ids: np.ndarray, items: np.ndarray, scores: np.ndarray, slack: np.ndarray) -> None:
        width, least = items.shape[1], self.best[own, -1]
        if self.signs:  # exact; where only larger ids come, equal scores change nothing
            least = 2 * least - width + np.where(self.held[own, -1] < ids.min(), 1, 0)
        else:
            least = least - slack
        if len(ids) > self.k + 1 and (empty := np.flatnonzero(least == -np.inf)).size:
            # so many items of these alone reach it, without the query's own
            reached = np.partition(scores[empty], -self.k - 1, axis=1)[:, -self.k - 1] - 2 * slack[empty]
            least[empty] = np.where(np.isnan(reached), -np.inf, reached)
        row, at = np.divmod(_few(scores >= np.nextafter(least.astype(np.float32), -np.inf, dtype=np.float32)[:, None]), len(ids))
        if self.exclude_self:
            other = self.ids[own[row]] != ids[at]
            row, at = row[other], at[other]
        found = (scores[row, at].astype(np.float64) + width) / 2 if self.signs else self.scores(own[row], items, at)
        row, names = own[row], ids[at]
        last = self.best[row, -1]
        better = (found > last) | ((found == last) & (names < self.held[row, -1]))
        if better.any():
            self.more.append((row[better], found[better], names[better]))
            self.waiting += int(better.sum())
        if self.waiting > len(self.ids) * self.k // 2:
            self.merge()

    def merge(self) -> None:
        if not self.more:
            return
        row, score, name = (np.concatenate(c) for c in zip(*self.more))
        self.more, self.waiting = [], 0
        if self.signs and self.joined(row, score, name):
            return
        mine = np.unique(row)
        row, score, name = np.r_[row, np.repeat(mine, self.k)], np.r_[score, self.best[mine].ravel()], np.r_[name, self.held[mine].ravel()]
        order = np.lexsort((name, -score, row))
        row = row[order]
        starts = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        first = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.best[mine], self.held[mine] = score[first].reshape(-1, self.k), name[first].reshape(-1, self.k)

    def joined(self, row: np.ndarray, score: np.ndarray, name: np.ndarray) -> bool:
        """merge() for whole scores and ids below 2**40, which sort as one number, if no query has far more than others."""
        counts = np.bincount(row, minlength=len(self.ids))
        wide, most = self.k + int(counts.max()), self.queries.shape[1] + 1
        if name.min() < 0 or name.max() >> 40 or most >> 20 or wide * len(counts) > 4 * (self.k * len(counts) + len(row)):
            return False
        none = np.iinfo(np.int64).max
        keys = np.full((len(counts), wide), none)
        some = np.isfinite(self.best)
        keys[:, : self.k][some] = ((most - self.best[some]).astype(np.int64) << 40) + self.held[some]
        order = np.argsort(row, kind="stable")
        row, starts = row[order], np.cumsum(counts) - counts
        keys[row, self.k + np.arange(len(row)) - starts[row]] = ((most - score[order]).astype(np.int64) << 40) + name[order]
        keys = np.sort(keys, axis=1)[:, : self.k]
        some = keys < none
        self.best = np.where(some, most - (keys >> 40), -np.inf)
        self.held = np.where(some, keys & ((1 << 40) - 1), none)
        return True

    def finish(self, ids: np.ndarray, items: np.ndarray) -> None:
        self.merge()
        if self.own is not None:
            self.queries = self.own
            row, at = np.nonzero(np.isfinite(self.best))
            self.again = np.full(self.best.shape, -np.inf)
            self.again[row, at] = self.scores(row, items, np.searchsorted(ids, self.held[row, at]))

    def rows(self) -> pa.RecordBatch:
        self.merge()
        keep = np.isfinite(self.best).ravel()
        out = {"query_id": np.repeat(self.ids, self.k)[keep], "item_id": self.held.ravel()[keep], "score": self.best.ravel()[keep]}
        if self.own is not None:
            out["exact"] = self.again.ravel()[keep]
        return pa.RecordBatch.from_pydict(out)


class _Places(_Kernel):
    """How many items score above each query's true item, like it, and like it with a smaller id. Rows of queries hold
    the true item's id, its vector and the query."""

    def __init__(self, ids: np.ndarray, wide: np.ndarray, signs: bool):
        d = (wide.shape[1] - 1) // 2
        self.own, true, queries = wide[:, 0].astype(np.int64), wide[:, 1 : 1 + d], wide[:, 1 + d :]
        self.signs = signs
        super().__init__(ids, self.prepared(queries))
        self.truth = np.round((self.queries * self.prepared(true)).sum(axis=1), 9)
        self.greater, self.equal, self.before = (np.zeros(len(ids), np.int64) for _ in range(3))

    prepared = _Nearest.prepared

    def settle(self, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
        above = low > self.truth
        self.greater[above] += n
        return ~above & (high >= self.truth)

    def take(self, own: np.ndarray, ids: np.ndarray, items: np.ndarray, scores: np.ndarray, slack: np.ndarray) -> None:
        truth = self.truth[own]
        high = scores > np.nextafter((truth + slack).astype(np.float32), np.inf, dtype=np.float32)[:, None]
        self.greater[own] += np.count_nonzero(high, axis=1)
        near = (scores >= np.nextafter((truth - slack).astype(np.float32), -np.inf, dtype=np.float32)[:, None]) > high
        row, at = np.divmod(_few(near), len(ids))
        found = np.round(scores[row, at].astype(np.float64), 9) if self.signs else self.scores(own[row], items, at)
        same = found == truth[row]
        count = lambda kept: np.bincount(row[kept], minlength=len(own))
        self.greater[own] += count(found > truth[row])
        self.equal[own] += count(same)
        self.before[own] += count(same & (ids[at] < self.own[own[row]]))

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids, self.greater, self.equal, self.before)], names=["query_id", "greater", "equal", "before"])


def _spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _dealt(vectors: DataFrame, width: int, parts: int, part: str, other: str, others: int) -> DataFrame:
    """(cell, ids, vectors): rows of (id, vector) in matrices, dealt by id to parts; each goes to cells of all the others.
    Vectors that 32-bit floats hold travel as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1))
            if len(ids) and matrix.shape[1] != width:
                raise ValueError("vectors differ in length")
            with np.errstate(over="ignore"):
                single = matrix.astype(np.float32)
            mine = (_spread(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            rows = [np.flatnonzero(mine == p) for p in range(parts)]
            rows = {p: r for p, r in enumerate(rows) if len(r)}
            sent = single if np.array_equal(single, matrix) else matrix
            out = [list(rows), [ids[r].tobytes() for r in rows.values()], [sent[r].tobytes() for r in rows.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.binary(), pa.binary()))], names=[part, "ids", "vectors"])

    dealt = vectors.mapInArrow(run, f"{part} int, ids binary, vectors binary")
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("chunk", "share", "ids", "vectors")


def _table(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids and vectors of dealt rows, in the order of ids."""
    ids = [np.frombuffer(x, np.int64) for x in rows["ids"].to_pylist()]
    parts = [np.frombuffer(x.as_buffer(), np.float64 if len(x.as_buffer()) == 8 * width * len(i) else np.float32).reshape(len(i), -1) for x, i in zip(rows["vectors"], ids)]
    names, matrix = np.concatenate(ids), np.concatenate(parts)
    order = np.argsort(names, kind="stable")
    return names[order], matrix[order]


class Shape(NamedTuple):
    """Rows of a table of vectors, and components of each."""

    rows: int
    width: int


def shape(vectors: DataFrame) -> Shape:
    n, width = vectors.agg(F.count("*"), F.max(F.size(vectors.columns[1]))).first()
    return Shape(n, width or 0)


def grid(queries: Shape, items: Shape, cells: int, parallelism: int) -> tuple[int, int]:
    """(chunks of queries, shares of items): a chunk's queries and results and a share's items fit in a task, and there are
    enough pairs of a chunk and a share for all cores."""
    chunks = max(-(-queries.rows * 8 * (queries.width + 1 + 2 * cells) // CHUNK_BYTES), -(-queries.rows * cells // HELD), 1)
    shares = max(-(-items.rows * 8 * (items.width + 1) // SHARE_BYTES), 1)
    # more chunks cost no results; shares do
    chunks = max(chunks, min(-(-queries.rows // BLOCK), -(-3 * parallelism // shares)))
    return chunks, max(shares, min(-(-items.rows // (8 * BLOCK)), -(-3 * parallelism // chunks)))


def _through(kernel: Callable[..., _Kernel], queries: DataFrame, items: DataFrame, schema: str, cells: int, shapes: tuple[Shape, Shape] | None, counter: dict | None, whole_table: bool = False) -> DataFrame:
    """A kernel's rows for all queries over all items, a task's results together. cells: values of results that a task holds
    for a query; whole_table: tasks need all their items at once. counter gets accumulators met and skipped."""
    spark = queries.sparkSession
    counts = None
    if counter is not None:
        counts = counter["met"], counter["skipped"] = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(found: _Kernel) -> pa.RecordBatch:
        if counts:
            counts[0].add(found.met)
            counts[1].add(found.skipped)
        return found.rows()

    asked = shapes[0] if shapes else shape(queries)
    if asked.rows <= MOST_SENT and asked.rows * 8 * (asked.width + 1 + 2 * cells) <= BROADCAST_BYTES and not whole_table:
        rows = queries.toArrow().combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        matrix = _matrix(columns[1]) if len(rows) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((columns[0].to_numpy(zero_copy_only=False).astype(np.int64), matrix))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = kernel(*sent.value)
            for batch in batches:
                if batch.num_rows and len(found.ids):
                    vectors = found.prepared(_matrix(batch.column(1)))
                    for ids, part in _cells(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), vectors):
                        found.meet(ids, part)
            yield counted(found)

        return items.mapInArrow(whole, schema)

    held = shapes[1] if shapes else asked if items is queries else shape(items)
    chunks, shares = grid(asked, held, cells, spark.sparkContext.defaultParallelism)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def met(one: pa.Table, other: pa.Table) -> pa.Table:
        if not (one.num_rows and other.num_rows):
            return arrow.empty_table()
        found = kernel(*(x.astype(np.int64 if x.ndim == 1 else np.float64, copy=False) for x in _table(one, asked.width)))
        ids, matrix = _table(other, held.width)
        if (needed := found.distinct(matrix)) is not None and len(needed) < len(ids):
            found.met += len(found.ids) * (len(ids) - len(needed))
            found.skipped += len(found.ids) * (len(ids) - len(needed))
            ids, matrix = ids[needed], matrix[needed]
        for at in range(0, len(ids), 4 * BLOCK):
            for part in _cells(ids[at : at + 4 * BLOCK], found.prepared(matrix[at : at + 4 * BLOCK])):
                found.meet(*part)
        found.finish(ids, matrix)
        return pa.Table.from_batches([counted(found)])

    sides = [_dealt(queries, asked.width, chunks, "chunk", "share", shares), _dealt(items, held.width, shares, "share", "chunk", chunks)]
    # several times as many partitions as cells, so that few tasks get two
    one, other = (side.repartition(4 * chunks * shares, "chunk", "share").groupBy("chunk", "share") for side in sides)
    return one.cogroup(other).applyInArrow(met, schema)


def batch_topk(queries: DataFrame, items: DataFrame, k: int, signs: bool = False, exclude_self: bool = False, shapes: tuple[Shape, Shape] | None = None, counter: dict | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best items of every query; inputs are (id, vector).

    signs scores the components' signs: the number of equal ones. A task keeps the k best of each query over all its
    items, so the last ranking sees k rows for each query and task. shapes, of queries and items, are measured unless given. counter, a dict, gets accumulators of the pairs met
    and of those skipped by bounds.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    kernel = lambda ids, matrix: _Nearest(ids, matrix, k, signs, exclude_self)
    found = _through(kernel, queries, items, "query_id long, item_id long, score double", k, shapes, counter)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def agreements(kinds: dict[str, DataFrame], base: str, k: int) -> DataFrame:
    """(packing, overlap, agreement): what share of the base's k neighbours each kind's neighbours hold, mean over the
    rows; kinds are (id, vector). Every kind's neighbours are found once and meet in one aggregation."""
    size = shape(kinds[base])
    near = [batch_topk(v, v, k, exclude_self=True, shapes=(size, size)).select("query_id", "item_id", F.lit(1 << i).alias("kind")) for i, v in enumerate(kinds.values())]
    held = reduce(DataFrame.union, near).groupBy("query_id", "item_id").agg(F.bit_or("kind").alias("kinds"))
    names = list(kinds)
    has = lambda name: F.col("kinds").bitwiseAND(F.lit(1 << names.index(name))) != 0
    each = held.where(has(base)).select(F.explode(F.array_compact(F.array(*(F.when(has(n), F.lit(n)) for n in names)))).alias("packing"))
    rows = kinds[base].agg(F.count("*").alias("rows"))  # one row
    counted = each.groupBy("packing").agg(F.count("*").alias("overlap")).crossJoin(F.broadcast(rows))
    return counted.select("packing", "overlap", (F.col("overlap") / (F.col("rows") * k)).alias("agreement"))


def agreement(one: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """Mean share of the k best that two rankings have in common: overlap, queries, agreement."""
    both = one.select("query_id", "item_id").join(other.select("query_id", "item_id"), ["query_id", "item_id"])
    queries = one.select("query_id").distinct().agg(F.count("*").alias("queries"))
    return both.agg(F.count("*").alias("overlap")).join(queries, F.lit(True)).select("overlap", "queries", (F.col("overlap") / (F.col("queries") * k)).alias("agreement"))


def rerank(queries: DataFrame, items: DataFrame, candidates: int, k: int) -> DataFrame:
    """The k best by exact score among each query's candidates by signs."""
    if candidates < 1 or k < 1:
        raise ValueError("k must be at least 1")
    kernel = lambda ids, matrix: _Nearest(ids, matrix, candidates, True, False, exact=True)
    found = _through(kernel, queries, items, "query_id long, item_id long, score double, exact double", candidates, None, None, whole_table=True)
    ranked = lambda column: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(column), "item_id")).cast("long")
    first = found.withColumn("place", ranked("score")).where(F.col("place") <= candidates)
    scored = first.select("query_id", "item_id", F.col("exact").alias("score"))
    return scored.withColumn("rank", ranked("score")).where(F.col("rank") <= k)


def truth_places(queries: DataFrame, items: DataFrame, truth: DataFrame, signs: bool = False, counter: dict | None = None) -> DataFrame:
    """(query_id, greater, equal, before) of each query's true item in truth (query_id, item_id): how many items score
    higher, equal (itself included), and equal with a smaller id. Only counts leave the blocks."""
    paired = truth.join(queries.toDF("query_id", "q"), "query_id").join(items.toDF("item_id", "v"), "item_id")
    asked = paired.select(F.col("query_id"), F.concat(F.array(F.col("item_id").cast("double")), F.transform("v", lambda x: x.cast("double")), F.transform("q", lambda x: x.cast("double"))).alias("vector"))

    kernel = lambda ids, wide: _Places(ids, wide, signs)
    counts = _through(kernel, asked, items, "query_id long, greater long, equal long, before long", 3, None, counter)
    return counts.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("greater", "equal", "before")))


def group_places(sentences: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, greater, equal, before) over groups: how many groups of sentences (group_id, vector) hold a best score for
    the item that is higher than that of its own group (group_id = item_id), equal (itself included), and equal with a
    smaller id. Sentences are sorted by group; only counts leave a block, and one row an item for the first and the
    last group of each block, which other blocks may hold too."""
    own = sentences.join(items.select(F.col("id").alias("group_id"), F.col("vector").alias("item")), "group_id")
    truth = own.groupBy("group_id").agg(F.max(F.round(dot("vector", "item"), 9)).alias("truth")).withColumnRenamed("group_id", "id")
    asked = items.join(truth, "id").select("id", F.concat(F.array("truth"), F.transform("vector", lambda x: x.cast("double"))).alias("vector"))
    ranged = sentences.select("group_id", "vector").repartitionByRange("group_id").sortWithinPartitions("group_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, groups, vectors_, ids, wide in _matrices(batch):
                starts = np.flatnonzero(np.r_[True, np.diff(groups) != 0])
                best = np.maximum.reduceat(np.round(wide[:, 1:] @ vectors_.T, 9), starts, axis=1)
                names, mine = groups[starts], wide[:, :1]
                inner = np.s_[:, 1:-1]
                same = (best == mine)[inner]
                counts = [(best > mine)[inner].sum(axis=1), same.sum(axis=1), (same & (names[None, 1:-1] < ids[:, None])).sum(axis=1)]
                none = np.full(len(ids), np.nan)
                rows = [(ids, *counts, np.full(len(ids), -1), none, none)]
                for at in {0, len(starts) - 1}:
                    zero = np.zeros(len(ids), np.int64)
                    rows.append((ids, zero, zero, zero, np.full(len(ids), names[at]), best[:, at], wide[:, 0]))
                columns = [np.concatenate(c) for c in zip(*rows)]
                kinds = [pa.int64()] * 5 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "greater", "equal", "before", "group_id", "best", "truth"])

    found = block_pairs(asked, ranged).mapInArrow(run, "item_id long, greater long, equal long, before long, group_id long, best double, truth double")
    inner = found.where("group_id = -1 and isnan(best)").select("item_id", "greater", "equal", "before")
    edges = found.where("not isnan(best)").groupBy("item_id", "group_id").agg(F.max("best").alias("best"), F.max("truth").alias("truth"))
    same = F.col("best") == F.col("truth")
    edges = edges.select("item_id", (F.col("best") > F.col("truth")).cast("long").alias("greater"), same.cast("long").alias("equal"), (same & (F.col("group_id") < F.col("item_id"))).cast("long").alias("before"))
    return inner.union(edges).groupBy("item_id").agg(*(F.sum(c).alias(c) for c in ("greater", "equal", "before")))
