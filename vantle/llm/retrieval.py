"""Ranked lexical search: Block-Max WAND over compressed posting blocks.

Documents are indexed in shards of bounded size, cut inside the task that reads them, so that no posting list grows with
the corpus. A shard's list of a term is cut into blocks of BLOCK postings: document gaps and counts as variable-length
bytes, beside each block's first and last document and its largest impact, which stay readable without decoding.

A query keeps the k best scores so far. Shallow pointers move over the blocks' first and last documents alone; between
two block edges the sum of the weighted maxima of the blocks in force is fixed and bounds every document there. The
pivot is the first stretch whose sum can reach the threshold: all before it is passed by, and only blocks that reach
into a live stretch are decoded. A task keeps its threshold from shard to shard.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantle.llm.common import BROADCAST_BYTES, bounded, sized, written

TOP, BLOCK = 50, 128
#: UTF-8 bytes of the texts of a shard, at least; a shard holds one more text at most.
SHARD_BYTES = 16 << 20
#: Documents scored at once, at first and at most.
FIRST_RUN, LONGEST_RUN = 256, 4096
#: 1000 * ln(...) is a term's weight; these are the constants of its saturation.
SCALE, PER_COUNT, PER_LENGTH, LEAST_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50, 50

INDEX = "shard long, term binary, postings long, head binary, body binary"
#: The row of a shard that holds its documents: head is their ids, body their length factors, postings the ids not null.
DOCUMENTS = b""
HITS = "item_id long, doc_id long, score long"

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _TERM[b] else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The text's terms in UTF-8: maximal runs of digits, ASCII letters (lowered) and all that isn't ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as variable-length bytes, seven bits each, the last of a number above 127; and how many each takes."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[ends[has] - size[has] + k] = (x[has] >> np.uint64(7 * k)) & np.uint64(127)
    out[ends - 1] |= 128
    return out, size


def numbers(data: np.ndarray) -> np.ndarray:
    """What varints() wrote."""
    ends = np.flatnonzero(data >> 7)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def impact(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return SCALE * counts // (PER_COUNT * counts + PER_LENGTH * factors)


def _length_factor(n: int, documents: int, total: int) -> int:
    return 100 - LENGTH_SHARE + LEAST_LENGTH * n * documents // total


class _Shard:
    """Documents on their way into one shard of the index."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.held, self.counts, self.different = [], [], []
        self.bytes = 0

    def add(self, doc_id, text: str) -> None:
        found = Counter(terms(text))
        if found:
            self.ids.append(doc_id)
            self.lengths.append(found.total())
            self.held.extend(map(self.vocabulary.__getitem__, found))
            self.counts.extend(found.values())
            self.different.append(len(found))
        self.bytes += len(text)

    def rows(self, shard: int, documents: int, total: int) -> pa.RecordBatch:
        """The shard's rows, by term; its documents are numbered by ascending id, null ids last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        ids = [self.ids[i] for i in order]
        factors = np.array([_length_factor(self.lengths[i], documents, total) for i in order], np.int64)
        some = sum(i is not None for i in ids)
        # terms by their bytes, postings by term and document
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term, doc = rank[np.array(self.held)], number[np.repeat(np.arange(len(order)), self.different)]
        by = np.lexsort((doc, term))
        term, doc, n = term[by], doc[by], np.array(self.counts, np.int64)[by]
        lists = np.flatnonzero(np.diff(term, prepend=-1))
        place = np.arange(len(term)) - np.repeat(lists, np.diff(np.append(lists, len(term))))
        blocks = np.flatnonzero(place % BLOCK == 0)
        lasts = np.append(blocks[1:], len(term)) - 1
        gaps = np.diff(doc, prepend=0)
        gaps[blocks] = 0
        pairs = np.empty(2 * len(term), np.int64)
        pairs[::2], pairs[1::2] = gaps, n
        body, size = varints(pairs)
        ends = np.append(0, np.cumsum(size))
        starts = ends[2 * blocks]
        heads = np.stack([doc[blocks], doc[lasts], np.maximum.reduceat(impact(n, factors[doc]), blocks), starts], axis=1).astype("<i8")
        of = np.searchsorted(blocks, lists)
        edges, data = np.append(of, len(blocks)), body.tobytes()
        bytes_at = np.append(starts[of], len(data))
        packed = []
        for k in range(len(names)):
            head = heads[edges[k] : edges[k + 1]].copy()
            head[:, 3] -= bytes_at[k]
            packed.append(head.astype("<i4").tobytes())
        columns = [
            pa.array([shard] * (len(names) + 1), pa.int64()),
            pa.array([DOCUMENTS, *names], pa.binary()),
            pa.array([some, *np.diff(np.append(lists, len(term)))], pa.int64()),
            pa.array([np.array([i or 0 for i in ids], "<i8").tobytes(), *packed], pa.binary()),
            pa.array([factors.astype("<i8").tobytes(), *(data[bytes_at[k] : bytes_at[k + 1]] for k in range(len(names)))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "postings", "head", "body"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(terms(t.as_py())) for t in batch.column(0)]
        yield pa.RecordBatch.from_pydict({"documents": [sum(n > 0 for n in sizes)], "total": [sum(sizes)]})


def counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    bounded(docs.sparkSession)
    found = docs.select(F.col("text").cast("string")).mapInArrow(_count, "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def build(docs: DataFrame, documents: int, total: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents that hold a term: one row a shard and term, and one a shard for its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py() or "")
                if shard.bytes >= shard_bytes:
                    if shard.ids:
                        yield shard.rows(number, documents, total)
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield shard.rows(number, documents, total)

    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


class PostingList:
    """A term's blocks in a shard; decoded one by one, when asked for."""

    def __init__(self, head: bytes, body: bytes, factors: np.ndarray):
        table = np.frombuffer(head, "<i4").reshape(-1, 4).astype(np.int64)
        self.first, self.last, self.most = table[:, 0], table[:, 1], table[:, 2]
        self.ends = np.append(table[:, 3], len(body))
        self.body, self.factors = np.frombuffer(body, np.uint8), factors
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        found = self.known.get(k)
        if found is None:
            pairs = numbers(self.body[self.ends[k] : self.ends[k + 1]])
            docs = self.first[k] + np.cumsum(pairs[::2])
            found = self.known[k] = (docs, impact(pairs[1::2], self.factors[docs]))
        return found

    def add(self, scores: np.ndarray, start: int, end: int, weight: int) -> None:
        """Adds weighted impacts of the documents from start up to end."""
        for k in range(np.searchsorted(self.last, start), np.searchsorted(self.first, end)):
            docs, impacts = self.block(k)
            a, z = (0 if docs[0] >= start else np.searchsorted(docs, start)), (len(docs) if docs[-1] < end else np.searchsorted(docs, end))
            scores[docs[a:z] - start] += weight * impacts[a:z]


class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = 1  # a score that can still enter

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.null, null)
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def search_shard(lists: list[tuple[PostingList, int]], ids: np.ndarray, null: np.ndarray, best: Best) -> None:
    """Takes a shard's documents into best, by lists with their terms' weights."""
    first, last, most = (np.concatenate([getattr(x, name) * (w if name == "most" else 1) for x, w in lists]) for name in ("first", "last", "most"))
    edges = np.unique(np.concatenate((first, last + 1)))
    change = np.zeros(len(edges), np.int64)
    np.add.at(change, np.searchsorted(edges, first), most)
    np.subtract.at(change, np.searchsorted(edges, last + 1), most)
    bound = np.cumsum(change)[:-1]  # of the documents from one edge up to the next
    at, run = 0, FIRST_RUN
    while at < len(bound):
        live = bound[at:] >= best.least
        pivot = at + int(np.argmax(live))
        if not live[pivot - at]:
            return
        # the stretches behind the pivot that are live as well, up to a number of documents
        dead = np.flatnonzero(~live[pivot - at :])
        end = pivot + int(dead[0]) if len(dead) else len(bound)
        end = min(end, max(pivot + 1, int(np.searchsorted(edges, edges[pivot] + run, "right")) - 1))
        start, stop = int(edges[pivot]), int(edges[end])
        scores = np.zeros(stop - start, np.int64)
        for found, weight in lists:
            found.add(scores, start, stop, weight)
        enter = np.flatnonzero(scores >= best.least)
        if len(enter):
            best.add(scores[enter], ids[start + enter], null[start + enter])
        at, run = end, min(LONGEST_RUN, 2 * run)


def _search(queries: list[tuple], k: int):
    """Index rows, a shard's together, to the task's best of each query: (item_id, [(term, weight), ...])."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, tuple]]:
        now, rows = None, {}
        for batch in batches:
            for shard, term, *row in zip(*(batch.column(name).to_pylist() for name in ("shard", "term", "postings", "head", "body"))):
                if shard != now and rows:
                    yield rows
                    rows = {}
                now, rows[term] = shard, row
        if rows:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for rows in shards(batches):
            some, head, body = rows.pop(DOCUMENTS)
            ids, factors = np.frombuffer(head, "<i8"), np.frombuffer(body, "<i8")
            null = np.arange(len(ids)) >= some
            lists = {term: PostingList(head, body, factors) for term, (_, head, body) in rows.items()}
            for (_, wanted), found in zip(queries, best):
                held = [(lists[t], w) for t, w in wanted if t in lists]
                if held:
                    search_shard(held, ids, null, found)
        for (item, _), found in zip(queries, best):
            n = len(found.scores)
            yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(found.ids, mask=found.null), pa.array(found.scores)], names=["item_id", "doc_id", "score"])

    return run


def weighted(items: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """item_id, terms (term, weight): each item's terms that documents hold, with weights above 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = sorted(set(terms(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])

    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = written(source.mapInArrow(cut, "item_id long, term binary").distinct(), "terms")
    held = index.select("term", "postings").join(sized(written(found.select("term").distinct(), "sought")), "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("held") + 1))).cast("long")
    weights = held.groupBy("term").agg(F.sum("postings").alias("held")).select("term", weight.alias("weight")).where("weight > 0")
    return found.join(weights, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, equal scores by ascending id, null ids last.

    Every row of docs is a document, also where ids repeat; rows of items that repeat an id are one item with the terms of
    all. Null texts have no terms, and items without a term that documents hold have no rows. Other columns are ignored.
    Empty tables give an empty one. Items go to the tasks in blocks of at most about BROADCAST_BYTES of terms.
    """
    spark = docs.sparkSession
    documents, total = counts(docs)
    index = written(build(docs, documents, total, shard_bytes), "index")
    wanted = written(weighted(items, index, documents), "queries")
    size = wanted.agg(F.sum(F.aggregate("terms", F.lit(64), lambda n, t: n + F.octet_length(t["term"]) + 64).cast("long"))).first()[0] or 0
    blocks, tasks = 1 + size // BROADCAST_BYTES, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.hash("item_id"), F.lit(blocks)) == block).collect()
        queries = [(r["item_id"], [(bytes(t["term"]), t["weight"]) for t in r["terms"]]) for r in rows]
        names = spark.createDataFrame([(bytearray(t),) for t in {DOCUMENTS, *(t for _, held in queries for t, _ in held)}], "term binary")
        lists = index.join(F.broadcast(names), "term", "left_semi")
        found = lists.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_search(queries, k), HITS)
        hits = found if hits is None else hits.unionByName(found)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
