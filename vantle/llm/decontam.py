"""Benchmark decontamination by spaced seeds: masks that ignore some token positions join documents and test items.

Every mask hashes the tokens at its care positions, so a substitution at another position leaves the hash alone. Test
hashes make a Bloom filter, sized by their number up to a bound; document positions that pass it join the test hashes in
Spark, and the diagonals of the joined hits are verified token by token, with substitutions allowed. If the test set
outgrows the filter, more positions reach the join and the result stays the same. Items too short for this are found by
a hash of all their tokens, in the same way.

Seeds that many items hold, such as those of a phrase that all items of a benchmark begin with, would join every holder
among the documents with every item. Their places carry features instead: each token around the place with its distance
from it. A pair that overlaps there has a known number of equal features at least, so it shares one among the rarest
features of both sides (prefix filtering), and only pairs that do are verified.

With a quarter of the tokens changed at random, an overlap of 12 tokens keeps a whole seed with a probability of 0.99,
and one of 8 tokens, whose items get lighter masks, with 0.95.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import mixed, odd_numbers, sized, word_hashes, written

#: 1: the token counts, 0: it may differ. Items of fewer than LIGHT_TOKENS tokens have the lighter masks too.
MASKS = ("11111", "110111", "1101011", "11001011", "1010111")
LIGHT_MASKS, LIGHT_TOKENS = ("11011", "110101", "1100101", "10111", "1001011"), 12
#: Bits of the filter for each hash, bits at least and at most (powers of two), probes of each hash, bits of a segment.
BITS_EACH, LEAST_BITS, MOST_BITS, PROBES, SEGMENT = 128, 1 << 18, 1 << 29, 4, 1 << 16
#: Verified overlaps have at least so many tokens, such a share of equal ones, and such a share of the item,
#: or LONG_TOKENS tokens.
MIN_TOKENS, SIMILARITY, ITEM_SHARE, LONG_TOKENS = 8, 0.75, 0.5, 20
#: Seeds with more places than this in the items are joined by the tokens around them, so many on either side; pairs of
#: a document are verified in blocks of about so many items.
HOT, REACH, BLOCK = 64, 20, 1024
#: Places whose features a task holds at once.
_HELD = 1 << 13
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))
_PLACES = odd_numbers(16, 21)
_AROUND = odd_numbers(2 * REACH + max(map(len, MASKS + LIGHT_MASKS)), 22)
_BIT = np.uint8(128) >> np.arange(8, dtype=np.uint8)
#: Letters of scripts without spaces (Thai to Khmer, kana, Han), each a token; their punctuation and wide marks are spaces.
_SINGLE = re.compile("([\u0e01-\u0e4e\u0e81-\u0edf\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def tokens(text: str | None) -> np.ndarray:
    if text and not text.isascii():
        text = _SINGLE.sub(r" \1 ", _MARKS.sub(" ", text))
    return word_hashes(text, _PUNCTUATION)


def runs(found: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n tokens."""
    m = max(0, len(found) - n + 1)
    total = np.full(m, 100 + n, dtype=np.uint64)
    for k in range(n):
        total += found[k : k + m] * _PLACES[k]
    return total


def seeds(found: np.ndarray, light: bool) -> list[np.ndarray]:
    """The hashes of each mask, at every position where it fits."""
    out, placed = [], found * _PLACES[:, None][: max(map(len, MASKS + LIGHT_MASKS))]
    for n, mask in enumerate((*MASKS, *(LIGHT_MASKS if light else ()))):
        m = len(found) - len(mask) + 1
        if m > 0:
            total = np.full(m, n + 1, dtype=np.uint64)
            for k, care in enumerate(mask):
                if care == "1":
                    total += placed[k, k : k + m]
            out.append(total)
    return out


def probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The hashes' k-th places in the filter; bits is a power of two. The first one is cheap, and most fail it."""
    if k:
        hashes = mixed(hashes) if k < 3 else mixed(mixed(hashes))
    return ((hashes >> np.uint64(32 if k == 2 else 0)) & np.uint64(bits - 1)).view(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, data, found = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = tokens(text.as_py())
            if len(t):
                own = seeds(t, len(t) < LIGHT_TOKENS) if len(t) >= MIN_TOKENS else [runs(t, len(t))]
                ids.append(item)
                data.append(t.tobytes())
                found.append([{"seed": int(h), "at": i} for hs in own for i, h in enumerate(hs.view(np.int64))])
        kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(found, kind)], names=["item_id", "item", "seeds"])


def _hits(held: Callable[[], np.ndarray], short: list[int], light: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = held()
        bits = 8 * len(filled)

        def passed(hashes: np.ndarray) -> np.ndarray:
            good = np.arange(len(hashes))
            for k in range(PROBES):
                if not len(good):
                    break
                at = probe(hashes[good] if k else hashes, k, bits)
                good = good[_BIT[at & 7] & filled[at >> 3] > 0]
            return good

        for batch in batches:
            ids, data, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = tokens(text.as_py())
                hits = []
                for hashes in seeds(t, light):
                    at = passed(hashes)
                    hits += [{"seed": h, "at": i} for i, h in zip(at.tolist(), hashes[at].view(np.int64).tolist())]
                for n in short:  # one place in a text will do
                    hashes, at = np.unique(runs(t, n), return_index=True)
                    good = passed(hashes)
                    hits += [{"seed": h, "at": i} for i, h in zip(at[good].tolist(), hashes[good].view(np.int64).tolist())]
                if hits:
                    ids.append(doc)
                    data.append(t.tobytes())
                    found.append(hits)
            kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(found, kind)], names=["doc_id", "tokens", "hits"])

    return run


def _segments(bits: int):
    """Bits of the hashes as bitmaps (segment, bitmap), one for each segment with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            places = np.unique(np.concatenate([probe(hashes, k, bits) for k in range(PROBES)]))
            for segment in np.unique(places // SEGMENT).tolist():
                mine = held.setdefault(segment, np.zeros(SEGMENT, bool))
                mine[places[places // SEGMENT == segment] % SEGMENT] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(m).tobytes() for m in held.values()])], names=["segment", "bitmap"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of the bitmaps of each segment."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, bitmap in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bitmap = np.frombuffer(bitmap, np.uint8)
            held[segment] = held[segment] | bitmap if segment in held else bitmap
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([m.tobytes() for m in held.values()], pa.binary())], names=["segment", "bitmap"])


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """The packed filter of a column of hashes; at most MOST_BITS / 8 bytes reach the driver, whatever the table's size."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * hashes.count()):
        bits *= 2
    parts = hashes.mapInArrow(_segments(bits), "segment long, bitmap binary").repartition("segment").mapInArrow(_united, "segment long, bitmap binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():
        out[row["segment"] * SEGMENT // 8 : (row["segment"] + 1) * SEGMENT // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place (seed, at, need) of a row with its features: hashes of seed, need, a token nearby and its distance."""

    def batch_of(out):
        values = pa.array(np.concatenate([o[4] for o in out]).view(np.int64))
        ends = np.cumsum([0] + [len(o[4]) for o in out], dtype=np.int32)
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), values)], names=["row", "seed", "at", "need", "features"])

    for batch in batches:
        out = []
        for row, data, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            found = np.frombuffer(data.as_buffer(), np.uint64)
            for p in places:
                seed, at, need = (p[k].as_py() for k in ("seed", "at", "need"))
                low = max(0, at - REACH)
                part = found[low : at - REACH + len(_AROUND)]
                salt = np.uint64((seed + need * 0x9E3779B97F4A7C15) % 2**64)
                out.append((row, seed, at, need, mixed(part * _AROUND[low - at + REACH :][: len(part)] + salt)))
                if len(out) == _HELD:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)


def _featured(places: DataFrame, texts: DataFrame) -> DataFrame:
    """Places (row, seed, at, need) with features, by the tokens of texts (row, tokens)."""
    mine = places.groupBy("row").agg(F.collect_list(F.struct("seed", "at", "need")).alias("places")).join(texts, "row")
    return mine.select("row", "tokens", "places").mapInArrow(_around, "row long, seed long, at int, need int, features array<long>")


def _rarest(places: DataFrame, counts: DataFrame) -> DataFrame:
    """(feature, row, at): of the h features of a place that items have, the h - need + 1 that fewest items have.
    Places that share need features share one of these; where h is below need there are none."""
    known = places.select("row", "seed", "at", "need", F.explode("features").alias("feature")).join(counts, "feature")
    ordered = known.groupBy("row", "seed", "at", "need").agg(F.sort_array(F.collect_list(F.struct("n", "feature"))).alias("f"))
    return ordered.select("row", "at", F.explode(F.expr("slice(f.feature, 1, greatest(0, size(f) - need + 1))")).alias("feature"))


def _hot_pairs(at: DataFrame, flat: DataFrame, hot: DataFrame, hits: DataFrame, tests: DataFrame) -> DataFrame:
    """(doc_row, item_row, diagonal) of the places under hot seeds that may overlap."""
    held = flat.join(sized(hot), "seed").select(F.col("item_row").alias("row"), "seed", F.col("item_at").alias("at"), "need")
    held = written(_featured(held, tests.select(F.col("item_row").alias("row"), F.col("item").alias("tokens"))), "held")
    counts = written(held.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")), "counts")
    needs = written(held.select("seed", "need").distinct(), "needs")
    met = at.join(sized(needs), "seed").select(F.col("doc_row").alias("row"), "seed", F.col("doc_at").alias("at"), "need")
    met = _featured(met, hits.select(F.col("doc_row").alias("row"), "tokens"))
    ours = _rarest(met, sized(counts)).select("feature", F.col("row").alias("doc_row"), F.col("at").alias("doc_at"))
    theirs = _rarest(held, sized(counts)).select("feature", F.col("row").alias("item_row"), F.col("at").alias("item_at"))
    return ours.join(theirs, "feature").select("doc_row", "item_row", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int]:
    """(start in doc, tokens, equal tokens) of the segment with most equal tokens that keeps SIMILARITY."""
    best = (0, 0, 0)
    for d in diagonals.tolist():
        low, high = max(0, -d), min(len(item), len(doc) - d)
        same = doc[low + d : high + d] == item[low:high]
        total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - SIMILARITY, -SIMILARITY))])
        # from each new low, on to the last end where the total isn't lower still
        for start in np.flatnonzero(total == np.minimum.accumulate(total)):
            if start and total[start - 1] <= total[start]:
                continue
            end = len(total) - 1 - int(np.argmax(total[::-1] >= total[start] - 1e-9))
            equal = int(same[start:end].sum())
            if equal > best[2]:
                best = (int(low + d + start), int(end - start), equal)
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "start_token", "n_tokens", "n_equal", "item_tokens"]
    for batch in batches:
        out = []
        for doc_id, data, met in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "tokens", "met"))):
            doc = np.frombuffer(data, np.uint64)
            for m in met:
                item = np.frombuffer(m["item"], np.uint64)
                start, n, equal = best_overlap(doc, item, np.unique(m["diagonals"]))
                if n == equal == len(item) or n >= MIN_TOKENS and (n >= ITEM_SHARE * len(item) or n >= LONG_TOKENS):
                    out.append((doc_id, m["item_id"], start, n, equal, len(item)))
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _without(flat: DataFrame, hot: DataFrame) -> DataFrame:
    """Places under seeds that aren't hot."""
    return written(flat.join(sized(hot), "seed", "left_anti").select("seed", "item_row", "item_at"), "cold")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: doc_id, item_id, start_token, n_tokens, n_equal, item_tokens; one row for each pair.

    Tokens are words between white space, A-Z lowered, without outer punctuation, and single letters of scripts without
    spaces. Null and empty texts overlap with nothing. Items of fewer than MIN_TOKENS tokens overlap with documents
    that hold all their tokens in a row. Rows with a null doc_id are reported
    under it, rows that repeat an id or an item under theirs. Only doc_id, item_id and text are read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(items.mapInArrow(_items, "item_id long, item binary, seeds array<struct<seed:long,at:int>>"), "items")
    tests = items.withColumn("item_row", F.monotonically_increasing_id())
    tests = written(tests, "tests")
    size = (F.length("item") / 8).cast("int")
    least = F.least(F.lit(LONG_TOKENS), F.greatest(F.lit(MIN_TOKENS), F.ceil(size * ITEM_SHARE)))
    # equal tokens of an overlap at least; items below MIN_TOKENS meet under a hash of all their tokens, which is enough
    need = F.when(size >= MIN_TOKENS, F.ceil(least * SIMILARITY).cast("int"))
    flat = tests.select("item_row", need.alias("need"), F.explode("seeds").alias("s"))
    flat = written(flat.select("item_row", "need", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at")), "flat")
    hot = written(flat.where("need is not null").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("seed"), "hot")

    # bounded by MOST_BITS
    packed = docs.sparkSession.sparkContext.broadcast(bloom_filter(flat.select("seed")))
    lengths = [r[0] for r in tests.select(F.least(size, F.lit(LIGHT_TOKENS))).distinct().collect()]  # at most LIGHT_TOKENS
    short, light = sorted(n for n in lengths if n < MIN_TOKENS), any(MIN_TOKENS <= n < LIGHT_TOKENS for n in lengths)

    def find(batches):
        return _hits(lambda: packed.value, short, light)(batches)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = source.mapInArrow(find, "doc_id long, tokens binary, hits array<struct<seed:long,at:int>>")
    hits = written(hits.withColumn("doc_row", F.monotonically_increasing_id()), "hits")
    at = hits.select("doc_row", F.explode("hits").alias("h")).select("doc_row", F.col("h.seed").alias("seed"), F.col("h.at").alias("doc_at"))
    pairs = at.join(sized(_without(flat, hot)), "seed").select("doc_row", "item_row", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(at, flat, hot, hits, tests))
    pairs = written(pairs.groupBy("doc_row", "item_row").agg(F.collect_set("diagonal").alias("diagonals")), "pairs")
    # a document meets its items together, so that its tokens travel once; where these are many, in blocks
    many = written(pairs.groupBy("doc_row").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "many")
    dealt = pairs.join(sized(many), "doc_row", "left")
    block = F.pmod(F.xxhash64("item_row"), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("long"))
    met = dealt.withColumn("block", block).join(tests.select("item_row", "item_id", "item"), "item_row")
    met = met.groupBy("doc_row", "block").agg(F.collect_list(F.struct("item_id", "item", "diagonals")).alias("met"))
    whole = met.join(hits.select("doc_row", "doc_id", "tokens"), "doc_row")
    out = whole.select("doc_id", "tokens", "met").mapInArrow(_verify, "doc_id long, item_id long, start_token long, n_tokens long, n_equal long, item_tokens long")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", "n_tokens", "start_token", "item_tokens")).alias("b")).select("doc_id", "item_id", "b.start_token", "b.n_tokens", "b.n_equal", "b.item_tokens")
