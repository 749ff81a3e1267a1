"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets confirm.

A document's set is its distinct five-word shingles. Equal sets form a class at once. Of each class, MinHash samples
are cut into bands for candidates, and folded into an odd sketch: a bitmap of parities, where the number of ones in
the XOR of two sketches tells the size of the samples' symmetric difference, most precisely where similarity is high.

Links are found without all pairs of a group. Each bucket names a pivot, and each member is confirmed against its
pivots. What then still lies in several components of one bucket is compared sketch by sketch, in blocks of bounded
size, and every pair that a link could hide in is confirmed, a few for each member at first and then all. Only then is
a bucket done.

A second bitmap of parities is folded from the whole set. The ones in an XOR of two never outnumber the elements in
which the sets differ, so it rules out, with certainty, most pairs of a large group that lie a little below 0.75.

With 32 bands of 4 samples, a pair at the similarity of 0.75 is missed with probability 0.684**32 = 5e-6, and the
sketch (estimate below SIFT) hides it with a probability below 1e-5; higher similarities are safer. Confirmation is
exact on 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import dropped, mixed, odd_numbers, sized, text_key, word_hashes, written
from vantle.llm.graph import connected_components

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_LONGS = 16
#: Longs of the bitmap folded from the whole set, behind those of the sketch.
WHOLE_LONGS = 32
#: Pairs whose estimated similarity is below this aren't confirmed: over four standard deviations below 0.75.
SIFT = 0.55
#: Members of a bucket in one block of the comparison sketch by sketch.
BLOCK = 1024
#: Pairs that share one copy of a text, about.
PARTNERS = 256

_PLACES = odd_numbers(WORDS, 11)
_SAMPLES = odd_numbers(SAMPLES, 12)[:, None]
_SHIFTS = odd_numbers(SAMPLES, 13)[:, None]
_BAND = odd_numbers(ROWS, 14)[None, :]
#: The most ones in the XOR of two sketches whose estimate reaches SIFT: n/2 * (1 - (1 - 2/n)**(2 * samples * (1 - s)))
MOST_ONES = int(32 * SKETCH_LONGS * (1 - (1 - 2 / (64 * SKETCH_LONGS)) ** (2 * SAMPLES * (1 - SIFT)))) + 1


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; of the whole sequence where it is shorter."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mixed((words * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
    m = n - WORDS + 1
    out = words[:m] * _PLACES[0]
    for k in range(1, WORDS):
        out += words[k : k + m] * _PLACES[k]
    return np.unique(mixed(out))


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    low = None
    for at in range(0, len(found), 4096):
        part = (found[None, at : at + 4096] * _SAMPLES + _SHIFTS).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A key of each band; keys of different bands don't meet."""
    keys = mixed(low.reshape(BANDS, ROWS))
    return mixed((keys * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parities of how many samples fall on each bit, as longs."""
    at = mixed(low + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * SKETCH_LONGS)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * SKETCH_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def whole_parity(found: np.ndarray) -> np.ndarray:
    """Parities of how many elements of the whole set fall on each bit, as longs."""
    at = (found >> np.uint64(17)) % np.uint64(64 * WHOLE_LONGS)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * WHOLE_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, digest, keys, sketches = [], [], [], []
        for text in batch.column(2):
            found = shingles(text.as_py())
            size.append(len(found))
            if len(found):
                low = samples(found)
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(bands(low))
                sketches.append(np.concatenate([odd_sketch(low), whole_parity(found)]))
            else:
                digest.append(None)
                keys.append(None)
                sketches.append(None)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, longs), pa.array(sketches, longs)],
            names=["doc_id", "key", "n_shingles", "digest", "bands", "sketch"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, n_shingles, and for documents with words: digest of the set, band keys, odd sketch."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_signatures, "doc_id long, key binary, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, first = None, None
    for batch in batches:
        linked = []
        for a, one, other in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if a != last:
                last, first = a, shingles(one.as_py())
            second = shingles(other.as_py())
            common = len(np.intersect1d(first, second, assume_unique=True))
            linked.append(common > 0 and DENOMINATOR * common >= NUMERATOR * (len(first) + len(second) - common))
        kept = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["a", "b", "linked"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of pairs (a, b) after a look at both full sets. texts: (id, text), one row for each id.

    The partners of an a that has many are dealt to shares of about PARTNERS, each of which meets a copy of its text."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    used = texts.join(sized(ids), "id", "left_semi")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("shares"))
    many = sized(written(shares.where("shares > 1"), "many"))
    dealt = pairs.join(many, "a", "left").withColumn("share", F.pmod(F.hash("b"), F.coalesce("shares", F.lit(1)))).drop("shares")
    copies = used.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(many, "a", "left")
    copies = copies.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    second = dealt.join(used.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(copies, ["a", "share"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long, linked boolean")


def _possible():
    """Whether the sketches and sizes of a and b leave a link possible."""
    ones = lambda span: sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in span), F.lit(0))
    differ, both = ones(range(SKETCH_LONGS, SKETCH_LONGS + WHOLE_LONGS)), F.col("n_a") + F.col("n_b")
    return (ones(range(SKETCH_LONGS)) <= MOST_ONES) & (DENOMINATOR * (both - differ) >= NUMERATOR * (both + differ))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each (bucket, left, right) of sorted rows."""
    held: list[dict] = []
    key = None

    def whole():
        return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "left", "right", "side", "id", "n", "component")}
        col["sketch"] = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        new = np.flatnonzero((np.diff(col["bucket"]) != 0) | (np.diff(col["left"]) != 0) | (np.diff(col["right"]) != 0)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            mine = (col["bucket"][at], col["left"][at], col["right"][at])
            if held and mine != key:
                yield whole()
                held = []
            key = mine
            held.append({k: v[at:end] for k, v in col.items() if k not in ("bucket", "left", "right")})
    if held:
        yield whole()


def _across(limit: int | None):
    """Of each block: pairs of different components where a link is possible, the limit best of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            x, y = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
            part, whole = g["sketch"][y, :SKETCH_LONGS], g["sketch"][y, SKETCH_LONGS:]
            out: list[tuple] = []
            for k in x:
                differ = np.bitwise_count(whole ^ g["sketch"][k, SKETCH_LONGS:]).sum(axis=1, dtype=np.int64)
                both = g["n"][y] + g["n"][k]
                good = np.flatnonzero((g["component"][y] != g["component"][k]) & (DENOMINATOR * (both - differ) >= NUMERATOR * (both + differ)))
                if not len(good):
                    continue
                good = good[np.bitwise_count(part[good] ^ g["sketch"][k, :SKETCH_LONGS]).sum(axis=1) <= MOST_ONES]
                cut = limit is not None and len(good) > limit
                if cut:
                    good = good[np.argsort(differ[good], kind="stable")[:limit]]
                ids, own = g["id"][y[good]], g["id"][k]
                out.append((np.minimum(ids, own), np.maximum(ids, own), np.full(len(good), cut)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b", "cut"])

    return run


def links(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) over the classes' representatives in signed (id, n, bands, sketch)."""
    rows = written(signed.select("id", F.explode("bands").alias("bucket")), "buckets")
    shared = rows.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last")
    members = written(rows.join(shared.drop("last"), "bucket"), "members")
    dropped(rows)
    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    sketch = signed.select("id", "n", "sketch")
    pairs = pairs.join(sketch.toDF("a", "n_a", "sketch_a"), "a").join(sketch.toDF("b", "n_b", "sketch_b"), "b")
    pairs = written(pairs.where(_possible()).select("a", "b"), "pairs")
    tested = written(confirmed(pairs, texts), "tested")
    dropped(pairs)
    found = written(connected_components(tested.where("linked")), "components")
    limit: int | None = 16
    while True:
        proposed = _between(members, sketch, found, limit)
        if proposed is None:
            return found
        proposed = written(proposed.groupBy("a", "b").agg(F.max("cut").alias("cut")), "proposed")
        left = written(proposed.select("a", "b").join(tested, ["a", "b"], "left_anti"), "untested")
        if not left.isEmpty():
            again = written(confirmed(left, texts), "tested")
            tested = tested.union(again)
            if not again.where("linked").isEmpty():
                found = written(connected_components(tested.where("linked")), "components")
        more = not proposed.where("cut").isEmpty()
        dropped(proposed, left)
        if not more:
            return found
        limit = None if limit > 1000 else limit * 16


def _between(members: DataFrame, sketch: DataFrame, found: DataFrame, limit: int | None) -> DataFrame | None:
    """Pairs (a, b, cut) across components within buckets, block by block; None if no bucket spans two components.

    The largest component of a bucket isn't compared with itself: it is dealt to blocks by a hash, and so are all
    other members, and each block of these meets each block of either kind.
    """
    own = members.join(found.toDF("id", "component"), "id", "left")
    own = own.select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sizes = own.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("top"))
    spread = written(spread.where("parts > 1").select("bucket", "total", F.col("top.component").alias("main"), F.col("top.n").alias("n_main")), "spread")
    if spread.isEmpty():
        return None
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    rows = own.join(spread, "bucket").withColumn("minor", F.col("component") != F.col("main")).join(sketch, "id")
    rows = rows.withColumn("of_main", blocks(F.col("n_main"))).withColumn("of_minor", blocks(F.col("total") - F.col("n_main")))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    mine = lambda n: F.pmod(F.hash("id"), n)
    # blocks of others are at left; at right are blocks of the largest component (from 0) and of others (from -1 down)
    both_sides = F.concat(span(F.col("of_main")), F.transform(span(F.col("of_minor")), lambda k: -1 - k))
    place = lambda side, left, right: F.struct(F.lit(side).alias("side"), left.alias("left"), right.alias("right"))
    as_left = F.transform(both_sides, lambda k: place(0, mine(F.col("of_minor")), k))
    as_right = F.transform(span(F.col("of_minor")), lambda k: place(1, k, F.when(F.col("minor"), -1 - mine(F.col("of_minor"))).otherwise(mine(F.col("of_main")))))
    at = F.explode(F.when(F.col("minor"), F.concat(as_left, as_right)).otherwise(as_right))
    dealt = rows.select("bucket", "id", "n", "component", "sketch", at.alias("at")).select("bucket", "at.*", "id", "n", "component", "sketch")
    dealt = dealt.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "side")
    return dealt.mapInArrow(_across(limit), "a long, b long, cut boolean")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Null and empty texts, and texts without words, have no shingles and stand alone. Rows with a null doc_id are linked
    with nothing and kept, with a null component. Rows that repeat a doc_id stand for one document: whatever links to
    one of them is linked to all. Only doc_id and text are read. An empty table gives an empty one.
    """
    signed = written(signatures(docs), "signatures")
    usable = signed.where("doc_id is not null and digest is not null")
    classes = usable.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "sketch"), "doc_id").alias("r"))
    classes = written(classes.select("digest", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands"), F.col("r.sketch").alias("sketch")), "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    #: A representative's text: of rows that repeat its id, one with the class's set
    repeated = not usable.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        classes, texts = _told_apart(usable, docs, classes)
        grouped = links(classes.select("id", "n", "bands", "sketch"), texts)
        equal = classes.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        names = grouped.join(classes.select(F.col("id").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
        linked = grouped.join(names, "component").join(classes.select(F.col("id").alias("node"), "doc_id"), "node").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
        of = usable.join(equal.join(classes.select("id", "digest"), F.col("a") == F.col("id")).select("digest", F.col("b").alias("first")), "digest")
        found = connected_components(linked.union(of.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))))
        whole = found.toDF("doc_id", "component_id")
        out = signed.join(whole, "doc_id", "left")
    else:
        found = links(classes.select("id", "n", "bands", "sketch"), texts.withColumnRenamed("doc_id", "id"))
        of_class = classes.select("digest", "id").join(found.toDF("id", "found"), "id", "left").select("digest", F.coalesce("found", "id").alias("component_id"))
        out = signed.join(of_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _told_apart(usable: DataFrame, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """classes and texts under ids that no two classes share, where documents with one id have different texts. Of each
    class one text is taken, that with the least key."""
    ids = classes.withColumnRenamed("id", "doc_id").withColumn("id", F.xxhash64("digest"))
    firsts = written(usable.groupBy("digest").agg(F.min("key").alias("key")).select("key", F.xxhash64("digest").alias("id")), "firsts")
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).join(sized(firsts), "key")
    return ids, texts.groupBy("id").agg(F.first("text").alias("text"))
