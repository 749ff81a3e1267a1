"""Media columns: payloads as 8-bit sound, cut by content into chunks that are stored once.

A text's bytes become the samples of a WAV file. A gear hash rolls over the file and cuts it where its low bits are
zero, so equal passages give equal chunks wherever they start. Digests of chunks are deduplicated by Spark joins: the
first place of a chunk owns it. Each file stores the chunks it owns in one run of bytes, and every file is an ordered
list of chunks, by which it is put together again and verified. Only bytes that another file owns are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import sized, text_key, written

BLOCK = 64
#: Least and most bytes of a chunk; a cut where so many low bits of the hash are zero: 1 in 1024.
LEAST, MOST, BITS = 512, 8192, 10
RATE = 8000
HEADER = 44
_GEAR = np.random.default_rng(31).integers(0, 2**32, 256, dtype=np.uint32)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these filled with zeros to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\0")


def wav(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples; their number is even here."""
    number = lambda n, size=4: n.to_bytes(size, "little")
    form = number(1, 2) + number(1, 2) + number(RATE) + number(RATE) + number(1, 2) + number(8, 2)
    return b"RIFF" + number(36 + len(samples)) + b"WAVEfmt " + number(16) + form + b"data" + number(len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of such a file, after a look at its header."""
    size = int.from_bytes(media[40:44], "little")
    if media[:4] != b"RIFF" or media[36:40] != b"data" or len(media) != HEADER + size:
        raise ValueError("not a WAV file of 8-bit samples")
    return media[HEADER:]


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the rolling hash of the last 32: the sum of each one's gear, shifted once for each step of age."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(media: bytes) -> list[int]:
    """Lengths of the media's chunks, in order."""
    h = gear(np.frombuffer(media, dtype=np.uint8))
    # the hash's upper bits depend on all 32 bytes
    places = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    out, at, n = [], 0, len(media)
    while n - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        end = min(int(places[k]) if k < len(places) else n, at + MOST, n)
        out.append(end - at)
        at = end
    if at < n:
        out.append(n - at)
    return out


def feature(samples: bytes) -> str:
    """Mean, deviation and rate of changes of the samples, rounded."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float64)
    changes = float((np.diff(x) != 0).mean())
    return f"{x.mean():.6f} {x.std():.6f} {changes:.6f}"


def _pieces(media: bytes, lengths: list[int]) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [media[e - n : e] for e, n in zip(ends, lengths)]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, lengths, digests = [], [], []
        for text in batch.column(2):
            n, data = padded(text.as_py())
            media = wav(data)
            lengths.append(cuts(media))
            digests.append([hashlib.blake2b(c, digest_size=16).digest() for c in _pieces(media, lengths[-1])])
            sizes.append(n)
        arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(lengths, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n_bytes", "lengths", "digests"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes each file stores: all of it, or without the chunks that others own."""
    for batch in batches:
        out = []
        for text, foreign, lengths in zip(batch.column("text"), batch.column("foreign").to_pylist(), batch.column("lengths").to_pylist()):
            media = wav(padded(text.as_py())[1])
            if foreign:
                skip = set(foreign)
                media = b"".join(c for i, c in enumerate(_pieces(media, lengths)) if i not in skip)
            out.append(media)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "owned"])


def _exported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that other files need: (digest, bytes)."""
    for batch in batches:
        digests, data = [], []
        for owned, lengths, foreign, wanted in zip(batch.column("owned"), *(batch.column(n).to_pylist() for n in ("lengths", "foreign", "wanted"))):
            skip, at, owned = set(foreign or ()), 0, owned.as_py()
            places = {}
            for i, n in enumerate(lengths):
                if i not in skip:
                    places[i] = (at, at + n)
                    at += n
            for w in wanted:
                digests.append(w["digest"])
                data.append(owned[slice(*places[w["at"]])])
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "bytes"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every file put together from what it owns and what was fetched, verified and measured."""
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for key, owned, lengths, fetched in zip(batch.column("key").to_pylist(), batch.column("owned"), batch.column("lengths").to_pylist(), batch.column("fetched").to_pylist()):
            media = owned.as_py()
            if fetched:
                got, at, parts = {f["at"]: f["bytes"] for f in fetched}, 0, []
                for i, n in enumerate(lengths):
                    if i in got:
                        parts.append(got[i])
                    else:
                        parts.append(media[at : at + n])
                        at += n
                media = b"".join(parts)
            data = samples_of(media)
            if hashlib.md5(data[: len(data.rstrip(b"\0"))]).digest() != key and not _ends_in_zeros(data, key):
                raise ValueError("a file read back isn't the one that was stored")
            rows.append((key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _ends_in_zeros(data: bytes, key: bytes) -> bool:
    """Whether the text itself ends in zero characters, so that the key is of more bytes."""
    return any(hashlib.md5(data[:n]).digest() == key for n in range(max(0, len(data) - BLOCK), len(data) + 1))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, n_bytes, and the ordered chunks' lengths and digests."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_recipes, "doc_id long, key binary, n_bytes long, lengths array<int>, digests array<binary>")


def store(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunk store (key, owned) and its index (key, keeper, lengths, foreign, refs, wanted), both written.

    found: recipes() of docs, written. The index has only files that share chunks or texts. Its size is counted before
    it is broadcast; a larger one is joined by a shuffle.
    """
    files = found.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("rows"), F.first("lengths").alias("lengths"), F.first("digests").alias("digests"))
    files = written(files, "files")
    places = files.select("key", F.posexplode("digests").alias("at", "digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("owner"), F.count("*").alias("uses")).where("uses > 1")
    shared = written(places.join(owners, "digest").select("key", "at", "digest", "owner"), "shared")
    foreign = shared.where(F.struct("key", "at") != F.col("owner"))
    refs = foreign.groupBy("key").agg(F.collect_list("at").alias("foreign"), F.collect_list(F.struct("at", "digest")).alias("refs"))
    wanted = foreign.select(F.col("owner.key").alias("key"), F.col("owner.at").alias("at"), "digest").distinct()
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "digest")).alias("wanted"))
    index = files.where("rows > 1").select("key").union(refs.select("key")).union(wanted.select("key")).distinct()
    index = index.join(files.select("key", "keeper", "lengths"), "key").join(refs, "key", "left").join(wanted, "key", "left")
    index = written(index, "index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.join(sized(index.select("key", "keeper", "lengths", "foreign"), index), "key", "left")
    # a file is stored by the row with the least id of those that share its text
    keeps = F.col("lengths").isNull() | F.col("doc_id").eqNullSafe(F.col("keeper"))
    kept = written(rows.where(keeps).select("key", "text", "foreign", "lengths").mapInArrow(_owned, "key binary, owned binary"), "store")
    if kept.count() != files.count():  # rows that repeat id and text, or have no id
        kept = written(kept.dropDuplicates(["key"]), "store")
    return kept, index


def read_back(kept: DataFrame, index: DataFrame) -> DataFrame:
    """Every stored file's features, after its chunks were fetched, put in order and verified."""
    exports = kept.join(sized(index.where("wanted is not null").select("key", "lengths", "foreign", "wanted"), index), "key")
    chunks = exports.mapInArrow(_exported, "digest binary, bytes binary")
    refs = index.where("refs is not null").select("key", F.explode("refs").alias("r")).select("key", "r.at", "r.digest")
    fetched = refs.join(chunks, "digest").groupBy("key").agg(F.collect_list(F.struct("at", "bytes")).alias("fetched"))
    marked = kept.join(sized(index.select("key", "lengths", F.col("refs").isNotNull().alias("parts")), index), "key", "left")
    kind = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    alone = marked.where(~F.coalesce("parts", F.lit(False))).withColumn("fetched", F.expr("cast(null as array<struct<at:int,bytes:binary>>)")).drop("parts")
    parted = marked.where(F.coalesce("parts", F.lit(False))).drop("parts").join(fetched, "key")
    return alone.unionByName(parted).mapInArrow(_features, kind)


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what was read back of every row of docs.

    A null text counts as empty: 64 zero samples. Equal texts share one stored file. Rows that repeat are each
    reported, null ids stay null. Only doc_id and text are read. An empty table gives an empty one.
    """
    found = written(recipes(docs), "recipes")
    kept, index = store(docs, found)
    features = written(read_back(kept, index), "features")
    return found.select("doc_id", "key", "n_bytes").join(features, "key").drop("key")
