"""What the operators share: the shared folder, written intermediate tables, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to a Python worker at once; they bound its memory, whatever the texts' lengths.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Shuffle files go when the query that made them is done; what a later query needs is a written table.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group of a written table: files can be read by several tasks, and writers stay small.
ROW_GROUP = 4 << 20
_written: dict[str, SparkSession] = {}
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset a temporary one of this machine, for
    a session that runs on this machine alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:  # a running session refuses a new value of this setting
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="vantle-"))
        found = _own_dir[0]
    return found.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """From now on this session's Arrow batches are as BATCHES says, unless it has sizes of its own."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there, and a lost executor costs nothing.

    The table is removed by dropped(), or when the process ends.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    if not _written:
        atexit.register(_remove)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        _delete(_written.pop(table.written_path), table.written_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already; the cluster's own clean-up takes over
            return


def held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves remainder 2 modulo 4; a null id counts as the empty text."""
    return zlib.crc32(("" if doc_id is None else str(int(doc_id))).encode()) % 4 == 2


def held_out_column(doc_id="doc_id"):
    """held_out as a Column."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


_FACTOR = 0x9E3779B97F4A7C15 * 0xD1342543DE82EF95 % 2**64 | 1
#: Bytes of a text hashed at once, at least, and of words that are hashed on their own.
_PIECE, _LONG = 1 << 20, 1024
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.default_rng(15).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 12)
        for k, base in enumerate((_FACTOR, pow(_FACTOR, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def word_hashes(text: str | None, stripped: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the text's words, in order: what stands between ASCII white space, A-Z lowered and other bytes as
    they are. stripped tells for each byte whether it is taken off the ends of words; words of such alone stay whole.

    All words are hashed together: a word's hash is a polynomial over its bytes, the difference of two running sums.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + _PIECE)
        while end < n and not _SPACE[data[end]]:
            end += 1
        out.append(_hashed(data[at:end], stripped))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out)


def _hashed(data: np.ndarray, stripped: np.ndarray | None) -> np.ndarray:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if stripped is not None and len(starts):
        kept = np.flatnonzero(~(stripped | _SPACE)[data])
        first = np.searchsorted(kept, starts)
        last = np.searchsorted(kept, ends) - 1
        some = first <= last
        starts[some], ends[some] = kept[first[some]], kept[last[some]] + 1
    forth, back = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * forth[: len(data)], out=total[1:])
    out = mixed((total[ends] - total[starts]) * back[starts])
    for k in np.flatnonzero(ends - starts > _LONG):  # long ones might be made to collide
        out[k] = xxhash.xxh3_64_intdigest(bytes(data[starts[k] : ends[k]]).lower())
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes up to which a table is sent to every executor; beyond, joins shuffle.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """A written table, or columns of the written table, marked for broadcast if the rows are measured to be small: by
    their bytes as JSON, which are no less than what they take in memory but for a constant a row. Where the files of the
    rows alone are larger, nothing is measured."""
    spark, path = df.sparkSession, (df if table is None else table).written_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if table is None and target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength() > BROADCAST_BYTES:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + F.lit(16))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def share(key: str, part: float):
    """Whether a row belongs to a fixed part (0 to 1) of all, by a 63-bit hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key), 1) < F.lit(int(part * 2.0**63) if part < 1 else 2**63 - 1)


def text_key(column: str = "text"):
    """A 16-byte key of a text, computed on the JVM; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")))
