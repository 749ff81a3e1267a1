"""Packing documents into training sequences: best-fit decreasing over a segment tree.

Overlong documents are first cut into full windows, each a sequence of its own. What is left of every document is
shorter than a window; these remainders are packed by best-fit decreasing, where a segment tree indexed by remaining
capacity finds the tightest open sequence. Remainders are dealt to packing groups of about GROUP_PIECES pieces by a
hash of the piece, so that no task's input grows with the corpus and no key can be hot; at that size the loss against
one single pack is a fraction of a sequence a group.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import bounded

WINDOW = 2048
#: Pieces in a packing group at most, on average.
GROUP_PIECES = 20_000
#: Entries of a worker's table of tokenized words before it starts anew.
WORD_TABLE = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_key long"


class WordTokenizer:
    """Token ids of whole texts, computed word by word and remembered for each word.

    The vocabulary's own splitting rule puts a boundary before every space that a non-space follows, so a text may be
    cut there and the parts tokenized alone. Texts with other runs of spaces are tokenized whole. Words go through the
    rank form of the same vocabulary, which gives the same ids in a third of the time; parts that may hold one of the
    tokenizer's special tokens go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)")
        self.words = self._by_ranks(ranks) if ranks else None
        self.known: dict[str, bytes] = {}
        self.stops = {c: self.part(c) for c in ",.;:!?"}

    @staticmethod
    def _by_ranks(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def part(self, text: str) -> bytes:
        if self.words is None or self.special.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.words.encode_ordinary(text)).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a space and the word. Letters alone are one pre-token; a stop or comma behind them is another."""
        if self.words is None or not word[:-1].isalpha():
            return self.part(" " + word)
        if word.isalpha():
            return array("I", self.words.encode_single_piece((" " + word).encode())).tobytes()
        if word[-1] in self.stops:
            stem = self.known.get(word[:-1])
            if stem is None:
                stem = self.known[word[:-1]] = self.word(word[:-1])
            return stem + self.stops[word[-1]]
        return self.part(" " + word)

    def text(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known = self.known
        first, *rest = text.split(" ")
        found = list(map(known.get, rest))
        if None in found:
            if len(known) > WORD_TABLE:
                known.clear()
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                word = rest[at]
                if not word or word[0].isspace():  # the text can't be cut at a space that another white space follows
                    return self.part(text)
                ids = found[at] = self.word(word)
                if len(word) <= 64:  # long words seldom return
                    known[word] = ids
        return (self.part(first) if first else b"") + b"".join(found)


_tokenizers: dict[tuple, WordTokenizer] = {}  # of this worker, from task to task


class BestFit:
    """Open sequences by remaining capacity; a segment tree over 0..window finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.open = [[] for _ in range(window + 1)]
        self.count = [0] * (2 * self.size)

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at //= 2

    def put(self, sequence: int, capacity: int) -> None:
        if capacity > 0:
            self.open[capacity].append(sequence)
            self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open sequence with the least capacity of at least need, and that capacity."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a right neighbour holds something
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._change(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length; sequences count from 0."""
    placed: list = [None] * len(lengths)
    tree, opened = BestFit(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        found = tree.take(need)
        if found is None:
            found, opened = (opened, window), opened + 1
        sequence, capacity = found
        placed[i] = (sequence, window - capacity)
        tree.put(sequence, capacity - need)
    return placed


def _cut(path: str, ranks: str | None, window: int, end_id: int, keep_ids: bool):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizers.get((path, ranks)) or _tokenizers.setdefault((path, ranks), WordTokenizer(path, ranks))
        row = 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece_key", *["ids"] * keep_ids)}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.text(text.as_py() or "") + tail
                total, row = len(ids) // 4, row + 1
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    values = (doc_id, start, len(part) // 4, zlib.crc32(part), total, zlib.crc32(f"{row}:{start}:{doc_id}".encode()), *[part] * keep_ids)
                    for column, value in zip(out.values(), values):
                        column.append(value)
            arrays = [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    return run


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and its end id, cut into full windows and one remainder.

    tokenizer is the vocabulary's file, ranks the same vocabulary's rank file (optional, for speed). A null text counts
    as empty: such a document is its end id alone. keep_ids adds the ids themselves (binary).
    """
    bounded(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_cut(tokenizer, ranks, window, end_id, keep_ids), PIECES + (", ids binary" if keep_ids else ""))


def group_count(docs: DataFrame, window: int = WINDOW) -> int:
    """Packing groups of GROUP_PIECES pieces at most, on average: an id takes a byte of text or more, so a document has no
    more full windows than its bytes make, and one remainder."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    return (n + (size or 0) // window) // GROUP_PIECES + 1


def pack(cut: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces(): gapless from 0 within a sequence, which holds at most window ids.

    Sequences are numbered without clashes but not densely. An empty table gives an empty one. Rows that repeat are
    packed as often as they occur; null ids are packed like others.
    """

    def place(key, pdf):
        group = int(key[0])
        lengths = pdf["length"].tolist()
        full = [i for i, n in enumerate(lengths) if n >= window]
        rest = [i for i, n in enumerate(lengths) if n < window]
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        opened = 0
        for i, (s, o) in zip(rest, best_fit_decreasing([lengths[i] for i in rest], window)):
            sequence[i], offset[i] = s, o
            opened = max(opened, s + 1)
        for n, i in enumerate(full):
            sequence[i] = opened + n
        return pdf.drop(columns=["piece_key", "pack_group"]).assign(sequence_id=sequence + (group << 32), offset=offset)

    names = [c for c in cut.columns if c != "piece_key"]
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    dealt = cut.withColumn("pack_group", F.pmod(F.hash("piece_key", "ids_crc32"), F.lit(max(1, groups))))
    return dealt.groupBy("pack_group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Documents as packed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Only doc_id and text are read; other columns of any name are ignored. The number of packing groups follows the number
    of pieces.
    """
    return pack(pieces(docs, tokenizer, ranks, window, end_id, keep_ids), group_count(docs, window), window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole sequences of ids from pack_documents(keep_ids=True): sequence_id, n_ids, ids (binary), padded to window
    unless the number of ids is a power of two."""

    def build(pdf):
        pdf = pdf.sort_values("offset")
        ids = b"".join(pdf["ids"])
        n = len(ids) // 4
        if n & (n - 1):
            ids += np.full(window - n, pad_id, dtype="<u4").tobytes()
        return pdf.head(1)[["sequence_id"]].assign(n_ids=n, ids=[ids])

    return packed.groupBy("sequence_id").applyInPandas(build, "sequence_id long, n_ids long, ids binary")

