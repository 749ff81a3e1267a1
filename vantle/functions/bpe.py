"""Byte-level pieces of captions under a given list of merges, with ids, remembered for each word of a worker."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantle.functions.text import PRETOKEN

#: A pre-token's last piece ends in this.
END = "</w>"
_MARKS = ("<|startoftext|>", "<|endoftext|>")
_TOKEN = regex.compile("|".join([*map(regex.escape, _MARKS), PRETOKEN]), regex.IGNORECASE)


def byte_letters() -> list[str]:
    """A printable letter for each byte: bytes that print in Latin-1 stand for themselves, others get letters from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


LETTERS = byte_letters()
_BYTES = {c: b for b, c in enumerate(LETTERS)}


def pieces(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The word's letters, its last marked as an end, merged by the lowest rank until none applies."""
    parts = [*word[:-1], word[-1] + END]
    while len(parts) > 1:
        ranked = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        if not ranked:
            break
        lowest = min(ranked)[0]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == lowest:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def vocabulary(merges: list[tuple[str, str]]) -> dict[str, int]:
    """Ids: letters in the order of their code points as bytes print, the same as ends, merges, then the marks."""
    own = sorted(LETTERS, key=lambda c: (ord(c) >= 256, ord(c)))
    names = [*own, *(c + END for c in own), *(a + b for a, b in merges), *_MARKS]
    return {name: i for i, name in enumerate(names)}


def tokens(text: str, ranks: dict[tuple[str, str], int], known: dict[str, list[str]]) -> list[str]:
    """Pieces of a cleaned text; known remembers words."""
    out: list[str] = []
    for word in _TOKEN.findall(text):
        if word in _MARKS:
            out.append(word)
            continue
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = pieces("".join(LETTERS[b] for b in word.encode("utf-8", "replace")), ranks)
        out += known[word]
    return out


#: Texts whose pieces are held as Python values at once, and letters of words remembered.
AT_ONCE, REMEMBERED = 64, 4 << 20


def counts(merges: list[tuple[str, str]]):
    """A UDF from cleaned text to the number of its pieces; null has none. No pieces of texts are held."""
    ranks = {pair: i for i, pair in enumerate(merges)}

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        letters = 0
        for texts in batches:
            out = []
            for text in texts:
                n = 0
                for match in _TOKEN.finditer(text.as_py() or ""):
                    word = match.group()
                    if word not in known:
                        if letters > REMEMBERED:
                            known.clear()
                            letters = 0
                        letters += len(word)
                        known[word] = len(tokens(word, ranks, {}))
                    n += known[word]
                out.append(n)
            yield pa.array(out, pa.int64())

    return run


def encode(merges: list[tuple[str, str]], ids: bool = False):
    """A UDF from cleaned text to its pieces, or to their ids; null gives none."""
    ranks, place = {pair: i for i, pair in enumerate(merges)}, vocabulary(merges)

    @F.arrow_udf(T.ArrayType(T.LongType() if ids else T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[str]] = {}
        kind = pa.list_(pa.int64() if ids else pa.string())
        for texts in batches:
            parts = []
            for at in range(0, len(texts), AT_ONCE):
                found = [tokens(text.as_py() or "", ranks, known) for text in texts[at : at + AT_ONCE]]
                parts.append(pa.array([[place[p] for p in f] for f in found] if ids else found, kind))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def decode(pieces_: list[str]) -> str:
    """The text that pieces stand for, with a space behind each word."""
    data = "".join(pieces_).replace(END, LETTERS[32])
    return bytes(_BYTES[c] for c in data).decode("utf-8", "replace")


def decode_ids(ids: list[int], merges: list[tuple[str, str]]) -> str:
    names = list(vocabulary(merges))
    return decode([names[i] for i in ids])
