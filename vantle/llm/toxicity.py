"""Toxicity of texts whose words may be disguised: a noisy channel restores them, a learned lexicon scores them.

A character language model (trigrams counted over all documents in Spark) and a channel of leetspeak, repetition and
spacing make a lattice for each disguised token; Viterbi decoding finds the likeliest plain word. A logistic model over
the words of the restored text, fitted on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import bounded, held_out_column, share, written

#: About so many labelled rows at most are learned from, whatever their number; the FEATURES words that speak most for a
#: label of 1 make up the lexicon.
SAMPLE_DOCS, FEATURES = 12_000, 256
THRESHOLD = 0.3
ALPHABET = 28
#: The letters that a disguise may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Log-probabilities of the channel: a letter for a sign, a repeated letter dropped, a separator dropped, a sign kept.
SWAP, REPEAT, DROP = -1.0, -0.4, -0.5
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~`+=/\\"
_THRICE = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .*_\-]){3,}[^\W_](?![^\W_])")
_PLACE = np.zeros(0x110000, dtype=np.uint8)
_PLACE[97:123] = np.arange(1, 27)
_PLACE[0xC0:0x2000] = 27


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**3, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if text:
                c = _PLACE[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
                total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["trigram", "n"])


def language_model(docs: DataFrame) -> list[float]:
    """Log-probability of each character after the two before it, from all texts of docs; 22 thousand numbers."""
    bounded(docs.sparkSession)
    found = docs.select(F.col("text").cast("string")).mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(ALPHABET**3, 0.1)
    counts[found["trigram"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=np.float64)
    counts = counts.reshape(-1, ALPHABET)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).ravel().tolist()


def _place(c: str) -> int:
    return int(_PLACE[ord(c)])


def decode(token: str, model: list[float]) -> str:
    """The likeliest plain word behind a token (lower case), by Viterbi over its whole lattice. States are the last two
    letters; each keeps its best path, as a chain of letters, so that time and memory grow with the token's length."""
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {("", ""): (0.0, None)}
    place = {"": 0}
    for c in token:
        options = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LEET.get(c, "")]
        for letter, _ in options:
            place.setdefault(letter, _place(letter))
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            if not options:
                new[a, b] = (score + DROP, path)
            for letter, cost in options:
                s = score + cost + model[(place[a] * ALPHABET + place[b]) * ALPHABET + place[letter]]
                if (b, letter) not in new or s > new[b, letter][0]:
                    new[b, letter] = (s, (path, letter))
                if b == letter and ((a, b) not in new or score + cost + REPEAT > new[a, b][0]):
                    new[a, b] = (score + cost + REPEAT, path)
        states = new
    path = max(states.items(), key=lambda x: (x[1][0] + model[(place[x[0][0]] * ALPHABET + place[x[0][1]]) * ALPHABET], x[0]))[1][1]
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Words of texts, disguised ones decoded; decodings of a worker are remembered up to a bound."""

    def __init__(self, model: list[float]):
        self.model, self.known = model, {}

    def plain(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[token] = decode(token, self.model)
        return found

    def words(self, text: str) -> set[str]:
        low = text.lower()
        raw = set(low.split())
        out = set()
        for w in raw:
            bare = w.strip(_EDGES)
            if bare.isalpha():
                out.add(bare)
                if len(bare) > 4 and _THRICE.search(bare):
                    out.add(self.plain(bare))
            elif bare:
                out.add(bare)
                out.add(self.plain(bare))
                whole = w.strip(".,;:?\"'")  # a sign at the edge may be a letter
                if whole != bare:
                    out.add(self.plain(whole))
            if bare and bare != w and any(c in LEET for c in (w[0], w[-1])):
                out.add(self.plain(w.rstrip("!.,").lstrip("(")))
        for m in _SPACED.finditer(low):
            out.add(self.plain(re.sub(r"[ .*_\-]", "", m[0])))
        # beginnings stand for the inflected forms of a word
        return out | {w[:4] + "*" for w in out if len(w) > 5} | {w[:6] + "*" for w in out if len(w) > 7}


def _worded(model: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            words = [sorted(restorer.words(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    return run


def fit(docs: DataFrame, labels: DataFrame, model: list[float], sample_docs: int = SAMPLE_DOCS) -> dict[str, float]:
    """Weights of words, and of "" for the bias, from labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out_column())
    total = known.count()
    if total > sample_docs:
        known = known.where(share("doc_id", sample_docs / total))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample of ids is bounded by sample_docs, so it may be broadcast
    rows = texts.join(F.broadcast(known), "doc_id").select("toxic", "text").mapInArrow(_worded(model), "toxic int, words array<string>")
    rows = written(rows.withColumn("copy", F.xxhash64("words")).dropDuplicates(["toxic", "copy"]), "sample")  # copies count once
    neg, pos = ((rows.where(F.col("toxic") == y).count()) for y in (0, 1))
    if not pos or not neg:
        return {"": 6.0 if pos else -6.0}
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("tox"), F.count("*").alias("n"))
    rate = (F.col("tox") / pos) / ((F.col("n") - F.col("tox") + 0.5) / neg)
    chosen = counts.where((F.col("tox") >= max(3, math.ceil(0.01 * pos))) & (F.length("word") > 1) & (rate >= 4))
    # a top-k of features: the words that speak most for a label of 1
    words = [r["word"] for r in chosen.orderBy(F.desc(F.col("tox") * F.log(rate)), "word").limit(FEATURES).select("word").collect()]
    held = F.array_intersect("words", F.array(*map(F.lit, words))) if words else F.expr("cast(array() as array<string>)")
    found = sorted((r["toxic"], sorted(r["held"])) for r in rows.select("toxic", held.alias("held")).collect())
    return train(found, words)


def train(rows: list[tuple[int, list[str]]], words: list[str]) -> dict[str, float]:
    """Logistic regression with a ridge, by Newton steps, over which of the words each row holds."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    place = {w: i + 1 for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words) + 1), dtype=np.float32)
    x[:, 0] = 1
    for i, (_, own) in enumerate(rows):
        x[i, [place[w] for w in own]] = 1
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[0] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * weight[:, None].astype(np.float32)).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return {"": float(beta[0])} | {w: float(beta[i]) for w, i in place.items()}


def _scores(model: list[float], weights: dict[str, float]):
    lexicon, bias = {w: v for w, v in weights.items() if w}, weights[""]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py()
                total = bias + sum(lexicon[w] for w in sorted(lexicon.keys() & restorer.words(text))) if text else bias
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts get the score of a text without any learned word. Labels with a null id or label are ignored;
    without labels of both kinds the score is the same for all. Only doc_id and text are read, and doc_id and toxic of
    labels. An empty table gives an empty one.
    """
    model = language_model(docs)
    weights = fit(docs, labels, model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = source.mapInArrow(_scores(model, weights), "doc_id long, score double")
    return out.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
