"""Language of whole texts by a byte convolutional network, trained in numpy and applied to batched windows.

Embedded bytes pass filters of several widths, a rectifier, the maximum over the window and a softmax. A text is cut
into windows of WINDOW bytes, all of them; a document's probabilities are the mean over its windows, weighted by their
bytes. Training takes windows of a bounded sample of labelled rows (SAMPLE_DOCS, chosen by a hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import bounded, held_out_column, share

WINDOW = 256
EMBED, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
#: At most about so many labelled documents are learned from, and so many windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 2
#: Passes over the sample, and training steps that small samples get at least.
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 300, 64, 0.006
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class ByteNet:
    """The network: parameters, forward pass and one training step."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"embed": draw(256, EMBED), "out": draw(len(WIDTHS) * FILTERS, classes), "bias": np.zeros(classes, np.float32)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = draw(w * EMBED, FILTERS)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def pooled(self, windows: np.ndarray):
        x = self.p["embed"][windows]
        parts, where, views = [], [], []
        for w in WIDTHS:
            view = np.concatenate([x[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)
            h = view @ self.p[f"conv{w}"]
            at = h.argmax(axis=1) if where is not None else None
            parts.append(np.take_along_axis(h, at[:, None], axis=1)[:, 0] + self.p[f"b{w}"])
            where.append(at)
            views.append(view)
        return np.maximum(np.concatenate(parts, axis=1), 0), where, views

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        x = self.p["embed"][windows]
        parts = []
        for w in WIDTHS:
            view = np.concatenate([x[:, k : x.shape[1] - w + 1 + k] for k in range(w)], axis=2)
            parts.append((view @ self.p[f"conv{w}"]).max(axis=1) + self.p[f"b{w}"])
        return softmax(np.maximum(np.concatenate(parts, axis=1), 0) @ self.p["out"] + self.p["bias"])

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        hidden, where, views = self.pooled(windows)
        d = softmax(hidden @ self.p["out"] + self.p["bias"])
        d[np.arange(len(labels)), labels] -= 1
        d /= len(labels)
        g = {"out": hidden.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (d @ self.p["out"].T) * (hidden > 0)
        rows = np.arange(len(labels))[:, None]
        for n, (w, at, view) in enumerate(zip(WIDTHS, where, views)):
            mine = back[:, n * FILTERS : (n + 1) * FILTERS]
            seen = view[rows, at]  # the input of each filter's maximum
            g[f"conv{w}"] = np.einsum("bfk,bf->kf", seen, mine)
            g[f"b{w}"] = mine.sum(axis=0)
            into = mine[:, :, None] * self.p[f"conv{w}"].T[None]
            for k in range(w):
                np.add.at(g["embed"], windows[rows, at + k], into[:, :, k * EMBED : (k + 1) * EMBED])
        return g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, classes: int, seed: int = 7) -> ByteNet:
    """A network fitted by Adam over shuffled batches."""
    net, rng = ByteNet(classes, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(labels)))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            for k, g in net.gradients(windows[pick], labels[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(data: bytes) -> np.ndarray:
    """All windows of the bytes; the last is filled with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), dtype=np.uint8).reshape(rows, WINDOW)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A few windows of each text, spread over it."""
    for pdf in batches:
        rows = []
        for lang, text in zip(pdf["lang"], pdf["text"]):
            if text and _LETTER.search(text):
                found = windows_of(text.encode("utf-8", "replace"))
                for k in range(min(SAMPLE_WINDOWS, len(found))):
                    rows.append((lang, found[k * len(found) // SAMPLE_WINDOWS].tobytes()))
        yield pd.DataFrame(rows, columns=["lang", "window"])


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], ByteNet | None]:
    """Languages and a network from (doc_id, text, lang): rows that aren't held out and have a language."""
    bounded(labelled.sparkSession)
    known = labelled.where("lang is not null").where(~held_out_column())
    total = known.count()
    if total > sample_docs:
        known = known.where(share("doc_id", sample_docs / total))
    found = known.select("lang", "text").mapInPandas(_sampled, "lang string, window binary").toPandas()
    langs = sorted(set(found["lang"]))
    if not langs:
        return [], None
    found = found.sort_values(["lang", "window"])
    data = np.frombuffer(b"".join(found["window"]), dtype=np.uint8).reshape(-1, WINDOW)
    return langs, train(data, found["lang"].map(langs.index).to_numpy(), len(langs))


def _predict(langs: list[str], net: ByteNet | None, text_at: int):
    def means(texts: list[bytes]) -> list[np.ndarray]:
        cut = [windows_of(t) for t in texts]
        all_of = np.concatenate(cut)
        p = np.concatenate([net.probabilities(all_of[at : at + 128]) for at in range(0, len(all_of), 128)])
        weight = np.concatenate([np.minimum(WINDOW, np.maximum(1, len(t) - WINDOW * np.arange(len(c)))) for t, c in zip(texts, cut)])
        ends = np.cumsum([len(c) for c in cut])
        sums = np.add.reduceat(p * weight[:, None], [0, *ends[:-1]])
        return list(sums / np.add.reduceat(weight, [0, *ends[:-1]])[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs_out, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            texts, rows, size = [], [], 0

            def flush():
                for row, p in zip(rows, means(texts) if texts else []):
                    best = int(p.argmax())
                    langs_out[row], scores[row] = langs[best], float(min(1.0, p[best]))

            for row, text in enumerate(batch.column(text_at)):
                text = text.as_py()
                if net is None or not text or not _LETTER.search(text):
                    continue
                texts.append(text.encode("utf-8", "replace"))
                rows.append(row)
                size += len(texts[-1])
                if size > 4 << 20:
                    flush()
                    texts, rows, size = [], [], 0
            flush()
            arrays = [*batch.columns, pa.array(langs_out, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], net: ByteNet | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) behind its columns, which must not have these names.

    und with score 0 stands for null texts and texts without a letter, and for all if there was nothing to learn from.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    bounded(docs.sparkSession)
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(_predict(langs, net, docs.columns.index(text)), schema)


def lettered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter."""
    bounded(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(_LETTER.search(t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from docs itself.

    Only doc_id, text and lang are read, and lang for learning alone. Null ids count as the empty text for the split.
    An empty table gives an empty one.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, net = fit(source)
    out = predict(source.select("doc_id", "text"), langs, net)
    return out.select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")
