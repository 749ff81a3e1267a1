"""Decontamination where many items of the benchmark hold the same phrase."""

import numpy as np
import pytest
from test_brute_force import new_words, overlaps

from vantle.llm import decontam


def templated(rng, items, docs, vocabulary):
    """Items that begin with one phrase of 8 words; documents with the phrase, some with a whole or changed item too.
    The other words are new ones, or follow the Zipf-Mandelbrot law over a vocabulary of the size given."""
    phrase, law = new_words(rng, 8), 1 / (np.arange(vocabulary) + 2.7)
    law /= law.sum()

    def rest(n):
        return [f"w{k}" for k in rng.choice(vocabulary, n, p=law)] if vocabulary else new_words(rng, n)

    held = [phrase + rest(int(rng.integers(34, 60))) for _ in range(items)]
    texts, planted = [], set()
    for i in range(docs):
        text = rest(10) + phrase + rest(40)
        if i % 10 == 0:
            k = int(rng.integers(items))
            part = list(held[k])
            for j in rng.choice(len(part), int((i % 3) * 0.1 * len(part)), replace=False):
                part[j] = new_words(rng, 1)[0]
            text = rest(7) + part + text
            planted.add((i, k))
        texts.append(text)
    return held, texts, planted


def joined(spark, rows, key):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{key} long, text string")


@pytest.mark.parametrize("vocabulary", [0, 5000])
def test_a_common_phrase_is_no_reason_to_verify_all_pairs(spark, monkeypatch, vocabulary):
    held, texts, planted = templated(np.random.default_rng(8), 500, 400, vocabulary)
    pairs, plain = [], decontam.written

    def counted(df, label):
        out = plain(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(decontam, "written", counted)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(joined(spark, texts, "doc_id"), joined(spark, held, "item_id")).collect()}
    assert planted <= found
    assert all(overlaps(texts[i], held[k]) for i, k in found)
    assert pairs[0] < 0.05 * 500 * 400


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_seeds_find_what_brute_force_finds(spark, monkeypatch, hot):
    """Every seed, or every seed of four places, counts as hot; lengths on both sides of every limit, repeated items."""
    monkeypatch.setattr(decontam, "HOT", hot)
    monkeypatch.setattr(decontam, "BLOCK", 2)
    rng = np.random.default_rng(9)
    phrase = new_words(rng, 9)
    items = [[*phrase[: int(rng.integers(5, 10))], *new_words(rng, n)] for n in (1, 3, 4, 7, 11, 15, 22, 31) * 4]
    items += [items[0], items[5], ["a", "b"], []]
    texts = [new_words(rng, 6) + phrase + new_words(rng, 20), phrase, ["x", "a", "b"], [], phrase * 4]
    for item in items[:32]:
        for share in (0, 0.2):
            part = list(item)
            for i in rng.choice(len(part), int(share * len(part)), replace=False):
                part[i] = new_words(rng, 1)[0]
            texts.append(new_words(rng, 5) + part + new_words(rng, 9))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(joined(spark, texts, "doc_id"), joined(spark, items, "item_id")).collect()}
    expected = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if set(t) & set(item) and overlaps(t, item)}
    assert found <= expected
    assert len(found) >= 0.98 * len(expected) and len(expected) > 300
