"""Sharding, ranked search and the filter audit against plain versions of what they promise."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vantle.llm import audit, queries, retrieval, sharding

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, key string, row int, shard string, part string, score string, `class` string, length int, mask int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", 1, "x", "p", "s", "c", 3, 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Été", "中文", "x-y", "A1"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 400, 120)]
    texts += texts[:20] + [texts[0]] * 30 + [None, None, "", "", " \n", "$", "a", "a", "b " * 9000, "b " * 9000 + "c", "B" * 300]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    return out + [(5, texts[0], "s0"), (5, texts[5], None), (None, texts[0], "s1"), (None, texts[7], None), (None, None, None), (3, "b " * 9000, "s1")]


def size(text):
    return len((text or "").encode()) + 16


def plain_capacity(sizes, shards):
    """The smallest capacity for sizes in order, one group after the other."""
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            used, held = (used + 1, s) if held + s > middle else (used, held + s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 7, 40, 200])
def test_sharding(spark, rows, shards):
    docs = frame(spark, rows)
    found = [r.asDict() for r in sharding.sharded(docs, shards).collect()]
    expected = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    of = {}
    for r in found:
        of.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(len(s) == 1 for s in of.values())
    slots, totals = {}, Counter()
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        totals[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

    groups = {}
    for r in sharding.keyed(docs).collect():
        groups[r["key"]] = groups.get(r["key"], 0) + r["size"]
    own = []
    for k, s in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if s * (shards - len(own)) <= sum(groups.values()) - sum(groups[o] for o in own):
            break
        own.append(k)
    rest = [s for k, s in sorted(groups.items()) if k not in own]
    capacity = plain_capacity(rest, shards - len(own))
    assert sorted(totals[k] for k in range(len(own))) == sorted(groups[k] for k in own)
    assert max((totals[k] for k in range(len(own), shards)), default=0) <= capacity
    got, cuts, least = sharding.partition(sharding.keyed(docs), shards)
    assert (sorted(got), least) == (sorted(own), capacity) and len(cuts) < shards


def test_a_coarse_start_gives_the_same_shards(spark, rows, monkeypatch):
    """Blocks of many groups are split until the capacity is exact."""
    keyed = sharding.keyed(frame(spark, rows))
    expected = sharding.partition(keyed, 9)
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 5)
    assert (sharding.partition(keyed, 9)[0], sharding.partition(keyed, 9)[2]) == (expected[0], expected[2])


def test_sharding_of_nothing_and_plan(spark, rows, capsys):
    assert sharding.sharded(frame(spark, rows).where("false")).count() == 0
    out = sharding.sharded(frame(spark, rows))
    out.explain()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", capsys.readouterr().out)


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranking(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item in {i for i, _ in items}:
        wanted = {t for i, text in items if i == item for t in terms(text)} & set(held)
        scored = []
        for i, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard_bytes,k", [(1 << 12, 5), (1 << 24, 50), (1, 3)])
def test_ranked_search(spark, rows, shard_bytes, k):
    items = [(1, "w1 w2 W3 Été"), (2, rows[4][1]), (2, "中文 a1"), (3, None), (4, "nowhere"), (None, "x y w9"), (6, "b b b c"), (7, "w1 w2 w3 été")]
    given = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, term int, shard int")
    found = retrieval.ranked(frame(spark, rows), given, k, shard_bytes).collect()
    assert Counter(map(tuple, found)) == plain_ranking([r[:2] for r in rows], items, k)


def test_ranked_search_of_the_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op12_ranked_search(spark, SMALL).collect())) == plain_ranking(docs, items, 50)


def test_ranked_search_of_nothing(spark, rows):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    docs = frame(spark, rows)
    assert retrieval.ranked(docs.where("false"), items).count() == retrieval.ranked(docs, items.where("false")).count() == 0
    assert retrieval.ranked(docs.where("text is null or text = ''"), items).count() == 0


def test_items_are_dealt_in_blocks(spark, rows, monkeypatch):
    items = [(i, f"w{i} w{i + 1} w{i + 2}") for i in range(30)]
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 700)
    found = retrieval.ranked(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
    assert Counter(map(tuple, found)) == plain_ranking([r[:2] for r in rows], items, 4)


def test_numbers_as_bytes():
    x = np.array([0, 1, 127, 128, 129, 16383, 16384, 2**31, 2**40 + 5] + list(range(300)))
    data, size = retrieval.varints(x)
    assert retrieval.numbers(data).tolist() == x.tolist() and size.sum() == len(data)


def test_blocks_below_the_threshold_stay_packed():
    """A common term's blocks beyond the first run can't pass the documents that hold the rare one as well."""
    shard = retrieval._Shard()
    for i in range(20_000):
        shard.add(i, "rare common" if i < 100 else "common " * (1 + i % 3))
    batch = shard.rows(0, 20_000, 40_000).to_pydict()
    rows = dict(zip(batch["term"], zip(batch["head"], batch["body"])))
    head, body = rows.pop(retrieval.DOCUMENTS)
    ids, factors = np.frombuffer(head, "<i8"), np.frombuffer(body, "<i8")
    lists = {t: retrieval.PostingList(*r, factors) for t, r in rows.items()}
    best = retrieval.Best(50)
    retrieval.search_shard([(lists[b"rare"], 5000), (lists[b"common"], 10)], ids, np.zeros(len(ids), bool), best)
    assert best.ids.tolist() == list(range(50))
    assert len(lists[b"common"].known) <= 3 < len(lists[b"common"].first)


def plain_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, bad = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = words(t)
        same = [j for j, u, _ in rows if (u or "") == t and j is not None]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(same) < i}
        fails.append((part or "", i, {k for k, v in f.items() if v}))
    out, shares = {}, Counter()
    for part in {p for p, _, _ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for p, i, f in fails if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                everyone = [f for p, _, f in fails if p == part]
                out[part, "".join(order), step] = (len(left), len(removed), sum(letter in f for _, f in gone), sum(f == {letter} for f in everyone), sum(i in good for i, _ in removed), sum(i in bad for i, _ in removed))
                gone += removed
                shares[part, letter] += len(removed)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("bits", [64, 3])
def test_filter_audit(spark, rows, bits, monkeypatch):
    monkeypatch.setattr(audit, "FIRST_BLOCK", 8)
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 150, 3)] + [(3, 0, 1), (None, 1, 1), (9, None, None), (999, 1, 1)]
    given = spark.createDataFrame([(i, None if q is None else int(q), None if x is None else int(x), 1) for i, q, x in labels], "doc_id long, quality int, toxic int, part int")
    found = audit.filter_audit(frame(spark, rows), given, bits).collect()
    values = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(found) == len(values) == 600 * len({s or "" for _, _, s in rows})
    assert values == plain_audit(rows, labels)


def test_filter_audit_of_nothing(spark, rows):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(frame(spark, rows).where("false"), labels).count() == 0
    assert audit.filter_audit(frame(spark, rows).drop("source"), labels.where("false")).count() == 600
