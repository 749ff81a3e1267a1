"""Operators against plain, slow versions of what they promise."""

import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vantle.llm import decontam, langid, neardup, packing, pii, queries, secret_scan, toxicity, warc

BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def new_words(rng, n):
    return [f"v{rng.integers(0, 10**9)}" for _ in range(n)]


def texts_of(spark, d=SMALL):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


def plain_best_fit(lengths, window):
    """Totals of the sequences: longest first, each into the fullest that it fits, or a new one."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, total in enumerate(open_) if total + n <= window]
        if fitting:
            open_[max(fitting, key=lambda i: open_[i])] += n
        else:
            open_.append(n)
    return sorted(open_)


def test_packing_is_plain_best_fit(spark):
    tokenizer = Tokenizer.from_file(BPE)
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts_of(spark).items()}
    found = queries.op1_packing(spark, SMALL).collect()
    totals = {}
    for r in found:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(ids), len(whole[r["doc_id"]])) == (r["length"], r["doc_tokens"]) and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        totals[r["sequence_id"]] = totals.get(r["sequence_id"], 0) + r["length"]
    assert sum(totals.values()) == sum(map(len, whole.values()))
    rest = [len(ids) % 2048 for ids in whole.values() if len(ids) % 2048]
    assert sorted(totals.values()) == sorted([2048] * sum(len(ids) // 2048 for ids in whole.values()) + plain_best_fit(rest, 2048))


def test_null_and_repeated_documents_are_packed(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (2, "a b")]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), BPE, RANKS).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in found) == [(0, 3), (1, 1), (1, 1), (2, 1), (2, 3)]


def overlaps(doc, item):
    """Whether any diagonal has a stretch that counts, by looking at all of them."""
    if 0 < len(item) < decontam.MIN_TOKENS:
        return any(doc[i : i + len(item)] == item for i in range(len(doc)))
    for d in range(-len(item), len(doc)):
        same = [doc[i + d] == x for i, x in enumerate(item) if 0 <= i + d < len(doc)]
        for i in range(len(same)):
            equal = 0
            for j in range(i, len(same)):
                equal += same[j]
                n = j + 1 - i
                if n >= 8 and equal >= 0.75 * n and (n >= len(item) / 2 or n >= 20):
                    return True
    return False


def test_decontamination_equals_brute_force(spark):
    """Items of 8 to 40 tokens, whole, in part, and with up to a quarter of the tokens changed; null and repeated ids."""
    rng = np.random.default_rng(3)
    items, texts = [], []
    for n in (8, 9, 10, 12, 16, 20, 30, 40) * 6:
        item = new_words(rng, n)
        items.append(item)
        for share in (0, 0.1, 0.25):
            part = list(item[: max(8, int(n * rng.uniform(0.6, 1)))])
            for i in rng.choice(len(part), int(share * len(part)), replace=False):
                part[i] = new_words(rng, 1)[0]
            texts.append(new_words(rng, 15) + part + new_words(rng, 9))
        texts.append(new_words(rng, 10) + item[: n // 3] + new_words(rng, 10))
    items += [items[0], ["a", "b"], new_words(rng, 3)]
    texts += [["x", "a", "b", "y"], items[-1], [], items[3]]
    rows = [(i if i % 50 else None, " ".join(t)) for i, t in enumerate(texts)] + [(7, None)]
    benchmark = spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(items)), (None, " ".join(items[5])), (99, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    names = [*range(len(items)), None]
    expected = {(rows[i][0], name) for i, t in enumerate(texts) for name, item in zip(names, [*items, items[5]]) if set(t) & set(item) and overlaps(t, item)}
    assert found <= expected and len(found) >= 0.97 * len(expected) and len(expected) > 140


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_personal(text):
    count = lambda x: sum(c in "0123456789" for c in x)
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= count(m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= count(m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_base_personal_data_is_what_plain_patterns_find(spark):
    rng = np.random.default_rng(5)
    texts = [t or "" for t in texts_of(spark).values()]
    texts += ["".join(rng.choice(list("ab1234567890 .-@+()%\n"), rng.integers(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(["4111 1111 1111 1111", "10.0.0.1", ".", "a@b.c", "@", "x", " ", "+1 (132) 555-1352", "-", "1"], 8)) for _ in range(2000)]
    for text in texts:
        assert pii.base_spans(text) == plain_personal(text)


def test_many_spans_do_not_hide_an_identifier():
    """Candidates beside many base spans, and a context word before long white space."""
    text = "10.0.0.1, " * 30 + "passport" + " " * 90 + "AB-1234567 end"
    taken = pii.base_spans(text)
    found = list(pii.candidates(text, taken))
    assert [text[s:e] for s, e in found] == ["AB-1234567"]
    words = [m.span() for m in re.finditer(r"\S+", text)]
    assert pii._contexts(text, words, *found[0])[0] == "passport 9"


def test_personal_data_with_null_ids_and_long_texts(spark):
    seeds = [(None if i == 3 else i, f"text holder email: user{i}@example.com tail", "en", 1) for i in range(20)]
    rows = [*seeds, (50, "text holder email: someone@intranet tail" + " word" * 50_000, "en", 1), (50, None, None, None), (51, "holder email: nothing here", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, key int")
    found = pii.find(df).collect()
    assert len(found) == len(rows) and sum(r["doc_id"] is None for r in found) == 1
    added = [s for r in found for s in r["spans"] if s["kind"].startswith("ctx-")]
    assert [rows[20][1][s["start"] : s["end"]] for s in added] == ["someone@intranet"]
    out = pii.redact(df)
    assert out.columns == df.columns and out.where("doc_id = 50 and text like '%[EMAIL]%'").count() == 1


def plain_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_base_secrets_are_what_plain_patterns_find(spark):
    rng = np.random.default_rng(6)
    texts = [t or "" for t in texts_of(spark).values()]
    pieces = ["token", "PASSWORD", "api_key", "Secret", "=", ": ", '"', "'", "abc", "9f" * 13, "AKIA" + "Z9" * 8, "AKIA", " ", "é", "0123456789abcdef", "/+"]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 14))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = secret_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "base").collect()
    for r in found:
        assert [(s["start"], s["end"], s["kind"]) for s in r["base"]] == plain_secrets(texts[r["doc_id"]])


def test_copied_examples_and_live_secrets(spark):
    """A generic token that many owners hold is an example, one that stays with its owner is live; base spans stay."""
    copied, own, common = "Ab1" * 12, "Xy7" + "Qw3eR" * 7, "0123456789abcdef" * 2
    rows = [(i, f"key {copied} and {common}", f"owner{i}", 1, "x") for i in range(5)] + [(9, f"key {own} end", "owner9", 1, "x"), (9, f"key {own} end", "owner9", 1, "x"), (10, None, None, None, None), (None, "", "o", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, hash string")
    found = secret_scan.scan(df).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] < 5:
            assert not r["added"] and (r["n_live"], r["n_example"]) == (0, 2) and [s["kind"] for s in r["base"]] == ["hex"]
        elif r["doc_id"] == 9:
            assert [s["value"] for s in r["added"]] == [own] and r["n_live"] == 1
        else:
            assert not r["added"] and not r["base"]


def test_generic_tokens_that_meet_base_spans_do_not_count(spark):
    """Overlaps from either side, against a look at every pair."""
    rng = np.random.default_rng(7)
    pieces = ["Zz9-" * 9, "0123456789abcdef" * 2, "token=", " ", "Q", "Ab1_" * 8, "password: abcdefgh", "!"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(300)]
    found = secret_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        text = texts[r["doc_id"]]
        generic = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_-]{32,}", text) if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
        base = plain_secrets(text)
        assert [(s["start"], s["end"]) for s in r["generic"]] == [(s, e) for s, e in generic if not any(b[0] < e and s < b[1] for b in base)]


def test_secrets_are_found_in_time_that_grows_with_the_matches(spark):
    text = " ".join(f"{i:024x}" for i in range(60_000))
    began = time.perf_counter()
    r = secret_scan.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).first()
    assert (r["n"], r["last"]["end"]) == (60_000, len(text)) and time.perf_counter() - began < 60


def paths(token, model):
    """Scores of all ways to read a token, by trying all."""
    A, place = toxicity.ALPHABET, toxicity._place
    best = (-np.inf, "")
    choices = []
    for c in token:
        options = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")]
        choices.append([("put", *o) for o in options] + [("repeat", *o) for o in options] if options else [("drop", "", toxicity.DROP)])
    for way in itertools.product(*choices):
        word, score, fine = "", 0.0, True
        for kind, letter, cost in way:
            if kind == "drop":
                score += cost
            elif kind == "repeat":
                fine &= word[-1:] == letter
                score += cost + toxicity.REPEAT
            else:
                a, b = (place(x) if x else 0 for x in (word[-2:-1], word[-1:]))
                score += cost + model[(a * A + b) * A + place(letter)]
                word += letter
        a, b = (place(x) if x else 0 for x in (word[-2:-1], word[-1:]))
        score += model[(a * A + b) * A]
        if fine and score > best[0]:
            best = (score, word)
    return best


def test_viterbi_is_exact():
    rng = np.random.default_rng(9)
    model = np.log(rng.dirichlet(np.full(toxicity.ALPHABET, 0.3), toxicity.ALPHABET**2) + 1e-6).ravel().tolist()
    for _ in range(150):
        token = "".join(rng.choice(list("aabbc1|!0@.-"), rng.integers(1, 9)))
        assert toxicity.decode(token, model) == paths(token, model)[1], token
    began = time.perf_counter()
    assert len(toxicity.decode("ab1" * 30_000, model)) <= 90_000 and time.perf_counter() - began < 20


def test_disguised_toxic_words_count(spark):
    """Learned plain, found in disguise; learned from the right rows only."""
    rng = np.random.default_rng(10)
    words = "river stone garden window market yellow simple walking morning people".split()
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(words, 12)) + (" vilebrute" if toxic else "")))
        labels.append((i, int(toxic)))
    plain = [(1000, "the v1l3brut3 here"), (1001, "such a v.i.l.e.b.r.u.t.e here"), (1002, "a viiiilebrute"), (1003, "stone garden"), (1004, None), (1004, "stone garden"), (None, "stone garden")]
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows + plain], "doc_id long, text string, score double, predicted int")
    found = toxicity.score(docs, spark.createDataFrame([(*x, "k") for x in labels], "doc_id long, toxic int, text string")).collect()
    by = {r["doc_id"]: r for r in found if r["doc_id"] not in (None, 1004)}
    assert len(found) == len(rows) + len(plain) and all(by[i]["predicted"] == 1 for i in (1000, 1001, 1002)) and by[1003]["predicted"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in by.values())


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(11)
    net, windows, labels = langid.ByteNet(3, 1), rng.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(5), labels]).mean()
    for name, g in net.gradients(windows, labels).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-6
        up = loss()
        net.p[name][at] = before - 1e-6
        down = loss()
        net.p[name][at] = before
        assert np.isclose((up - down) / 2e-6, g[at], rtol=1e-3, atol=1e-6), name


def test_language_of_texts_without_letters_and_of_repeated_rows(spark):
    rows = [(i, "the quick brown fox and the dog" if i % 2 else "der schnelle braune fuchs und der hund", "en" if i % 2 else "de") for i in range(80)]
    odd = [(900, "½ ² ① 12 _", "en"), (901, "中", None), (902, None, "en"), (903, "und der hund " * 20_000, None), (903, "and the dog", None), (None, "the dog and the fox", None)]
    found = langid.identify(spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert by[900] == by[902] == ["und"] and by[901][0] in ("en", "de") and sorted(by[903]) == ["de", "en"] and by[None] == ["en"]
    assert all(by[i] == ["en" if i % 2 else "de"] for i in range(80))


def test_warc_repeats_long_pages_and_clashing_columns(spark):
    long = "<p>é</p>" * 400_000
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (3, "u", "x"), (3, "u", "x"), (4, None, None), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, capture string, payload int")
    found = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect())
    n = len(long.encode())
    assert found == [(0, "revisit", 3, 1), (1, "revisit", 2, n), (1, "revisit", 2, n), (2, "response", None, n), (3, "response", None, 1), (3, "response", None, 1), (4, "response", None, 0)]


def test_every_capture_has_its_request_and_metadata(spark):
    found = queries.op10_warc(spark, SMALL).select("page_id", "payload_bytes", "capture.*").collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(found) == len(pages)
    for r in found:
        assert r["request"]["record_id"] == f"<urn:capture:{r['page_id']}:request>" and r["request"]["note"].startswith("GET ")
        assert r["metadata"]["note"] == f"payload-bytes: {len((pages[r['page_id']]['html'] or '').encode())}"


def test_records_without_a_main_record_are_reported(spark):
    whole = warc.transaction("1", "http://a/", b"x", None)
    parts = list(warc.members(whole))
    import gzip

    segment = whole + gzip.compress(parts[0].replace(b"capture:1:response", b"capture:7:response"))
    found = {r["record_id"]: r for r in warc.captures(warc.records(spark.createDataFrame([(bytearray(segment),)], "content binary"))).collect()}
    assert found["<urn:capture:7:response>"]["kind"] == "orphan" and found["<urn:capture:7:response>"]["request"] is not None
    assert found["<urn:capture:1:response>"]["kind"] == "response" and len(found) == 2


def test_members_of_large_files_take_linear_time():
    import gzip
    import os

    member = gzip.compress(os.urandom(1 << 14), 1)
    began = time.perf_counter()
    assert sum(1 for _ in warc.members(member * 4000)) == 4000 and time.perf_counter() - began < 10
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(member[:-4]))


def test_hot_pivots_are_dealt(spark, monkeypatch):
    """More partners of one text than a share holds: links stay those of brute force."""
    monkeypatch.setattr(neardup, "PARTNERS", 3)
    rng = np.random.default_rng(12)
    base = new_words(rng, 60)
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: 60 - i % 9] + new_words(rng, i % 9))) for i in range(1, 30)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    linked = {i for i, t in rows if 100 * len(cut(t) & cut(rows[0][1])) >= 75 * len(cut(t) | cut(rows[0][1]))}
    assert linked <= {r["doc_id"] for r in found if r["component_id"] == 0}


def test_pipeline_against_plain_stages(spark):
    """Nulls, empty texts, repeated ids with equal and unlike texts, copies without ids, a leaked item, personal data."""
    import corpus_pipeline

    rng = np.random.default_rng(13)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    english = lambda n: " ".join(rng.choice("the and of to in that was for with his they from this have not but which she".split(), n)) + " " + " ".join(new_words(rng, 20))
    a, b, c, d = (english(60) for _ in range(4))
    rows = [(5, a), (3, a + " one"), (7, b), (7, b), (7, c), (None, a), (None, d), (None, d + " x"), (8, None), (9, ""), (10, "1234"), (11, english(30) + " " + item), (None, item), (12, english(40) + " mail me@example.org")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns, name
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = [(3, a + " one"), (7, b), (7, c), (12, rows[-1][1].replace("me@example.org", "[EMAIL]"))]
    assert sorted((i, t) for i, t in out if i is not None) == sorted(expected)
    assert [t for i, t in out if i is None] in ([d], [d + " x"])
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    tokenizer = Tokenizer.from_file(BPE)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in out)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id = -1"), SMALL).count() == 0, name


def test_long_documents_make_more_packing_groups(spark, monkeypatch):
    """Groups hold no more pieces on average than stated, whatever the documents' lengths; nulls and no rows at all too."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    rows = [(1, "a b " * 50_000), (2, None), (None, ""), (3, "x"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = packing.pieces(docs, BPE, RANKS)
    assert cut.count() / packing.group_count(docs) <= 10 and packing.group_count(docs.limit(0)) == 1
    out = packing.pack_documents(docs, BPE, RANKS).collect()
    assert sum(r["length"] for r in out) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] * (2 if r["doc_id"] == 3 else 1) for r in out}.values())
    assert len({r["sequence_id"] >> 32 for r in out}) > 1
