"""Captures of repeated ids, digests by other means, and columns whose names meet those of the operators."""

import base64
import hashlib
from collections import Counter

from vantle.llm import pii, queries, warc

SMALL = "/root/testdata/sf0.001"


def test_captures_of_one_id_keep_their_own_records(spark):
    rows = [(1, "http://a/x", "one"), (1, "http://a/y", "two"), (1, "http://a/z", "three!"), (1, "http://a/z", "three!"), (2, "http://b/", "one"), (None, "http://c/q", "two"), (None, "http://c/r", "two"), (5, "http://d/5", "two"), (5, "http://d/6", "two")]
    found = warc.round_trip(spark.createDataFrame([(*r, "n", True) for r in rows], "page_id long, url string, html string, name string, again boolean")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    path = lambda u: "/" + u.split("/", 3)[3]
    got = Counter((r["page_id"], r["capture"]["target_uri"], r["capture"]["request"]["note"], r["payload_bytes"], r["payload_digest"]) for r in found)
    assert got == Counter((i, u, f"GET {path(u)} HTTP/1.1", len(t), digest(t)) for i, u, t in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found) == Counter(
        {(1, 3, "revisit", 2): 1, (1, 3, "revisit", 5): 1, (1, 6, "response", None): 2, (2, 3, "response", None): 1, (None, 3, "revisit", 5): 2, (5, 3, "response", None): 2}
    )


def test_short_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (5, "u", "ß" * 2), (6, "u", "ß" * 2)]
    found = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 4).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "revisit", 6), (6, "response", None)}


def test_digests_and_owners_of_the_pages(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    last = {}
    for i, t in pages.items():
        last[t] = max(i, last.get(t, i))
    found = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op10_warc(spark, SMALL).collect()}
    owner = lambda i, t: ("response", None) if last[t] == i else ("revisit", last[t])
    assert found == {i: (len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), *owner(i, t)) for i, t in pages.items()}


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    extra = ["__row", "__key", "__added", "row", "doc", "key", "text_key", "added"]
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(["mail x@y.example.com now " + "word " * 40, None, "", "w " * 9000, "one two three four five six", "one two three four five six"])]
    rows += [(4, "one two three four five six", "en", "s4"), (4, "another text of that id", "en", "s4"), (None, "no id at all", None, None)]
    docs = spark.createDataFrame([(*r, *(f"{c}!" for c in extra)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in extra))
    for name in ("language", "near_duplicates", "decontamination", "personal_data"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        kept = out.collect()
        assert kept and all(tuple(r)[4:] == tuple(f"{c}!" for c in extra) for r in kept)
        assert dict(corpus_pipeline.STAGES)[name](spark, docs.where("false"), SMALL).count() == 0
    texts = [r["text"] for r in pii.redact(docs).collect()]
    assert len(texts) == len(rows) and any(t and t.startswith("mail [EMAIL] now") for t in texts)
