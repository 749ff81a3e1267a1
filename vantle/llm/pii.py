"""Personal data: fixed base patterns, and contextual patterns bootstrapped from what these find.

The base entities are seeds. The words before a seed make lexical patterns; the same words occur before other tokens or
groups of tokens with digits or an at sign, of whatever shape. Spark scores the graph of patterns and instances in turns: a pattern is as good
as the instances it finds, an instance as good as the patterns that find it. Patterns of high confidence with enough
distinct seeds then add the unseen identifiers that they find.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantle.llm.common import sized, text_key, written

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring, and what a pattern needs to add spans: confidence and distinct seeds.
TURNS, CONFIDENCE, LEAST_SEEDS = 3, 0.8, 5
#: Least characters of a candidate.
SHORTEST = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"[0-9]")
#: A token with a digit or an at sign, and the groups of digits and capitals after it: spaced phones, cards, IBANs.
_TOKEN = re.compile(
    r"(?<!\S)(\S*[0-9@]\S*)(?:(?<=[0-9A-Z)]) (?:[A-Z]{2,4} )?[(]?[0-9A-Z]*[0-9][0-9A-Z]*[)]?(?:[-./][0-9A-Z]+)*(?=$|\s|[.,;:!?)\]}\"'<])){0,8}"
)
_WORD = re.compile(r"\S+")
_LABEL = re.compile(r"[A-Za-z_]+[:=](?!/)")
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each local part is the run of its letters before an at sign, from the last match on."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, found.end()))
                free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base entities by start, then kind; code points, end exclusive."""
    spans = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                parts = [part.lstrip("0") for part in m[0].split(".")]
                if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                    spans.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of identifiers outside the spans taken, which are sorted."""
    at, n = 0, 0
    ends = list(accumulate((e for _, e, _ in taken), max))
    while m := _TOKEN.search(text, at):
        start, end = m.span()
        while n < len(taken) and ends[n] <= start:
            n += 1
        met = _first_met(taken, n, start, end)
        if met and (met[0] <= start or not text[met[0] - 1].isspace()):  # on behind the token where the span ends
            at = met[1]
            while at < len(text) and not text[at].isspace():
                at += 1
            continue
        at = end = met[0] if met else end
        value = text[start:end]
        if label := _LABEL.match(value.lstrip(_EDGES)):
            start += len(value) - len(value.lstrip(_EDGES)) + label.end()
            value = text[start:end]
        start += len(value) - len(value.lstrip(_EDGES))
        end = start + len(text[start:end].rstrip(_EDGES + " "))
        if start and text[start - 1] == "(" and text.find(")", start, end) >= 0:
            start -= 1
        if end - start >= SHORTEST:
            yield start, end


def _first_met(taken: list[tuple[int, int, str]], n: int, start: int, end: int) -> tuple[int, int, str] | None:
    """The first span from n on that overlaps (start, end)."""
    while n < len(taken) and taken[n][0] < end:
        if taken[n][1] > start:
            return taken[n]
        n += 1
    return None


def _contexts(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """Lexical patterns of an identifier: one or two words before it, and whether it holds an at sign. words are the
    places of all words of the text."""
    k = bisect_left(words, (start, 0))  # the first word that starts no earlier
    before = [text[s : min(e, start)].strip(_EDGES).lower() for s, e in words[max(0, k - 2) : k]]
    form = "@" if "@" in text[start:end] else "9"
    return [f"{' '.join(before[-n:])} {form}" for n in (1, 2) if len(before) >= n and before[-1]]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    seen = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.int64()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        spans, instances = [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            found = base_spans(text)
            spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            items = [(s, e, k) for s, e, k in found]
            if _DIGIT.search(text) or "@" in text:
                items += [(s, e, None) for s, e in candidates(text, sorted(found))]
            words = [m.span() for m in _WORD.finditer(text)] if items else []
            instances.append(
                [{"start": s, "end": e, "kind": k, "value": xxhash.xxh3_64_intdigest(text[s:e].lower()) - 2**63, "patterns": p} for s, e, k in items if (p := _contexts(text, words, s, e))]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(instances, pa.list_(seen))],
            names=["doc_id", "key", "base", "instances"],
        )


_SPAN = "struct<start:int,end:int,kind:string>"


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, base spans and instances (seeds and candidates) with their patterns."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_extract, f"doc_id long, key binary, base array<{_SPAN}>, instances array<struct<start:int,end:int,kind:string,value:long,patterns:array<string>>>")


def scored_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind) of high confidence, from the graph of patterns and distinct values in found.instances."""
    rows = found.select(F.explode("instances").alias("i")).select("i.kind", "i.value", F.explode("i.patterns").alias("pattern"))
    edges = written(rows.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "graph")
    kinds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS)
    # each pattern stands for the kind that most of its seeds have
    kinds = written(kinds.groupBy("pattern").agg(F.max_by("kind", F.struct("seeds", "kind")).alias("meant")), "meant")
    edges = written(edges.join(kinds, "pattern"), "edges")
    scores = edges.groupBy("value", "meant").agg(F.max((F.col("kind") == F.col("meant")).cast("double")).alias("score")).na.fill(0.0, ["score"])
    for _ in range(TURNS):
        of = edges.join(scores, ["value", "meant"])
        patterns = of.groupBy("pattern", "meant").agg(F.avg("score").alias("confidence"))
        patterns = written(patterns, "patterns")
        miss = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        again = edges.join(patterns, ["pattern", "meant"]).groupBy("value", "meant").agg((1 - miss).alias("by_patterns"), F.max((F.col("kind") == F.col("meant")).cast("double")).alias("seed"))
        scores = again.select("value", "meant", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("by_patterns") * 0.5).alias("score"))
    return patterns.where(F.col("confidence") >= CONFIDENCE).select("pattern", F.col("meant").alias("kind"))


def added_spans(found: DataFrame) -> DataFrame:
    """(key, added): for texts with such, the spans that contextual patterns add; kinds have ctx- before them."""
    good = scored_patterns(found)
    rows = found.select("key", F.explode("instances").alias("i")).where("i.kind is null").select("key", "i.start", "i.end", F.explode("i.patterns").alias("pattern"))
    rows = rows.join(good, "pattern").groupBy("key", "start", "end").agg(F.min("kind").alias("kind"))
    span = F.struct("start", "end", F.concat(F.lit("ctx-"), "kind").alias("kind"))
    return rows.groupBy("key").agg(F.collect_set(span).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and spans (base ones and added ones) of every row of docs.

    A null text counts as empty and has no spans. Rows that repeat are each reported; null ids stay null. Only doc_id
    and text are read. An empty table gives an empty one.
    """
    found = written(extracted(docs), "extracted")
    added = sized(written(added_spans(found.where(F.size("instances") > 0)), "added"))
    every = F.concat("base", F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)")))
    return found.select("doc_id", "key", "base").join(added, "key", "left").select("doc_id", "key", "base", every.alias("spans"))


def _joined(spans, kinds=KINDS):
    """kind:start:end by start, then kind."""
    place = lambda s: F.array_position(F.array(*map(F.lit, [*kinds, *(f"ctx-{k}" for k in kinds)])), s["kind"])
    sortable = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(sortable), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find()."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list) -> str:
    """The text with its spans replaced by their kinds in brackets; overlapping spans are replaced together."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], "[" + s["kind"].removeprefix("ctx-").upper() + "]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all rows and columns stay, whatever their names. Null texts stay null."""
    found = written(extracted(docs), "extracted")
    added = written(added_spans(found.where(F.size("instances") > 0)), "added")
    names = docs.columns
    text_at, place = names.index("text"), len(names)
    keyed = docs.toDF(*(f"c{i}" for i in range(place))).withColumn("key", text_key(f"c{text_at}"))
    joined = keyed.join(sized(added), "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, more in zip(batch.column(text_at), batch.column(place).to_pylist()):
                text = text.as_py()
                spans = [{"start": s, "end": e, "kind": k} for s, e, k in base_spans(text or "")] + (more or [])
                out.append(redacted(text, spans) if spans else text)
            columns = [pa.array(out, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:place])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return joined.mapInArrow(run, plain).toDF(*names)
