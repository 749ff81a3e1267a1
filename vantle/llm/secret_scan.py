"""Secrets, natively: base patterns, and corpus-wide ownership that tells copied examples from live-looking ones.

Every step is a DataFrame function. Matches come from one regular expression a kind, their places from the lengths of
the pieces between them. Candidate hashes are then counted over the corpus by distinct repositories and owners: a
value that many owners hold is a copied example, one that stays with an owner and looks random is taken for live.
Generic random-looking tokens add spans only where that count calls them live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import sized, written

KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9_-]{32,}"
LEAST_VALUE = 6
#: More owners than this make a value a copied example; live values have so many different characters at least.
OWNERS, DIFFERENT = 2, 8

_SPAN = "struct<start:int,place:int,end:int,kind:string,value:string>"


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def _running(values: Column, combine) -> Column:
    """Running results of combine (associative) over an array, in as many passes as its length has binary digits."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def doubled(now, k):
        shift = F.pow(F.lit(2), k).cast("int")
        head = F.slice(now, 1, shift)
        tail = F.slice(now, shift + 1, F.size(now))
        return F.concat(head, F.zip_with(tail, F.slice(now, 1, F.size(now) - shift), combine))

    return F.aggregate(steps, values, doubled)


def _spans(text: Column, pattern: str, kind: str, place: int, group: int, possible: Column | None = None) -> Column:
    """All matches with their places; value is the group's text. A match starts behind all pieces and matches before."""
    found, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.transform(found, lambda m: F.length(m))
    # the piece behind the last match has no match of its own
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda s: F.length(s))
    ends = _running(F.zip_with(lengths, gaps, lambda n, g: n + g), lambda x, y: x + y)
    span = lambda r: F.struct((r["end"] - r["n"]).alias("start"), F.lit(place).alias("place"), r["end"].alias("end"), F.lit(kind).alias("kind"), r["v"].alias("value"))
    out = F.transform(F.arrays_zip(lengths.alias("n"), ends.alias("end"), values.alias("v")), span)
    return F.when(text.rlike(pattern) if possible is None else possible & text.rlike(pattern), out).otherwise(_none())


def _apart(spans: Column) -> Column:
    """Of spans sorted by start and place, those of the last place that overlap none of another: by the running maximum of
    the others' ends, and from behind the running minimum of their starts."""
    last = F.lit(_GENERIC_PLACE)
    ends = _running(F.transform(spans, lambda s: F.when(s["place"] < last, s["end"]).otherwise(0)), lambda x, y: F.greatest(x, y))
    starts = _running(F.transform(F.reverse(spans), lambda s: F.when(s["place"] < last, s["start"]).otherwise(2**31 - 1)), lambda x, y: F.least(x, y))
    rows = F.arrays_zip(spans.alias("s"), ends.alias("before"), F.reverse(starts).alias("behind"))
    free = F.filter(rows, lambda r: (r["s"]["place"] == last) & (r["before"] <= r["s"]["start"]) & (r["behind"] >= r["s"]["end"]))
    return F.transform(free, lambda r: r["s"])


_GENERIC_PLACE = 4


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, owner, repository, base spans and generic candidates of every row."""
    names = {c.lower() for c in docs.columns}
    column = lambda c: F.col(c).cast("string") if c.lower() in names else F.lit(None).cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column(owner).alias("owner"), column(repository).alias("repository"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    assign = F.filter(_spans(text, ASSIGN, "assign", 1, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    access = _spans(text, ACCESS, "access", 2, 0, text.contains("AKIA"))
    base = F.array_sort(F.concat(assign, access, _spans(text, HEX, "hex", 3, 0)))
    random = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    generic = F.filter(_spans(text, GENERIC, "generic", _GENERIC_PLACE, 0), lambda s: random(s["value"]))
    out = source.select("doc_id", "owner", "repository", base.alias("base"), generic.alias("generic"))
    apart = _apart(F.array_sort(F.concat("base", "generic")))
    return out.withColumn("generic", F.when((F.size("generic") > 0) & (F.size("base") > 0), apart).otherwise(F.col("generic")))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, different) of every candidate value, counted over the whole corpus."""
    rows = found.select("owner", "repository", F.explode(F.concat("base", "generic")).alias("s"))
    rows = rows.select("owner", "repository", F.sha2(F.col("s.value").cast("binary"), 256).alias("hash"), F.size(F.array_distinct(F.split("s.value", ""))).alias("different"))
    rows = rows.groupBy("hash", "owner", "repository").agg(F.max("different").alias("different"))
    rows = rows.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("different").alias("different"))
    return rows.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("different").alias("different"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, base and added spans with values, n_live and n_example of every row of docs.

    A null text counts as empty. A null or absent owner or repository counts as one. Rows that repeat are each
    reported. Columns besides the four named are ignored. An empty table gives an empty one.
    """
    found = written(scanned(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "scanned")
    with_any = found.where((F.size("base") > 0) | (F.size("generic") > 0))
    counts = written(ownership(with_any), "ownership")
    live = (F.col("owners") <= OWNERS) & (F.col("different") >= DIFFERENT)
    each = with_any.select("row", F.explode(F.concat("base", "generic")).alias("s")).withColumn("hash", F.sha2(F.col("s.value").cast("binary"), 256))
    each = each.join(sized(counts.select("hash", live.alias("live")), counts), "hash")
    per_row = each.groupBy("row").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.collect_list(F.when(F.col("live") & (F.col("s.kind") == "generic"), F.col("s"))).alias("added")
    )
    out = found.join(per_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "base", F.coalesce("added", _none()).alias("added"), zero("n_live"), zero("n_example"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan()."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *map(of, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), "n_live", "n_example")
