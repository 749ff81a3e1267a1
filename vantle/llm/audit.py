"""How five quality filters interact, in every order they may be applied in.

Duplicates are found by partition refinement: classes of equal length in code points are split by the hashes of
successive blocks, each fifteen times as long as all before, and classes of one row drop out after every split. Only the
first block is hashed for every row; later ones are read of survivors alone. The survivors' full texts are compared
last, and all but those of the smallest id of a text are marked. Each row is then a mask of failed filters; masks are
counted by part, and all orders and steps follow from at most 32 counts a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import sized, written

FILTERS = "ABCDE"
LEAST_WORDS, UPPER_PERCENT, DISTINCT_PERCENT = 200, 2, 50
SYMBOLS = r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
#: Code points of the first block, and how many times as long each next one is as all before it.
FIRST_BLOCK, GROWTH = 256, 15
#: Parts a text's rows are first reduced in.
SALTS = 16


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, part and text; null texts and parts are empty, and so is an absent source."""
    source = F.col("source").cast("string") if "source" in {c.lower() for c in docs.columns} else F.lit(None)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("part"), text.alias("text"))


def own_mask(text: Column) -> Column:
    """Bits of the filters that look at one text alone (A to D)."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = {"A": n < LEAST_WORDS, "B": 100 * distinct < DISTINCT_PERCENT * n, "C": 100 * upper > UPPER_PERCENT * F.length(text), "D": text.rlike(SYMBOLS)}
    total = F.lit(0)
    for letter, condition in failed.items():
        total = total + F.when(condition, _bit(letter)).otherwise(0)
    return total


def _hash(parts: list[Column], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - bits) if bits < 64 else F.xxhash64(*parts)


def _repeated(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """The classes of more than one row."""
    return written(rows.groupBy(*by).count().where("count > 1").select(*by), label)


def marked(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, part and mask (int) of every row of docs, with E among the bits.

    E fails where a smaller id's row has the same text; rows that repeat an id with its text share the mark, and rows
    without an id neither have nor make one. bits shortens the hashes, for tests: results don't depend on them.
    """
    source = _read(docs).withColumns({"length": F.length("text"), "head": _hash([F.substring("text", 1, FIRST_BLOCK)], bits)})
    rows = written(source.select("doc_id", "part", "length", "head", own_mask(F.col("text")).alias("mask")), "rows")
    lengths = _repeated(rows, ["length"], "lengths")
    heads = _repeated(rows.join(sized(lengths), "length", "left_semi"), ["length", "head"], "heads")
    texts = source.join(sized(heads), ["length", "head"], "left_semi")
    texts = written(texts.select("doc_id", "part", "text", "length", _hash(["length", "head"], bits).alias("class"), own_mask(F.col("text")).alias("mask")), "texts")

    longest, at = texts.agg(F.max("length")).first()[0] or 0, FIRST_BLOCK
    alive, split = texts, texts
    while at < longest:
        finer = F.when(F.col("length") > at, _hash(["class", F.substring("text", at + 1, GROWTH * at)], bits)).otherwise(F.col("class"))
        split = split.withColumn("class", finer)
        alive = alive.withColumn("class", finer)
        alive = alive.join(sized(_repeated(alive, ["class"], "classes")), "class", "left_semi")
        at += GROWTH * at

    # equal texts meet in parts first, so that no task compares all rows of one
    least = alive.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("class", "text", "salt").agg(F.min("doc_id").alias("least"))
    least = least.groupBy("class", "text").agg(F.min("least").alias("least"))
    classes = written(least.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least")), "least")
    fails = F.coalesce(F.when(F.col("doc_id") > F.col("least"), _bit("E")), F.lit(0))
    out = ["doc_id", "part", (F.col("mask") + fails).alias("mask")]
    found = split.join(sized(classes), "class", "left")
    mixed = classes.where("texts > 1")  # unlike texts of equal hashes
    if mixed.isEmpty():
        ends = found.select(*out)
    else:
        mixed = written(mixed.select("class"), "mixed")
        own = least.join(sized(mixed), "class", "left_semi")
        ends = found.where("texts is null or texts = 1").select(*out).unionByName(split.join(sized(mixed), "class", "left_semi").join(own, ["class", "text"]).select(*out))
    return rows.join(sized(heads), ["length", "head"], "left_anti").select("doc_id", "part", "mask").unionByName(ends)


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by part and mask: n, good and toxic. An id is good or toxic if any of its labels says so."""
    label = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label("quality"), label("toxic"))
    labelled = masks.where("doc_id is not null").join(labels, "doc_id", "left").unionByName(masks.where("doc_id is null"), allowMissingColumns=True)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality", "good"), total("toxic", "lost"))


def filter_audit(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order of the filters and step. Null texts are empty texts, and equal to them. Only doc_id, text
    and source of docs and doc_id, quality and toxic of labels are read. Null labels and labels of no row count for
    nothing. An empty table has no parts and gives no rows.
    """
    parts = counted(marked(docs, bits), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "lost")).alias("masks"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda letter: F.instr("filter_order", letter)
    bits_where = lambda condition: sum((F.when(condition(place(x)), _bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    rows = rows.withColumns({"own": bits_where(lambda p: p == F.col("step")), "before": bits_where(lambda p: p < F.col("step"))})
    own, before = F.col("own"), F.col("before")

    def total(condition, value=lambda m: m["n"]) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(condition(m["mask"]), value(m)).otherwise(0).cast("long"))

    removed = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    # of all orders, a filter comes first among the k that a row fails in one k-th
    orders_first = lambda m: F.element_at(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.bit_count(m["mask"])) * m["n"]
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["lost"]).alias("toxic_lost"),
        total(lambda m: m.bitwiseAND(own) != 0, orders_first).alias("shapley"),
    )
