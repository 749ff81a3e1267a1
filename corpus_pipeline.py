"""Corpus preparation: language, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last
returns packed pieces. Stages can be written and read again between each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantle.llm import decontam, langid, neardup, packing, pii
from vantle.llm.common import sized, text_key, written


def _without(docs: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """docs without the rows of these ids (in the column name); rows with a null id stay."""
    return docs.join(sized(written(ids.distinct(), "gone")), name, "left_anti").select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): docs with all their columns in one, so that none meets a name of ours."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Null texts and texts without a letter go; all others stay, also where no labelled row
    is there to learn from."""
    langs, net = langid.fit(docs.select("doc_id", "text", "lang"))
    if net is None:
        return langid.lettered(docs)
    names = docs.columns
    found = langid.predict(docs.toDF(*(f"c{i}" for i in range(len(names)))), langs, net, f"c{names.index('text')}")
    return found.where(F.col("lang_pred") != langid.UNKNOWN).drop("lang_pred", "score").toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; one with a null id only where no
    other of the group has an id. Rows that repeat an id and its text count once; other texts under the id are documents
    of their own. Null texts, empty ones and ones without words aren't duplicates of each other."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        found = written(neardup.near_duplicates(docs.select("doc_id", "text")), "groups")
        return _without(docs, found.where(~F.col("kept")).select("doc_id"))
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    # keys in the order of ids, then of texts; rows without an id come last
    rows = written(_numbered(named.union(docs.where("doc_id is null")).orderBy(F.asc_nulls_last("doc_id"), text_key())), "rows")
    found = written(neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))), "groups")
    return _without(rows, found.where(~F.col("kept")).select(F.col("doc_id").alias("row")), "row").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Rows are judged one by one, also where ids are null or repeat;
    null and empty texts stay. An empty table gives an empty one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = written(_numbered(docs), "rows")
    found = decontam.contaminated(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), benchmark)
    return _without(rows, found.select(F.col("doc_id").alias("row")), "row").select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets in the place of each piece of personal data. Null texts stay null, rows and
    columns stay as they are; an empty table gives an empty one."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences. A null text is packed as an empty one, and repeated rows each; an empty
    table gives an empty one."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: The stages learn a network, hash and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's result written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
