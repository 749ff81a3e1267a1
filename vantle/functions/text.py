"""Captions and names: cleaning, pre-tokens, padding, stems."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the pre-token pattern of captions, in lower case.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities decoded twice, then trimmed; no built-in function does."""
    return texts.map(lambda t: None if t is None else html.unescape(html.unescape(t)).strip())


def basic_clean(text: Column) -> Column:
    """A caption as the pre-tokenizer takes it: entities decoded twice, white space collapsed and trimmed, lower case."""
    return clean(unescape(text))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(clean(text), F.lit(PRETOKEN), F.lit(0))


def padded(ids: Column, most: int, first: int, last: int) -> tuple[Column, Column, Column]:
    """ids between the start and end marks, cut to most with them and filled with 0; mask; segment."""
    body = F.concat(F.slice(F.concat(F.array(F.lit(first)), ids), 1, most - 1), F.array(F.lit(last)))
    n = F.size(body)
    fill = F.array_repeat(F.lit(0), F.lit(most) - n)
    return F.concat(body, fill), F.concat(F.array_repeat(F.lit(1), n), fill), F.array_repeat(F.lit(0), most)


def stem(name: Column) -> Column:
    """The name before its last dot; empty without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def parent_url(url: Column) -> Column:
    """What stands behind the last ?v= of a url; the whole where there is none."""
    return F.element_at(F.split(url, r"\?v="), -1)
