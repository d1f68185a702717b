"""First JSON block of a model's text: code fence, else balanced braces, else balanced brackets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdictframe.functions.text import col, strip


def _balanced(text: str, opening: str, closing: str) -> str | None:
    """Text from the first opening mark to the mark that closes it; marks in strings count as well."""
    start = text.find(opening)
    if start < 0:
        return None
    depth = 0
    for mark in re.finditer(re.escape(opening) + "|" + re.escape(closing), text[start:]):
        depth += 1 if mark.group() == opening else -1
        if depth == 0:
            return text[start : start + mark.end()]
    return None


@F.pandas_udf(StringType())
def _block(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _balanced(t, "{", "}") or _balanced(t, "[", "]"))


def extract_json_block(c: Column | str) -> Column:
    """Null when there is no block. Rows with a fence, or without any bracket, stay out of Python."""
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    text = col(c)
    open_mark = text.contains("{") | text.contains("[")
    return F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(
        _block(F.when(open_mark & ~text.rlike(fence), text))
    )
