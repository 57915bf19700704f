"""Text out of polymorphic JSON content."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of an object that hold text, in the order of reading.
TEXT_KEYS = ["content", "text", "title", "caption", "title_content", "paragraph_content", "table_caption", "table_footnote", "item_content", "children"]
# End of fixed values.


def text_of(value) -> str:
    """Strings and numbers as they are, lists joined, of objects the known keys; white space normalised."""
    if isinstance(value, list):
        value = " ".join(text_of(v) for v in value)
    elif isinstance(value, dict):
        value = " ".join(t for t in (text_of(value[k]) for k in TEXT_KEYS if k in value) if t)
    return "" if value is None else " ".join(str(value).split())


def _parsed(raw: str | None) -> str:
    try:
        return "" if raw is None else text_of(json.loads(raw))
    except ValueError:
        return ""


def extract_text(content: Column | str) -> Column:
    """Text of a VARIANT column, by an Arrow UDF over its JSON."""
    @F.pandas_udf("string")
    def extract(raw: pd.Series) -> pd.Series:
        return raw.map(_parsed)

    return extract(F.to_json(F.col(content) if isinstance(content, str) else content))
