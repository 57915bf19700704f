"""The grid of the first table of an HTML column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.html import tables_of


def first_grid(html: Column | str) -> Column:
    """array<array<string>>: rows with spans written out; empty without a table."""
    @F.pandas_udf("array<array<string>>")
    def grids(values: pd.Series) -> pd.Series:
        return values.map(lambda page: next((t["grid"] for t in tables_of(page)[2]), []))

    return grids(F.col(html) if isinstance(html, str) else html)
