"""Small helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_columns(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named double columns, keep the rest."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})
