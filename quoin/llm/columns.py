"""Names for a caller's columns that none of an operator's own can clash with."""

from __future__ import annotations

from pyspark.sql import DataFrame


def renamed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """(docs with columns given_0, given_1 and so on, the new names of names); toDF(*docs.columns) brings the old ones back."""
    own = [f"given_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*own), [own[docs.columns.index(n)] for n in names]
