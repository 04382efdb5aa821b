"""Rows kept apart from what is worked out about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Apart:
    """A frame whose columns have names that nothing else uses, so that helpers and results cannot clash with them.

    ``Apart(df)[name]`` is a column's name meanwhile; ``back`` gives the columns their names again.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"_input_{k}_" for k in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        return f"_input_{self.names.index(name)}_"

    def back(self, worked: DataFrame, results: dict[str, Column | str] | None = None) -> DataFrame:
        """The input's columns and then the results; a column named like a result is replaced by it."""
        results = results or {}
        kept = [F.col(self[c]).alias(c) for c in self.names if c not in results]
        made = [(F.col(v) if isinstance(v, str) else v).alias(c) for c, v in results.items()]
        return worked.select(*kept, *made)
