"""The replay of a table's prefixes as a Python table function: any columns, dealt and ordered by the caller."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import ship
from .jobs import on_schedule


class Replay:
    """Of each partition of a table, the rows that end a scheduled prefix, with the prefix' length k beside them.

    The columns are those of the table. Rows come one at a time in the order asked for, and a counter is all that is kept of a partition,
    however long it is. A table that has a column k already, or no columns, is an error when the query is planned.
    """

    def __init__(self):
        self._k = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not rows.dataType.fields:
            raise ValueError("replay takes a table")
        if "k" in [f.name.lower() for f in rows.dataType.fields]:
            raise ValueError("the table has a column k already")
        return AnalyzeResult(StructType([*rows.dataType.fields]).add("k", LongType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        self._k += 1
        if on_schedule(self._k):
            yield (*row, self._k)


def replay(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows that end a scheduled prefix of each value of `by`, with k; `order` must not leave ties, or which of them ends a prefix is open."""
    ship(rows.sparkSession)
    return udtf(Replay)(rows.asTable().partitionBy(by).orderBy(*order))
