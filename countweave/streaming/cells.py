"""Running cell sums over a stream of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cells import cell_sums


def running_cell_sums(tokens: DataFrame) -> DataFrame:
    """The same sums as for a table; write the result in update (or complete) mode.

    State is one row per cell that has tokens, so it is bounded by the grid.
    """
    if not tokens.isStreaming:
        raise ValueError("expected a streaming DataFrame; use cell_sums for tables")
    return cell_sums(tokens)
