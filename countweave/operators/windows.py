"""Rolling log-likelihoods and other windows along a series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ZERO_VARIANCE = 1e-24
ZERO_VARIANCE_SCORE = 1.0


def _normal_fit(n: int, variance: Column) -> Column:
    """Log likelihood of n points under a normal with their own mean and variance."""
    return -n / 2 * (F.ln(2 * math.pi * variance) + 1)


def _frames(order: WindowSpec, ws: int) -> tuple[WindowSpec, WindowSpec, WindowSpec]:
    half = ws // 2
    return (
        order.rowsBetween(-half, ws - half - 1),
        order.rowsBetween(-half, -1),
        order.rowsBetween(0, ws - half - 1),
    )


def _full_window_score(keys: list[str], value: str, ws: int, split: bool, order_by: str) -> Column:
    """Score of every position that has a full window around it, NULL elsewhere."""
    if ws < 2:
        raise ValueError("the window must hold at least 2 positions")
    full, left, right = _frames(Window.partitionBy(*keys).orderBy(order_by), ws)
    half = ws // 2
    if split:
        a, b = F.var_pop(value).over(left), F.var_pop(value).over(right)
        flat = (a <= ZERO_VARIANCE) | (b <= ZERO_VARIANCE)
        fitted = _normal_fit(half, a) + _normal_fit(ws - half, b)
    else:
        v = F.var_pop(value).over(full)
        flat, fitted = v <= ZERO_VARIANCE, _normal_fit(ws, v)
    return F.when(F.count(value).over(full) == ws, F.when(flat, F.lit(ZERO_VARIANCE_SCORE)).otherwise(fitted))


def _edges_filled(keys: list[str], raw: str) -> Column:
    """Positions without a full window get the sum over the full ones / series length."""
    whole = Window.partitionBy(*keys)
    edge = F.coalesce(F.sum(raw).over(whole), F.lit(0.0)) / F.count(F.lit(1)).over(whole)
    return F.coalesce(F.col(raw), edge)


def rolling_loglik(df: DataFrame, keys: list[str], value: str, ws: int, split: bool, name: str,
                   order_by: str = "bin", fill_edges: bool = True) -> DataFrame:
    """Rolling normal log likelihood around each position.

    ``split`` fits each half of the window on its own. Windows without spread
    score 1. Positions that have no full window get the sum over the full
    windows divided by the series length.
    """
    out = df.withColumn("_raw", _full_window_score(keys, value, ws, split, order_by))
    filled = _edges_filled(keys, "_raw") if fill_edges else F.col("_raw")
    return out.withColumn(name, filled).drop("_raw")


def loglik_ratios(df: DataFrame, keys: list[str], value: str, windows: dict[str, int],
                  order_by: str = "bin") -> DataFrame:
    """Split minus unsplit rolling log likelihood, one column per named window length.

    All frames of all lengths share one partitioning, one sort and one window
    operator; the edge fill adds one more operator over the same rows.
    """
    parts = {(n, split): f"_{n}_{int(split)}" for n in windows for split in (False, True)}
    raw = df.select("*", *[
        _full_window_score(keys, value, windows[n], split, order_by).alias(c) for (n, split), c in parts.items()
    ])
    filled = raw.select(*df.columns, *[_edges_filled(keys, c).alias(c) for c in parts.values()])
    return filled.select(*df.columns, *[
        (F.col(parts[n, True]) - F.col(parts[n, False])).alias(n) for n in windows
    ])


def ratio_scales(df: DataFrame, keys: list[str], value: str, ws: int, order_by: str = "bin") -> DataFrame:
    """Ratios r1, r2, r4 at ws, 2 ws and 4 ws."""
    return loglik_ratios(df, keys, value, {"r1": ws, "r2": 2 * ws, "r4": 4 * ws}, order_by)


def trailing_mean(df: DataFrame, keys: list[str], value: str, ws: int, name: str, order_by: str = "bin") -> DataFrame:
    """Mean of the last ``ws`` positions, fewer at the start."""
    frame = Window.partitionBy(*keys).orderBy(order_by).rowsBetween(-(ws - 1), 0)
    return df.withColumn(name, F.avg(value).over(frame))


def differences(df: DataFrame, keys: list[str], value: str, name: str, order_by: str = "bin") -> DataFrame:
    """Successive differences; the first position of a series has none and is dropped."""
    order = Window.partitionBy(*keys).orderBy(order_by)
    return (
        df.withColumn("_prev", F.lag(value).over(order))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") > 1)
        .withColumn(name, F.col(value) - F.col("_prev"))
        .drop("_prev", "_n")
    )
