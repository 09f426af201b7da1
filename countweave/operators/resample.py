"""Bootstrap of token counts within cells.

A cell's tokens are numbered by the md5 of their id, and draw i of a replicate
takes the token at (keyed hash mod n); one md5 gives four draws. The numbers do
not depend on how the data is partitioned. Each cell goes by its own size, in
one plan for all: up to ARRAY_LIMIT tokens it is one array per row, resampled
without a shuffle. A larger cell is never gathered: its tokens stay rows,
numbered through as many hash ranges as that cell needs, and draws find them
by equality. The large cells lie end to end, so a token has one number, its
place, and draws are made from the cells' sizes alone. The number of tasks
follows the tokens, so that no task grows with them. Both ways draw the same
tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import SPAN, WORDS, digest, word
from ..schema import name_missing, require_model_columns
from ..sources.storage import materialize
from . import cells, design

ARRAY_LIMIT = 4096
RANGE_TARGET = 100_000
TASK_ROWS = 500_000
BLOCK = 16_384


def _cell_name(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def _tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def large_cells(sums: DataFrame, keys: list[str], array_limit: int = ARRAY_LIMIT) -> DataFrame:
    """Cells of more than ``array_limit`` tokens laid end to end: cell_size, and the place ``_first`` of their first token.

    Where the smaller cells are so few that they, too, are at most one per ``array_limit`` of these tokens, all cells
    are among them, and the tokens need not be read again for the rest. So there is at most one row per half
    ``array_limit`` of tokens.
    """
    found = sums.where((F.col("n_tokens") > 0) & F.col("bin").isNotNull())
    is_large = F.col("n_tokens") > array_limit
    n_large, n_small = found.agg(F.sum(F.when(is_large, F.col("n_tokens"))), F.count(F.when(~is_large, 1))).first()
    if (n_large or 0) < n_small * array_limit:
        found = found.where(is_large)
    before = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        found.select(*keys, F.col("n_tokens").alias("cell_size"), _cell_name(keys).alias("_cell"))
        .withColumn("_first", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).cast("bigint"))
    )


def token_places(tokens: DataFrame, large: DataFrame, keys: list[str], n_tasks: int) -> DataFrame:
    """Every token of the large cells: ``_first`` of its cell, its place (the hash order within the cell), count.

    A cell is cut into as many hash ranges as its size asks for, so no window
    holds much more than RANGE_TARGET tokens. ``_first`` plus the number of the range tells ranges of all cells apart.
    """
    parts = F.ceil(F.col("cell_size") / RANGE_TARGET)
    part = F.floor(F.col("_w") * parts / SPAN)
    order = F.md5(F.col("token_id").cast("string"))
    rows = (
        tokens.join(large.select(*keys, "cell_size", "_first"), keys)
        .select("_first", "cell_size", "count", "token_id", word(order).alias("_w"))
        .select("_first", (F.col("_first") + F.coalesce(part, F.lit(0))).alias("_range"),
                (F.col("_first") + F.col("_w") / SPAN * F.col("cell_size")).alias("_about"), "_w", "token_id", "count")
    )
    # the digest's first word is compared as a number, the whole digest only where that is equal; sorted by about the
    # place first, which one number tells, the window finds its rows in order
    inside = Window.partitionBy("_range").orderBy("_w", order, "token_id", "count")
    numbered = materialize(
        rows.repartition(n_tasks, "_range").sortWithinPartitions("_about")
        .withColumn("_at", F.row_number().over(inside) - 1).select("_first", "_range", "_at", "count"))
    sizes = numbered.groupBy("_first", "_range").agg((F.max("_at") + 1).alias("_size"))
    run = Window.partitionBy("_first").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select(
        "_range", (F.col("_first") + F.coalesce(F.sum("_size").over(run), F.lit(0))).alias("_start")))
    return numbered.join(starts, "_range").select("_first", (F.col("_start") + F.col("_at")).alias("place"), "count")


def _array_draws(pools: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    n = F.size("pool").cast("bigint")
    # the digests are an array of their own, so that each is worked out once for its four draws
    digests = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / WORDS).cast("int")), lambda q: F.struct(
        q.alias("q"), digest(seed, "replicate", "_cell", q).alias("h")))

    def drawn(e, j):
        value = F.get("pool", (word(e["h"], j) % n).cast("int"))
        return F.when(e["q"] * WORDS + j < n, value).otherwise(0.0)

    def add(acc, e):
        for j in range(WORDS):
            acc = acc + drawn(e, j)
        return acc

    return (
        pools.withColumn("_cell", _cell_name(keys))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        .select("replicate", *keys, F.aggregate(digests, F.lit(0.0), add).alias("total"), n.alias("n_tokens"))
    )


def draw_places(large: DataFrame, replicates: int, seed: int, n_tasks: int) -> DataFrame:
    """Every draw of the large cells: replicate, place drawn. They need the cells' sizes only, no token."""
    last = F.col("cell_size") - 1
    blocks = (
        large.select("_first", "cell_size", "_cell", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / BLOCK))).alias("_b"))
        .repartition(n_tasks, "_first", "replicate", "_b")
    )
    quads = F.sequence(F.col("_b") * (BLOCK // WORDS), F.floor(F.least((F.col("_b") + 1) * BLOCK - 1, last) / WORDS))
    drawn = F.array(*[
        F.when(F.col("_q") * WORDS + j <= last, F.col("_first") + word(F.col("_h"), j) % F.col("cell_size")) for j in range(WORDS)])
    return (
        blocks.select("_first", "cell_size", "_cell", "replicate", F.explode(quads).alias("_q"))
        .select("_first", "cell_size", "replicate", "_q", digest(seed, "replicate", "_cell", "_q").alias("_h"))
        .select("replicate", F.explode(drawn).alias("place"))
        .where(F.col("place").isNotNull())
    )


def _row_draws(tokens: DataFrame, large: DataFrame, keys: list[str], replicates: int, seed: int, n_tokens: int) -> DataFrame:
    """Draws find their tokens by one number, the place; both sides are dealt over tasks of bounded size."""
    n_tasks = _tasks(n_tokens * replicates)
    places = token_places(tokens, large, keys, _tasks(n_tokens)).repartition(n_tasks, "place")
    draws = draw_places(large, replicates, seed, n_tasks).repartition(n_tasks, "place")
    # the files of the places are far smaller than their rows, so their size must not make them a table sent whole
    found = draws.join(places.hint("merge"), "place").groupBy("replicate", "_first").agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_tokens"))
    return found.join(large.select("_first", *keys), "_first").select("replicate", *keys, "total", "n_tokens")


def bootstrap_sums(tokens: DataFrame, replicates: int, seed: int, sums: DataFrame | None = None,
                   array_limit: int = ARRAY_LIMIT) -> DataFrame:
    """Resampled cell sums: replicate, cell keys, total, n_tokens.

    Every observed cell redraws as many tokens as it has, with replacement.
    Needs a ``token_id`` that is unique within a cell. Tokens without a bin are in no cell
    (``cells.off_grid`` reports them).
    """
    if "token_id" not in tokens.columns:
        raise ValueError("resampling needs a token_id column")
    effects = require_model_columns(tokens)
    keys = ["ran", "parent", "child", *effects, "bin"]
    present = name_missing(cells.drop_missing(tokens), effects).where(F.col("bin").isNotNull())
    if sums is None:
        sums = materialize(cells.cell_sums(tokens))
    large = materialize(large_cells(sums, keys, array_limit))
    n_large, n_cells = large.agg(F.coalesce(F.sum("cell_size"), F.lit(0)), F.count(F.lit(1))).first()
    if n_large and n_cells == sums.where((F.col("n_tokens") > 0) & F.col("bin").isNotNull()).count():
        return _row_draws(present, large, keys, replicates, seed, n_large)
    entry = F.struct(F.md5(F.col("token_id").cast("string")).alias("o"), F.col("token_id").alias("t"), "count")
    pools = present.join(large, keys, "left_anti").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["count"]).alias("pool"))
    small_draws = _array_draws(pools, keys, replicates, seed)
    if not n_large:
        return small_draws
    return small_draws.unionByName(_row_draws(present, large, keys, replicates, seed, n_large))


def bootstrap_series(resampled: DataFrame, level_table: DataFrame, effects: list[str], n_bins: int,
                     replicates: int) -> DataFrame:
    """Resampled sums on the complete grid of every replicate, reference series filled again.

    Cells without tokens stay missing.
    """
    frame = design.series_grid(level_table, effects).select(
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), "*"
    )
    return cells.on_grid(resampled, frame, effects, n_bins, extra=("replicate",))
