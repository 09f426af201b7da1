"""Random walks of many independent chains at once, as a table that is stepped.

Proposals and acceptances are keyed by (seed, chain, child, number of the proposal), so a walk is the same however its table
is dealt out. As most proposals are refused, a block tries the next ones of every chain in one plan, all from where the
chain stands; the first accepted one ends its block, and those after it are proposed anew from there.
That is the walk taken one by one, in fewer jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SPAN, hash32
from ..functions.special import normal_quantile
from ..functions.vectors import let
from ..sources.storage import materialize
from .curve import BAD_OBJECTIVE

CHAIN = ["chain", "child"]
#: Proposals of a chain in one block.
BLOCK = 8
#: Blocks after which draws leave the table.
FLUSH = 40
# When a chain counts as stuck.
STUCK_AFTER = 200
STUCK_BELOW = 0.01
MAX_RESTARTS = 50

DRAW = "struct<draw_id: int, x: array<double>, value: double, neg_loglik: double, acceptance: double, proposals: bigint>"
Evaluate = Callable[[DataFrame, list[str]], DataFrame]


def uniform(seed: int, *key: Column | str) -> Column:
    """Keyed uniform in (0, 1)."""
    return (hash32(seed, *key) + 0.5) / F.lit(float(SPAN))


def proposal(seed: int, number: Column) -> Column:
    """The numbered proposal from x: a normal move of each place, ``length`` its spread."""
    def place(x: Column, i: Column) -> Column:
        u = uniform(seed, "chain", "child", number, i)
        return x + F.get("length", i) * let(u, normal_quantile)
    return F.transform("x", place)


def log_posterior(value: Column, x: Column, prior_on: Column, prior_sd: float) -> Column:
    """Minus the objective, with a normal prior on the marked places."""
    squares = F.aggregate(F.zip_with(x, prior_on, lambda v, on: F.when(on, v * v / (prior_sd * prior_sd)).otherwise(F.lit(0.0))),
                          F.lit(0.0), lambda acc, v: acc + v)
    return -value - 0.5 * squares


def walk(starts: DataFrame, evaluate: Evaluate, seed: int, steps: int, every: int, prior_sd: float, block: int = BLOCK) -> DataFrame:
    """Draws of every chain: chain, child, draw_id, x, value, neg_loglik, acceptance, proposals.

    ``starts``: chain, child, further keys, x, ``length`` (spread of each place's moves; fixed, so proposals are symmetric) and
    ``prior_on``. Every ``every``-th accepted position is a draw, until each chain has ``steps``. ``acceptance`` is the
    draw's probability of having been accepted, ``proposals`` how many came before it. A chain that in
    STUCK_AFTER proposals keeps less than STUCK_BELOW of all goes back to where it last was well, and so do its draws; after
    MAX_RESTARTS the walk raises.
    """
    keys = [c for c in starts.columns if c not in ("x", "length", "prior_on")]
    ids = [*keys, "trial"]
    at = evaluate(starts.withColumn("trial", F.lit(0)), ids).select(*keys, "value", "neg_loglik")
    lp = log_posterior(F.col("value"), F.col("x"), F.col("prior_on"), prior_sd)
    zero = F.lit(0).cast("bigint")
    fresh = starts.join(at, keys).withColumn("lp", lp)
    state = materialize(fresh.select(
        *keys, "x", "length", "prior_on", "value", "neg_loglik", "lp", zero.alias("proposals"), zero.alias("accepted"),
        F.lit(0).alias("kept"), F.lit(0).alias("since"), F.lit(0).alias("restarts"),
        F.struct("x", "value", "neg_loglik", "lp", zero.alias("accepted"), F.lit(0).alias("kept")).alias("safe"),
        F.array().cast(f"array<{DRAW}>").alias("draws")))
    out, n = [], 0
    while True:
        n += 1
        state = materialize(_block(state, keys, evaluate, seed, steps, every, prior_sd, block))
        seen = state.agg(F.min("kept").alias("kept"), F.max("restarts").alias("restarts")).first()
        if seen.kept is None:
            break
        if seen.restarts > MAX_RESTARTS:
            raise RuntimeError("the chain does not move; lower step_size")
        finished = seen.kept >= steps
        if finished or n % FLUSH == 0:
            out.append(materialize(state.select(*CHAIN, F.explode("draws").alias("d")).select(*CHAIN, "d.*")))
            state = state.withColumn("draws", F.array().cast(f"array<{DRAW}>"))
        if finished:
            break
    draws = starts.select(*CHAIN, F.lit(None).cast(DRAW).alias("d")).where("false").select(*CHAIN, "d.*")
    for part in out:
        draws = draws.unionByName(part)
    # a draw taken back after a restart is followed by another one of its number
    entry = [c for c in draws.columns if c not in (*CHAIN, "draw_id")]
    return draws.groupBy(*CHAIN, "draw_id").agg(F.max_by(F.struct(*entry), "proposals").alias("d")).select(*CHAIN, "draw_id", "d.*")


def _block(state: DataFrame, keys: list[str], evaluate: Evaluate, seed: int, steps: int, every: int, prior_sd: float, block: int) -> DataFrame:
    """Every chain up to its next accepted proposal, or through a block of refused ones."""
    ids = [*keys, "trial"]
    left = F.least(F.lit(block), F.lit(STUCK_AFTER) - F.col("since"))
    trials = state.where(F.col("kept") < steps).select(
        *keys, "x", "length", "prior_on", "lp", "proposals", F.explode(F.sequence(F.lit(0), (left - 1).cast("int"))).alias("trial"))
    trials = trials.withColumn("number", F.col("proposals") + F.col("trial")) \
        .select(*ids, "lp", "number", "prior_on", proposal(seed, F.col("number")).alias("x"))
    found = trials.join(evaluate(trials, ids).select(*ids, "value", "neg_loglik"), ids)
    then = found.withColumn("then", log_posterior(F.col("value"), F.col("x"), F.col("prior_on"), prior_sd)) \
        .withColumn("ratio", F.exp(F.least(F.lit(0.0), F.col("then") - F.col("lp"))))
    taken = (uniform(seed, "chain", "child", "number", F.lit("accept")) < F.col("ratio")) & (F.col("value") < BAD_OBJECTIVE)
    first = then.groupBy(*keys).agg(
        F.min(F.when(taken, F.struct("trial", "x", "value", "neg_loglik", F.col("then").alias("lp"), "ratio"))).alias("to"),
        (F.max("trial") + 1).alias("tried"))
    s = state.join(first, keys, "left").withColumn("tried", F.coalesce("tried", F.lit(0)))
    went = F.col("to").isNotNull()
    spent = F.when(went, F.col("to.trial") + 1).otherwise(F.col("tried"))
    s = s.select("*", went.alias("went"), spent.alias("spent"), (F.col("accepted") + went.cast("int")).alias("accepted1"))
    keep = F.col("went") & (F.col("accepted1") % every == 0)
    draw = F.struct(F.col("kept").cast("int").alias("draw_id"), F.col("to.x"), F.col("to.value"), F.col("to.neg_loglik"),
                    F.col("to.ratio").alias("acceptance"), (F.col("proposals") + F.col("to.trial")).cast("bigint").alias("proposals"))
    now = lambda c: F.when(F.col("went"), F.col(f"to.{c}")).otherwise(F.col(c)).alias(c)
    moved = s.select(
        *keys, now("x"), "length", "prior_on", now("value"), now("neg_loglik"), now("lp"), (F.col("proposals") + F.col("spent")).alias("proposals"),
        F.col("accepted1").alias("accepted"), (F.col("kept") + keep.cast("int")).alias("kept"), (F.col("since") + F.col("spent")).cast("int").alias("since"),
        "restarts", "safe", F.when(keep, F.array_append("draws", draw.cast(DRAW))).otherwise(F.col("draws")).alias("draws"))
    full = F.col("since") >= STUCK_AFTER
    stuck = full & (F.col("kept") * every < F.col("proposals") * STUCK_BELOW)
    back = lambda c: F.when(stuck, F.col(f"safe.{c}")).otherwise(F.col(c)).alias(c)
    here = F.struct("x", "value", "neg_loglik", "lp", "accepted", "kept")
    return moved.select(
        *keys, back("x"), "length", "prior_on", back("value"), back("neg_loglik"), back("lp"), "proposals", back("accepted"), back("kept"),
        F.when(full, F.lit(0)).otherwise(F.col("since")).alias("since"), (F.col("restarts") + stuck.cast("int")).alias("restarts"),
        F.when(full & ~stuck, here).otherwise(F.col("safe")).alias("safe"), "draws")
