"""Quasi-Newton descent of many independent problems at once, as a table that is stepped.

One row per problem: its point, gradient and short history as arrays. A step sends all trial lengths of all
problems through one plan, so the number of jobs depends on the steps of the slowest problem and not on how
many there are. Problems that are settled leave the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, empty, moved, named, norm, with_direction
from ..sources.storage import materialize
from .objective import PROBLEM, dense

#: Moves remembered; trial lengths of a step, each a quarter of the one before; smallest length tried.
MEMORY = 8
LENGTHS = 5
SHORTEST = 1e-14
#: What a trial must gain, as a share of what the slope promises.
GAIN = 1e-4
# How a problem ended.
ENOUGH, SETTLED, STUCK, OUT_OF_EVALS = 2, 3, 4, 5
STATE = ["x", "value", "neg_loglik", "least", "negative", "g", "steps", "turns", "reach", "evals", "status"]

Evaluate = Callable[[DataFrame, list[str]], DataFrame]


def begin(points: DataFrame, evaluate: Evaluate) -> DataFrame:
    """State of every problem at its starting vector x; a column ``free`` (1 or 0 per place) holds the others."""
    at = evaluate(points.withColumn("trial", F.lit(0)), [*PROBLEM, "trial"]).drop("trial")
    kept = [c for c in points.columns if c not in PROBLEM]
    vector = empty("array<double>")
    return materialize(_aimed(points.join(at, PROBLEM).select(
        *PROBLEM, *kept, "value", "neg_loglik", "least", "negative", dense(F.col("g"), F.col("x")).alias("g"),
        vector.alias("steps"), vector.alias("turns"), F.lit(1.0).alias("reach"), F.lit(1).alias("evals"), F.lit(0).alias("status"))))


def _held(state: DataFrame, v: Column) -> Column:
    return F.zip_with(v, "free", lambda x, m: x * m) if "free" in state.columns else v


def _aimed(state: DataFrame) -> DataFrame:
    """Adds each problem's direction d and its slope along it.

    Where the direction leads up the history is forgotten and the gradient followed down; at a flat point there is no way down.
    """
    known = F.size("steps") > 0
    turned = with_direction(state.withColumn("g", _held(state, F.col("g")))).withColumn("slope", dot(F.col("g"), F.col("d")))
    up = ~(F.col("slope") < 0)
    steep = named(turned.withColumn("up", up), [("size", F.greatest(norm(F.col("g")), F.lit(1e-12)))])
    down = F.transform("g", lambda x: -x / F.col("size"))
    none = empty("array<double>")
    return steep.withColumn("d", F.when(F.col("up") & known, down).otherwise(F.col("d"))) \
        .withColumn("slope", F.when(F.col("up") & known, -norm(F.col("g"))).otherwise(F.col("slope"))) \
        .withColumn("steps", F.when(F.col("up"), none).otherwise(F.col("steps"))) \
        .withColumn("turns", F.when(F.col("up"), none).otherwise(F.col("turns"))).drop("up", "size")


def _stepped(state: DataFrame, evaluate: Evaluate, tolerance: float, max_evals: int, enough: float | None) -> DataFrame:
    """All active problems after one step."""
    length = lambda i: F.col("reach") * F.pow(F.lit(0.25), i)
    trials = state.where("slope < 0").select(*PROBLEM, F.explode(F.sequence(F.lit(0), F.lit(LENGTHS - 1))).alias("trial"), "x", "d", "reach") \
        .select(*PROBLEM, "trial", moved(F.col("x"), length(F.col("trial")), F.col("d")).alias("x"))
    found = evaluate(trials, [*PROBLEM, "trial"]).withColumnRenamed("value", "then")
    tries = found.groupBy(*PROBLEM).agg(F.array_sort(F.collect_list(
        F.struct("trial", "then", "neg_loglik", "least", "negative", "g"))).alias("tries"))
    good = F.filter("tries", lambda t: t["then"] <= F.col("value") + GAIN * length(t["trial"]) * F.col("slope"))
    both = state.join(tries, PROBLEM, "left").withColumn("to", F.get(good, F.lit(0))).drop("tries")
    went, known = F.col("to").isNotNull(), F.size("steps") > 0
    evals = F.col("evals") + F.when(went, F.col("to.trial") + 1).when(F.col("slope") < 0, F.lit(LENGTHS)).otherwise(F.lit(0))
    both = both.select("*", went.alias("went"), evals.alias("spent"))
    # the oldest move goes when the memory is full
    kept = lambda c: F.slice(c, F.greatest(F.size(c) - MEMORY + 2, F.lit(1)), F.size(c))
    both = named(both, [
        ("x1", moved(F.col("x"), length(F.col("to.trial")), F.col("d"))), ("g1", _held(state, dense(F.col("to.g"), F.col("x")))),
        ("s", F.zip_with("x1", "x", lambda a, b: a - b)), ("y", F.zip_with("g1", "g", lambda a, b: a - b)),
        ("curved", dot(F.col("s"), F.col("y")) > 1e-12 * norm(F.col("s")) * norm(F.col("y")))])
    forget = empty("array<double>")
    history = lambda c, new: F.when(~F.col("went"), forget).when(
        F.col("curved"), F.array_append(kept(c), F.col(new))).otherwise(F.col(c)).alias(c)
    shorter = F.col("reach") * 0.25**LENGTHS
    status = F.when(went, F.when(F.lit(enough is not None) & (F.col("to.then") <= F.lit(enough or 0.0)), ENOUGH)
                    .when(F.abs(F.col("value") - F.col("to.then")) <= tolerance * F.abs(F.col("to.then")), SETTLED)
                    .when(F.col("spent") >= max_evals, OUT_OF_EVALS).otherwise(0)) \
        .when(F.col("spent") >= max_evals, OUT_OF_EVALS) \
        .when(~(F.col("slope") < 0) | (~known & (shorter < SHORTEST)), STUCK).otherwise(0)
    rest = [c for c in state.columns if c not in (*PROBLEM, *STATE, "d", "slope")]
    pick = lambda new, col: F.when(F.col("went"), F.col(new)).otherwise(F.col(col)).alias(col)
    return materialize(_aimed(both.select(
        *PROBLEM, *rest, pick("x1", "x"), pick("to.then", "value"), pick("to.neg_loglik", "neg_loglik"), pick("to.least", "least"),
        pick("to.negative", "negative"), pick("g1", "g"), history("steps", "s"), history("turns", "y"),
        F.when(F.col("went") | known, F.lit(1.0)).otherwise(shorter).alias("reach"), F.col("spent").alias("evals"), status.alias("status"))))


def descend(state: DataFrame, evaluate: Callable[[DataFrame], Evaluate], series: DataFrame, tolerance: float, max_evals: int,
            enough: float | None = None) -> DataFrame:
    """Bring the value of every problem down until each is settled; returns the last states.

    ``evaluate(series)`` evaluates trials on a series table. Status: 2 = the value is ``enough``, 3 = it changed by less
    than the tolerance, 4 = no further step possible, 5 = out of evaluations (trials up to the one taken).
    Settled problems leave the table with their status, and their series leave once they are half of all.
    """
    if enough is not None:
        state = state.withColumn("status", F.when(F.col("value") <= enough, ENOUGH).otherwise(F.col("status")))
    done, of = [], None
    while True:
        counts = state.agg(F.count_if(F.col("status") == 0).alias("active"), F.count_if(F.col("status") != 0).alias("settled")).first()
        if counts.settled:
            done.append(state.where("status <> 0"))
        if not counts.active:
            break
        state = state.where("status = 0")
        if of is not None and counts.active <= of / 2:
            series, of = materialize(series.join(state.select(*PROBLEM), PROBLEM, "left_semi")), counts.active
        of = of or counts.active + counts.settled
        state = _stepped(state, evaluate(series), tolerance, max_evals, enough)
    if not done:
        return state
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out)
