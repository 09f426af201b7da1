"""Statistics over parameter draws.

``draws``: draw_id, is_full_fit, param_idx, value (and ``source`` where several
kinds of draws are compared). A parameter's draws are never gathered: means and
tail shares are plain aggregates and quantiles go through ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize
from . import ordering

CONVERGED = 3


def drop_burnin(draws: DataFrame, burnin: int) -> DataFrame:
    """Drop the first draws; the full-data fit stays."""
    return draws.where(F.col("is_full_fit") | (F.col("draw_id") >= burnin))


def thin(draws: DataFrame, accepted_rank: str, every: int) -> DataFrame:
    """Keep each ``every``-th accepted draw."""
    return draws.where(F.col(accepted_rank) % every == 0)


def convergence(diagnostics: DataFrame, least_share: float = 0.9) -> DataFrame:
    """One row: draws, share of them whose fit converged, and whether that is enough to use only those."""
    share = F.avg((F.col("status") == CONVERGED).cast("int"))
    return diagnostics.agg(F.count(F.lit(1)).alias("draws"), share.alias("share"), (share >= least_share).alias("enough"))


def keep_converged(draws: DataFrame, diagnostics: DataFrame | None, least_share: float = 0.9,
                   converged_only: bool = True) -> DataFrame:
    """Draws whose fit converged; all of them when fewer than ``least_share`` did.

    Without diagnostics every draw is kept.
    """
    if diagnostics is None or not converged_only:
        return draws
    share = diagnostics.agg(F.avg((F.col("status") == CONVERGED).cast("int")).alias("s")).scalar()
    kept = diagnostics.where((F.col("status") == CONVERGED) | (share < least_share)).select("draw_id")
    return draws.join(kept, "draw_id", "left_semi")


def full_fit_values(draws: DataFrame) -> DataFrame:
    """Estimates from the full-data fit."""
    return draws.where("is_full_fit").select("param_idx", F.col("value").alias("estimate"))


def median_values(draws: DataFrame, keys: tuple[str, ...] = ("param_idx",)) -> DataFrame:
    """Estimates as medians over draws."""
    return ordering.quantiles(draws, list(keys), "value", {"estimate": 0.5})


def p_values(draws: DataFrame, estimates: DataFrame, include_full_fit: bool = True) -> DataFrame:
    """Two-sided p-value per parameter from the mean-centred draws."""
    used = draws if include_full_fit else draws.where(~F.col("is_full_fit"))
    centre = used.groupBy("param_idx").agg(F.avg("value").alias("_mean"))
    at = centre.join(estimates.select("param_idx", "estimate"), "param_idx")
    x = F.col("value") - F.col("_mean")
    share = lambda limit: F.avg((x <= limit).cast("double"))
    return ordering.attach(used, at, ["param_idx"]).groupBy("param_idx").agg(
        (1 - share(F.abs("estimate")) + share(-F.abs("estimate"))).alias("p_value")
    )


def tested(params: DataFrame) -> DataFrame:
    """Only treatment effects on rate, slope and point are tested."""
    return params.where(F.col("kind") == "beta")


def intervals(draws: DataFrame, alpha: float) -> DataFrame:
    return ordering.quantiles(draws, ["param_idx"], "value", {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2})


def holm(p_table: DataFrame, alpha: float, monotone: bool = False) -> DataFrame:
    """Step-down correction: k-th smallest p times (m - k + 1); ties by parameter index.

    Raw by default; ``monotone`` adds the running maximum and the cap at 1.
    """
    placed = ordering.ranked(p_table, [], "p_value", F.col("param_idx").cast("double"), 100_000.0, "_k")
    left = F.col("_k_total") - F.col("_k") + 1
    out = placed.withColumn("p_value_adj", F.col("p_value") * left).withColumn("alpha_adj", F.lit(alpha) / left)
    if monotone:
        highest = out.select(F.col("_k").alias("_j"), F.col("p_value_adj").alias("_a"))
        run = _running_max(highest, "_j", "_a")
        out = out.join(run, out["_k"] == run["_j"]).withColumn("p_value_adj", F.least(F.col("_top"), F.lit(1.0)))
        out = out.drop("_j", "_top")
    return out.drop("_k", "_k_total")


def _running_max(df: DataFrame, position: str, value: str, chunk: int = 100_000) -> DataFrame:
    """Running maximum along positions, chunk by chunk."""
    cut = df.withColumn("_c", F.floor(F.col(position) / chunk))
    ends = cut.groupBy("_c").agg(F.max(value).alias("_m"))
    before = Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_c").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select("_c", F.max("_m").over(before).alias("_b"))
    return cut.join(carried, "_c").select(
        position, F.greatest(F.max(value).over(inside), F.col("_b")).alias("_top"))


def bonferroni(p_table: DataFrame, alpha: float) -> DataFrame:
    m = p_table.agg(F.count("p_value")).scalar()
    return p_table.withColumn("p_value_adj", F.col("p_value") * m).withColumn("alpha_adj", F.lit(alpha) / m)


def significance(alpha: float):
    p = F.col("p_value_adj")
    return (
        F.when(p.isNull(), " ").when(p < alpha / 50, "***").when(p < alpha / 5, "**")
        .when(p < alpha, "*").otherwise("ns")
    )


def summary(draws: DataFrame, params: DataFrame, estimates: DataFrame, alpha: float = 0.05,
            method: str = "holm", include_full_fit: bool = True) -> DataFrame:
    """One row per parameter: estimate, interval, p-value, correction, mark.

    Holm recomputes the interval of a tested parameter at its own level and
    leaves the others at ``alpha``; Bonferroni uses one level for all.
    """
    if method not in ("holm", "bonferroni"):
        raise ValueError("method must be 'holm' or 'bonferroni'")
    used = draws if include_full_fit else draws.where(~F.col("is_full_fit"))
    p = p_values(used, estimates).join(tested(params).select("param_idx"), "param_idx", "left_semi")
    if method == "holm":
        adjusted = holm(p, alpha)
        level = F.coalesce("alpha_adj", F.lit(alpha))
    else:
        p = materialize(p)
        adjusted = bonferroni(p, alpha)
        level = F.lit(alpha) / p.agg(F.count("p_value")).scalar()
    base = params.select("param_idx", "name").join(
        adjusted.select("param_idx", "p_value", "p_value_adj", "alpha_adj"), "param_idx", "left")
    if method == "bonferroni":
        base = base.withColumn("alpha_adj", level)
    base = materialize(base)
    probabilities = base.select(
        "param_idx", (level / 2).alias("ci_low"), (1 - level / 2).alias("ci_high"))
    ci = ordering.quantiles(used, ["param_idx"], "value", probabilities)
    return (
        base.join(estimates.select("param_idx", "estimate"), "param_idx", "left")
        .join(ci, "param_idx", "left")
        .select("param_idx", "name", "estimate", "ci_low", "ci_high", "p_value", "p_value_adj", "alpha_adj",
                significance(alpha).alias("significance"))
    )


def recommended_draws(params: DataFrame, alpha: float) -> DataFrame:
    """How many draws the number of tests calls for."""
    return tested(params).agg(F.count(F.lit(1)).alias("tests")).withColumn(
        "recommended_draws", F.col("tests") / F.lit(alpha))


def autocorrelation(draws: DataFrame, keys: tuple[str, ...] = ("source", "param_idx")) -> DataFrame:
    """Correlation of successive draws per parameter."""
    pairs = ordering.successive_pairs(draws, list(keys), "draw_id", "value")
    return pairs.groupBy(*keys).agg(F.corr("previous", "current").alias("autocorrelation"))


def acceptance_rate(diagnostics: DataFrame, every: int) -> DataFrame:
    """Share of proposals accepted: kept draws x thinning / proposals made."""
    return diagnostics.agg(
        (F.count(F.lit(1)) / (F.max("proposals") + 1) * every).alias("acceptance_rate"))
