"""Plot-ready tables: histograms, quantile pairs, curves, traces, densities.

Only data; nothing is drawn.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model
from ..functions.hashing import hash32
from ..functions.special import normal_cdf, normal_quantile, polynomial
from ..schema import NO_RANDOM_EFFECT, REFERENCE
from ..sources.storage import materialize
from . import ordering
from .design import SERIES
from .stats import autocorrelation

SHAPIRO_SIZE = 35

# Royston's (1995) corrections to the two outer Shapiro-Wilk weights, and the
# mean and log-sd of log(1 - W) for samples of more than eleven.
SHAPIRO_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SHAPIRO_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SHAPIRO_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
SHAPIRO_LOG_SD = [-0.4803, -0.082676, 0.0030302]


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, peak_normalised: bool = False) -> DataFrame:
    """Equal-width histogram between a group's smallest and largest value; empty bins are left out."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bucket = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    counted = (
        ordering.attach(known, ends, keys)
        .groupBy(*keys, bucket.cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    )
    out = counted.select(*keys, "bucket", (F.col("_lo") + (F.col("bucket") + 0.5) * width).alias("mid"), "n")
    if peak_normalised:
        # at most `bins` rows per group
        out = out.withColumn("density", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))
    return out


def effect_histograms(draws: DataFrame, params: DataFrame, bins: int = 75) -> DataFrame:
    """Peak-normalised histograms of warps and of treatment effects, over all draws of a family."""
    family = F.when(F.col("kind") == "wfactor", F.concat(F.lit("wfactor_"), F.col("component"))).otherwise(
        F.concat(F.lit("beta_"), F.col("component")))
    named = params.where(F.col("kind").isin("wfactor", "beta")).select("param_idx", family.alias("family"))
    return histogram(ordering.attach(draws, named, ["param_idx"]), ["family"], "value", bins, peak_normalised=True)


def residual_groups(cell_table: DataFrame) -> DataFrame:
    """Log residuals once per group they belong to: all, ran, treatment, parent and child."""
    whole = cell_table.where(F.col("count").isNotNull() & F.col("pred_log").isNotNull() & ~F.isnan("pred_log"))
    labels = F.array(
        F.lit("all"), F.concat(F.lit("ran_lvl_"), F.col("ran")),
        F.concat(F.lit("treatment_"), F.col("treatment")), F.concat_ws("_", "parent", "child"),
    )
    return whole.select(
        F.explode(labels).alias("grouping"), *SERIES, "bin",
        (F.col("pred_log") - F.col("count_log")).alias("residual_log"),
    )


def quantile_pairs(residuals: DataFrame, value: str = "residual_log") -> DataFrame:
    """Q-Q table per group: sample value, normal quantile, gamma-mixed quantile.

    Mixing a normal over a gamma-distributed sd with mean s gives s times the
    normal quantile, whatever the gamma's variance.
    """
    tie, chunk = ordering.hash_tie([*SERIES, "bin"])
    placed = ordering.ranked(residuals, ["grouping"], value, tie, chunk, "i")
    spread = residuals.groupBy("grouping").agg(F.stddev_samp(value).alias("_sd"))
    i, n = F.col("i"), F.col("i_total")
    a = F.when(n <= 10, F.lit(3 / 8)).otherwise(F.lit(0.5))
    return ordering.attach(placed, spread, ["grouping"]).select(
        "grouping", "i", F.col(value).alias("sample"),
        normal_quantile((i - a) / (n + 1 - 2 * a)).alias("normal"),
        (normal_quantile((i - 0.5) / n) * F.col("_sd")).alias("convolved"),
    )


def rate_count(cell_table: DataFrame, log: bool = True, parents: list[str] | None = None,
               children: list[str] | None = None, rans: list[str] | None = None,
               reference_only: bool = False) -> DataFrame:
    """Observed and predicted series for chosen groups, on the log or the raw scale."""
    count, pred = ("count_log", "pred_log") if log else ("count", "pred")
    for name in (count, pred):
        if name not in cell_table.columns:
            raise ValueError(f"column not found: {name}")
    out = cell_table
    for column, chosen in (("parent", parents), ("child", children), ("ran", rans)):
        if chosen:
            out = out.where(F.col(column).isin(*chosen))
    if reference_only:
        out = out.where(F.col("treatment") == REFERENCE)
    return out.select("parent", "child", "treatment", "ran", "bin", F.col(count).alias("count"), F.col(pred).alias("pred"))


def decomposition(cell_table: DataFrame, child: str, log: bool = False) -> DataFrame:
    """The views of one child: all, points.obs, points.extrap, lines, none, and each ran level."""
    is_none = F.col("ran") == NO_RANDOM_EFFECT

    def view(name, with_count, with_pred, when):
        return F.when(when, F.struct(
            name.alias("view"), F.lit(with_count).alias("show_count"), F.lit(with_pred).alias("show_pred")))

    views = F.filter(F.array(
        view(F.lit("all"), True, True, F.lit(True)),
        view(F.lit("points.obs"), True, False, ~is_none),
        view(F.lit("points.extrap"), True, False, is_none),
        view(F.lit("lines"), False, True, F.lit(True)),
        view(F.lit("none"), True, True, is_none),
        view(F.col("ran"), True, True, ~is_none),
    ), lambda v: v.isNotNull())
    rows = rate_count(cell_table, log=log, children=[child])
    return rows.select(F.explode(views).alias("v"), *rows.columns).select(
        "v.view", "parent", "child", "treatment", "ran", "bin",
        F.when(F.col("v.show_count"), F.col("count")).alias("count"),
        F.when(F.col("v.show_pred"), F.col("pred")).alias("pred"),
    )


def short_label() -> Column:
    """Compact parameter label for tables and axes."""
    spot = F.concat(F.lit("T/B"), (F.col("k") + 1).cast("string"))
    return F.when(F.col("kind") == "wfactor", F.concat_ws("_", F.lit("level"), "ran", "child")).otherwise(
        F.concat_ws("_", "component", spot))


def sample_draws(draws: DataFrame, per_param: int = 100, seed: int = 42) -> DataFrame:
    """Up to ``per_param`` draws of each parameter, picked by keyed hash.

    ``row_number() <= k`` prunes inside every partition before the shuffle.
    """
    order = Window.partitionBy("param_idx").orderBy(hash32(seed, "param_idx", "draw_id"), "draw_id")
    return draws.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_param).drop("_r")


def parameter_rows(params: DataFrame, summary: DataFrame, draws: DataFrame, per_param: int = 100,
                   seed: int = 42) -> DataFrame:
    """Parameter table with labels, intervals, marks and a bounded set of draws."""
    section = F.when(F.col("kind") == "baseline", "baseline").when(F.col("kind") == "wfactor", "random").otherwise(
        F.col("treatment"))
    info = params.select("param_idx", "kind", "component", "parent", "child", "ran", "treatment",
                         short_label().alias("label"), section.alias("section"))
    stats = summary.select("param_idx", "estimate", "ci_low", "ci_high", "significance")
    picked = sample_draws(draws, per_param, seed).select("param_idx", "draw_id", "value")
    return info.join(stats, "param_idx").join(picked, "param_idx", "left").select(
        "param_idx", "section", "component", "parent", "child", "label", "estimate", "ci_low", "ci_high",
        "significance", "draw_id", "value",
    )


def child_summary(predicted: DataFrame, params: DataFrame, summary: DataFrame, draws: DataFrame,
                  parents: list[str] | None = None, children: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of chosen parents and children under their names."""
    def chosen(df, parent_column=True):
        if children:
            df = df.where(F.col("child").isin(*children))
        if parents and parent_column:
            df = df.where(F.col("parent").isin(*parents) | F.col("parent").isNull())
        return df

    cells_of = chosen(predicted)
    params_of = chosen(params)
    residuals = materialize(residual_groups(cells_of))
    return {
        "rate_count": rate_count(cells_of), "parameters": parameter_rows(params_of, summary, draws),
        "residual_histogram": histogram(residuals, ["grouping"], "residual_log", 50),
        "effect_histogram": effect_histograms(draws, params_of), "quantile_pairs": quantile_pairs(residuals),
    }


def draw_traces(draws: DataFrame, points: int = 1000, high: float = 20.0, low_samples: int = 10,
                seed: int = 42) -> DataFrame:
    """Evenly spaced draws of all high-mean parameters and of a sample of the others.

    The full-data fit is left out. ``order`` numbers the sampled low parameters
    by mean absolute value, largest first.
    """
    walk = draws.where(~F.col("is_full_fit"))
    means = walk.groupBy("param_idx").agg(
        F.avg("value").alias("_mean"), F.avg(F.abs("value")).alias("_size"), F.count(F.lit(1)).alias("_n"),
    ).withColumn("level", F.when(F.col("_mean") > high, "high").otherwise("low"))
    # one row per parameter; the top-k is pruned before the shuffle
    pick = Window.partitionBy("level").orderBy(hash32(seed, "param_idx"), "param_idx")
    low = means.where(F.col("level") == "low").withColumn("_r", F.row_number().over(pick)).where(
        F.col("_r") <= low_samples)
    by_size = Window.partitionBy("level").orderBy(F.desc("_size"), "param_idx")
    low = low.withColumn("order", F.row_number().over(by_size)).drop("_r")
    kept = low.unionByName(means.where(F.col("level") == "high").withColumn("order", F.lit(None).cast("int")))
    step = F.floor(1 + F.col("_j") * (F.col("_n") - 1) / float(points - 1))
    wanted = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_j")).select(
        "param_idx", "level", "order", step.alias("step"))
    placed = ordering.ranked(walk, ["param_idx"], "draw_id", F.lit(0.0), 1.0, "step")
    return wanted.join(placed.select("param_idx", "step", "value"), ["param_idx", "step"]).select(
        "level", "param_idx", "order", "step", "value")


def objective_traces(diagnostics: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Objective and likelihood of every draw relative to the full-data fit."""
    full = diagnostics.where("is_full_fit").select(
        *by, F.col("objective").alias("_o"), F.col("neg_loglik").alias("_n"))
    return ordering.attach(diagnostics.where(~F.col("is_full_fit")), full, list(by)).select(
        *by, "draw_id", (F.col("objective") / F.col("_o")).alias("objective"),
        (F.col("neg_loglik") / F.col("_n")).alias("neg_loglik"))


def _shapiro_weights(n: int) -> list[float]:
    """Royston's weights for samples of n (n > 5), smallest first."""
    from statistics import NormalDist

    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / np.sqrt(n)
    ssq = float((m**2).sum())
    last = np.polyval(SHAPIRO_C1[::-1], u) + m[-1] / np.sqrt(ssq)
    second = np.polyval(SHAPIRO_C2[::-1], u) + m[-2] / np.sqrt(ssq)
    inner = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / np.sqrt(inner)
    a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    return [float(v) for v in a]


def shapiro_p(values: Column, n: int) -> Column:
    """Shapiro-Wilk p-value of a sorted array of n > 11 values; NULL for constant samples."""
    weights = F.array(*[F.lit(w) for w in _shapiro_weights(n)])
    mean = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / n
    top = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)
    spread = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda acc, v: acc + v)
    flat = F.get(values, 0) == F.get(values, n - 1)
    off = F.greatest(1.0 - top * top / spread, F.lit(1e-19))
    x = F.lit(float(np.log(n)))
    z = (F.ln(off) - polynomial(x, SHAPIRO_MEAN)) / F.exp(polynomial(x, SHAPIRO_LOG_SD))
    return F.when(~flat, normal_cdf(-z))


def normality(draws: DataFrame, resamples: int = 100, size: int = SHAPIRO_SIZE, seed: int = 1234) -> DataFrame:
    """Mean Shapiro-Wilk p per (source, parameter) over small resamples of its draws.

    The resample positions are made from the keys and looked up by equality;
    only ``resamples x size`` rows per parameter move.
    """
    keys = ["source", "param_idx"]
    placed = ordering.ranked(draws, keys, "draw_id", F.lit(0.0), 1.0, "_spot").withColumn("_spot", F.col("_spot") - 1)
    sizes = draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slots = sizes.select(
        *keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples * size - 1))).alias("_slot")
    ).select(
        *keys, F.floor(F.col("_slot") / size).alias("_sample"),
        (hash32(seed, "source", "param_idx", "_slot") % F.col("_n")).alias("_spot"),
    )
    samples = slots.join(placed.select(*keys, "_spot", "value"), [*keys, "_spot"]).groupBy(*keys, "_sample").agg(
        F.array_sort(F.collect_list("value")).alias("_v"))
    return samples.select(*keys, shapiro_p(F.col("_v"), size).alias("p")).groupBy(*keys).agg(
        F.when(F.count("p") == resamples, F.avg("p")).alias("normality"))


def spaced_by_rank(table: DataFrame, keys: list[str], value: str, take: int = 10) -> DataFrame:
    """Parameters at ``take`` equally spaced ranks of ``value``; ties by parameter index."""
    placed = ordering.ranked(table, keys, value, F.col("param_idx").cast("double"), 100_000.0, "_k")
    j = F.explode(F.sequence(F.lit(0), F.lit(take - 1)))
    targets = placed.groupBy(*keys).agg(F.first("_k_total").alias("_n")).select("*", j.alias("pick")).select(
        *keys, (F.col("pick") + 1).alias("pick"),
        F.floor(1 + F.col("pick") * (F.col("_n") - 1) / float(take - 1)).alias("_k"))
    return targets.join(placed.drop("_k_total"), [*keys, "_k"]).select(*keys, "pick", "param_idx", value)


def bandwidths(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rule-of-thumb Gaussian bandwidth: 0.9 min(sd, IQR / 1.34) n^-1/5."""
    spread = df.groupBy(*keys).agg(
        F.stddev_samp(value).alias("_sd"), F.count(value).alias("n"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.first(value).alias("_one"))
    q = ordering.quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    low = F.least(F.col("_sd"), iqr)
    usable = F.when(low > 0, low).when(F.col("_sd") > 0, F.col("_sd")).when(
        F.abs("_one") > 0, F.abs("_one")).otherwise(F.lit(1.0))
    return spread.join(q, keys).select(*keys, "n", "lo", "hi",
                                       (0.9 * usable * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def density(df: DataFrame, keys: list[str], value: str, points: int = 512) -> DataFrame:
    """Gaussian kernel density on ``points`` positions, peak moved to 0, as log(density + 1).

    Values are first spread linearly onto a grid of ``points`` positions by
    aggregation; each weight then adds to every output position, summed before
    and after the shuffle.
    """
    wide = bandwidths(df, keys, value).select(
        *keys, F.col("n").alias("_n"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("bw").alias("_bw"))
    # grid reaches 7 bandwidths beyond the data, output 3
    left, right = F.col("_lo") - 7 * F.col("_bw"), F.col("_hi") + 7 * F.col("_bw")
    at = (F.col(value) - left) / ((right - left) / (points - 1))
    cell = F.floor(at)
    spread = ordering.attach(df, wide, keys).select(*keys, "_n", "_lo", "_hi", "_bw", F.explode(F.array(
        F.struct(cell.alias("at"), (1 - (at - cell)).alias("w")),
        F.struct((cell + 1).alias("at"), (at - cell).alias("w")),
    )).alias("_e"))
    weights = spread.groupBy(*keys, F.col("_e.at").alias("_at")).agg(
        F.sum("_e.w").alias("_w"), *[F.first(c).alias(c) for c in ("_n", "_lo", "_hi", "_bw")])
    step = (F.col("_hi") - F.col("_lo") + 14 * F.col("_bw")) / (points - 1)
    x = F.col("_lo") - 3 * F.col("_bw") + F.col("i") * (F.col("_hi") - F.col("_lo") + 6 * F.col("_bw")) / (points - 1)

    def kernel(lag: Column) -> Column:
        z = lag * F.col("_step") / F.col("_bw")
        return F.exp(-0.5 * z * z) / (F.col("_bw") * math.sqrt(2 * math.pi))

    # a weight's share of every output position, between the two grid positions beside it
    opened = (
        weights.withColumn("_step", step).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x).withColumn("_p", (F.col("x") - F.col("_lo") + 7 * F.col("_bw")) / F.col("_step"))
    )
    near, part = F.floor("_p"), F.col("_p") - F.floor("_p")
    share = (1 - part) * kernel(near - F.col("_at")) + part * kernel(near + 1 - F.col("_at"))
    smoothed = opened.groupBy(*keys, "i").agg(
        F.first("x").alias("x"), F.sum(F.col("_w") / F.col("_n") * share).alias("_d"))
    peak = F.max_by("x", F.struct("_d", -F.col("i"))).over(Window.partitionBy(*keys))
    return smoothed.select(*keys, (F.col("i") + 1).alias("i"), (F.col("x") - peak).alias("x"), F.log1p("_d").alias("log_density"))


COMPARED = ("autocorrelation", "normality", "parameters")


def compare_sources(draws: DataFrame, wanted: Sequence[str] = COMPARED) -> dict[str, DataFrame]:
    """Chain and bootstrap draws side by side, each as densities per source.

    ``autocorrelation`` and ``normality``: over parameters, one value each; a parameter without a value
    has no part in it. ``parameters``: the draws of ten parameters equally spaced by their mean.
    """
    def over_parameters(table: DataFrame, value: str) -> DataFrame:
        return density(materialize(table.where(F.col(value).isNotNull())), ["source"], value)

    out = {}
    if "autocorrelation" in wanted:
        out["autocorrelation"] = over_parameters(autocorrelation(draws.where(~F.col("is_full_fit"))), "autocorrelation")
    if "normality" in wanted:
        out["normality"] = over_parameters(normality(draws), "normality")
    if "parameters" in wanted:
        means = materialize(draws.groupBy("source", "param_idx").agg(F.avg("value").alias("value")))
        spaced = spaced_by_rank(means, ["source"], "value").select("source", "param_idx").distinct()
        picked = materialize(draws.join(spaced, ["source", "param_idx"], "left_semi"))
        out["parameters"] = density(picked, ["source", "param_idx"], "value")
    return out


def warp_curves(df: DataFrame, position: str, bound: float, w: float) -> DataFrame:
    """Each position unwarped, warped up and warped down: x, curve, y."""
    x = F.col(position).cast("double")
    curves = F.array(*[
        F.struct(F.lit(name).alias("curve"), value.alias("y")) for name, value in (
            ("w = 0", x), ("w > 0", model.warp(x, bound, F.lit(float(w)))),
            ("w < 0", model.warp(x, bound, F.lit(-float(w)))))
    ])
    return df.select("*", x.alias("x"), F.explode(curves).alias("c")).select(*df.columns, "x", "c.curve", "c.y")


def step_curves(df: DataFrame, position: str, rates: Column, slopes: Column, points: Column, bound: float,
                unbounded: float, warps: tuple[float, float, float]) -> DataFrame:
    """Step curve at each position without and with warps of (rates, slopes, points)."""
    if len(warps) != 3:
        raise ValueError("warps must hold one value each for rates, slopes and points")
    x = F.col(position).cast("double")
    w_rate, w_slope, w_point = (F.lit(float(w)) for w in warps)
    plain = model.step_curve(x, rates, slopes, points)
    warped = model.step_curve(
        x, F.transform(rates, lambda v: model.warp(v, unbounded, w_rate)),
        F.transform(slopes, lambda v: model.warp(v, unbounded, w_slope)),
        F.transform(points, lambda v: model.warp(v, bound, w_point)))
    return df.select("*", x.alias("x"), plain.alias("curve"), warped.alias("warped"))


def logistic_curve(df: DataFrame, position: str, top: float, slope: float) -> DataFrame:
    """Falling logistic of height ``top``, and its slope at the centre: -slope * top / 4 for any logistic."""
    x = F.col(position).cast("double")
    return df.select("*", x.alias("x"), (top * model.logistic(x * -slope)).alias("y"),
                     F.lit(-slope * top / 4).alias("centre_slope"))
