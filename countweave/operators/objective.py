"""The penalised objective with its gradient, at series grain, for many parameter vectors at once.

The parameters of a (replicate, child) are one vector, in order of param_idx. A series knows at which places of
its child's vector its own parameters stand. So trial vectors meet series by equality, each
series gives its share of value and gradient from arrays, and shares are summed by place: a child with very
many series is spread like any other. The column expressions are built once and kept, as building them takes longer than a plan.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import slopes
from ..functions.vectors import dot, empty, named, places, total
from ..schema import COMPONENTS, NO_RANDOM_EFFECT, WARPS, ModelSettings
from .curve import BAD_OBJECTIVE
from .design import targets

FULL_FIT = -1
PROBLEM = ["replicate", "child"]
WARP_OF = {"Rt": "rate", "tslope": "slope", "tpoint": "point"}
#: Places below 0 carry other sums than the gradient's.
VALUE, LIKELIHOOD, BAD, NEGATIVE = -1, -2, -3, -4


def problem_params(params: DataFrame, replicate: bool) -> DataFrame:
    """Parameters with their replicate and their place in the vector of their (replicate, child)."""
    own = F.col("replicate").cast("int") if replicate else F.lit(FULL_FIT)
    rows = params.select(own.alias("replicate"), "child", "param_idx", "kind", "component", "parent", "ran", "treatment", "k", "value")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*PROBLEM).orderBy("param_idx")) - 1)


def vectors(params: DataFrame, **flags: Column) -> DataFrame:
    """Each problem's parameter vector x, and further arrays in the same order."""
    entry = F.struct("place", F.col("value").alias("x"), *[c.alias(name) for name, c in flags.items()])
    sorted_ = F.array_sort(F.collect_list(entry))
    return params.groupBy(*PROBLEM).agg(sorted_.alias("_e")).select(
        *PROBLEM, *[F.col(f"_e.{n}").alias(n) for n in ("x", *flags)])


def problem_series(series: DataFrame, dispersion: DataFrame, params: DataFrame, pairs: DataFrame, replicate: bool) -> DataFrame:
    """Series with log counts of observed cells, dispersion, and the places of their parameters.

    ``at_<component>``: per transition the places whose values add up; ``w_<warp>``: the place of the warp, if any.
    """
    on = ["replicate", "parent", "child"] if replicate else ["parent", "child"]
    both = series.join(dispersion.select(*on, "dispersion"), on)
    rep = F.col("replicate").cast("int") if replicate else F.lit(FULL_FIT)
    seen = F.zip_with("n_tokens", "count", lambda n, c: F.when(
        n.isNotNull() | (F.col("ran") == NO_RANDOM_EFFECT), F.log1p(c)))
    own = both.select(rep.alias("replicate"), "child", "parent", "treatment", "ran", seen.alias("log_counts"), "dispersion")
    effects = targets(pairs).select(F.col("effect"), F.col("treatment").alias("of"))
    fixed = params.where(F.col("kind") != "wfactor").join(effects, F.col("treatment") == F.col("effect")).groupBy(
        *PROBLEM, "parent", F.col("of").alias("treatment"), "component", "k").agg(F.sort_array(F.collect_list("place")).alias("at"))
    at = fixed.groupBy(*PROBLEM, "parent", "treatment").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("component") == c, F.struct("k", "at")))), lambda e: e["at"]).alias(f"at_{c}")
        for c in COMPONENTS])
    warps = params.where(F.col("kind") == "wfactor").groupBy(*PROBLEM, "ran").agg(*[
        F.max(F.when(F.col("component") == w, F.col("place"))).alias(f"w_{w}") for w in WARPS])
    return own.join(at, [*PROBLEM, "parent", "treatment"]).join(warps, [*PROBLEM, "ran"], "left")


def spread(series: DataFrame) -> DataFrame:
    """Series dealt evenly over the cores, for an evaluation costs some milliseconds a series but reads few bytes of it:
    partitions made by size would leave a whole fit to one task."""
    spark = series.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return series.repartition(n, *PROBLEM, "parent", "treatment", "ran")


@lru_cache(8)
def _components(n_bins: int, settings: ModelSettings) -> list[tuple[str, Column]]:
    """``e_<component>``: a series' warped values with their derivatives at its problem's x; ``d``: its distances."""
    bounds = {"Rt": settings.unbounded, "tslope": settings.unbounded, "tpoint": float(n_bins)}

    def warped(c: str) -> Column:
        summed = F.transform(F.col(f"at_{c}"), lambda ps: F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + F.get("x", p)))
        return slopes.warps(summed, bounds[c], F.coalesce(F.get("x", F.col(f"w_{WARP_OF[c]}")), F.lit(0.0)))

    v = lambda c: F.transform(f"e_{c}", lambda x: x["v"])
    ends = F.concat(F.array(F.lit(0.0)), v("tpoint"), F.array(F.lit(float(n_bins))))
    gaps = F.transform(places(F.size("ends") - 1), lambda k: F.get("ends", k + 1) - F.get("ends", k) - settings.buffer(n_bins))
    raw = F.concat(v("tslope"), F.when(F.size("e_tpoint") > 0, gaps).otherwise(empty("double")), v("Rt"))
    d = F.transform(raw, lambda d: F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d))
    return [*[(f"e_{c}", warped(c)) for c in COMPONENTS], ("ends", ends), ("d", d)]


def _at(series: DataFrame, trials: DataFrame, ids: list[str], n_bins: int, settings: ModelSettings) -> DataFrame:
    """Series at the vectors x of their problem's trials, with e and d."""
    rows = series.join(trials.select(*dict.fromkeys([*PROBLEM, *ids]), "x"), PROBLEM)
    return named(rows, _components(n_bins, settings)).drop("ends")


def start_distances(series: DataFrame, at: DataFrame, n_bins: int, settings: ModelSettings) -> DataFrame:
    """Series with the distances at their problem's vector x."""
    return _at(series, at, PROBLEM, n_bins, settings).withColumnRenamed("d", "distances").drop(*[f"e_{c}" for c in COMPONENTS], "x")


@lru_cache(1)
def _fit() -> tuple[list[tuple[str, Column]], dict[str, Column]]:
    """Stages, then the likelihood of a series' cells with its derivatives by the series' values (value, bad, Rt, tslope, tpoint)."""
    rates, steps, points = (F.col(f"e_{c}") for c in COMPONENTS)
    v = lambda a, k: F.get(a, k)["v"]
    seen = F.filter(F.transform("log_counts", lambda y, i: F.struct((i + 1).cast("double").alias("at"), y.alias("y"))), lambda c: c["y"].isNotNull())
    curved = F.transform(seen, lambda c: F.struct(c["at"], c["y"], slopes.curve(c["at"], rates, steps, points).alias("r")))
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("off"), F.lit(0.0).alias("bend"))

    def bent(k: Column) -> Column:
        risen = F.transform("c", lambda c: F.struct(
            c["slope"].alias("slope"), (c["at"] - v(points, k)).alias("off"),
            slopes.model.logistic(v(steps, k) * (c["at"] - v(points, k))).alias("s")))
        return F.aggregate(risen, zero, lambda acc, c: F.struct(
            (acc["up"] + c["slope"] * c["s"]).alias("up"), (acc["off"] + c["slope"] * c["s"] * (1.0 - c["s"]) * c["off"]).alias("off"),
            (acc["bend"] + c["slope"] * c["s"] * (1.0 - c["s"])).alias("bend")))

    jump = lambda k: v(rates, k + 1) - v(rates, k)
    up = lambda k: F.coalesce(F.get("t", k)["up"], F.lit(0.0))
    first = F.aggregate("c", F.lit(0.0), lambda acc, c: acc + c["slope"])
    return [("c", slopes.cells(curved, F.col("dispersion"))), ("t", F.transform(places(F.size(points)), bent)), ("first", first),
            ("fitted", F.coalesce(F.aggregate("c", F.lit(0.0), lambda acc, c: acc + c["value"]), F.lit(0.0)))], {
        "bad": F.exists("c", lambda c: c["value"].isNull() | F.isnan(c["value"]) | c["slope"].isNull() | F.isnan(c["slope"])),
        "Rt": F.transform(places(F.size(rates)), lambda k: F.when(k == 0, F.col("first")).otherwise(up(k - 1)) - up(k)),
        "tslope": F.transform("t", lambda x, k: jump(k) * x["off"]),
        "tpoint": F.transform("t", lambda x, k: -v(steps, k) * jump(k) * x["bend"])}


def _by_distance(by: str) -> dict[str, Column]:
    """Derivatives by a series' values from those by its distances, a column."""
    k = F.size("e_tpoint")
    return {"Rt": F.when(k > 0, F.slice(by, 2 * k + 2, k + 1)).otherwise(F.col(by)),
            "tslope": F.when(k > 0, F.slice(by, 1, k)).otherwise(empty("double")),
            "tpoint": F.transform(places(k), lambda i: F.get(by, k + i) - F.get(by, k + i + 1))}


def _entries() -> Column:
    """(place, share) of the gradient from derivatives by a series' values, ``g_<component>``."""
    out = []
    for c in COMPONENTS:
        by_value = F.zip_with(f"g_{c}", f"e_{c}", lambda x, w: x * w["dv"])
        out.append(F.flatten(F.zip_with(F.col(f"at_{c}"), by_value, lambda ps, x: F.transform(
            ps, lambda p: F.struct(p.cast("int").alias("place"), x.alias("share"))))))
        at = F.col(f"w_{WARP_OF[c]}")
        by_warp = total(F.zip_with(f"g_{c}", f"e_{c}", lambda x, w: x * w["dw"]))
        out.append(F.when(at.isNotNull(), F.array(F.struct(at.cast("int").alias("place"), by_warp.alias("share"))))
                   .otherwise(empty("struct<place: int, share: double>")))
    return F.concat(*out)


@lru_cache(2)
def _penalised(gradient: bool) -> tuple[list[tuple[str, Column]], Column]:
    """Stages, then what a series adds to value and gradient."""
    stages, f = _fit()
    weight = F.transform("coefficients", lambda a: F.coalesce(1.0 / (a * a), F.lit(0.0)))
    penalty = F.zip_with(weight, "d", lambda c, x: c / F.when(x <= 0, F.lit(1e-60)).otherwise(x * x))
    sums = F.concat(_row(VALUE, F.col("fitted") + total(penalty)), _row(LIKELIHOOD, F.col("fitted")), _row(BAD, f["bad"].cast("int")))
    if not gradient:
        return [x for x in stages if x[0] in ("c", "fitted")], sums
    by = F.zip_with(weight, "d", lambda c, x: F.when(x > 0, -2.0 * c / (x * x * x)).otherwise(F.lit(0.0)))
    b = _by_distance("by")
    g = [(f"g_{c}", F.zip_with(f[c], b[c], lambda x, y: x + y)) for c in COMPONENTS]
    return [*stages, ("by", by), *g], F.concat(sums, _entries())


@lru_cache(8)
def _lacking(n_bins: int, target: float) -> tuple[list[tuple[str, Column]], Column]:
    """Stages, then what a series adds to the shortfall and its gradient."""
    lack = F.transform("d", lambda x: F.greatest(target - x, F.lit(0.0)))
    below = F.exists(F.sequence(F.lit(1), F.lit(n_bins)), lambda b: F.coalesce(
        ~(slopes.curve(b.cast("double"), *[F.col(f"e_{c}") for c in COMPONENTS]) >= 0), F.lit(True)))
    stages = [("lack", lack), ("by", F.transform("lack", lambda x: -2.0 * x)), *[(f"g_{c}", g) for c, g in _by_distance("by").items()]]
    return stages, F.concat(_row(VALUE, dot(F.col("lack"), F.col("lack"))), _row(NEGATIVE, below.cast("int")), _entries())


def _row(place: int, share: Column) -> Column:
    return F.array(F.struct(F.lit(place).alias("place"), share.cast("double").alias("share")))


def _sums(shares: DataFrame, ids: list[str]) -> DataFrame:
    """Shares summed by place, then one row per trial: value, neg_loglik, least, negative, g (place, share)."""
    summed = shares.select(*ids, "least", F.explode("entries").alias("e")).groupBy(*ids, "e.place").agg(
        F.sum("e.share").alias("share"), F.min("least").alias("least"))
    special = lambda p: F.max(F.when(F.col("place") == p, F.col("share")))
    out = summed.groupBy(*ids).agg(
        special(VALUE).alias("value"), special(LIKELIHOOD).alias("neg_loglik"), special(BAD).alias("bad"),
        F.coalesce(special(NEGATIVE) > 0, F.lit(False)).alias("negative"), F.min("least").alias("least"),
        F.array_sort(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "share")))).alias("g"))
    off = (F.coalesce("bad", F.lit(0.0)) > 0) | F.col("value").isNull() | F.isnan("value") | (F.col("value") > BAD_OBJECTIVE)
    bad = F.lit(BAD_OBJECTIVE)
    return out.select(
        *ids, F.when(off, bad).otherwise(F.col("value")).alias("value"),
        F.when(off, bad).otherwise(F.col("neg_loglik")).alias("neg_loglik"), "least", "negative",
        F.when(off, F.transform("g", lambda e: F.struct(e["place"].alias("place"), F.lit(0.0).alias("share")))).otherwise(F.col("g")).alias("g"))


def _added(df: DataFrame, parts: tuple[list[tuple[str, Column]], Column], ids: list[str]) -> DataFrame:
    stages, entries = parts
    return _sums(named(df, stages).select(*ids, entries.alias("entries"), F.array_min("d").alias("least")), ids)


def penalised(series: DataFrame, trials: DataFrame, n_bins: int, settings: ModelSettings, ids: list[str], gradient: bool = True) -> DataFrame:
    """Objective, likelihood and gradient of every trial vector: its likelihood over observed cells plus the penalty.

    ``series`` carries ``coefficients``, one per distance (NULL: none); ``trials`` carries the problem, ``ids`` and x. One row
    per trial: value, neg_loglik, least (its smallest distance) and g, the gradient's entries (place, share).
    An undefined likelihood gives 1e100 and a gradient of 0.
    """
    return _added(_at(series, trials, ids, n_bins, settings), _penalised(gradient), ids)


def shortfall(series: DataFrame, trials: DataFrame, n_bins: int, settings: ModelSettings, ids: list[str], target: float) -> DataFrame:
    """Summed squared amounts by which distances stay below ``target``, with the gradient.

    Also whether any predicted log rate, observed or not, is negative.
    """
    found = _added(_at(series, trials, ids, n_bins, settings), _lacking(n_bins, target), ids)
    return found.withColumn("neg_loglik", F.lit(None).cast("double"))


def dense(g: Column, x: Column) -> Column:
    """A gradient's entries as a vector as long as x; places no series reaches are 0."""
    sparse = F.transform(x, lambda _, i: F.coalesce(F.get(F.filter(g, lambda e: e["place"] == i), F.lit(0))["share"], F.lit(0.0)))
    return F.when(F.size(g) == F.size(x), F.transform(g, lambda e: e["share"])).otherwise(sparse)
