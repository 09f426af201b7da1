import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from countweave import ChainSettings
from countweave.functions import model, slopes, special
from countweave.functions.vectors import dot
from countweave.operators import curve, descent, fit, objective, walk
from countweave.plans import run as plan
from verification import fixtures as fx

IDS = ["replicate", "child", "trial"]


@pytest.fixture(scope="module")
def ready(start):
    p = fit.problems(start.series, start.dispersion, start.params, start.pairs, fx.N_BINS, fx.SETTINGS)
    return fit.with_penalty(fit.make_feasible(p))


def params_at(p):
    """Parameters with the values where the problems stand."""
    at = p.points.select("child", F.posexplode("x").alias("place", "value"))
    return p.params.drop("value", "replicate").join(at, ["child", "place"])


def around(spark, p, child, h=1e-6):
    """The child's vector, and trials that move each place both ways."""
    x = np.array(p.points.where(F.col("child") == child).first()["x"])
    rows = [(fit.FULL_FIT, child, 2 * i + up, (x + (h if up else -h) * e).tolist()) for i, e in enumerate(np.eye(len(x))) for up in (0, 1)]
    return x, spark.createDataFrame(rows, "replicate int, child string, trial int, x array<double>")


def slope_of(values, n, h=1e-6):
    v = {r["trial"]: r["value"] for r in values.select("trial", "value").collect()}
    return np.array([(v[2 * i + 1] - v[2 * i]) / (2 * h) for i in range(n)])


def test_special_functions(spark):
    xs = [0.01, 0.3, 1.0, 2.5, 17.0, 400.0, 1e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(
        special.log_gamma(F.col("x")).alias("g"), slopes.digamma(F.col("x"), 1 / (F.col("x") + 8)).alias("d")).collect()
    np.testing.assert_allclose([r["g"] for r in got], [math.lgamma(x) for x in xs], rtol=1e-11, atol=1e-11)
    np.testing.assert_allclose([r["d"] for r in got[2:4]], [-0.5772156649015329, 0.7031566406452432], rtol=1e-11)
    np.testing.assert_allclose([r["d"] for r in got], [(math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h) for x in xs for h in [1e-4 * x]], rtol=1e-5, atol=1e-6)
    ps = [1e-12, 1e-4, 0.05, 0.3, 0.5, 0.8, 0.999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select(
        "p", special.normal_quantile(F.col("p")).alias("z")).select("p", "z", special.normal_cdf(F.col("z")).alias("back"))
    from statistics import NormalDist
    for r in rows.collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-8
        assert abs(r["back"] - r["p"]) < 1e-12


def test_curve_edge_cases(spark):
    one = spark.range(1)
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(model.step_curve(F.lit(3.0), arr([2.5]), arr([]), arr([]))) == 2.5
    assert get(model.step_curve(F.lit(3.0), arr([1, float("inf"), 2]), arr([1, 1]), arr([2, 9]))) == float("inf")
    assert get(model.logistic(F.lit(-800.0))) == 0.0 and get(model.logistic(F.lit(800.0))) == 1.0
    assert get(model.warp(F.lit(7.0), 10.0, F.lit(0.0))) == 7.0
    with pytest.raises(Exception, match="bound"):
        get(model.warp_checked(F.lit(11.0), 10.0, F.lit(0.5)))


def test_gradient_matches_finite_differences(spark, ready):
    x, trials = around(spark, ready, "A")
    found = fit.value_and_gradient(ready).where("child = 'A'").orderBy("param_idx").collect()
    assert len(found) == len(x) and found[0]["objective"] > found[0]["neg_loglik"]
    moved = objective.penalised(ready.series, trials, fx.N_BINS, fx.SETTINGS, IDS, gradient=False)
    np.testing.assert_allclose([r["slope"] for r in found], slope_of(moved, len(x)), atol=2e-4, rtol=1e-4)


def test_objective_agrees_with_the_tables_of_the_model(start, ready):
    params = params_at(ready)
    keys = start.series.select("ran", "parent", "child", "treatment")
    warped = curve.warped_series(keys, params, start.pairs, fx.N_BINS, fx.SETTINGS)
    predicted = curve.predicted_cells(curve.with_dispersion(start.series, start.dispersion), params, start.pairs, fx.N_BINS, fx.SETTINGS)
    nll = curve.likelihood(predicted, ["child"])
    distances = curve.boundary_distances(warped, fx.N_BINS, 2.0)
    coefficients = curve.penalty_coefficients(distances, nll, fx.SETTINGS.max_penalty_at_distance_factor)
    want = curve.objective(nll, curve.penalties(distances, coefficients, ["child"]), ["child"]).orderBy("child").collect()
    got = fit.value_and_gradient(ready).select("child", "objective", "neg_loglik", "min_distance").distinct().orderBy("child").collect()
    for c in ("objective", "neg_loglik", "min_distance"):
        np.testing.assert_allclose([r[c] for r in got], [r[c] for r in want], rtol=1e-9)
    assert curve.feasible(predicted, distances, ["child"]).where("feasible").count() == 3


def test_bad_predictions_have_no_likelihood(spark, ready):
    x = np.array(ready.points.where("child = 'A'").first()["x"])
    place = ready.params.where("child = 'A' and kind = 'baseline' and component = 'Rt' and k = 0").first()["place"]
    x[place] = -5.0
    trial = spark.createDataFrame([(fit.FULL_FIT, "A", 0, x.tolist())], "replicate int, child string, trial int, x array<double>")
    r = objective.penalised(ready.series, trial, fx.N_BINS, fx.SETTINGS, IDS).first()
    assert r["value"] == r["neg_loglik"] == curve.BAD_OBJECTIVE and all(e["share"] == 0 for e in r["g"])


def test_infeasible_start_is_moved_inside(spark, start):
    moved = start.params.withColumn("value", F.when(
        (F.col("kind") == "baseline") & (F.col("component") == "tpoint") & (F.col("k") == 0) & (F.col("child") != "N"), 45.0).otherwise(F.col("value")))
    p = fit.problems(start.series, start.dispersion, moved, start.pairs, fx.N_BINS, fx.SETTINGS)
    least = lambda p: {r["child"]: r["least"] for r in objective.start_distances(p.series, p.points, fx.N_BINS, fx.SETTINGS).groupBy("child").agg(
        F.min(F.array_min("distances")).alias("least")).collect()}
    before, inside = least(p), fit.make_feasible(p)
    after = least(inside)
    assert before["A"] < 0 and before["R"] < 0 and all(after[c] >= fit.FEASIBLE_AT for c in "AR") and after["N"] == before["N"]
    x, trials = around(spark, p, "A")
    one = lambda t: objective.shortfall(p.series, t, fx.N_BINS, fx.SETTINGS, IDS, 0.02)
    at = one(p.points.withColumn("trial", F.lit(0))).where("child = 'A'").first()
    np.testing.assert_allclose([e["share"] for e in at["g"]], slope_of(one(trials), len(x)), rtol=1e-3, atol=1e-3)


BOWLS = "replicate int, child string, x array<double>"


def valley(trials, ids):
    """Rosenbrock's valley for the children that begin with h, a bowl for the others."""
    x, y = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    hill = F.col("child").startswith("h")
    value = F.when(hill, (1 - x) * (1 - x) + 100 * (y - x * x) * (y - x * x)).otherwise(dot(F.col("x"), F.col("x")))
    g = F.when(hill, F.array(-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x))).otherwise(F.transform("x", lambda v: 2 * v))
    return trials.select(*ids, value.alias("value"), F.lit(None).cast("double").alias("neg_loglik"), F.lit(1.0).alias("least"),
                         F.lit(False).alias("negative"), F.transform(g, lambda v, i: F.struct(i.alias("place"), v.alias("share"))).alias("g"))


def test_descent_reports_why_it_stopped(spark):
    rows = [(0, f"bowl{i}", [3.0 + i, -4.0]) for i in range(20)] + [(1, "hill", [0.6, 0.3]), (0, "flat", [0.0, 0.0])]
    state = descent.begin(spark.createDataFrame(rows, BOWLS), valley)
    out = {r["child"]: r for r in descent.descend(state, lambda s: valley, spark.createDataFrame(rows, BOWLS), 1e-9, 400).collect()}
    assert len(out) == 22 and out["flat"]["status"] == descent.STUCK and out["flat"]["x"] == [0.0, 0.0]
    assert all(out[f"bowl{i}"]["value"] < 1e-9 and out[f"bowl{i}"]["status"] in (3, 4) for i in range(20))
    np.testing.assert_allclose(out["hill"]["x"], [1, 1], atol=1e-2)
    few = descent.descend(state, lambda s: valley, spark.createDataFrame(rows, BOWLS), 1e-9, 4, enough=1e-3)
    few = {r["child"]: r for r in few.collect()}
    assert few["hill"]["status"] == descent.OUT_OF_EVALS and few["hill"]["evals"] >= 4
    assert few["flat"]["status"] == descent.ENOUGH and all(r["value"] <= 1e-3 for r in few.values() if r["status"] == descent.ENOUGH)


def test_held_places_do_not_move(spark):
    points = spark.createDataFrame([(0, "bowl", [3.0, -4.0], [1.0, 0.0])], BOWLS + ", free array<double>")
    out = descent.descend(descent.begin(points, valley), lambda s: valley, points, 1e-9, 100).first()
    assert abs(out["x"][0]) < 1e-3 and out["x"][1] == -4.0


def test_walk_is_the_one_taken_step_by_step(spark):
    """Blocks of proposals give the walk of one proposal at a time, at every block size; a stuck chain goes back."""
    def bowl(trials, ids):
        return trials.select(*ids, dot(F.col("x"), F.col("x")).alias("value"), F.lit(0.0).alias("neg_loglik"))

    starts = spark.createDataFrame([(c, k, [1.0, -1.0], [0.7, 0.7], [True, False]) for c in (0, 1) for k in "ab"],
                                   "chain int, child string, x array<double>, length array<double>, prior_on array<boolean>")
    runs = [sorted(tuple(r) for r in walk.walk(starts, bowl, 7, steps=2, every=2, prior_sd=2.0, block=b).select(
        "chain", "child", "draw_id", "x", "value", "acceptance", "proposals").collect()) for b in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 8
    assert len({r[3][0] for r in runs[0]}) > 3


def test_hot_child_is_spread(spark, ready):
    """A child with very many more series than the others does not meet in one task."""
    many = ready.series.where("child = 'A'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("copy") \
        .unionByName(ready.series.where("child <> 'A'")).repartition(16)
    ones = ready.points.withColumn("trial", F.lit(0))
    plan_ = objective.penalised(many, ones, fx.N_BINS, fx.SETTINGS, IDS)
    one = {r["child"]: r["neg_loglik"] for r in objective.penalised(ready.series, ones, fx.N_BINS, fx.SETTINGS, IDS, gradient=False).collect()}
    got = {r["child"]: r["neg_loglik"] for r in plan_.collect()}
    assert abs(got["A"] / one["A"] - 100) < 1e-6 and got["N"] == pytest.approx(one["N"])
    text = plan_._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in text and "FlatMap" not in text and "PythonUDF" not in text


def test_few_series_are_spread_over_the_cores(spark, ready):
    """A fit's series are some kilobytes, yet no task evaluates them all."""
    series = ready.series.withColumn("task", F.spark_partition_id()).groupBy("task").count().toPandas()
    assert len(series) > 1 and series["count"].max() < series["count"].sum() / 2 and series["count"].sum() == 96


def test_whole_run(spark, sf_dir):
    with pytest.warns(UserWarning):  # few steps: no fit settles, and the chain is short
        out = plan.run(fx.raw_tokens(spark, sf_dir).drop("l_orderkey", "l_quantity", "l_discount"), fx.VARIABLES, replace(fx.SETTINGS, max_evals=2),
                       bootstraps=2, chain=ChainSettings(steps=4, step_size=0.002, burnin=1, neighbor_filter=1), n_bins=fx.N_BINS)
    n = out.params.count()
    assert out.stats.count() == n and out.draws.count() == 3 * n
    d = out.draw_diagnostics.toPandas()
    assert len(d) == 3 and d.is_full_fit.sum() == 1 and (d.objective >= d.neg_loglik).all()
    assert out.chain_draws.where("not is_full_fit").count() == 4 * n
    assert out.residuals.count() == 1 + 4 + 4 + 6
    bundle = out.tables()
    assert set(bundle) >= {"cells", "params", "draws", "stats", "chain_draws", "reference_pools", "settings",
                           "parameter_rows", "objective_traces", "compared_parameters"}
    assert bundle["settings"].where("name = 'n_bins'").first()["value"] == str(fx.N_BINS)
    assert bundle["recommended_draws"].first()["actual_draws"] == 3
    assert bundle["compared_autocorrelation"].where("source = 'chain'").count() == 512
    tested = out.stats.where("p_value is not null").count()
    assert tested == out.params.where("kind = 'beta'").count()
    with pytest.raises(ValueError):
        plan.run(fx.raw_tokens(spark, sf_dir), fx.VARIABLES)
