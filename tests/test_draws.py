import numpy as np
import pytest
from pyspark.sql import functions as F

from countweave.operators import cells, diagnostics, ordering, resample, stats

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and one value of it most of those."""
    hot = np.where(RNG.random(6000) < 0.5, 0.0, RNG.normal(size=6000).round(2))
    rows = [("hot", i, float(v)) for i, v in enumerate(hot)] + [("cold", i, float(i % 7)) for i in range(50)]
    return spark.createDataFrame(rows, "g string, i int, x double").repartition(8)


def test_rank_is_exact_under_skew(skewed):
    got = ordering.ranked(skewed, ["g"], "x", F.col("i").cast("double"), 500.0, buckets=16).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(part) + 1)) and set(part["rank_total"]) == {len(part)}
        pairs = list(zip(part.x, part.i))
        assert pairs == sorted(pairs)
    whole = ordering.ranked(skewed.where("g = 'hot'"), [], "x", F.col("i").cast("double"), 500.0).toPandas()
    assert sorted(whole["rank"]) == list(range(1, 6001))


def test_quantiles_equal_linear_interpolation(skewed):
    ps = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.9987, "e": 1.0}
    got = ordering.quantiles(skewed, ["g"], "x", ps, buckets=16).toPandas().set_index("g")
    for g, part in skewed.toPandas().groupby("g"):
        np.testing.assert_allclose(got.loc[g, list(ps)].astype(float), np.quantile(part.x, list(ps.values())))


@pytest.mark.parametrize("range_rows", [100, 1000])
def test_ranges_follow_the_rows_of_a_key(skewed, range_rows):
    cut = ordering._with_edges(skewed, ["g"], "x", 64, range_rows).groupBy("g").agg(
        F.max("_ranges").alias("n"), F.max(F.size("_edges")).alias("edges")).toPandas().set_index("g")
    n_hot = min(64, -(-6000 // range_rows))
    assert (cut.loc["hot", "n"], cut.loc["hot", "edges"]) == (n_hot, n_hot - 1) and np.isnan(cut.loc["cold", "n"])
    tie, chunk = ordering.hash_tie(["g", "i"])
    got = ordering.ranked(skewed.withColumn("t", tie), ["g"], "x", F.col("t"), chunk, buckets=64, range_rows=range_rows).toPandas()
    assert len(got) == 6050
    for _, part in got.groupby("g"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(part) + 1))
        pairs = list(zip(part.x, part.t))
        assert pairs == sorted(pairs)
    ps = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.9987, "e": 1.0}
    q = ordering.quantiles(skewed, ["g"], "x", ps, buckets=64, range_rows=range_rows).toPandas().set_index("g")
    for g, part in skewed.toPandas().groupby("g"):
        np.testing.assert_allclose(q.loc[g, list(ps)].astype(float), np.quantile(part.x, list(ps.values())))
    whole = ordering.ranked(skewed, [], "x", F.col("i").cast("double"), 500.0, range_rows=range_rows).toPandas()
    assert sorted(whole["rank"]) == list(range(1, 6051)) and "_whole" not in whole


@pytest.mark.parametrize("chunk", [7, 100000])
def test_successive_pairs_cross_chunks(skewed, chunk):
    got = ordering.successive_pairs(skewed, ["g"], "i", "x", chunk).groupBy("g").agg(
        F.corr("previous", "current").alias("r"), F.count(F.lit(1)).alias("n")).toPandas().set_index("g")
    for g, part in skewed.toPandas().sort_values("i").groupby("g"):
        x = part.x.to_numpy()
        assert got.loc[g, "n"] == len(x) - 1
        np.testing.assert_allclose(got.loc[g, "r"], np.corrcoef(x[:-1], x[1:])[0, 1])


def bootstrap_tokens(spark):
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        rows.append((float(i % 11), 1 if hot else i % 5 + 1, "p", "c", "m1" if hot else f"m{i % 2}", "L" if hot or i % 2 else "R", f"t{i}"))
    return spark.createDataFrame(rows, "count double, bin int, parent string, child string, ran string, side string, token_id string")


def test_bootstrap_of_small_and_large_cells_agrees_and_stays_in_range(spark, monkeypatch):
    t = bootstrap_tokens(spark)
    keys = ["replicate", "ran", "parent", "child", "side", "bin"]

    def run(**kw):
        return resample.bootstrap_sums(t, 4, 9, **kw).toPandas().sort_values(keys).reset_index(drop=True)[keys + ["total", "n_tokens"]]

    arrays = run()
    assert run(array_limit=40).equals(arrays)
    monkeypatch.setattr(resample, "RANGE_TARGET", 13)
    assert run(array_limit=40).equals(arrays)
    assert run(array_limit=0).equals(arrays)
    ends = t.groupBy("ran", "parent", "child", "side", "bin").agg(
        F.min("count").alias("lo"), F.max("count").alias("hi"), F.count("count").alias("n")).toPandas()
    both = arrays.merge(ends, on=keys[1:])
    assert (both.n == both.n_tokens).all()
    assert ((both.total >= both.lo * both.n) & (both.total <= both.hi * both.n)).all()
    assert arrays.groupby(keys[1:]).total.nunique().max() > 1
    with pytest.raises(ValueError):
        resample.bootstrap_sums(t.drop("token_id"), 1, 1)


def test_places_and_draws_of_large_cells_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share of the draws follows TASK_ROWS and not the tokens or the session's partitions."""
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "RANGE_TARGET", 13)
    t = bootstrap_tokens(spark)
    keys = ["ran", "parent", "child", "side", "bin"]
    large = resample.large_cells(cells.cell_sums(t), keys, 0)
    places = resample.token_places(t, large, keys, 5).toPandas()
    assert sorted(places.place) == list(range(900)) and (places["_first"] <= places.place).all()
    draws = resample.draw_places(large, 4, 9, 30)
    assert draws.rdd.getNumPartitions() == 30
    shares = [len(p) for p in draws.rdd.glom().collect()]
    assert sum(shares) == 3600 and max(shares) < 600
    monkeypatch.setattr(resample, "TASK_ROWS", 100)
    out = resample.bootstrap_sums(t, 4, 9, array_limit=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(place") == 2 and "(place#" in plan and ", 36)" in plan
    assert out.agg(F.sum("n_tokens")).first()[0] == 3600


def test_tokens_without_an_id_are_drawn_in_large_cells_too(spark):
    t = bootstrap_tokens(spark).withColumn("token_id", F.when(F.col("token_id") != "t3", F.col("token_id")))
    keys = ["replicate", "ran", "parent", "child", "side", "bin"]
    arrays, rows = [resample.bootstrap_sums(t, 4, 9, array_limit=limit).toPandas().sort_values(keys).reset_index(drop=True)[
        keys + ["total", "n_tokens"]] for limit in (4096, 0)]
    assert rows.n_tokens.sum() == 3600 and rows.equals(arrays)


def test_equal_ids_are_drawn_alike_in_small_and_large_cells(spark):
    t = bootstrap_tokens(spark).withColumn("token_id", F.lit("same"))
    keys = ["replicate", "ran", "parent", "child", "side", "bin"]
    arrays, rows = [resample.bootstrap_sums(t, 2, 9, array_limit=limit).toPandas().sort_values(keys).reset_index(drop=True)[
        keys + ["total", "n_tokens"]] for limit in (4096, 0)]
    assert rows.equals(arrays)


def test_few_small_cells_go_with_the_large_ones(spark):
    keys = ["ran", "parent", "child", "side", "bin"]

    def chosen(n_small, empty=3):
        rows = [("m", "p", "c", "L", 1, 1.0, 360)] + [("m", "p", "c", "R", i, 1.0, 60) for i in range(n_small)]
        rows += [("n", "p", "c", "R", i, None, 0) for i in range(empty)] + [("m", "p", "c", "R", None, 1.0, 500)]
        sums = spark.createDataFrame(rows, "ran string, parent string, child string, side string, bin int, total double, n_tokens bigint")
        got = resample.large_cells(sums, keys, 60).orderBy("_first").toPandas()
        assert list(got["_first"]) == [0, *got.cell_size.cumsum()[:-1]] or got.empty
        return len(got)

    assert [chosen(0), chosen(6), chosen(7)] == [1, 7, 1]


def draws_table(spark, n=400):
    rows = [(i, i == n - 1, p, float(v)) for p in range(3)
            for i, v in enumerate(RNG.normal(loc=[0.0, 0.8, 3.0][p], size=n))]
    return spark.createDataFrame(rows, "draw_id int, is_full_fit boolean, param_idx int, value double")


def test_p_values_and_holm(spark):
    d = draws_table(spark)
    est = stats.full_fit_values(d)
    pdf = d.toPandas()
    p = stats.p_values(d, est)
    got = {r["param_idx"]: r["p_value"] for r in p.collect()}
    for i, part in pdf.groupby("param_idx"):
        x, e = part.value - part.value.mean(), abs(part.value[part.is_full_fit].iloc[0])
        np.testing.assert_allclose(got[i], 1 - (x <= e).mean() + (x <= -e).mean())
    without = stats.p_values(d, est, include_full_fit=False)
    assert without.count() == 3
    raw = stats.holm(p, 0.05).orderBy("p_value", "param_idx").toPandas()
    np.testing.assert_allclose(raw.p_value_adj, raw.p_value * [3, 2, 1])
    np.testing.assert_allclose(raw.alpha_adj, 0.05 / np.array([3, 2, 1]))
    up = stats.holm(p, 0.05, monotone=True).orderBy("p_value", "param_idx").toPandas()
    np.testing.assert_allclose(up.p_value_adj, np.minimum(np.maximum.accumulate(raw.p_value_adj), 1))


def test_holm_ties_go_by_index(spark):
    p = spark.createDataFrame([(i, 0.0) for i in (4, 2, 9, 7)] + [(1, 0.5)], "param_idx int, p_value double")
    got = stats.holm(p, 0.1).orderBy("alpha_adj").toPandas()
    assert list(got.param_idx) == [2, 4, 7, 9, 1]


def test_converged_rule(spark):
    d = draws_table(spark, 50)
    mostly = spark.createDataFrame([(i, 5 if i % 20 == 0 else 3) for i in range(50)], "draw_id int, status int")
    rarely = spark.createDataFrame([(i, 5 if i % 5 == 0 else 3) for i in range(50)], "draw_id int, status int")
    assert stats.keep_converged(d, mostly).count() == 47 * 3
    assert stats.keep_converged(d, rarely).count() == 150
    assert stats.keep_converged(d, None).count() == 150
    assert stats.drop_burnin(d, 10).count() == 40 * 3
    with pytest.raises(ValueError):
        stats.summary(d, None, None, method="none")


def test_normality_ranks_normal_above_skewed(spark):
    rows = [("chain", i, 0, float(v)) for i, v in enumerate(RNG.normal(size=2000))]
    rows += [("chain", i, 1, float(v)) for i, v in enumerate(RNG.exponential(size=2000))]
    rows += [("chain", i, 2, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "source string, draw_id int, param_idx int, value double")
    got = {r["param_idx"]: r["normality"] for r in diagnostics.normality(df).collect()}
    assert 0.4 < got[0] < 0.6 and got[1] < 0.02 and got[2] is None


def test_shapiro_matches_published_values(spark):
    # W of the first sample is 0.79 in Shapiro and Wilk (1965); longer ones need n > 11
    uniform = [float(i) for i in range(1, 21)]
    w = np.dot(diagnostics._shapiro_weights(20), uniform) ** 2 / np.sum((np.array(uniform) - 10.5) ** 2)
    assert abs(w - 0.9604) < 2e-3
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w = np.dot(diagnostics._shapiro_weights(11), men) ** 2 / np.sum((np.array(men) - np.mean(men)) ** 2)
    assert abs(w - 0.79) < 5e-3
    p = spark.range(1).select(diagnostics.shapiro_p(F.array(*[F.lit(v) for v in uniform]), 20).alias("p")).first()["p"]
    assert abs(p - 0.55) < 0.02


def test_density_integrates_to_one_with_its_peak_at_zero(spark):
    x = RNG.normal(size=3000)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    out = diagnostics.density(df, ["g"], "x").orderBy("i").toPandas()
    y = np.expm1(out.log_density)
    assert len(out) == 512 and abs(out.x[y.argmax()]) < 1e-12
    assert abs(np.trapezoid(y, out.x) - 1) < 0.01
    bw = diagnostics.bandwidths(df, ["g"], "x").first()["bw"]
    q = np.quantile(x, [0.25, 0.75])
    np.testing.assert_allclose(bw, 0.9 * min(x.std(ddof=1), (q[1] - q[0]) / 1.34) * 3000**-0.2)
    at = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 512)[100]
    exact = np.mean(np.exp(-0.5 * ((at - x) / bw) ** 2)) / (bw * np.sqrt(2 * np.pi))
    assert abs(y[100] - exact) < 1e-3


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([("a", float(i % 13)) for i in range(200)] + [("b", 4.0)] * 3, "g string, x double")
    h = diagnostics.histogram(df, ["g"], "x", 6, peak_normalised=True).toPandas()
    assert h[h.g == "a"].n.sum() == 200 and h[h.g == "b"].n.tolist() == [3] and h.groupby("g").density.max().eq(1).all()
