import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countweave.operators import changepoints, effects, windows

RNG = np.random.default_rng(7)


def frame(spark, series):
    rows = [(k, i + 1, float(v)) for k, xs in series.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "s string, bin int, x double")


def direct_loglik(x, ws, split):
    n, half, out = len(x), ws // 2, np.zeros(len(x))
    for i in range(n - ws + 1):
        parts = [x[i:i + half], x[i + half:i + ws]] if split else [x[i:i + ws]]
        total = 0.0
        for p in parts:
            sd = np.std(p)
            total += sum(-0.5 * math.log(2 * math.pi * sd * sd) - (v - p.mean()) ** 2 / (2 * sd * sd) for v in p) \
                if sd > 0 else np.nan
        out[i + half] = 1.0 if np.isnan(total) else total
    edge = out.sum() / n
    out[:min(half, n)] = edge
    out[max(n - ws + half + 1, 0):] = edge
    return out


@pytest.mark.parametrize("ws", [4, 5, 8, 13])
def test_rolling_loglik_equals_direct_sums(spark, ws):
    series = {"noise": RNG.normal(size=30), "flat": np.full(20, 2.0), "step": np.r_[np.zeros(12), np.full(12, 5.0)],
              "ramp": np.arange(25.0), "short": RNG.normal(size=3)}
    for split in (False, True):
        got = windows.rolling_loglik(frame(spark, series), ["s"], "x", ws, split, "y").orderBy("s", "bin").toPandas()
        for k, x in series.items():
            np.testing.assert_allclose(got[got.s == k].y, direct_loglik(x, ws, split), atol=1e-9, err_msg=k)


def test_small_helpers(spark):
    x = RNG.normal(size=12)
    df = frame(spark, {"a": x})
    smooth = windows.trailing_mean(df, ["s"], "x", 4, "y").orderBy("bin").toPandas().y
    np.testing.assert_allclose(smooth, [x[max(0, i - 3):i + 1].mean() for i in range(12)])
    np.testing.assert_allclose(windows.differences(df, ["s"], "x", "y").orderBy("bin").toPandas().y, np.diff(x))
    with pytest.raises(ValueError):
        windows.rolling_loglik(df, ["s"], "x", 1, False, "y")


def scan_peaks(curves, ws, cutoff):
    """Sequential scan over positions and scales."""
    n, half, found, last_i, last_v = len(curves[0]), ws // 2, [], 0, 0.0
    tops = [c.mean() + cutoff * c.std() for c in curves]
    for i in range(n):
        for c, top in zip(curves, tops):
            if c[i] > top and half < i < n - half:
                if i - last_i > half:
                    found.append(i)
                elif c[i] > last_v:
                    found[-1] = i
                else:
                    continue
                last_i, last_v = i, c[i]
                break
    return [i + 1 for i in found]


@pytest.mark.parametrize("scales", [1, 3])
def test_peaks_equal_the_sequential_scan(spark, scales):
    cases = {f"k{j}": [np.round(RNG.normal(size=40), 1) for _ in range(scales)] for j in range(40)}
    rows = [(k, i + 1, *[float(c[i]) for c in cs]) for k, cs in cases.items() for i in range(40)]
    names = [f"c{j}" for j in range(scales)]
    df = spark.createDataFrame(rows, "s string, bin int, " + ", ".join(f"{c} double" for c in names))
    got = {r["s"]: r["points"] for r in changepoints.peaks(df, ["s"], names, 6, 1.0).collect()}
    for k, cs in cases.items():
        assert got.get(k, []) == scan_peaks(cs, 6, 1.0), k


def naive_alignment(x, y):
    """Cell-by-cell dynamic programme with the same five steps."""
    n, d = len(x), np.abs(np.subtract.outer(x, y))
    cost, came = {(0, 0): d[0, 0]}, {}
    steps = [
        ((1, 3), [(0, 2, 2), (0, 1, 1), (0, 0, 1)]), ((1, 2), [(0, 1, 2), (0, 0, 1)]), ((1, 1), [(0, 0, 2)]),
        ((2, 1), [(1, 0, 2), (0, 0, 1)]), ((3, 1), [(2, 0, 2), (1, 0, 1), (0, 0, 1)]),
    ]
    for i in range(n):
        for j in range(n):
            best = None
            for (di, dj), path in steps:
                p = (i - di, j - dj)
                if p in cost:
                    c = cost[p] + sum(w * d[i - a, j - b] for a, b, w in path)
                    if best is None or c < best[0]:
                        best = (c, p, [(i - a, j - b) for a, b, _ in path])
            if best and (i, j) != (0, 0):
                cost[i, j], came[i, j] = best[0], best[1:]
    at, cells = (n - 1, n - 1), []
    while at != (0, 0):
        prev, path = came[at]
        cells += path
        at = prev
    return cells + [(0, 0)]


def matched(spark, rows):
    df = spark.createDataFrame([(k, [None if v is None else float(v) for v in x], [None if v is None else float(v) for v in y], p)
                                for k, (x, y, p) in enumerate(rows)], "k int, x array<double>, y array<double>, p array<int>")
    got = df.select("k", changepoints.matched_points(F.col("x"), F.col("y"), F.col("p")).alias("at")).collect()
    return [r["at"] for r in sorted(got)]


def wanted(x, y, points):
    path = naive_alignment(x, y)
    return [int(np.round(np.mean([i + 1 for i, j in path if j == p - 1]))) for p in points]


def test_alignment_equals_the_naive_programme(spark):
    rows = [(RNG.normal(size=18).cumsum(), RNG.normal(size=18).cumsum(), [3, 9, 15]) for _ in range(6)]
    rows += [(RNG.normal(size=n), RNG.normal(size=n), list(range(1, n + 1))) for n in (1, 2, 3, 4, 7, 40)]
    assert matched(spark, rows) == [wanted(*r) for r in rows]


def test_alignment_takes_the_first_of_equally_cheap_steps(spark):
    """Curves of few whole numbers: sums are exact, so most cells have several cheapest steps."""
    rows = [(RNG.integers(0, 2, 16).astype(float), RNG.integers(0, 2, 16).astype(float), list(range(1, 17))) for _ in range(12)]
    rows.append((np.zeros(12), np.zeros(12), list(range(1, 13))))
    assert matched(spark, rows) == [wanted(*r) for r in rows]


def test_alignment_of_equal_curves_is_the_identity(spark):
    x = list(RNG.normal(size=30))
    hole = [*x[:4], None, float("nan"), *x[6:]]
    assert matched(spark, [(x, x, [5, 20]), (x, x, [7]), (hole, [*x[:4], 1.0, 1.0, *x[6:]], [5, 6, 30]), (x, x, []), (x, [None, *x[1:]], [5])]) == [
        [5, 20], [7], [5, 6, 30], [], [None]]


def test_planted_change_points_are_found(start):
    found = {(r["parent"], r["child"], r["k"]): r["m"] for r in start.change_points.groupBy("parent", "child", "k").agg(
        F.avg("bin0").alias("m")).collect()}
    for p in ("F", "O"):
        for c in ("A", "N", "R"):
            hits = [v for (a, b, _), v in found.items() if (a, b) == (p, c)]
            assert min(abs(h - 13) for h in hits) <= 8


def test_interval_index_and_merge(spark):
    df = spark.createDataFrame([([3.0, 7.0], float(x)) for x in (1, 3, 5, 7, 9)] + [([], 4.0)], "p array<double>, x double")
    got = [(r["i"]["lower"], r["i"]["upper"]) for r in df.select(
        "x", changepoints.interval_index(F.col("p"), F.col("x")).alias("i")).collect()]
    assert got == [(-1, 0), (-1, 1), (0, 1), (1, -1), (1, -1), (-1, -1)]
    a = spark.createDataFrame([("g", v) for v in (1, 5, 30)], "g string, at int")
    b = spark.createDataFrame([("g", v) for v in (4, 12, 14, 30)], "g string, at int")
    assert changepoints.buffered_merge(a, b, ["g"], "at", 3).first()["points"] == [1, 5, 12, 30]


def naive_runs(profile, points, share):
    n, deg = len(profile), len(points)
    bounds = [(0 if k == 0 else points[k - 1] - 1, n - 1 if k == deg else points[k]) for k in range(deg + 1)]
    mean = lambda a, b: profile[a] if a == b else np.mean(profile[max(a, 0):b])
    rates, runs = [mean(*b) for b in bounds], []
    for k in range(1, deg + 1):
        at, back, ahead, rise, forward = bounds[k][0], 0, 0, 0.0, True
        need = (rates[k] - rates[k - 1]) * share
        sign = -1.0 if need < 0 else 1.0
        sizes = [b[1] - b[0] for b in bounds]
        while rise * sign < need * sign and (back < sizes[k - 1] or ahead < sizes[k]):
            rise = mean(at, at + ahead) - mean(at - back, at)
            if forward:
                ahead += ahead < sizes[k]
            else:
                back += back < sizes[k - 1]
            forward = not forward
        runs.append(max(back + ahead, 1))
    return rates, runs


def test_block_estimates_equal_the_loop(spark):
    cases = {}
    for j in range(12):
        x = np.r_[np.full(8, 1.0), np.full(9, 4.0 * RNG.normal()), np.full(8, 2.0)] + RNG.normal(size=25) * 0.6
        cases[f"t{j}"] = (x, [] if j == 0 else [8, 17])
    prof = spark.createDataFrame([("p", "c", k, [float(v) for v in x]) for k, (x, _) in cases.items()],
                                 "parent string, child string, treatment string, profile array<double>")
    pts = spark.createDataFrame(
        [("p", "c", k, i, float(v), v) for k, (_, ps) in cases.items() for i, v in enumerate(ps)],
        "parent string, child string, treatment string, k int, point double, bin0 int")
    for r in effects.block_estimates(prof, pts, 25, 0.8).collect():
        x, ps = cases[r["treatment"]]
        if not ps:
            np.testing.assert_allclose(r["rates"], [x.mean()])
            assert r["runs"] == []
            continue
        rates, runs = naive_runs(x, ps, 0.8)
        np.testing.assert_allclose(r["rates"], rates)
        assert r["runs"] == runs, r["treatment"]


def test_missing_value_only_spoils_what_depends_on_it(spark):
    from countweave.operators import design

    lv = design.levels(spark.createDataFrame([("a", "u"), ("b", "v")], "f string, g string"), ["f", "g"])
    pairs = design.effect_pairs(design.treatments(lv, ["f", "g"]))
    y = spark.createDataFrame([("ref", 1.0), ("b", 3.0), ("v", None), ("bv", 9.0)], "treatment string, value double")
    got = {r["treatment"]: r["value"] for r in effects.split_effects(y, pairs, []).collect()}
    assert got == {"ref": 1.0, "b": 2.0, "v": None, "bv": None}


def test_six_factors_split_and_combine(spark):
    from countweave.operators import design

    names = list("uvwxyz")
    level_table = spark.createDataFrame(
        [(f, f"{f}{i}", i, i == 0) for f in names for i in range(2)],
        "factor string, level string, level_idx int, is_ref boolean")
    table = design.treatments(level_table, names)
    pairs = design.effect_pairs(table)
    assert table.count() == 64 and pairs.count() == 3**6
    y = table.select("treatment", (F.col("treatment_idx") * F.col("treatment_idx")).cast("double").alias("value"))
    b = effects.split_effects(y, pairs, [])
    assert "Subquery" not in b._jdf.queryExecution().executedPlan().toString()
    back = {r["treatment"]: r["value"] for r in effects.combine_effects(b, pairs, []).collect()}
    assert back == {r["treatment"]: r["value"] for r in y.collect()}
    gone = effects.split_effects(y.where("treatment_idx > 0"), pairs, []).where("value IS NOT NULL")
    assert gone.count() == 0
