import pytest
from pyspark.sql import functions as F

from countweave import ChainSettings, ModelSettings, Variables, select_model_columns
from countweave.operators import cells, design
from countweave.sources import tables


def tokens(spark):
    rows = [(2.0, 1, "p", "c", "m1", "L", "old"), (None, 2, "p", "c", "m1", "R", "young"),
            (float("nan"), 3, "p", "c", "m2", "L", "young"), (5.0, 3, "p", "c", "m2", "R", "old")]
    return spark.createDataFrame(rows, "n double, at int, area string, gene string, mouse string, side string, age string")


NAMES = {"count": "n", "bin": "at", "parent": "area", "child": "gene", "ran": "mouse"}


def test_columns_are_mapped_and_effects_inferred(spark):
    out = select_model_columns(tokens(spark), NAMES)
    assert out.columns == ["count", "bin", "parent", "child", "ran", "side", "age"]
    one = select_model_columns(tokens(spark), {**NAMES, "fixed_effects": ["age"]})
    assert one.columns[5:] == ["age"]


@pytest.mark.parametrize("names, message", [
    ({**NAMES, "count": "missing"}, "not found"),
    ({**NAMES, "fixed_effects": ["nope"]}, "not found"),
    ({**NAMES, "colour": "x"}, "unknown"),
])
def test_bad_variables_raise(spark, names, message):
    with pytest.raises(ValueError, match=message):
        select_model_columns(tokens(spark), names)


def test_no_fixed_effect_raises(spark):
    with pytest.raises(ValueError, match="no fixed effects"):
        select_model_columns(tokens(spark).drop("side", "age"), NAMES)


def test_misplaced_column_raises(spark):
    bad = select_model_columns(tokens(spark), NAMES).select("bin", "count", "parent", "child", "ran", "side")
    with pytest.raises(ValueError, match="misplaced"):
        cells.cell_sums(bad)


def test_thin_fixed_effect_raises(spark):
    t = select_model_columns(tokens(spark).withColumn("side", F.lit("L")), NAMES)
    level_table, effects = cells.sums_levels(cells.cell_sums(t))
    with pytest.raises(ValueError, match="side"):
        design.check_fixed_effects(level_table, effects)


@pytest.mark.parametrize("given, error", [
    ({"buffer_factor": 0}, ValueError), ({"buffer_factor": 1.0}, ValueError), ({"ctol": -1}, ValueError),
    ({"ctol": "x"}, TypeError), ({"speed": 1}, ValueError),
])
def test_model_settings_are_checked(given, error):
    with pytest.raises(error):
        ModelSettings.from_dict(given)


def test_settings_warn_and_derive():
    with pytest.warns(UserWarning, match="ctol"):
        ModelSettings(ctol=2.0)
    with pytest.warns(UserWarning, match="steps"):
        ChainSettings(steps=50)
    with pytest.warns(UserWarning, match="step_size"):
        ChainSettings(step_size=2.0)
    with pytest.raises(ValueError):
        ChainSettings(burnin=-1)
    s = ModelSettings()
    assert s.window(40) == 3 and s.window(100) == 6 and s.buffer(100) == 5.0
    assert abs(s.unbounded - 4.5036e8) < 1e4


def test_missing_counts_keep_levels_but_not_cells(spark):
    t = select_model_columns(tokens(spark), NAMES)
    assert cells.drop_missing(t).count() == 2
    table = cells.cells(t, None)
    # 2 ran + none, 4 treatments, 3 bins
    assert table.count() == 3 * 4 * 3
    seen = table.where("ran <> 'none' and observed").collect()
    assert sorted((r["ran"], r["bin"], r["count"]) for r in seen) == [("m1", 1, 2.0), ("m2", 3, 5.0)]
    with pytest.raises(ValueError, match="filled"):
        cells.cells(t, 3, strict=True)


def test_csv_boundaries_and_bundle(spark, tmp_path):
    path = str(tmp_path / "tokens.csv")
    with open(path, "w") as f:
        f.write("n,side,at,area,gene,mouse\n1.5,L,1,p,c,m1\nNA,R,2,p,c,m1\n")
    v = Variables(count="n", bin="at", parent="area", child="gene", ran="mouse", fixed_effects=("side",))
    t = tables.read_tokens(spark, path, v)
    assert t.dtypes[:2] == [("count", "double"), ("bin", "int")]
    assert sorted((r["bin"], r["count"], r["side"]) for r in t.collect()) == [(1, 1.5, "L"), (2, None, "R")]
    edges = str(tmp_path / "edges.csv")
    with open(edges, "w") as f:
        f.write('"V1","V2"\nNA,78\nNA,81\n')
    got = {r["name"]: r["mean"] for r in tables.read_boundaries(spark, edges).collect()}
    assert got == {"V1": None, "V2": 79.5}
    version = tables.write_bundle({"tokens": t}, str(tmp_path / "out"))
    assert tables.read_bundle(spark, str(tmp_path / "out"), ["tokens"])["tokens"].count() == 2
    # a write that stops in the middle leaves the version before; a whole one takes its place
    fails = t.select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        tables.write_bundle({"tokens": t.limit(1), "broken": fails}, str(tmp_path / "out"))
    assert {k: v.count() for k, v in tables.read_bundle(spark, str(tmp_path / "out")).items()} == {"tokens": 2}
    tables.write_bundle({"tokens": t.limit(1), "more": t}, str(tmp_path / "out"))
    assert {k: v.count() for k, v in tables.read_bundle(spark, str(tmp_path / "out")).items()} == {"tokens": 1, "more": 2}
    with pytest.raises(ValueError, match="other"):
        tables.read_bundle(spark, str(tmp_path / "out"), ["other"])
    with pytest.raises(ValueError, match="no bundle"):
        tables.read_bundle(spark, str(tmp_path / "none"))
    assert tables.read_tokens(spark, str(tmp_path / "out" / f"version-{version}" / "tokens"), Variables(fixed_effects=("side",)), "parquet").count() == 2


def test_three_factors_and_colliding_names(spark):
    rows = [(a, b, c) for a in "xyz" for b in ("u", "v") for c in ("r", "s")]
    lv = design.levels(spark.createDataFrame(rows, "f1 string, f2 string, f3 string"), ["f1", "f2", "f3"])
    t = design.treatments(lv, ["f1", "f2", "f3"])
    names = [r["treatment"] for r in t.orderBy("treatment_idx").collect()]
    assert names == ["ref", "y", "z", "v", "s", "yv", "zv", "ys", "zs", "vs", "yvs", "zvs"]
    pairs = design.effect_pairs(t)
    assert pairs.where("treatment = 'zvs'").count() == 8
    same = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "bc"), ("bb", "c")], "f1 string, f2 string")
    t2 = design.treatments(design.levels(same, ["f1", "f2"]), ["f1", "f2"])
    assert t2.select("treatment").distinct().count() == t2.count() == 16
    assert design.effect_pairs(t2).where("treatment = effect").count() == 16


def test_streaming_sums_match_the_table(spark, tmp_path):
    from countweave.streaming.cells import running_cell_sums

    t = select_model_columns(tokens(spark), NAMES)
    with pytest.raises(ValueError):
        running_cell_sums(t)
    src = str(tmp_path / "in")
    t.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = running_cell_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("sums").exceptAll(cells.cell_sums(t)).count() == 0
    assert spark.table("sums").count() == cells.cell_sums(t).count()


def test_bins_off_the_grid_are_left_out(spark):
    rows = [(1.0 + b, b, "p", "c", "m", side) for b in (0, 1, 2, 3) for side in ("L", "R")] + [(9.0, None, "p", "c", "m", "L")]
    t = spark.createDataFrame(rows, "count double, bin int, parent string, child string, ran string, side string")
    got = {(r["bin"], r["count"]) for r in cells.cells(t, 3, leave_out=True).where("ran = 'm'").collect()}
    assert got == {(1, 2.0), (2, 3.0), (3, 4.0)}
    assert {r["count"] for r in cells.cells(t, 2, leave_out=True).where("ran = 'none'").collect()} == {2.0, 3.0}


def test_build_rejects_thin_effects_and_the_reserved_level(spark):
    from countweave.plans import initial

    rows = [(1.0, b, "p", "c", ran, side) for b in (1, 2) for ran in ("m", "none") for side in ("L", "R")]
    t = spark.createDataFrame(rows, "count double, bin int, parent string, child string, ran string, side string")
    with pytest.raises(ValueError, match="reserved"):
        initial.build(t, ModelSettings(), 2)
    with pytest.raises(ValueError, match="fewer than 2"):
        initial.build(t.where("side = 'L' and ran = 'm'"), ModelSettings(), 2)


@pytest.mark.parametrize("name", ["treatment", "replicate", "total", "n_tokens", "value"])
def test_effects_may_carry_the_librarys_own_names(spark, name):
    rows = [(1.0, 1 + i % 2, "p", "c", "r", f"l{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, f"count double, bin int, parent string, child string, ran string, {name} string")
    got = cells.cells(select_model_columns(df))
    assert f"fx_{name}" in got.columns and got.count() == 2 * 3 * 2
    assert got.where("ran = 'r'").agg({"n_tokens": "sum"}).first()[0] == 12


def test_missing_groups_and_bins_are_not_lost(spark):
    rows = [(2.0, 1, "p", "c", "r", "a"), (3.0, 1, "p", "c", None, "b"), (5.0, 9, "p", None, "r", "a"), (7.0, None, "p", "c", "r", "a")]
    df = select_model_columns(spark.createDataFrame(rows, "count double, bin int, parent string, child string, ran string, e string"))
    sums = cells.cell_sums(df)
    assert sums.agg({"total": "sum"}).first()[0] == 17
    with pytest.raises(ValueError, match="outside bins"):
        cells.series(sums, 3)
    on = cells.cells(sums, 3, leave_out=True).where("n_tokens IS NOT NULL").agg({"count": "sum"}).first()[0]
    assert on + cells.off_grid(sums, 3).agg({"total": "sum"}).first()[0] == 17
    with pytest.raises(ValueError, match="reserved"):
        cells.series(cells.cell_sums(df.na.replace({"r": "none"}, subset=["ran"])), 3, leave_out=True)
