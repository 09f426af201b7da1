from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from countweave.operators import cells, descent
from verification import catalog, compare
from verification import fixtures as fx

QUICK = [
    "a3_fill_log", "a11_residuals", "w6_ratio_scales", "c5_peaks_three_scales", "e6_parameters", "m17_objective",
    "r1_bootstrap_counts", "t10_summary", "p5_decomposition", "p12_density",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[-4:] == ["n_tokens", "count", "count_log", "observed"] and df.count() == 3840


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("key", QUICK)
def test_query_matches_sql(spark, duck, sf_dir, key):
    got = catalog.QUERIES[key](spark, sf_dir).toPandas()
    assert compare.differs(got, duck.sql(catalog.ORACLE[key]).df()) is None


@pytest.fixture(scope="module")
def made_dir(spark, tmp_path_factory):
    """A lineitem table with two tokens in every cell."""
    path = str(tmp_path_factory.mktemp("made"))
    i = F.col("id")
    level = lambda every, n: F.floor(i / every) % n
    day = (F.ceil(level(1, 40) * 62.5) + level(2880, 2) * 30).cast("int")
    spark.range(5760).select(
        i.alias("l_orderkey"), (i % 11).alias("l_partkey"), level(960, 3).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (i * 7 % 50 + 1).cast("double").alias("l_quantity"), (level(240, 2) * 0.06).alias("l_discount"),
        (level(480, 2) * 0.05).alias("l_tax"), F.element_at(F.split(F.lit("A,N,R"), ","), (level(80, 3) + 1).cast("int")).alias("l_returnflag"),
        F.when(level(40, 2) == 0, "F").otherwise("O").alias("l_linestatus"),
        F.date_add(F.lit("1995-01-01").cast("date"), day).cast("timestamp").alias("l_shipdate"),
    ).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.fixture
def passes(monkeypatch):
    """Names of the steps that read all tokens, as they are called."""
    seen, real = [], cells.cell_sums
    monkeypatch.setattr(cells, "cell_sums", lambda tokens: seen.append("cell_sums") or real(tokens))
    return seen


def test_replicate_parameters_sum_the_tokens_once(spark, made_dir, passes):
    out = catalog.QUERIES["r2_replicate_parameters"](spark, made_dir)
    assert passes == ["cell_sums"] and out.select("replicate").distinct().count() == catalog.REPLICATES


def test_replicate_effects_sum_the_tokens_once(spark, made_dir, passes):
    got = catalog.QUERIES["r2_replicate_effects"](spark, made_dir).toPandas()
    assert passes == ["cell_sums"] and len(got) == 2880
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{made_dir}/lineitem.parquet/*.parquet'")
    assert compare.differs(got, c.sql(catalog.ORACLE["r2_replicate_effects"]).df()) is None


def test_replicate_fits_go_on_until_they_settle(spark, made_dir, monkeypatch):
    """The evaluations of the query's fits are the model's own, so none is cut off. A coarser tolerance and one replicate make it short."""
    monkeypatch.setattr(catalog, "REPLICATES", 1)
    monkeypatch.setattr(fx, "SETTINGS", replace(fx.SETTINGS, ctol=1e-4))
    out = catalog.QUERIES["r5_replicate_fits"](spark, made_dir).collect()
    assert len(out) == 3 and {r["status"] for r in out} <= {descent.SETTLED, descent.STUCK}
    assert all(r["objective"] >= r["neg_loglik"] for r in out)
