"""Model inputs derived from the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countweave.operators import cells as cells_
from countweave.operators import changepoints, curve, design, effects
from countweave.schema import ModelSettings, Variables, select_model_columns
from countweave.sources.storage import materialize

N_BINS = 40
FIXED_EFFECTS = ["disc", "tax"]
SETTINGS = ModelSettings(window_factor=4.0)
WS = SETTINGS.window(N_BINS)

TOKENS_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS token_id,
       CAST(least(40, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 62.5) AS INT) + 1) AS INT) AS bin,
       l_linestatus AS parent, l_returnflag AS child, concat('s', l_suppkey % 3) AS ran,
       CASE WHEN l_discount < 0.05 THEN 'd0' ELSE 'd1' END AS disc,
       CASE WHEN l_tax < 0.04 THEN 't0' ELSE 't1' END AS tax, l_orderkey, l_quantity, l_discount
FROM lineitem
"""
TOKENS_CTE = f"""raw_tokens AS ({TOKENS_SQL}),
tokens AS (SELECT token_id, bin, parent, child, ran, disc, tax, l_orderkey,
  l_quantity * CASE WHEN bin <= 13 THEN 1 WHEN bin <= 27 THEN 6 ELSE 2 END
             * CASE WHEN disc = 'd1' AND bin > 13 THEN 1.5 ELSE 1.0 END AS count FROM raw_tokens)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-named token table (columns still carry user names)."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    bin_ = F.least(F.lit(N_BINS), F.floor(day / 62.5).cast("int") + 1)
    late = F.col("day_bin") > 13
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("day_bin", bin_)
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        F.date_format("l_shipdate", "yyyyMMdd")).alias("item"),
            "day_bin", "l_linestatus", "l_returnflag",
            F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"),
            F.when(F.col("l_discount") < 0.05, "d0").otherwise("d1").alias("disc"),
            F.when(F.col("l_tax") < 0.04, "t0").otherwise("t1").alias("tax"),
            "l_orderkey", "l_quantity", "l_discount",
        )
        .withColumn(
            "amount",
            F.col("l_quantity")
            * F.when(F.col("day_bin") <= 13, 1).when(F.col("day_bin") <= 27, 6).otherwise(2)
            * F.when((F.col("disc") == "d1") & late, 1.5).otherwise(1.0),
        )
    )


VARIABLES = Variables(count="amount", bin="day_bin", parent="l_linestatus", child="l_returnflag", ran="source",
                      fixed_effects=("disc", "tax"), token_id="item")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_model_columns(raw_tokens(spark, sf_dir), VARIABLES)


def tokens_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).where(~((F.col("ran") == "s2") & (F.col("bin") == 7)))


def tokens_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tokens(spark, sf_dir)
    raw = raw.withColumn("amount", F.when(F.col("l_orderkey") % 50 != 0, F.col("amount")))
    return select_model_columns(raw, VARIABLES)


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.floor("value").cast("double").alias("count"), F.dayofmonth("ts").alias("bin"),
        F.lit("all").alias("parent"), F.col("event_type").alias("child"),
        F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string")).alias("ran"),
        F.when(F.col("user_id") % 4 < 2, "a").otherwise("b").alias("seg"),
        F.col("event_id").alias("token_id"),
    )
    return select_model_columns(e, Variables(token_id="token_id"))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(cells_.cell_sums(tokens(spark, sf_dir)))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_.open_bins(cells_.series(tokens(spark, sf_dir), N_BINS))


def held_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells for queries that read them more than once."""
    return cells_.open_bins(materialize(cells_.series(tokens(spark, sf_dir), N_BINS)))


def levels_and_treatments(spark: SparkSession, sf_dir: str):
    level_table, effects_found = cells_.sums_levels(sums(spark, sf_dir))
    return level_table, design.treatments(level_table, effects_found)


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.ratio_table(cells(spark, sf_dir), N_BINS, WS)


def simple_points(ratio_table: DataFrame) -> DataFrame:
    """Change points that SQL can state: the best bin of each half of every complete series.

    Like the operator's own peaks they keep more than half a window from both ends.
    """
    half = F.when(F.col("bin").between(WS // 2 + 2, N_BINS // 2), 0).when(
        F.col("bin").between(N_BINS // 2 + 1, N_BINS - WS // 2), 1)
    return ratio_table.withColumn("k", half).where("k is not null").groupBy(*design.SERIES, "k").agg(
        (F.max_by("bin", "r1") - 1).alias("bin0"))


class SimpleModel:
    """Parameters SQL can state: real block rates, simple change points, slopes by rank."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        sum_table = sums(spark, sf_dir)
        self.levels, fixed = cells_.sums_levels(sum_table)
        self.levels = materialize(self.levels)
        self.treatments = materialize(design.treatments(self.levels, fixed))
        self.pairs = materialize(design.effect_pairs(self.treatments))
        self.series = materialize(cells_.series(sum_table, N_BINS))
        self.cells = cells_.open_bins(self.series)
        self.points = simple_points(changepoints.ratio_table(self.cells, N_BINS, WS))
        self.treatment_points = changepoints.treatment_points(self.points)
        self.profiles = effects.profiles(cells_.log_means(self.cells))
        self.estimates = effects.block_estimates(
            self.profiles, self.treatment_points, N_BINS, SETTINGS.rise_threshold_factor)
        fixed_runs = self.estimates.withColumn("runs", F.transform("points", lambda p, k: (k + 1) * 3))
        self.values = effects.component_values(fixed_runs, SETTINGS.min_initial_slope)
        self.split = effects.split_effects(self.values, self.pairs, ["parent", "child", "component", "k"])
        self.warps = effects.initial_warps(
            self.series.select("ran", "child").distinct(), SETTINGS.rng_seed)
        self.dispersion = cells_.dispersion(self.cells)

    @property
    def params(self) -> DataFrame:
        return effects.parameter_table(self.split, self.warps, self.treatments)

    def ready(self) -> "SimpleModel":
        """Materialise the parameters before they feed several branches."""
        self.held = materialize(self.params)
        self.warped = materialize(curve.warped_series(
            self.series.select(*design.SERIES), self.held, self.pairs, N_BINS, SETTINGS))
        self.predicted = curve.predicted_cells(
            curve.with_dispersion(self.series, self.dispersion), self.held, self.pairs, N_BINS, SETTINGS)
        self.distances = curve.boundary_distances(self.warped, N_BINS, SETTINGS.buffer(N_BINS))
        self.nll = curve.likelihood(self.predicted, ["child"])
        return self

    def coefficients(self) -> DataFrame:
        return curve.penalty_coefficients(self.distances, self.nll, SETTINGS.max_penalty_at_distance_factor)

    def scaled_draws(self, n: int = 3) -> DataFrame:
        draw = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        return self.held.select("*", draw.alias("draw_id")).withColumn("value", F.col("value") * (1 + 0.01 * F.col("draw_id")))


def mean_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells predicted by their group's mean log count."""
    c = held_cells(spark, sf_dir)
    mean = cells_.log_means(c).withColumnRenamed("mean_log", "pred_log")
    return c.join(mean, ["parent", "child", "treatment", "bin"]).withColumn("pred", F.expm1("pred_log"))


def draws(spark: SparkSession, sf_dir: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A draws table without a fit, and its parameters: two sources, or every line under the one named."""
    li = table(spark, sf_dir, "lineitem")
    p = (F.col("l_suppkey") % 12).cast("bigint")
    d = li.groupBy(
        (F.lit(source) if source else F.when(F.col("l_linenumber") % 2 == 0, "chain").otherwise("bootstrap")).alias("source"),
        p.alias("param_idx"),
        F.col("l_orderkey").alias("draw_id"),
    ).agg(F.avg((F.col("l_discount") - 0.05) * 10 + p * 0.05).alias("value"))
    full = d.groupBy("source", "param_idx").agg((F.avg("value") * 1.1 + 0.0137).alias("value")).select(
        "source", "param_idx", F.lit(-1).cast("bigint").alias("draw_id"), "value", F.lit(True).alias("is_full_fit"))
    i = F.col("param_idx")
    params = d.select("param_idx").distinct().select(
        "param_idx", F.when(i < 9, "beta").otherwise("wfactor").alias("kind"),
        F.when(i < 3, "Rt").when(i < 6, "tslope").when(i < 9, "tpoint").when(i == 9, "point").when(i == 10, "rate")
        .otherwise("slope").alias("component"),
        F.when(i < 9, "p").alias("parent"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("child"),
        F.when(i >= 9, "s0").alias("ran"), F.when(i < 9, "d1").alias("treatment"),
        F.when(i < 9, (i % 3).cast("int")).alias("k"), F.concat(F.lit("par_"), i.cast("string")).alias("name"),
    )
    return d.withColumn("is_full_fit", F.lit(False)).unionByName(full), params


def boot_draws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All draws as one source."""
    d, p = draws(spark, sf_dir, "bootstrap")
    return materialize(d), materialize(p)


def draw_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("draw_id"), F.when(F.col("o_orderkey") % 20 == 0, 5).otherwise(3).alias("status"),
        F.col("o_totalprice").alias("objective"), (F.col("o_totalprice") * 0.9).alias("neg_loglik"),
        (F.col("o_orderkey") % 1000).cast("int").alias("evals"))


def with_full_fit(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics with the row of the full-data fit, draw -1."""
    full = diagnostics.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("draw_id"), F.lit(3).alias("status"))
    return diagnostics.select("draw_id", "status").unionByName(full)
