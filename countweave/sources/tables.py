"""Reading token and boundary tables; writing and reading result bundles."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Variables, select_model_columns


def token_schema(variables: Variables) -> T.StructType:
    """Schema of a user-named token file, so that reading needs no inference pass."""
    fields = [
        T.StructField(variables.count, T.DoubleType()), T.StructField(variables.bin, T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in (variables.parent, variables.child, variables.ran)],
        *[T.StructField(c, T.StringType()) for c in variables.fixed_effects],
    ]
    if variables.token_id is not None:
        fields.append(T.StructField(variables.token_id, T.StringType()))
    return T.StructType(fields)


def read_tokens(spark: SparkSession, path: str, variables: Variables | None = None, fmt: str = "csv",
                schema: T.StructType | None = None) -> DataFrame:
    """Token table from CSV (header row, NA for missing) or Parquet, in model columns."""
    variables = variables or Variables()
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA")
        if schema is None and variables.fixed_effects:
            # columns are matched by position, so take the file's own order
            named = {f.name: f for f in token_schema(variables).fields}
            header = spark.read.option("header", True).csv(path).columns
            schema = T.StructType([named.get(c, T.StructField(c, T.StringType())) for c in header])
        reader = reader.schema(schema) if schema is not None else reader
        df = reader.csv(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
    return select_model_columns(df, variables)


def column_means(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean of each column, NULL where a column has no value: name, mean."""
    columns = columns or df.columns
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    return means.unpivot([], columns, "name", "mean")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Mean boundary position per column of a boundary file."""
    return column_means(spark.read.option("header", True).option("nullValue", "NA").csv(path))


MANIFEST = "number long, version string, names array<string>"


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest rows of a bundle, one for every version written to its end; None where there is no bundle yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(spark: SparkSession, path: str) -> Row | None:
    rows = _manifest(spark, path)
    return None if rows is None else rows.orderBy(F.desc("number"), "version").first()


def write_bundle(tables: dict[str, DataFrame], path: str) -> str:
    """A new version of a bundle: each table under its name, then the row of the manifest that makes it the one to read.

    A write that stops before the end leaves the version before as it was. Returns the version.
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/version-{version}/{name}")
    last = _latest(spark, path)
    row = [(1 if last is None else last.number + 1, version, list(tables))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read_bundle(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the last version that was written to its end; all of them where no names are given."""
    last = _latest(spark, path)
    if last is None:
        raise ValueError(f"no bundle at {path}")
    missing = sorted(set(names or []) - set(last.names))
    if missing:
        raise ValueError(f"tables not in the bundle: {missing}")
    return {name: spark.read.parquet(f"{path}/version-{last.version}/{name}") for name in names or last.names}
