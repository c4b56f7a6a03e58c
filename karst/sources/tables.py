"""Tables beside clouds: CSV with blanks as nulls and fixed decimals, elevation caches, summary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed columns of CSV files with a header; blank and nan cells are null."""
    df = spark.read.csv(path, header=True, schema=schema, nullValue="", nanValue="nan", enforceSchema=False)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_csv(df: DataFrame, path: str, places: dict[str, int]) -> None:
    """CSV files with a header and so many decimals in some columns; what reads them back reads the rounded values. A file a partition."""
    shown = {c: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{n}f", F.bround(F.col(c).cast("double"), n))) for c, n in places.items()}
    df.withColumns(shown).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def cached_dem(spark: SparkSession, path: str, make) -> DataFrame:
    """The elevation table at path; made and written by make() where there is none yet. The path may be in any store that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_summary(row: DataFrame, path: str, places: dict[str, int] | None = None) -> None:
    """A one-row table as a JSON document, numbers rounded half to even."""
    if row.limit(2).count() != 1:
        raise ValueError("a summary is one row")
    row.withColumns({c: F.bround(c, n) for c, n in (places or {}).items()}).coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
