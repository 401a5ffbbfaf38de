"""Readers. Predicates stay on the bare partition column, so files are pruned before reading."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.dates import as_date


PRICE_SCHEMA = "model string, brand string, grass_date string, price_usd_median double"
WOE_SCHEMA = "feature string, stage string, ord int, op string, lo double, hi double, `values` array<string>, out double"


def scan_window(df: DataFrame, part: str, anchor: str, days: int, cols: Sequence[str] | None = None) -> DataFrame:
    """Partitions from ``days`` before the anchor up to the anchor, both included."""
    first = (as_date(anchor) - dt.timedelta(days=days)).isoformat()
    kept = df.where((F.col(part) >= first) & (F.col(part) <= as_date(anchor).isoformat()))
    return kept.select(*cols) if cols else kept


def scan_dates(df: DataFrame, part: str, dates: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    kept = df.where(F.col(part).isin(list(dates)))
    return kept.select(*cols) if cols else kept


def run_sql(spark: SparkSession, text: str, args: Mapping[str, object] | None = None, **frames: DataFrame) -> DataFrame:
    """Run a SQL text: values through ``:name`` markers, tables through ``{name}`` frames."""
    return spark.sql(text, args=dict(args or {}), **frames)


def read_price(spark: SparkSession, path: str) -> DataFrame:
    """Device price list: CSV with header and ``d/M/yy`` dates; a bad date becomes null."""
    raw = spark.read.csv(path, schema=PRICE_SCHEMA, header=True)
    return raw.withColumn("grass_date", F.try_to_timestamp("grass_date", F.lit("d/M/yy")).cast("date"))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def dim_from_list(spark: SparkSession, items: Sequence[str], name: str) -> DataFrame:
    """A short in-code list as a one-column frame."""
    return spark.createDataFrame([(i,) for i in sorted(set(items))], T.StructType([T.StructField(name, T.StringType())]))


def read_pages(spark: SparkSession, folder: str, glob: str = "*.{txt,md,htm,html}") -> DataFrame:
    """Captured pages: one row per file with its path, case folder and whole text."""
    pages = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return pages.withColumn("case", F.element_at(F.split("path", "/"), -2))


def load_scorer(path: str) -> tuple[VectorAssembler, GeneralizedLinearRegressionModel]:
    """Saved feature assembler and fitted regression below one model folder."""
    return (
        VectorAssembler.load(f"{path}/vector_assembler"),
        GeneralizedLinearRegressionModel.load(f"{path}/model"),
    )


def load_woe(spark: SparkSession, path: str) -> list[dict]:
    """Rules of a scorecard from Parquet (see ``creditloom.plans.scoring``).

    Rules describe a model, not data: they are as many as its bins, and turn into one expression.
    """
    rows = spark.read.schema(WOE_SCHEMA).parquet(path).collect()
    return [row.asDict() for row in rows]
