"""Points and features as DataFrames: validation, and loaders for the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; ValueError names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df.select(*columns)


def points(df: DataFrame, id_col: str = "point_id", *more: str) -> DataFrame:
    """cloud_id, the id, x, y and z as doubles, and further columns; rows without finite coordinates drop out."""
    df = require(df, "cloud_id", id_col, "x", "y", "z", *more)
    df = df.select("cloud_id", id_col, *(F.col(c).cast("double").alias(c) for c in "xyz"), *more)
    infinite = float("inf")
    for c in "xyz":
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < infinite))
    return df


def embedding_points(spark: SparkSession, sf_dir: str, *more, first: int = 0) -> DataFrame:
    """Clouds by label, of three dimensions of the embeddings from ``first`` on."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    axes = [F.col("embedding")[first + i].cast("double").alias(c) for i, c in enumerate("xyz")]
    return e.select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), *axes, *more)


def embedding_features(spark: SparkSession, sf_dir: str, first: int = 3, count: int = 8) -> DataFrame:
    """Further dimensions of the embeddings, one row for each channel."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = F.posexplode(F.slice("embedding", first + 1, count)).alias("channel", "value")
    return e.select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").alias("point_id"), own).withColumns({"channel": F.col("channel").cast("long"), "value": F.col("value").cast("double")})


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds by user: scaled value, hour of the day, and the number in props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return e.select(F.col("user_id").cast("long").alias("cloud_id"), F.col("event_id").alias("point_id"), (F.col("value") / 600).cast("double").alias("x"), (F.hour("ts") / 24).cast("double").alias("y"), k.alias("z"))
