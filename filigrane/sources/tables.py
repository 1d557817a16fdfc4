from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder, on any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
