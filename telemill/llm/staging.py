"""Intermediate tables in the shared folder, so that no result depends on an executor's own disk."""

from pyspark.sql import DataFrame, SparkSession

from telemill.scratch import new_folder


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder and read it back: the lineage ends here."""
    spark = frame.sparkSession
    folder = new_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
