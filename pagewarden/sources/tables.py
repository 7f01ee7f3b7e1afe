"""Reading the given Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts. A cluster reads it as it is split and shuffles nothing; in
    local mode a table of fewer files than cores is spread over the cores.
    """
    table = read_table(spark, sf_dir, name)
    context = spark.sparkContext
    if context.master.startswith("local") and len(table.inputFiles()) < context.defaultParallelism:
        return table.repartition(context.defaultParallelism)
    return table
