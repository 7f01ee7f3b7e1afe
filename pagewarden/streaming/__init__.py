"""Audit, lifecycle and spans on streams."""

from pyspark.sql import DataFrame


def append_stream(rows: DataFrame, out: str, checkpoint: str, partitions: int = None):
    """Appends the rows of a stream to Parquet files until the input is used up.

    ``partitions``: into how many parts the query's state is cut, for as long as the checkpoint lives;
    without it, the session's shuffle partitions.
    """
    spark, key = rows.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if partitions:
        spark.conf.set(key, str(partitions))
    try:  # a query takes its own copy of the settings when it starts
        return rows.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
