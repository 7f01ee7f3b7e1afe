"""Small helpers shared by the corpus operators."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewarden.operators.scale import materialize, scratch_dir  # noqa: F401

# Texts may be long: a batch that crosses to Python holds at most so many rows.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Arrow batches through a function of column lists to column lists.

    ``make`` is called once in each task and returns the function, so tables it
    needs are built once; it gets one Python list for each input column and
    returns one for each output column.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(*[c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def spread(n_rows: int, rows_per_task: int, spark: SparkSession) -> int:
    """Number of groups that keeps each near ``rows_per_task`` and every core busy."""
    floor = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-n_rows // rows_per_task))
