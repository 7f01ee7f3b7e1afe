"""Store tables that are looked up by key."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from pagewarden.sources.sinks import SnapshotTable

BUCKET = "_bucket"
ROW_GROUP_BYTES = 8 << 20


class KeyedTable(SnapshotTable):
    """A snapshot table whose files are laid out for look-ups by a key.

    Rows lie in folders by hash bucket of ``key`` and are sorted by (``key``, ``order``) there, in small row
    groups. A look-up lists the folders of its buckets only, and of their files it reads the
    row groups and pages whose minimum and maximum enclose a wanted key. ``blooms`` are other columns
    that are looked up: every row group has a Bloom filter of them, so all footers are read, but few rows.

    Tasks write ranges of (bucket, key, order), so a hot key is split over as many tasks and files as its
    rows need, as long as ``order`` tells them apart. Rows with a null key are kept; no look-up finds them.
    ``add(rows, together)`` appends: parts of a level are laid out anew as one once there are enough of them.
    """

    max_keys = 1000  # more keys than this are joined instead of pushed down; the result is the same

    def __init__(self, path: str, schema, key: str, order=(), blooms=(), buckets: int = 64):
        super().__init__(path, schema)
        self.key, self.order, self.blooms, self.buckets = key, order, blooms, buckets

    def _bucket_of(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, level: int) -> tuple:
        laid = df.withColumn(BUCKET, self._bucket_of(F.col(self.key)))
        places = [BUCKET, self.key, *self.order]
        name = f"part-{self._fresh()}"
        writer = laid.repartitionByRange(*places).sortWithinPartitions(*places).write.partitionBy(BUCKET).option(
            "parquet.block.size", ROW_GROUP_BYTES)
        for column in self.blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.path}/{name}")
        return level, name

    def _read(self, spark: SparkSession, parts: list) -> DataFrame:
        return self._read_laid(spark, parts).drop(BUCKET)

    def _read_laid(self, spark: SparkSession, parts: list) -> DataFrame:
        plain = spark.createDataFrame([], self.schema)
        schema = StructType(plain.schema.fields).add(BUCKET, IntegerType())
        if not parts:
            return spark.createDataFrame([], schema)
        # Each part is partitioned by itself; there are few, see ``add``.
        return reduce(DataFrame.unionByName, [
            spark.read.schema(schema).parquet(f"{self.path}/{folder}") for _, folder in parts])

    def find(self, spark: SparkSession, values, column: str = None) -> DataFrame:
        """The rows whose ``column`` (the key, or one with Bloom filters) is one of a list of values."""
        column = column or self.key
        if column != self.key and column not in self.blooms:
            raise ValueError(f"{self.path} is not laid out for look-ups by {column!r}")
        laid = self._read_laid(spark, self._newest(spark)[1])
        kind = laid.schema[column].dataType
        wanted = [F.lit(v).cast(kind) for v in sorted({v for v in values if v is not None})]
        if not wanted:
            return laid.where("false").drop(BUCKET)
        found = laid.where(F.col(column).isin(wanted))
        if column == self.key:
            found = found.where(F.col(BUCKET).isin([self._bucket_of(v) for v in wanted]))
        return found.drop(BUCKET)

    def find_by(self, keys: DataFrame, column: str = None) -> DataFrame:
        """The rows whose ``column`` stands in the same column of ``keys``, however many these are."""
        column = column or self.key
        spark = keys.sparkSession
        distinct = keys.select(column).distinct()
        few = [r[0] for r in distinct.limit(self.max_keys + 1).collect()]
        if len(few) <= self.max_keys:
            return self.find(spark, few, column)
        return self.read(spark).join(distinct, column, "left_semi")


def together(rows: DataFrame) -> DataFrame:
    """What becomes of parts that come together in an append-only table: all their rows."""
    return rows
