"""Helpers that keep results whole when one key holds much of the data."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A key is hot from 1 / (SPLIT * shuffle partitions) of the rows on, so there are at most
# SPLIT * shuffle partitions hot keys, whatever the data.
SPLIT = 2
ID_BUCKET_DIGITS = 3  # 16 ** 3 = 4096 numbering buckets
RANK_CHUNKS = 256
SIEVE_WORDS, SIEVE_CHUNK = 2 ** 22, 2 ** 10  # words of 64 bits: 32 MB at most in a plan
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the cluster names it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        path = context.getCheckpointDir()
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            path = tempfile.mkdtemp(prefix="pagewarden-")
            context.setCheckpointDir(path)
    return path


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; ``close`` removes it."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}"


def close(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, after its last sink is written.

    Data frames made by ``materialize`` before cannot be read afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write an intermediate table once and go on from the written files.

    The lineage ends here, later readers prune columns, and a lost executor
    costs a re-read instead of a recomputation. With ``free`` the shuffle files of the
    write, which nothing reads again, go when it ends and not at some later collection.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    if free:
        spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, floor: int = None) -> dict:
    """Keys with so many rows that they need several tasks, and how many each needs.

    Counted with map-side pre-aggregation. ``floor`` is the number of rows for one task;
    without it, the share of one of SPLIT * shuffle partitions equal parts of the table.
    """
    keyed = df.where(F.col(key).isNotNull()).select(key)
    if floor is None:
        floor = max(2, -(-keyed.count() // (SPLIT * _partitions(df.sparkSession))))
    rows = keyed.groupBy(key).count().where(F.col("count") > floor).collect()
    return {r[key]: -(-r["count"] // floor) for r in rows}


def sieve(keys: DataFrame, key: str):
    """A test for columns of the same type: true for the values of ``key``, false for nearly all others.

    A Bloom filter whose value sets a bit in each half of one word. There are two to four keys
    to a word, more from 4 * SIEVE_WORDS of them on: then more other values pass, which only costs
    time. The words are one array, a constant in the plan: as an expression and no join, the test moves
    below aggregates and to both sides of a join on its column.
    """
    spark = keys.sparkSession
    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    n = min(SIEVE_WORDS, max(SIEVE_CHUNK, 1 << (hashed.count() // 4).bit_length()))

    def bits(h):
        low, high = F.shiftright(h, 40).bitwiseAND(31), F.shiftright(h, 46).bitwiseAND(31) + 32
        one = F.lit(1).cast("bigint")
        return F.call_function("shiftleft", one, low.cast("int")).bitwiseOR(
            F.call_function("shiftleft", one, high.cast("int")))

    def in_order(by, value):
        return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda r: r[value]).alias("words")

    words = hashed.select(F.col("h").bitwiseAND(n - 1).alias("word"), bits(F.col("h")).alias("bits")).unionAll(
        spark.range(n).selectExpr("id AS word", "0L AS bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy(F.expr(f"word DIV {SIEVE_CHUNK}").alias("chunk")).agg(in_order("word", "bits"))
    whole = materialize(chunks.agg(F.flatten(in_order("chunk", "words")).alias("words")), "sieve", free=True)

    def passes(column) -> Column:
        h = F.xxhash64(column)
        word = F.get(whole.scalar(), h.bitwiseAND(n - 1).cast("int"))
        return F.bit_count(word.bitwiseAND(bits(h))) == 2
    return passes


def salted_join(left: DataFrame, right: DataFrame, key: str, hot,
                spread_by: str, how: str = "left", salts: int = None) -> DataFrame:
    """Equi join whose hot left keys are split over as many tasks as they need.

    ``hot`` comes from ``hot_keys``; a plain list of keys takes ``salts`` tasks for each. Only
    right rows of hot keys are repeated, in all at most twice SPLIT * shuffle partitions
    times; the right side is unique by key. Left rows without a key match nothing, so they
    are spread as well instead of meeting in the one task of the NULL key.
    """
    if how == "inner" and not hot:
        return left.join(right, key, how)
    spark = left.sparkSession
    salts = salts or _partitions(spark)
    parts = hot if isinstance(hot, dict) else dict.fromkeys(hot, salts)
    fan_out = F.lit(1)
    if parts:  # few rows, see hot_keys
        kind = dict(left.dtypes)[key]
        known = F.broadcast(spark.createDataFrame(
            list(parts.items()), f"_hot {kind}, _parts int"))
        left = left.join(known, F.col(key) == F.col("_hot"), "left").drop("_hot")
        right = right.join(known, F.col(key) == F.col("_hot"), "left").drop("_hot")
        fan_out = F.coalesce("_parts", F.lit(1))
    own = F.when(F.col(key).isNull(), salts).otherwise(fan_out)
    # The salt is worked out on both sides: a constant column would be folded away and
    # the salt would leave the join keys.
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), own).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(
        F.sequence(F.lit(0), fan_out - 1) if parts else F.array(F.lit(0))))
    return salted_left.drop("_parts").join(
        salted_right.drop("_parts"), [key, "_salt"], how).drop("_salt")


def moment(time: str, tie: str) -> Column:
    """A time and an integer tie-break as one fixed-width number that orders like the pair.

    So the newest of many rows is a hash aggregate on one narrow column, without a sort.
    """
    wide = "CAST({} AS decimal(38, 0))"
    return F.expr(f"CAST({wide.format(f'unix_micros({time})')} * {wide.format(2 ** 64)} "
                  f"+ {wide.format(f'coalesce({tie}, -9223372036854775808L)')} AS decimal(38, 0))")


def newest_rows(df: DataFrame, key: str, time: str, tie: str, rest) -> DataFrame:
    """Of every key the row that is last by (time, tie, ``rest``), whole.

    Only (key, moment) is aggregated; the rows of the newest moments are then looked up, and ties
    among those few are settled by the columns ``rest``. A null time is older than any other.
    """
    timed = df.withColumn("_moment", F.coalesce(moment(time, tie), F.expr(f"CAST({-(10 ** 37)} AS decimal(38, 0))")))
    last = timed.groupBy(key).agg(F.max("_moment").alias("_last")).withColumnRenamed(key, "_key")
    found = timed.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_moment") == F.col("_last")), "left_semi")
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in rest])
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_moment")


def dense_ids(df: DataFrame, key_columns, id_column: str, base=0) -> DataFrame:
    """Consecutive ids from ``base + 1`` in md5 order of a unique key.

    Rows are numbered inside hash buckets in parallel; the offsets of the
    buckets are 4096 counts, so no task sees more than its bucket. The rows are read for
    the counts and again for the numbers, so they are written first.
    """
    df = materialize(df, "unnumbered")
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_columns]))
    keyed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.substring("_digest", 1, ID_BUCKET_DIGITS)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("_bucket").count().select(
        "_bucket",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest")
    return keyed.withColumn("_n", F.row_number().over(inside)).join(
        F.broadcast(offsets), "_bucket"
    ).withColumn(
        id_column, (F.lit(base) + F.col("_offset") + F.col("_n")).cast("bigint")
    ).drop("_digest", "_bucket", "_offset", "_n")


def _chunk_of(value: str, cuts: list, first: int = 0) -> str:
    """Number of cuts at or below a value, as a balanced tree of comparisons."""
    if not cuts:
        return str(first)
    middle = len(cuts) // 2
    return (f"CASE WHEN {value} < {cuts[middle]} "
            f"THEN {_chunk_of(value, cuts[:middle], first)} "
            f"ELSE {_chunk_of(value, cuts[middle + 1:], first + middle + 1)} END")


def rank_newest_first(df: DataFrame, key: str, time: str, tie: str, out: str,
                      chunks: int = RANK_CHUNKS) -> DataFrame:
    """Position of every row within its key by descending (time, tie); ``tie`` is an integer.

    The time axis is cut at quantiles of the whole table, and a time that holds more than
    one quantile is cut again along ``tie``. So a (key, chunk) group holds about 1/chunks of
    the rows even if one key or one time holds them all; the counts of the later chunks
    of a key are added to the position in a chunk.
    """
    timed = df.withColumn("_micros", F.unix_micros(time))
    share = [i / chunks for i in range(1, chunks)]
    cuts = sorted(timed.select(
        F.percentile_approx("_micros", share, 10 * chunks).alias("cuts")).first()["cuts"] or [])
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})  # fewer than ``chunks``
    beyond = f"CASE WHEN _micros IS NULL THEN 0 ELSE {chunks} END"  # after all parts of a heavy time
    if heavy:
        parts = timed.where(F.col("_micros").isin(heavy)).groupBy("_micros").agg(
            F.percentile_approx(tie, share, 10 * chunks).alias("cuts")).collect()
        beyond = "CASE _micros " + " ".join(
            f"WHEN {r['_micros']} THEN {_chunk_of(f'`{tie}`', sorted(set(r['cuts'])))}"
            for r in parts) + f" ELSE {chunks} END"
    chunked = timed.withColumn("_chunk", F.expr(
        f"{_chunk_of('_micros', sorted(set(cuts)))} * {chunks + 1} + {beyond}")).drop("_micros")
    later = Window.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = chunked.groupBy(key, "_chunk").count().select(
        key, "_chunk", F.coalesce(F.sum("count").over(later), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(F.desc(time), F.desc(tie))
    return chunked.withColumn("_n", F.row_number().over(inside)).join(
        offsets, [key, "_chunk"]
    ).withColumn(out, (F.col("_offset") + F.col("_n")).cast("bigint")).drop(
        "_chunk", "_offset", "_n"
    )
