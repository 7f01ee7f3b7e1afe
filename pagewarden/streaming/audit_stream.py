"""The audit on streams of crawl files.

Two queries. The first parses new pages, audited and legal ones, and appends their facts (no html). The
second reads the facts: sites whose policy link starts a walk wait for the legal pages that the walk
needs, each level of the walk being a stream-stream outer join on the page's URL. A legal page counts if it was
loaded within ``reach`` of the site's period, whichever of the two arrives first; what is not there when the watermark
passes is unreachable. So no table is read again for a batch, and all state leaves with the watermark: rows, for
``delay`` and once ``reach`` for every level.

A stream's end holds back what may still change; ``write_heartbeat`` lets the rest out.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewarden import lexicon, schemas
from pagewarden.operators import extraction, rules, walk
from pagewarden.streaming import append_stream

KEYS = ("page_id", "url", "fetched_at")


def crawl_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New crawl files; a page without a load time has that of its file."""
    return spark.readStream.schema(schemas.CRAWL).option(
        "maxFilesPerTrigger", max_files).parquet(path).withColumn(
        "fetched_at", F.coalesce("fetched_at", "_metadata.file_modification_time"))


def _facts(pages: DataFrame) -> DataFrame:
    return extraction.page_facts(pages, extra=("is_target",))


def facts_schema(spark: SparkSession):
    return _facts(spark.createDataFrame([], schemas.CRAWL).withColumn("is_target", F.lit(True))).schema


def start_facts(pages: DataFrame, out: str, checkpoint: str, target: bool = True):
    """Appends the facts of new pages (``target``: to be audited) until the input is used up."""
    return append_stream(_facts(pages.withColumn("is_target", F.lit(target))), out, checkpoint)


def write_heartbeat(spark: SparkSession, facts: str, at) -> None:
    """A row of no page, whose time moves the watermark on; what stands before ``at`` is let out.

    Filters on facts reach the files before the watermark is taken, so the row has values that pass
    them; the test of ``is_target`` reads the time as well and therefore stays behind it.
    """
    values = {"fetched_at": F.lit(at).cast("timestamp"), "is_target": F.lit(False), "url": F.lit(""),
              "privacy_policy_url": F.lit("")}
    spark.range(1).select(*[
        values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in facts_schema(spark)
    ]).write.mode("append").parquet(facts)


def facts_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(facts_schema(spark)).option("maxFilesPerTrigger", max_files).parquet(path)


def _salted(rows: DataFrame, by, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)))


def _every_salt(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))


def _level(state: DataFrame, legal: DataFrame, reach: str, max_pages: int, salts: int) -> DataFrame:
    """One level of all walks: the queued URLs meet the loads of their pages."""
    queued = _salted(walk.queued(state, "at"), ("start", "at"), salts)
    near = F.expr(f"fetched_at BETWEEN at - INTERVAL {reach} AND at + INTERVAL {reach}")
    met = queued.join(legal, (F.col("url") == F.col("legal_url")) & (F.col("salt") == F.col("legal_salt")) & near, "left")
    return walk.folded(met, max_pages, "at", newest=("fetched_at", "page_id"))


def _legal(facts: DataFrame, salts: int) -> DataFrame:
    """Loads of pages, once for every salt; which of them a walk reads only the walk knows."""
    return _every_salt(facts, salts).select(
        F.col("url").alias("legal_url"), F.col("salt").alias("legal_salt"), F.col("readable").alias("ok"), "flags",
        "legal_links", "fetched_at", "page_id")


def audited(facts: DataFrame, rule_list: list = None, delay: str = "1 hour", period: str = "1 hour",
            reach: str = "1 hour", max_pages: int = lexicon.MAX_POLICY_PAGES, salts: int = 4) -> DataFrame:
    """Site records with their findings, as a stream from the stream of facts.

    A walk runs once for each policy URL and ``period``; hot URLs are spread over ``salts`` tasks.
    """
    timed = facts.withWatermark("fetched_at", delay)
    target = F.expr("CASE WHEN fetched_at IS NOT NULL THEN is_target END")
    linked = extraction.site_records(timed.where(target).drop("is_target")).where("privacy_policy_url IS NOT NULL")
    starts = linked.groupBy(F.window("fetched_at", period), F.col("privacy_policy_url").alias("start")).agg(
        F.count("*").alias("sites"))
    state = walk.begun(starts.select("start", F.window_time("window").alias("at")), "at")
    legal = _legal(timed, salts)
    for _ in range(max_pages):
        state = _level(state, legal, reach, max_pages, salts)
    results = _every_salt(walk.walk_results(state, "at"), salts).withColumnRenamed("salt", "result_salt")
    met = _salted(linked, ("page_id", "url", "fetched_at"), salts).join(
        results, (F.col("privacy_policy_url") == F.col("start")) & (F.col("salt") == F.col("result_salt"))
        & F.expr(f"fetched_at BETWEEN at - INTERVAL {period} AND at"), "left").where("at IS NOT NULL").drop(
        "start", "at", "salt", "result_salt")
    # Sites without a policy link wait for nothing.
    rest = extraction.site_records(facts.where("is_target").drop("is_target")).where("privacy_policy_url IS NULL")
    return rules.evaluate(walk.with_outcome(met.unionByName(rest, allowMissingColumns=True)), rule_list)


def start_audit(facts: DataFrame, out: str, checkpoint: str, rule_list: list = None,
                partitions: int = None, **limits):
    """Appends the findings, by all rules, of what the watermark of the facts has passed."""
    return append_stream(rules.finding_rows(audited(facts, rule_list, **limits), *KEYS), out, checkpoint, partitions)
