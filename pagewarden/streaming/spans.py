"""First and last sight of findings, from a stream of published scans.

A scan is one event: its run, website, start and rules. The stream adds up each period by itself:
first, last, count and newest scan of every (website, rule). A period that the watermark has
passed leaves the state as a few rows of a table, and spans are merged from these rows, so the
state holds open periods only, however long the history is.
"""

from pyspark.sql import DataFrame, functions as F

from pagewarden.streaming import append_stream

SCANS = "scan_run_id bigint, website_id bigint, started_at timestamp, rule_ids array<string>"


def published_scans(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """The completed runs, each with the rules of its findings (repeats included)."""
    done = runs.where("status = 'Completed'").select("scan_run_id", "website_id", "started_at")
    found = findings.groupBy("scan_run_id").agg(F.collect_list("rule_id").alias("rule_ids"))
    return done.join(found, "scan_run_id", "left").withColumn(
        "rule_ids", F.coalesce("rule_ids", F.array().cast("array<string>")))


def period_spans(scans: DataFrame, period: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sums of every (period, website, rule), as a stream in append mode or on a table.

    The rows without a rule are of the scans themselves: they say which scan of a website is its newest.
    """
    timed = scans.withWatermark("started_at", delay) if scans.isStreaming else scans
    rows = timed.select(
        "website_id", "started_at", "scan_run_id",
        F.explode(F.concat(F.array(F.lit(None).cast("string")), "rule_ids")).alias("rule_id"))
    return rows.groupBy(F.window("started_at", period), "website_id", "rule_id").agg(
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"),
        F.count("*").alias("times_seen"), F.max(F.struct("started_at", "scan_run_id")).alias("newest")
    ).select(F.col("window.start").alias("period"), "website_id", "rule_id", "first_seen", "last_seen", "times_seen",
             "newest")


def merged(periods: DataFrame) -> DataFrame:
    """One row for each (website, rule) from the rows of any periods."""
    return periods.groupBy("website_id", "rule_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("times_seen").alias("times_seen"), F.max("newest").alias("newest"))


def spans(periods: DataFrame) -> DataFrame:
    """Spans as of the closed periods; open while the rule is in the newest scan of its website."""
    sums = merged(periods)
    last = sums.where("rule_id IS NULL").select("website_id", F.col("newest").alias("last"))
    return sums.where("rule_id IS NOT NULL").join(last, "website_id").select(
        "website_id", "rule_id", "first_seen", "last_seen", "times_seen",
        (F.col("newest") == F.col("last")).alias("is_open"))


def start_spans(scans: DataFrame, out: str, checkpoint: str, period: str = "1 day", delay: str = "1 day",
                partitions: int = None):
    """Appends the sums of closed periods until the input is used up."""
    return append_stream(period_spans(scans, period, delay), out, checkpoint, partitions)
