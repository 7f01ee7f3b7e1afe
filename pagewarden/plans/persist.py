"""From an audit to the store: tables in, tables out."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewarden import schemas
from pagewarden.operators import company, notify, reporting, rules, store
from pagewarden.operators.scale import materialize
from pagewarden.plans.audit import Audit


@dataclass
class Store:
    """The tables of the audit store."""

    websites: DataFrame
    runs: DataFrame
    findings: DataFrame
    companies: DataFrame


def empty_store(spark: SparkSession) -> Store:
    return Store(*[spark.createDataFrame([], s) for s in (
        schemas.WEBSITES, schemas.SCAN_RUNS, schemas.FINDINGS, schemas.COMPANIES)])


@dataclass
class Outcome:
    """The store after an audit, and the new reports and feed rows."""

    store: Store
    reports: DataFrame
    feed: DataFrame


def persist(audit: Audit, before: Store, resolutions: DataFrame = None) -> Outcome:
    """Stores an audit: one run for each page and load time, its findings and its end.

    Findings are written before any run is completed, so readers of completed
    runs see whole runs only. Pages loaded twice at one time share a run. ``resolutions`` are
    company results; those of sites the store does not know are left out.
    """
    done = materialize(audit.evaluated, "evaluated")
    lost = materialize(audit.failed.select("url", "fetched_at", "error_message"), "lost")
    seen = done.select("url", F.col("fetched_at").alias("seen_at")).unionByName(
        lost.select("url", F.col("fetched_at").alias("seen_at")))
    websites = materialize(store.get_or_create(before.websites, seen), "websites")
    sites = websites.select("website_id", "url")

    # A run is known by its site and second.
    second = F.date_trunc("second", "seen_at").alias("started_at")
    starts = seen.select("url", second).distinct().join(sites, "url").drop("url")
    started = materialize(store.start_runs(before.runs, starts), "started")
    run_of = started.join(sites, "website_id").select("url", "started_at", "scan_run_id")

    def with_run(rows: DataFrame) -> DataFrame:
        return rows.withColumn("started_at", F.date_trunc("second", "fetched_at")).join(
            run_of, ["url", "started_at"])

    found = materialize(with_run(rules.finding_rows(done, "page_id", "url", "fetched_at")), "found")
    new = materialize(store.new_findings(
        before.findings, found.withColumn("found_at", F.col("fetched_at"))), "new-findings")

    reports = materialize(reporting.reports(done), "reports")
    feed = materialize(notify.feed(found, ("page_id", "seq"), "fetched_at"), "feed")

    none = F.lit(None).cast("string")
    ended = with_run(reports.select("url", F.col("scanned_at").alias("fetched_at"), "report_id")).select(
        "scan_run_id", F.lit("Completed").alias("status"), F.col("fetched_at").alias("at"),
        F.col("report_id").alias("report_ref"), none.alias("error_message")
    ).unionByName(with_run(lost).select(
        "scan_run_id", F.lit("Failed").alias("status"), F.col("fetched_at").alias("at"),
        none.alias("report_ref"), "error_message"))
    columns = list(started.columns)
    runs = materialize(before.runs.select(*columns).unionByName(
        store.apply_outcomes(started, ended).select(*columns)), "runs")

    companies = before.companies
    if resolutions is not None:
        written = seen.groupBy("url").agg(F.max("seen_at").alias("written_at"))
        rows = company.store_rows(resolutions).join(sites.join(written, "url"), "url").drop("url")
        companies = materialize(store.upsert_companies(companies, rows), "companies")
    return Outcome(
        Store(websites, runs, before.findings.unionByName(new.select(*before.findings.columns)), companies),
        reports, feed)
