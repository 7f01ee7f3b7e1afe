"""Queries over the audit store."""

from pyspark.sql import DataFrame, functions as F

from pagewarden import lexicon
from pagewarden.operators import notify
from pagewarden.operators.scale import hot_keys, materialize, rank_newest_first, salted_join
from pagewarden.sources.catalogue import rules_frame
from pagewarden.sources.keyed import KeyedTable


def sites_of_runs(websites: DataFrame, runs: DataFrame, companies: DataFrame = None,
                  floor: int = None) -> DataFrame:
    """Runs with their website (and company).

    Website and company are both unique by website id, so they are joined first
    and a website with very many runs meets only one, salted, join.
    """
    sites = websites if companies is None else websites.join(companies, "website_id", "left")
    return salted_join(runs, sites, "website_id", hot_keys(runs, "website_id", floor),
                       spread_by="scan_run_id", how="inner")


def unified_report(websites, runs, companies, findings, floor: int = None,
                   ordered: bool = True) -> DataFrame:
    """Every run with company and findings; runs without findings show defaults."""
    companies = companies.select(
        "website_id", F.coalesce("legal_name", "name").alias("company"), "nif", "address",
        F.expr(
            f"CASE WHEN registry_verified THEN '{lexicon.REGISTRY_CONFIRMED}' "
            f"WHEN NOT registry_verified THEN '{lexicon.REGISTRY_NOT_CONFIRMED}' END"
        ).alias("registry"))
    runs = runs.select("scan_run_id", "website_id", "started_at",
                       F.col("status").alias("scan_status"))
    found = findings.select("scan_run_id", "rule_id", "description", "recommendation",
                            F.col("status").alias("finding_status"))
    report = sites_of_runs(websites.select("website_id", "url"), runs, companies, floor).join(
        found, "scan_run_id", "left"
    ).select(
        "url", "company", "nif", "address", "registry", "started_at", "scan_status",
        F.coalesce("rule_id", F.lit(lexicon.NO_FINDING_RULE)).alias("rule_id"),
        F.coalesce("description", F.lit(lexicon.NO_FINDING_DESCRIPTION)).alias("description"),
        F.coalesce("recommendation",
                   F.lit(lexicon.NO_FINDING_RECOMMENDATION)).alias("recommendation"),
        F.coalesce("finding_status", F.lit(lexicon.NO_FINDING_STATUS)).alias("finding_status"),
        F.col("rule_id").alias("_stored_rule"),
    )
    if ordered:
        report = report.orderBy(F.desc("started_at"), "url", F.asc_nulls_first("_stored_rule"))
    return report.drop("_stored_rule")


def unified_listing(websites, runs, findings, floor: int = None) -> DataFrame:
    """Fixed-width listing: long URLs and descriptions are cut."""
    runs = runs.select("scan_run_id", "website_id", "started_at", "status")
    found = findings.select("scan_run_id", "rule_id", "description")
    joined = sites_of_runs(websites.select("website_id", "url"), runs, None, floor).join(
        found, "scan_run_id", "left")
    text = (f"coalesce(nullif(description, ''), "
            f"'{lexicon.NO_FINDING_DESCRIPTION}')")
    return joined.orderBy(F.desc("started_at"), "url", "rule_id").selectExpr(
        "CASE WHEN length(url) > 32 THEN concat(substr(url, 1, 32), '...') ELSE url END AS url",
        "coalesce(date_format(started_at, 'yyyy-MM-dd HH:mm:ss'), 'N/A') AS started_at",
        "coalesce(nullif(status, ''), 'N/A') AS status",
        f"coalesce(nullif(rule_id, ''), '{lexicon.NO_FINDING_RULE}') AS rule_id",
        f"CASE WHEN length({text}) > 35 THEN concat(substr({text}, 1, 32), '...') "
        f"ELSE {text} END AS description",
    )


def site_history(runs: DataFrame, website_id: int) -> DataFrame:
    """Runs of one website, newest first."""
    return runs.where(F.col("website_id") == website_id).orderBy(
        F.desc("started_at"), F.desc("scan_run_id"))


def all_histories(runs: DataFrame) -> DataFrame:
    """Runs of every website with their position, newest first."""
    return rank_newest_first(runs, "website_id", "started_at", "scan_run_id", "position")


def histories_of(runs: KeyedTable, sites: DataFrame) -> DataFrame:
    """Runs of the given websites (website_id) with their position, from a table keyed by website."""
    return all_histories(runs.find_by(sites, "website_id"))


def findings_of_scans(findings: KeyedTable, scans: DataFrame) -> DataFrame:
    """Findings of the given runs (scan_run_id), from a table keyed by run."""
    return findings.find_by(scans, "scan_run_id")


def open_sites_per_rule(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """How many sites have a rule open."""
    opened = findings.where(F.col("status") == lexicon.FINDING_STATUS_OPEN)
    return opened.select("scan_run_id", "rule_id").join(
        runs.select("scan_run_id", "website_id"), "scan_run_id"
    ).groupBy("rule_id").agg(F.countDistinct("website_id").alias("sites"))


def shared_trackers(uses: DataFrame) -> DataFrame:
    """Trackers on several domains; ``uses`` has (tracker, domain) pairs.

    Pairs are made distinct first, so a tracker used everywhere is counted from
    pre-aggregated pairs and never gathered as a list.
    """
    return uses.distinct().groupBy("tracker").agg(
        F.count("*").alias("domains")).where("domains >= 2")


def tracker_domains(uses: DataFrame) -> DataFrame:
    """The domains of trackers that are on several domains, as pairs."""
    pairs = uses.distinct()
    return pairs.join(shared_trackers(uses).select("tracker"), "tracker", "left_semi")


def sites_by_nif(companies: DataFrame, websites: DataFrame, nif: str = None) -> DataFrame:
    known = companies.where(F.col("nif").isNotNull() if nif is None else F.col("nif") == nif)
    return known.select("nif", "website_id").join(
        websites.select("website_id", "url"), "website_id").select("nif", "url")


def sites_of_nifs(companies: KeyedTable, websites: KeyedTable, nifs: DataFrame) -> DataFrame:
    """Websites of the given tax numbers (nif), from tables keyed by website; companies have filters for nif."""
    known = materialize(companies.find_by(nifs, "nif").select("nif", "website_id"), "known-companies")
    return known.join(websites.find_by(known, "website_id").select("website_id", "url"), "website_id").select(
        "nif", "url")


def notification_listing(feed: DataFrame) -> DataFrame:
    return feed.select(
        "notification_id", "client_id", "device_name", "category", "level", "description",
        "type", "created_at").orderBy("client_id", "notification_id")


def notification_totals(feed: DataFrame) -> DataFrame:
    return feed.agg(
        F.count("*").alias("notifications"),
        F.countDistinct("client_id").alias("clients"),
        F.countDistinct("device_name").alias("devices"))


def described_findings(findings: DataFrame, rules: list = None) -> DataFrame:
    """Stored findings with category and severity, which the store lacks."""
    catalogue = rules_frame(findings.sparkSession, rules).select(
        F.col("id").alias("rule_id"), "severity")
    return findings.join(F.broadcast(catalogue), "rule_id", "left").withColumn(
        "category", F.expr(notify.category("rule_id")))


def finding_spans(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """First and last time a rule was seen on a site, how often, and whether it
    is in the newest completed scan of the site."""
    completed = runs.where("status = 'Completed'").select(
        "scan_run_id", "website_id", "started_at")
    newest = completed.groupBy("website_id").agg(
        F.max(F.struct("started_at", "scan_run_id")).alias("last")
    ).select(F.col("last.scan_run_id").alias("scan_run_id"), F.lit(True).alias("is_last"))
    seen = findings.select("scan_run_id", "rule_id").join(
        completed.join(newest, "scan_run_id", "left"), "scan_run_id")
    return seen.groupBy("website_id", "rule_id").agg(
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"),
        F.count("*").alias("times_seen"),
        F.bool_or(F.coalesce("is_last", F.lit(False))).alias("is_open"))
